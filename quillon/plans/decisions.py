"""Queries on evidence decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import parsing
from quillon.operators import evidence
from quillon.plans.registry import query
from quillon.plans.star import table

_POLICY = """policy AS (SELECT signature, CASE WHEN count(*) = 1 THEN min(label) END AS label, count(*) > 1 AS conflict FROM (SELECT DISTINCT p_brand AS signature, p_type AS label FROM part WHERE p_size > 45) GROUP BY signature)"""


@query(f"""WITH {_POLICY}, slot AS (SELECT p_partkey AS slot, p_brand AS signature, CASE WHEN p_partkey % 4 <> 0 THEN p_type END AS own, p_size < 10 AS verified, CASE WHEN p_partkey % 25 = 0 THEN 'REVIEWED' END AS over FROM part),
  s AS (SELECT slot, CASE WHEN over IS NOT NULL THEN 'override' WHEN verified AND own IS NOT NULL THEN 'verified' WHEN coalesce(conflict, FALSE) THEN 'withheld' WHEN label IS NOT NULL THEN 'policy'
    WHEN own IS NOT NULL THEN 'candidate' ELSE 'unclassified' END AS source, over, own, label AS pol FROM slot LEFT JOIN policy USING (signature))
  SELECT slot, CASE source WHEN 'override' THEN over WHEN 'verified' THEN own WHEN 'policy' THEN pol WHEN 'candidate' THEN own END AS label, source, source = 'candidate' AS review FROM s""")
def policy_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    groups = part.where("p_size > 45").groupBy(F.col("p_type").alias("label")).agg(F.collect_set("p_brand").alias("signatures"))
    slots = part.select(F.col("p_partkey").alias("slot"), F.col("p_brand").alias("signature"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("own_label"), (F.col("p_size") < 10).alias("verified"))
    overrides = part.where("p_partkey % 25 = 0").select(F.col("p_partkey").alias("slot"), F.lit("REVIEWED").alias("label"))
    return evidence.classified(slots, evidence.compiled_policy(groups), overrides, "slot")


@query("""WITH f AS (SELECT l_partkey AS paper, bool_or(l_linestatus = 'O' AND l_discount < 0.02) AS official, count(DISTINCT CASE WHEN l_discount < 0.02 THEN l_suppkey % 5 END) AS domains, bool_and(l_tax < 0.08) AS intact FROM lineitem GROUP BY 1)
  SELECT paper, CASE WHEN NOT intact THEN 'rejected' WHEN official OR domains >= 2 THEN 'verified' ELSE 'review' END AS decision, domains FROM f""")
def source_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    identical = F.col("l_discount") < 0.02
    rows = line.select(F.col("l_partkey").alias("paper"), F.pmod("l_suppkey", F.lit(5)).alias("domain"), (F.col("l_linestatus") == "O").alias("official"), identical.alias("identical"), (F.col("l_tax") < 0.08).alias("intact"))
    return evidence.source_verification(rows, "paper")


@query("""SELECT l_orderkey, min(l_returnflag) AS value, count(DISTINCT l_suppkey) AS sources FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) = 1 AND count(DISTINCT l_suppkey) >= 2 AND count(DISTINCT l_linestatus) <= 1""")
def community_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.corroborated(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_suppkey", agree=("l_linestatus",))


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS canonical, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderstatus) ELSE 'F' END AS a, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS b FROM orders),
  n AS (SELECT *, len(list_distinct(list_filter([upper(a), upper(b)], lambda v: v IS NOT NULL))) AS d, len(list_filter([a, b], lambda v: v IS NOT NULL)) AS k, (a IS NOT NULL AND upper(a) <> canonical) OR (b IS NOT NULL AND upper(b) <> canonical) AS other FROM c),
  s AS (SELECT *, CASE WHEN canonical IS NOT NULL AND other THEN 'conflict' WHEN canonical IS NOT NULL THEN 'canonical' WHEN d > 1 THEN 'conflict' WHEN k >= 2 THEN 'corroborated' WHEN k = 1 THEN 'single' ELSE 'missing' END AS status FROM n)
  SELECT o_orderkey, status, CASE WHEN status = 'canonical' THEN canonical WHEN status IN ('corroborated', 'single') THEN coalesce(a, b) END AS value FROM s""")
def answer_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, status = F.col("o_orderkey"), F.col("o_orderstatus")
    secondary = F.array(F.when(o % 2 == 0, F.lower(status)).otherwise("F"), F.when(o % 5 != 0, status))
    claim = evidence.selected_claim(F.when(o % 3 == 0, status), secondary, F.lit("mcq"))
    return table(spark, sf_dir, "orders").select("o_orderkey", claim.alias("c")).select("o_orderkey", "c.status", "c.value")


@query(r"""WITH t AS (SELECT p_partkey, p_partkey % 65 + 1 || ' ' || CASE p_partkey % 4 WHEN 0 THEN 'MCQ A' WHEN 1 THEN 'MSQ A;C' WHEN 2 THEN 'NAT ' || p_size || ' to ' || (p_size + 1) ELSE 'MCQ MTA' END || ' ' || (1 + p_size % 3) AS line FROM part),
  m AS (SELECT p_partkey, regexp_extract(line, '^\s*(\d{1,3})\s+(MCQ|MSQ|NAT)\s+(.+?)\s+([12])\s*$', ['n', 'k', 'a', 'm']) AS r FROM t)
  SELECT p_partkey, TRY_CAST(nullif(r.n, '') AS BIGINT) AS number, lower(nullif(r.k, '')) AS kind, nullif(r.a, '') AS answer, CAST(nullif(r.m, '') AS VARCHAR) AS marks,
    CASE WHEN r.a = 'MTA' THEN 'marks_to_all' WHEN r.a <> '' THEN 'value' END AS shape FROM m WHERE r.n <> ''""")
def key_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answer-key rows by their grammar; rows that don't fit are left out."""
    key, size = F.col("p_partkey"), F.col("p_size")
    answer = F.element_at(F.array(F.lit("MCQ A"), F.lit("MSQ A;C"), F.concat(F.lit("NAT "), size, F.lit(" to "), size + 1), F.lit("MCQ MTA")), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    line = F.concat_ws(" ", (F.pmod(key, F.lit(65)) + 1).cast("string"), answer, (1 + F.pmod(size, F.lit(3))).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", parsing.key_row(line).alias("r")).where("r.number IS NOT NULL")
    return rows.select("p_partkey", "r.number", "r.kind", "r.answer", F.col("r.marks").cast("string").alias("marks"), "r.shape")


_TAIL = """CASE l_partkey % 8 WHEN 0 THEN 'MCQ CS-1 B 1' WHEN 1 THEN 'MSQ GA A;C 2 0' WHEN 2 THEN 'N A T CS 3 to 31' WHEN 3 THEN 'NAT GA -1.5 to 2 OR 7 : 8.25 2' WHEN 4 THEN 'M C Q CS MTA 1' WHEN 5 THEN 'MCQ GA A OR D 2' WHEN 6 THEN 'MCQ CS A, B 1' ELSE 'NAT CS none 1' END"""


@query(f"""WITH r AS (SELECT l_orderkey AS paper, l_linenumber AS number, l_partkey % 8 AS k FROM lineitem)
  SELECT paper, CAST(number AS BIGINT) AS number, CASE WHEN k IN (1, 3, 5) THEN 'GA' ELSE 'CS' END AS section, CASE WHEN k = 1 THEN 'MSQ' WHEN k IN (2, 3, 7) THEN 'NAT' ELSE 'MCQ' END AS kind,
    ['B', 'A;C', '3 to 3', '-1.5 to 2 OR 7 : 8.25', 'MTA', 'A OR D', 'A, B', 'none 1'][k + 1] AS raw, [1, 2, 1, 2, 1, 2, 1, NULL][k + 1]::BIGINT AS marks,
    ['options', 'options', 'ranges', 'ranges', 'marks_to_all', 'any_of', 'options', NULL][k + 1] AS shape, ['B', 'AC', '', '', '', 'A|D', 'AB', ''][k + 1] AS choices,
    ['', '', '3..3', '-1.5..2|7..8.25', '', '', '', ''][k + 1] AS ranges, CASE k WHEN 6 THEN 'several' WHEN 7 THEN 'tail' END AS problem FROM r""")
def key_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of key tables that are pages of text: typed rows, glued ends, alternatives, and what doesn't fit."""
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), "l_linenumber", F.concat_ws(" ", F.col("l_linenumber").cast("string"), F.expr(_TAIL)).alias("line"))
    pages = line.groupBy("paper").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "line"))), lambda x: x["line"]), "  \n").alias("text"))
    rows = pages.select("paper", F.explode(parsing.key_table(F.col("text"), "typed")).alias("r")).select("paper", "r.*")
    choices = F.array_join(F.transform("choices", lambda c: F.array_join(c, "")), "|")
    ranges = F.array_join(F.transform("ranges", lambda b: F.concat_ws("..", b["least"], b["most"])), "|")
    return rows.withColumns({"choices": F.coalesce(choices, F.lit("")), "ranges": F.coalesce(ranges, F.lit(""))})
