"""Queries on links between records and on claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import answers
from quillon.operators import linkage, quality
from quillon.plans import star
from quillon.plans.registry import query
from quillon.plans.star import table

_EDGES = "edge AS (SELECT l_suppkey AS source_id, l_partkey AS slot_id, round(sum(l_quantity) / 100, 4) AS score FROM lineitem GROUP BY 1, 2)"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("slot_id")).agg(F.round(F.sum("l_quantity") / 100, 4).alias("score"))


@query(f"""WITH {_EDGES}, r AS (SELECT *, row_number() OVER s AS sr, row_number() OVER t AS tr, first_value(score) OVER s AS s1, nth_value(score, 2) OVER s AS s2, first_value(score) OVER t AS t1, nth_value(score, 2) OVER t AS t2
    FROM edge WINDOW s AS (PARTITION BY source_id ORDER BY score DESC, slot_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), t AS (PARTITION BY slot_id ORDER BY score DESC, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  m AS (SELECT source_id, slot_id, score, coalesce(round(s1 - s2, 6), 1.0) AS source_margin, coalesce(round(t1 - t2, 6), 1.0) AS target_margin, tr = 1 AS mutual FROM r WHERE sr = 1)
  SELECT *, CASE WHEN mutual AND source_margin >= 0.08 AND target_margin >= 0.08 THEN 'accepted' ELSE 'review' END AS outcome FROM m""")
def mutual_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.mutual_best(edges(spark, sf_dir), "source_id", "slot_id", "score")


_TOKENS = r"[a-z]+(?:''[a-z]+)?|\d+(?:\.\d+)?"


@query(rf"""WITH n AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS x, list_filter(regexp_extract_all(regexp_replace(lower(text), '(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]', ' ', 'g'), '{_TOKENS}'), lambda t: length(t) >= 3 OR regexp_full_match(t, '\d+')) AS a FROM documents WHERE text IS NOT NULL),
  s AS (SELECT * FROM n WHERE doc_id % 2 = 1), t AS (SELECT * FROM n WHERE doc_id % 2 = 0),
  h AS (SELECT s.doc_id, 1 AS no, 'content' AS tier, t.doc_id AS target FROM s JOIN t ON s.x = t.x AND s.x <> ''
    UNION ALL SELECT s.doc_id, 2, 'prefix', t.doc_id FROM s JOIN t ON left(s.x, 40) = left(t.x, 40) AND length(s.x) >= 40 AND starts_with(t.x, s.x)
    UNION ALL SELECT s.doc_id, 3, 'anchor', t.doc_id FROM s JOIN t ON s.a[1:6] = t.a[1:6] AND len(s.a) >= 6 AND len(t.a) >= 6 AND length(array_to_string(s.a, '')) >= 32
      AND CASE WHEN len(t.a) >= len(s.a) THEN t.a[1:len(s.a)] = s.a ELSE len(t.a) >= 0.75 * len(s.a) AND s.a[1:len(t.a)] = t.a END),
  g AS (SELECT doc_id, no, any_value(tier) AS tier, count(*) AS n, min(target) AS target FROM h GROUP BY doc_id, no), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY no) = 1),
  one AS (SELECT doc_id, tier, CASE WHEN n = 1 THEN target END AS target FROM f), claims AS (SELECT target, count(*) AS c FROM one WHERE target IS NOT NULL GROUP BY target)
  SELECT d.doc_id, tier, CAST(CASE WHEN c = 1 THEN o.target END AS VARCHAR) AS target, CASE WHEN tier IS NULL THEN 'unmatched' WHEN o.target IS NULL THEN 'ambiguous' WHEN c > 1 THEN 'collision' ELSE 'linked' END AS outcome
  FROM documents d LEFT JOIN one o USING (doc_id) LEFT JOIN claims ON claims.target = o.target WHERE d.doc_id % 2 = 1""")
def tiered_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd documents linked to even ones: by equal texts, whole prefixes, or anchor words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    targets = docs.where("doc_id % 2 = 0").select(F.col("doc_id").alias("target_id"), "text")
    linked = linkage.text_linked(docs.where("doc_id % 2 = 1"), targets, "doc_id", "target_id", "text")
    return linked.withColumn("target", F.col("target").cast("string"))


_CLAIMS = "claim0 AS (SELECT l_partkey AS slot, CASE WHEN l_discount < 0.04 THEN CAST(l_linenumber % 4 AS VARCHAR) END AS value, l_suppkey AS source, l_returnflag = 'A' AND l_discount < 0.02 AS official FROM lineitem), claim AS (SELECT * FROM claim0 WHERE value IS NOT NULL)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of all lines; some lines make none: their value is null."""
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("slot"), F.when(F.col("l_discount") < 0.04, F.pmod("l_linenumber", F.lit(4)).cast("string")).alias("value"), F.col("l_suppkey").alias("source"), ((F.col("l_returnflag") == "A") & (F.col("l_discount") < 0.02)).alias("official"))


@query(f"""WITH {_CLAIMS}, v AS (SELECT slot, value, count(DISTINCT source) AS sources, max(CAST(official AS INT)) AS official FROM claim GROUP BY slot, value),
  f AS (SELECT slot, count(*) AS n, sum(official) AS o, min(value) FILTER (WHERE official = 1) AS ov, min(value) AS one, max(sources) AS most FROM v GROUP BY slot),
  r AS (SELECT p_partkey AS slot, CASE WHEN n IS NULL THEN 'gap' WHEN o > 1 THEN 'official_conflict' WHEN o = 1 THEN 'official' WHEN n > 1 THEN 'conflict' WHEN most >= 2 THEN 'corroborated' ELSE 'unverified' END AS status, n, ov, one
    FROM part LEFT JOIN f ON f.slot = p_partkey)
  SELECT slot, status, CASE WHEN status = 'official' THEN ov WHEN status IN ('corroborated', 'unverified') THEN one END AS value, coalesce(status = 'official' AND n > 1, FALSE) AS secondary_disagrees FROM r""")
def claim_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slot"))
    return linkage.resolve_claims(slots, claims(spark, sf_dir), "slot")


@query(f"WITH {_CLAIMS} SELECT slot, count(DISTINCT value) AS n_values, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, CASE WHEN count(DISTINCT value) > 1 THEN array_to_string(list_sort(list(DISTINCT value)), ',') END AS conflict FROM claim0 GROUP BY slot")
def value_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.value_conflicts(claims(spark, sf_dir), "slot", "value")
    return found.withColumn("conflict", F.array_join("conflict", ","))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_discount BETWEEN 0.02 AND 0.04 OR l_discount BETWEEN 0.07 AND 0.09 AS agrees FROM lineitem""")
def interval_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    ranges = F.array(answers.interval(F.lit("0.02 to 0.04")), answers.interval(F.lit("0.07:0.09")))
    one = answers.interval(F.format_string("%.2f", "l_discount"))
    return line.select("l_orderkey", "l_linenumber", "l_partkey", answers.contains(ranges, one).alias("agrees"))


@query("""WITH ids AS (SELECT DISTINCT l_orderkey AS attempt_id, l_partkey AS question_id FROM lineitem)
  SELECT question_id, CASE WHEN p_size <= 20 THEN 'snapshot' WHEN question_id % 10 = 9 THEN 'alias' WHEN p_size <= 45 THEN 'canonical' ELSE 'unresolved' END AS route, count(*) AS uses
  FROM ids JOIN part ON p_partkey = question_id GROUP BY 1, 2""")
def hydration_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By which way each used question id resolves."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "question_id")
    used = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("question_id")).distinct().groupBy("question_id").agg(F.count("*").alias("uses"))
    stages = {"snapshot": part.where("p_size <= 20"), "alias": part.where("question_id % 10 = 9"), "canonical": part.where("p_size <= 45")}
    return linkage.routes(used, "question_id", stages).select("question_id", "route", "uses")


@query("""WITH e AS (SELECT o_orderkey, unnest(range(1, 8)) AS ordinal FROM orders), f AS (SELECT DISTINCT l_orderkey AS o_orderkey, CAST(l_linenumber AS BIGINT) AS ordinal FROM lineitem)
  SELECT o_orderkey, ordinal, 'missing' AS side FROM e ANTI JOIN f USING (o_orderkey, ordinal) UNION ALL SELECT o_orderkey, ordinal, 'unexpected' FROM f ANTI JOIN e USING (o_orderkey, ordinal)""")
def slot_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected line numbers 1 to 7 of every order against those that are there."""
    expected = quality.slot_grid(table(spark, sf_dir, "orders").withColumn("n", F.lit(7)), "o_orderkey", "n")
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").cast("long").alias("ordinal"))
    return quality.key_differences(expected, found, ["o_orderkey", "ordinal"])


@query(f"""WITH {star.CTE} SELECT subject, topic, list_aggr(list_filter([CASE WHEN count(*) FILTER (WHERE question_type = 'mcq' AND marks = 2) = 0 THEN 'mcq' END, CASE WHEN count(*) FILTER (WHERE question_type = 'msq' AND marks = 2) = 0 THEN 'msq' END,
  CASE WHEN count(*) FILTER (WHERE question_type = 'nat' AND marks = 2) = 0 THEN 'nat' END], lambda x: x IS NOT NULL), 'string_agg', ',') AS missing FROM question GROUP BY subject, topic HAVING missing IS NOT NULL""")
def incomplete_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics without a two-mark question of some type."""
    kind = F.when(F.col("marks") == 2, F.col("question_type"))
    found = quality.complete_sets(star.questions(spark, sf_dir).withColumn("kind", kind), ["subject", "topic"], "kind", ("mcq", "msq", "nat"))
    return found.select("subject", "topic", F.array_join("missing", ",").alias("missing"))


@query(f"""WITH {star.CTE} SELECT question_id, coalesce(CASE WHEN price > 1500 THEN text END, CASE WHEN marks = 2 THEN topic END, subject) AS value,
  CASE WHEN price > 1500 THEN 'canonical' WHEN marks = 2 THEN 'overlay' ELSE 'secondary' END AS source FROM question""")
def precedence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = {"canonical": F.when(F.col("price") > 1500, F.col("text")), "overlay": F.when(F.col("marks") == 2, F.col("topic")), "secondary": F.col("subject")}
    return star.questions(spark, sf_dir).select("question_id", quality.precedence(sources).alias("m")).select("question_id", "m.value", "m.source")
