"""Queries of the validators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import quality, validation
from quillon.plans import papers, star
from quillon.plans.registry import query
from quillon.plans.star import table


def _codes(rules: dict[str, str]) -> str:
    """The SQL of a sorted list of the codes whose rule holds."""
    return f"list_sort(list_filter([{', '.join(f'CASE WHEN {rule} THEN {chr(39)}{name}{chr(39)} END' for name, rule in rules.items())}], lambda v: v IS NOT NULL))"


def _joined(column: str):
    return F.array_join(column, ",").alias(column)


def bank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with options, answers and provenance, some of them damaged by a rule of their key."""
    k = F.col("question_id")
    labels = F.array(*(F.lit(x) for x in "ABCD"))
    letters = F.when(k % 17 == 3, F.slice(labels, 1, 3)).when(k % 17 == 5, F.reverse(labels)).otherwise(labels)
    options = F.transform(letters, lambda x: F.struct(x.alias("id"), F.concat_ws(" ", x, F.when(k % 19 == 4, F.lit("same")).otherwise(x)).alias("text")))
    kind = F.when(k % 23 == 6, F.lit("essay")).otherwise(F.col("question_type"))
    answer = F.when(F.col("question_type") == "nat", F.array().cast("array<string>")).when(k % 13 == 2, F.array(F.lit("E"))).otherwise(F.split("answer_key", ","))
    span = F.when(F.col("question_type") == "nat", F.struct(F.col("price").alias("lo"), (F.col("price") + F.when(k % 29 == 2, -1).otherwise(1)).alias("hi")))
    return star.questions(spark, sf_dir).select(
        "question_id", F.concat(F.when(k % 31 == 7, "Q:").otherwise("q"), F.lpad(k.cast("string"), 6, "0")).alias("external_id"), "subject", "topic", kind.alias("question_type"), "is_active",
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"), F.lit("odd")), (1 + F.pmod(k, F.lit(4))).cast("int")).alias("difficulty"),
        F.when(k % 2 == 0, "original").otherwise("previous_year").alias("source_kind"), F.when(k % 37 == 9, F.lit(3)).otherwise(F.col("marks")).alias("marks"),
        F.when(k % 41 == 10, F.concat(F.lit("Q. 7 "), "text")).otherwise(F.col("text")).alias("text"), F.concat_ws(" ", "text", "topic", "subject").alias("explanation"),
        F.when(kind == "nat", F.array().cast(options_type())).otherwise(options).alias("options"), answer.alias("answer"), span.alias("range"),
        F.when(k % 43 != 11, F.col("year")).alias("source_year"), F.col("subject").alias("source_paper"), k.alias("source_number"),
    )


def options_type() -> str:
    return "array<struct<id:string,text:string>>"


_LABELS = "CASE WHEN k % 17 = 3 THEN ['A', 'B', 'C'] WHEN k % 17 = 5 THEN ['D', 'C', 'B', 'A'] ELSE ['A', 'B', 'C', 'D'] END"
_BANK = f"""WITH {star.CTE}, b0 AS (SELECT *, question_id AS k, question_type AS real_kind FROM question),
  b AS (SELECT * REPLACE (CASE WHEN k % 23 = 6 THEN 'essay' ELSE question_type END AS question_type, CASE WHEN k % 37 = 9 THEN 3 ELSE marks END AS marks, CASE WHEN k % 41 = 10 THEN 'Q. 7 ' || text ELSE text END AS text),
    CASE WHEN k % 31 = 7 THEN 'Q:' ELSE 'q' END || lpad(CAST(k AS VARCHAR), 6, '0') AS external_id, ['easy', 'medium', 'hard', 'odd'][1 + k % 4] AS difficulty, CASE WHEN k % 2 = 0 THEN 'original' ELSE 'previous_year' END AS source_kind,
    text || ' ' || topic || ' ' || subject AS explanation, CASE WHEN k % 23 <> 6 AND real_kind = 'nat' THEN [] ELSE {_LABELS} END AS ids,
    CASE WHEN real_kind = 'nat' THEN [] WHEN k % 13 = 2 THEN ['E'] ELSE string_split(answer_key, ',') END AS answer, real_kind = 'nat' AND k % 29 <> 2 AS good_range, CASE WHEN k % 43 <> 11 THEN year END AS source_year FROM b0)"""
_CLOSED = "question_type IN ('mcq', 'msq')"
_FOREIGN = "len(list_filter(answer, lambda a: NOT list_contains(ids, a))) > 0"
_BANK_RULES = {
    "bad_external_id": "NOT regexp_full_match(external_id, '[a-z0-9][a-z0-9._-]+')", "bad_question_type": "question_type NOT IN ('mcq', 'msq', 'nat')", "bad_difficulty": "difficulty = 'odd'",
    "bad_source_kind": "FALSE", "bad_marks": "marks NOT IN (1, 2)", "empty_question": "trim(text) = ''", "short_explanation": "length(trim(explanation)) < 20", "not_four_options": f"{_CLOSED} AND len(ids) <> 4",
    "option_labels": f"{_CLOSED} AND len(ids) = 4 AND ids <> ['A', 'B', 'C', 'D']", "mcq_answer": f"question_type = 'mcq' AND (len(answer) <> 1 OR {_FOREIGN})", "msq_answer": f"question_type = 'msq' AND (len(answer) < 1 OR len(list_distinct(answer)) < len(answer) OR {_FOREIGN})",
    "nat_options": "question_type = 'nat' AND len(ids) > 0", "nat_answer": "question_type = 'nat' AND NOT good_range", "provenance_missing": "source_kind = 'previous_year' AND source_year IS NULL", "number_prefix": "starts_with(text, 'Q. 7')",
}


@query(f"{_BANK} SELECT question_id AS key, unnest({_codes(_BANK_RULES)}) AS code FROM b")
def bank_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.row_findings(bank_rows(spark, sf_dir), validation.question_rules(), "question_id")


_MINIMA = {"questions": ("TRUE", 80), "mcq": ("question_type = 'mcq'", 25), "msq": ("question_type = 'msq'", 25), "nat": ("question_type = 'nat'", 25), "one_mark": ("marks = 1", 40), "two_marks": ("marks = 2", 40)}


@query(f"""WITH {star.CTE}, c AS ({' UNION ALL '.join(f"SELECT subject, '{code}' AS code, count(*) FILTER (WHERE {rule}) AS found, {n} AS required FROM question GROUP BY subject" for code, (rule, n) in _MINIMA.items())}) SELECT subject, code, found, CAST(required AS BIGINT) AS required FROM c WHERE found < required""")
def bank_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects that lack questions in all, of a type, or of a mark."""
    return validation.minima(star.questions(spark, sf_dir), "subject", {code: (F.expr(rule), n) for code, (rule, n) in _MINIMA.items()})


_SHA = papers._SHA


@query(f"""WITH {papers._ROWS}, f AS (SELECT paper, count(*) AS n, count(DISTINCT ordinal) AS ordinals, count(DISTINCT question) AS labels, min(ordinal) AS low, max(ordinal) AS high, sha256(string_agg({_SHA}, chr(10) ORDER BY {_SHA})) AS sha FROM r GROUP BY paper),
  d AS (SELECT o_orderkey AS paper, CASE WHEN o_orderkey % 5 = 0 THEN 4 ELSE coalesce(n, 0) END AS declared, CASE WHEN o_orderkey % 6 = 0 THEN 'other' ELSE coalesce(sha, '') END AS checksum FROM orders LEFT JOIN f ON f.paper = o_orderkey)
  SELECT paper, array_to_string({_codes({'absent': 'n IS NULL', 'count_differs': 'n <> declared', 'duplicate_ordinal': 'ordinals < n', 'not_contiguous': 'NOT (low = 1 AND high = ordinals)', 'duplicate_label': 'labels < n', 'checksum_differs': 'sha <> checksum'})}, ',') AS codes FROM d LEFT JOIN f USING (paper)""")
def document_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers against what their document declares; some declarations are wrong by a rule of the key."""
    rows = papers.digested(spark, sf_dir, by_paper=True)
    # with the ordinals, which the findings read too: one shuffle of the same columns serves both
    listed = F.sort_array(F.collect_list(F.struct("sha", "ordinal")))
    right = rows.groupBy("paper").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(listed, lambda x: x["sha"]), "\n"), 256).alias("right"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper")).join(right, "paper", "left")
    declared = orders.select("paper", F.when(F.col("paper") % 5 == 0, F.lit(4)).otherwise(F.coalesce("n", F.lit(0))).alias("count"), F.when(F.col("paper") % 6 == 0, "other").otherwise(F.coalesce("right", F.lit(""))).alias("checksum"))
    return validation.paper_findings(rows, declared, "paper", "ordinal", "question", "sha").select("paper", _joined("codes"))


@query(f"""WITH {papers._ROWS}, g AS (SELECT paper, count(*) AS rows, list_distinct(list(ordinal)) AS ns, count(*) FILTER (WHERE (flag = 'A') <> (quantity > 25)) AS safe_differs FROM r GROUP BY paper)
  SELECT paper, rows, rows = 5 AS complete, array_to_string(list_filter(range(1, 6), lambda n: NOT list_contains(ns, n)), ',') AS missing, safe_differs FROM g""")
def consolidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.consolidation(papers.rows(spark, sf_dir), "paper", "ordinal", 5, F.col("flag") == "A", F.col("quantity") > 25)
    return found.withColumn("missing", F.array_join(F.transform("missing", lambda n: n.cast("string")), ","))


_ALIASES = "alias AS (SELECT p_partkey * 3 AS alias_id, CASE WHEN p_size = 7 THEN p_partkey * 3 WHEN p_size = 8 THEN -p_partkey WHEN p_size = 9 THEN p_partkey * 3 + 3 ELSE p_partkey END AS canonical_id FROM part), item AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 4 <> 0)"


@query(f"""WITH {_ALIASES} SELECT alias_id, canonical_id, array_to_string({_codes({'self': 'alias_id = canonical_id', 'shadows': 'alias_id IN (SELECT id FROM item)', 'unknown_target': 'canonical_id NOT IN (SELECT id FROM item)', 'chained': 'alias_id <> canonical_id AND canonical_id IN (SELECT a.alias_id FROM alias a)'})}, ',') AS codes FROM alias""")
def alias_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, k, size = table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    target = F.when(size == 7, k * 3).when(size == 8, -k).when(size == 9, k * 3 + 3).otherwise(k)
    aliases = part.select((k * 3).alias("alias_id"), target.alias("canonical_id"))
    return validation.alias_rules(aliases, part.where(k % 4 != 0).select(k.alias("id"))).withColumn("codes", F.array_join("codes", ","))


@query("""SELECT 'unknown_customer' AS rule, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')
  UNION ALL SELECT 'unknown_question', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)
  UNION ALL SELECT 'repeated_slot', count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 1)
  UNION ALL SELECT 'empty_paper', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def snapshot_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys, unique keys and empty parents of a snapshot, each rule with how often it is broken."""
    orders, line, customer, part = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "part"))
    known = lambda df, key, name: df.select(F.col(key).alias(name)).distinct()
    return validation.snapshot_counts({
        "unknown_customer": orders.join(known(customer.where("c_mktsegment <> 'BUILDING'"), "c_custkey", "o_custkey"), "o_custkey", "left_anti"),
        "unknown_question": line.join(known(part.where("p_size <= 45"), "p_partkey", "l_partkey"), "l_partkey", "left_anti"),
        "repeated_slot": quality.duplicate_keys(line, ["l_orderkey", "l_linenumber"]),
        "empty_paper": orders.join(known(line, "l_orderkey", "o_orderkey"), "o_orderkey", "left_anti"),
    })


@query(f"""WITH {star.CTE}, f AS (SELECT l_orderkey AS form, l_partkey AS item FROM lineitem), k AS (SELECT question_id AS item, question_type AS kind, marks, is_active FROM question WHERE question_id % 50 <> 0),
  g AS (SELECT form, count(*) AS count, count(DISTINCT f.item) AS d, count(*) FILTER (WHERE k.item IS NULL) AS unknown, count(*) FILTER (WHERE NOT is_active) AS inactive, count(DISTINCT kind) AS kinds, CAST(sum(marks) AS BIGINT) AS marks FROM f LEFT JOIN k USING (item) GROUP BY form)
  SELECT form, count, marks, array_to_string({_codes({'repeated_item': 'd < count', 'unknown_item': 'unknown > 0', 'inactive_item': 'inactive > 0', 'kinds_missing': 'kinds < 3', 'count_drift': 'count <> 4', 'marks_drift': 'coalesce(marks, 0) <> 6'})}, ',') AS codes FROM g""")
def form_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forms that should have four questions and six marks."""
    forms = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("form"), F.col("l_partkey").alias("item"))
    items = star.questions(spark, sf_dir).where("question_id % 50 <> 0").select(F.col("question_id").alias("item"), F.col("question_type").alias("kind"), "marks", "is_active")
    return validation.form_findings(forms, items, "form", "item", {"count": F.lit(4), "marks": F.lit(6)}).withColumn("codes", F.array_join("codes", ","))


_LINES = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')"
_DEPTH = {"few_words": r"len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) < 40", "few_lines": f"len({_LINES}) < 3", "repeated_lines": f"len(list_distinct({_LINES})) < 3", "blank_title": "trim(string_split(text, chr(10))[1]) = ''"}


@query(f"SELECT doc_id, array_to_string({_codes(_DEPTH)}, ',') AS codes FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def content_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.array_join(quality.codes(validation.depth_rules(F.col("text"), 40, 3, 3)), ",").alias("codes"))


@query("""WITH s AS (SELECT l_partkey AS item, avg(CASE WHEN l_returnflag <> 'R' THEN 1.0 ELSE 0.0 END) AS agreed, avg(CASE WHEN l_discount < 0.1 THEN 1.0 ELSE 0.0 END) AS covered, avg(CASE WHEN l_tax < 0.08 THEN 1.0 ELSE 0.0 END) AS intact, count(DISTINCT l_linestatus) = 1 AS one FROM lineitem GROUP BY l_partkey),
  c AS (SELECT item, list_sort(list_filter([CASE WHEN agreed < 0.90 THEN 'agreement_low' END, CASE WHEN covered < 0.95 THEN 'coverage_low' END, CASE WHEN intact < 0.98 THEN 'integrity_low' END, CASE WHEN NOT one THEN 'lineage_differs' END], lambda v: v IS NOT NULL)) AS codes FROM s)
  SELECT item, array_to_string(codes, ',') AS codes, len(codes) = 0 AS passed FROM c""")
def content_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.avg(F.when(F.expr(c), 1.0).otherwise(0.0))
    line = table(spark, sf_dir, "lineitem")
    scores = line.groupBy(F.col("l_partkey").alias("item")).agg(share("l_returnflag <> 'R'").alias("agreed"), share("l_discount < 0.1").alias("covered"), share("l_tax < 0.08").alias("intact"), (F.count_distinct("l_linestatus") == 1).alias("one"))
    gates = {"coverage_low": (F.col("covered"), 0.95), "integrity_low": (F.col("intact"), 0.98), "agreement_low": (F.col("agreed"), 0.90)}
    return validation.content_gates(scores, "item", gates, F.col("one")).withColumn("codes", F.array_join("codes", ","))


_CHOICES = """CASE p_partkey % 7 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' (A) one (B) two (C) three (D) four' WHEN 2 THEN p_name || chr(10) || 'A. one' || chr(10) || 'B) two' || chr(10) || 'c. three' || chr(10) || 'D. four'
  WHEN 3 THEN p_name || ' (A) one (B) two (D) four' WHEN 4 THEN p_name || ' (a) one ( b ) two (C)  (D) four' WHEN 5 THEN p_name || chr(10) || 'A. (A) x' || chr(10) || 'B. (B) y' || chr(10) || 'C. (C) z' || chr(10) || 'D. (D) w' ELSE NULL END"""


@query(f"""WITH t AS (SELECT p_partkey, p_partkey % 7 AS k, p_name FROM part)
  SELECT p_partkey, CASE k WHEN 1 THEN 'parenthesized' WHEN 2 THEN 'line_letter' END AS scheme, CASE WHEN k IN (1, 2) THEN p_name END AS stem, CASE WHEN k IN (1, 2) THEN 'one|two|three|four' END AS options,
    CASE k WHEN 0 THEN 'no_options' WHEN 3 THEN 'incomplete' WHEN 4 THEN 'empty_option' WHEN 5 THEN 'ambiguous' WHEN 6 THEN 'no_options' END AS reason FROM t""")
def parsed_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four choices parsed from texts in several shapes."""
    text = F.expr(_CHOICES.replace("chr(10)", "char(10)"))
    parsed = table(spark, sf_dir, "part").select("p_partkey", validation.parsed_options(text).alias("o"))
    return parsed.select("p_partkey", "o.scheme", "o.stem", F.array_join("o.options", "|").alias("options"), "o.reason")


@query(f"""{_BANK}, o AS (SELECT k, ids, list_transform(ids, lambda x: x || ' ' || CASE WHEN k % 19 = 4 THEN 'same' ELSE x END) AS texts FROM b)
  SELECT k AS question_id, array_to_string({_codes({'not_four': 'len(ids) <> 4', 'labels': "ids <> ['A', 'B', 'C', 'D']", 'empty': 'FALSE', 'active_html': 'FALSE', 'duplicates': 'len(list_distinct(texts)) < len(texts)'})}, ',') AS codes FROM o""")
def option_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = validation.option_rules(F.col("options"), tx.ACTIVE_HTML)
    return bank_rows(spark, sf_dir).select("question_id", F.array_join(quality.codes(rules), ",").alias("codes"))


@query(f"""WITH {papers._ROWS}, c AS (SELECT paper, question, flag, row_number() OVER (PARTITION BY paper ORDER BY ordinal, question, source, quantity, flag) AS number FROM r)
  SELECT o_orderkey AS paper, number, question, CASE WHEN question IS NULL THEN 'no_children' WHEN flag = 'A' THEN 'released' WHEN flag = 'R' THEN 'withheld' ELSE 'review' END AS decision FROM orders LEFT JOIN c ON c.paper = o_orderkey""")
def child_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents expanded to their children, each decided; parents without children stay."""
    rows = papers.rows(spark, sf_dir)
    listed = rows.groupBy("paper").agg(F.sort_array(F.collect_list(F.struct("ordinal", "question", "source", "quantity", "flag"))).alias("children"))
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper")).join(listed, "paper", "left")
    flag = F.col("child.flag")
    decided = validation.expanded(parents, "children", "paper", F.when(flag == "A", "released").when(flag == "R", "withheld").otherwise("review"))
    return decided.select("paper", "number", "child.question", "decision")


@query("""WITH k AS (SELECT l_orderkey, l_returnflag AS kind, l_suppkey % 3 AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem),
  f AS (SELECT l_orderkey, kind, place, min(n) AS n FROM k GROUP BY ALL) SELECT l_orderkey, string_agg(kind || place, ',' ORDER BY n) AS refs FROM f GROUP BY l_orderkey""")
def reference_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of a paper in order, the first of equal ones kept."""
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.concat("l_returnflag", (F.col("l_suppkey") % 3).cast("string")).alias("ref"))
    listed = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["ref"]).alias("refs"))
    return listed.select("l_orderkey", F.array_join(F.array_distinct("refs"), ",").alias("refs"))


@query(f"""WITH {star.CTE}, p AS (SELECT question_id, question_id % 2 = 1 AS previous, CASE WHEN question_id % 43 <> 11 THEN year END AS year, subject, question_id % 60 AS number FROM question),
  n AS (SELECT *, count(*) OVER (PARTITION BY year, subject, number) AS same FROM p WHERE previous)
  SELECT question_id, CASE WHEN year IS NULL THEN 'incomplete' WHEN same > 1 THEN 'repeated' ELSE 'unique' END AS provenance FROM n""")
def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Previous-year rows need a whole provenance that no other row of the document has."""
    k = F.col("question_id")
    rows = star.questions(spark, sf_dir).where(k % 2 == 1).select("question_id", F.when(k % 43 != 11, F.col("year")).alias("year"), "subject", (k % 60).alias("number"))
    repeats = quality.duplicate_keys(rows, ["year", "subject", "number"])
    state = F.when(F.col("year").isNull(), "incomplete").when(F.col("n").isNotNull(), "repeated").otherwise("unique")
    return rows.join(repeats, ["year", "subject", "number"], "left").select("question_id", state.alias("provenance"))


_PATH = "CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN '/srv/' || page_id WHEN 2 THEN 'C:\\x\\' || page_id WHEN 3 THEN 'a/../b' WHEN 4 THEN 'a//b' ELSE regexp_replace(url, '^[a-z]+://[^/]*/', '') END"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS p FROM pages) SELECT page_id, array_to_string({_codes({'absolute': "left(p, 1) IN ('/', '~')", 'drive': "regexp_matches(p, '^[A-Za-z]:')", 'upwards': "list_contains(string_split(p, '/'), '..')", 'backslash': "contains(p, chr(92))", 'doubled': "regexp_matches(p, '[^:]//')", 'blank': "trim(p) = ''"})}, ',') AS codes FROM p""")
def portable_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(_PATH.replace("\\", "\\\\"))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(quality.codes(validation.path_rules(path)), ",").alias("codes"))


@query("""WITH a AS (SELECT p_partkey AS id FROM part WHERE p_partkey % 9 <> 0), k AS (SELECT p_partkey AS id FROM part WHERE p_size <= 30), t AS (SELECT p_partkey AS id FROM part WHERE p_size >= 30 AND p_size < 48)
  SELECT coalesce(a.id, k.id, t.id) AS id, CASE WHEN a.id IS NULL THEN 'unknown' WHEN k.id IS NOT NULL AND t.id IS NOT NULL THEN 'in_both' ELSE 'in_neither' END AS problem
  FROM a FULL JOIN k ON k.id = a.id FULL JOIN t ON t.id = coalesce(a.id, k.id) WHERE a.id IS NULL OR (k.id IS NULL) = (t.id IS NULL)""")
def visibility_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A visibility plan must divide the bank into what stays and what goes."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    return validation.partition_findings(part.where("p_size <= 30"), part.where("p_size >= 30 AND p_size < 48"), part.where("id % 9 <> 0"), "id")


_KEYS = "year(o_orderdate) AS year, 'key_' || CASE WHEN o_orderkey % 8 = 0 THEN 'old' ELSE CAST(year(o_orderdate) + o_orderkey % 2 AS STRING) END || '.pdf' AS name, 'https://host' || year(o_orderdate) || '.org/' || (year(o_orderdate) + o_orderkey % 3 % 2) || '/key' AS url"


@query(f"""WITH k AS (SELECT o_orderkey, {_KEYS} FROM orders) SELECT o_orderkey, CASE WHEN o_orderkey % 8 = 0 THEN 'no_year_in_name' WHEN o_orderkey % 2 = 1 THEN 'name_differs' WHEN o_orderkey % 3 = 1 THEN 'url_differs' END AS problem FROM k""")
def key_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year of an answer key by its file name and its URL's path; a year in the host counts not."""
    keys = table(spark, sf_dir, "orders").selectExpr("o_orderkey", *(_KEYS.split(", '")[0], "'" + _KEYS.split(", '")[1], "'" + _KEYS.split(", '")[2]))
    return keys.select("o_orderkey", validation.key_year(F.col("year"), F.col("name"), F.col("url")).alias("problem"))


@query(f"""WITH {papers._ROWS}, d AS (SELECT paper, ordinal, min({_SHA}) AS digest FROM r GROUP BY ALL), a AS (SELECT paper, ordinal, {_SHA} AS digest FROM r WHERE flag <> 'R'), b AS (SELECT paper, ordinal + CASE WHEN paper % 50 = 0 THEN 10 ELSE 0 END AS ordinal, digest FROM d),
  ga AS (SELECT paper, ordinal, count(*) AS n, min(digest) AS has FROM a GROUP BY ALL), gb AS (SELECT paper, ordinal, count(*) AS n, min(digest) AS has FROM b GROUP BY ALL)
  SELECT 'ledger' AS artifact, count(*) FILTER (WHERE has IS NULL) AS missing, count(*) FILTER (WHERE digest IS NULL) AS unexpected, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE digest <> has) AS differing FROM d FULL JOIN ga USING (paper, ordinal)
  UNION ALL SELECT 'figures', count(*) FILTER (WHERE has IS NULL), count(*) FILTER (WHERE digest IS NULL), count(*) FILTER (WHERE n > 1), count(*) FILTER (WHERE digest <> has) FROM d FULL JOIN gb USING (paper, ordinal)""")
def artifact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers.digested(spark, sf_dir).withColumnRenamed("sha", "digest")
    required = rows.groupBy("paper", "ordinal").agg(F.min("digest").alias("digest"))
    moved = required.withColumn("ordinal", F.col("ordinal") + F.when(F.col("paper") % 50 == 0, 10).otherwise(0))
    return validation.artifact_coverage(required, {"ledger": rows.where("flag <> 'R'"), "figures": moved}, ["paper", "ordinal"])


_ASSET = "CASE page_id % 4 WHEN 0 THEN 'assets/' || page_id || '.png' WHEN 1 THEN 'other/' || page_id || '.svg' WHEN 2 THEN 'assets/../' || page_id || '.png' ELSE 'assets/' || page_id || '.exe' END"


@query(f"""WITH a AS (SELECT page_id, {_ASSET} AS p, CASE WHEN page_id % 5 = 0 THEN '' ELSE sha256(html) END AS claimed, sha256(html) AS sha FROM pages)
  SELECT page_id, array_to_string({_codes({'not_allowed': "NOT starts_with(p, 'assets/')", 'bad_suffix': "NOT regexp_matches(p, '[.](png|svg|webp|jpe?g)$')", 'digest_differs': 'claimed <> sha', 'upwards': "contains(p, '..')", 'backslash': 'FALSE'})}, ',') AS codes FROM a""")
def asset_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.sha2("html", 256)
    rules = validation.asset_rules(F.expr(_ASSET), F.when(F.col("page_id") % 5 == 0, "").otherwise(sha), sha, ("assets/",))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(quality.codes(rules), ",").alias("codes"))


@query("""WITH u AS (SELECT l_partkey AS item, 'fig-' || l_suppkey % 4 || '-' || l_partkey % 20 || '.png' AS source, sha256('content ' || l_partkey % 20) AS sha FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)),
  p AS (SELECT source, 'published/' || left(sha, 12) || '.png' AS target, count(DISTINCT item) AS items FROM u GROUP BY ALL), c AS (SELECT target, count(DISTINCT source) AS n FROM p GROUP BY target)
  SELECT source, target, items, CASE WHEN n > 1 THEN 'two_sources' END AS problem FROM p JOIN c USING (target)""")
def asset_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the figures of eligible items are published; equal content from two sources is a conflict."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "item")
    piece = (F.col("l_partkey") % 20).cast("string")
    assets = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("item"), F.concat(F.lit("fig-"), (F.col("l_suppkey") % 4).cast("string"), F.lit("-"), piece, F.lit(".png")).alias("source"), F.sha2(F.concat(F.lit("content "), piece), 256).alias("sha"))
    return validation.asset_plan(part, assets, "item", F.col("p_size") <= 10, "published")


_RISK_SQL = {
    "html_or_embedded_markup": r"regexp_matches(html, '(?i)<\s*/?\s*[a-z][^>]*>') OR contains(lower(html), 'javascript:')",
    "formula_or_latex_requires_visual_review": r"contains(html, '$') OR contains(html, chr(92) || '(') OR contains(html, chr(92) || '[') OR regexp_matches(html, '\\(frac|sqrt|sum|int|le|ge|times|cdot|alpha|beta|theta|lambda)\b') OR regexp_matches(html, '[\x{2200}-\x{22FF}]')",
    "code_layout_requires_visual_review": r"contains(lower(html), '#include') OR regexp_matches(html, '(?i)\b(int|void|char|float|double)\s+\w+\s*\(|\b(printf|for|while)\s*\(')",
    "prompt_depends_on_visual_asset": r"regexp_matches(html, '(?i)\b(figure|diagram|graph|image|circuit)\s+(shown|given|above|below)\b|\b(shown|given)\s+(above|below)\b')",
    "broken_or_private_glyph": r"regexp_matches(html, '[\x{FFFD}\x{E000}-\x{F8FF}]')", "remote_visual_asset_not_copied": "contains(lower(html), '[image:')",
}


@query(f"SELECT page_id, array_to_string({_codes(_RISK_SQL)}, ',') AS risks FROM pages")
def text_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(validation.text_risks(F.col("html")), ",").alias("risks"))


@query("SELECT * FROM (SELECT doc_id, lang, source, 'a' AS part, CAST(NULL AS BIGINT) AS n_chars FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, lang, NULL, 'b', n_chars FROM documents WHERE doc_id % 2 = 1)")
def evolved_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a table as one: columns that only one has are null in the other's rows."""
    docs = table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 2 = 0").select("doc_id", "lang", "source", F.lit("a").alias("part"))
    new = docs.where("doc_id % 2 = 1").select("doc_id", "lang", F.lit("b").alias("part"), "n_chars")
    return old.unionByName(new, allowMissingColumns=True)
