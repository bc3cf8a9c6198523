"""Queries of the full audits: banks, papers and notes as JSON records over the parts, damaged by rules of their key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import audits
from quillon.plans import star
from quillon.plans.registry import query
from quillon.plans.validation import _codes


def _answer_json() -> Column:
    k, kind, labels = F.col("question_id"), F.col("question_type"), F.split("answer_key", ",")
    one = F.when(k % 13 == 2, F.lit("E")).otherwise(labels[0])
    several = F.when(k % 13 == 2, F.array(F.lit("E"))).when(k % 19 == 4, F.array(F.lit("A"), F.lit("A"))).otherwise(labels)
    span = F.struct(F.col("price").alias("min"), (F.col("price") + F.when(k % 29 == 2, -1).otherwise(1)).alias("max"))
    return F.when(kind == "mcq", F.concat(F.lit('"'), one, F.lit('"'))).when(kind == "msq", F.to_json(several)).when(k % 2 == 0, F.to_json(span)).otherwise(F.col("price").cast("string"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(question_id, record) and what the record's fields are made of."""
    k, labels = F.col("question_id"), F.array(*(F.lit(x) for x in "ABCD"))
    letters = F.when(k % 17 == 3, F.slice(labels, 1, 3)).when(k % 17 == 5, F.reverse(labels)).otherwise(labels)
    options = F.when((F.col("question_type") == "nat") & (k % 47 != 8), F.slice(letters, 1, 0)).otherwise(letters)
    text = F.concat(F.when(k % 41 == 10, "Q. 7 ").otherwise(""), "text", F.when(k % 73 == 17, "").otherwise(F.concat(F.lit(" number "), k.cast("string"))), F.when(k % 67 == 15, " Page 3 of 9").otherwise(""), F.when(k % 71 == 16, " thefollowing").otherwise(""))
    number = 1 + F.pmod(F.expr("question_id DIV 75"), F.lit(65))
    safe = k % 2 == 0
    record = F.struct(
        F.when(k % 61 == 14, "q-same").otherwise(F.concat(F.when(k % 31 == 7, "Q:").otherwise("q"), F.lpad(k.cast("string"), 8, "0"))).alias("external_id"),
        text.alias("question"), F.transform(options, lambda x: F.struct(x.alias("id"), F.concat(F.lit("choice "), x).alias("text"))).alias("options"),
        F.col("subject").alias("course"), F.col("topic"), F.lower("topic").alias("topic_slug"), F.parse_json(_answer_json()).alias("correct_answer"), F.when(k % 23 == 6, "essay").otherwise(F.col("question_type")).alias("question_type"),
        F.element_at(F.array(F.lit("easy"), F.lit("medium"), F.lit("hard"), F.lit("odd")), (1 + F.pmod(k, F.lit(4))).cast("int")).alias("difficulty"), F.when(k % 37 == 9, 3).otherwise(F.col("marks")).alias("marks"),
        F.when(k % 53 != 12, F.concat("text", F.lit(" "), "topic")).alias("explanation"), F.lit(0.01).alias("numerical_tolerance"), F.when(safe, "original").otherwise("previous_year").alias("source_kind"),
        F.when(k % 43 != 11, 2017 + F.pmod(k, F.lit(10))).alias("source_year"), F.col("subject").alias("source_paper"), number.alias("source_question_number"), F.lit("paper").alias("source_url"), F.lit("key").alias("answer_key_url"),
        safe.alias("safe_for_quiz"), F.when(safe == (k % 11 != 5), "verified").otherwise("review").alias("status"), F.when(k % 7 == 2, F.array(F.lit("reviewed"))).when(k % 13 == 6, F.array().cast("array<string>")).otherwise(F.array(F.lit("checked"))).alias("review_flags"),
    )
    parts = star.questions(spark, sf_dir)
    return parts.select(F.concat(F.lit("bank-"), (k % 3).cast("string")).alias("bank"), "subject", "topic", number.alias("number"), "question_id", k.alias("position"), F.when(k % 59 == 13, '"lost"').otherwise(F.to_json(record)).alias("record"))


def _reviews(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    k = F.col("question_id")
    forced = records.where(k % 79 == 3).select(F.col("subject").alias("paper"), "number", F.lit("reviewed").alias("reason"))
    overrides = records.where(k % 83 == 4).select(F.col("subject").alias("paper"), "number", F.lit("Brand#1").alias("course"), F.lit("PROMO").alias("topic"), F.lit("promo").alias("topic_slug"))
    return forced, overrides


_COURSES = ("Brand#1", "Brand#11", "Brand#13", "Brand#21", "Brand#99")
_LEAST = {"questions": 20, "mcq": 7, "msq": 7, "nat": 7, "marks_1": 1, "marks_2": 1, "variants": 12}

_RECORD_SQL = f"""WITH {star.CTE}, b0 AS (SELECT question_id AS k, 'bank-' || question_id % 3 AS bank, subject, topic, question_type AS kind, marks AS m, text AS name, answer_key, 1 + (question_id // 75) % 65 AS number, question_id % 2 = 0 AS safe FROM question),
  forced AS (SELECT DISTINCT subject, number, TRUE AS is_forced FROM b0 WHERE k % 79 = 3), moved AS (SELECT DISTINCT subject, number, TRUE AS is_moved FROM b0 WHERE k % 83 = 4),
  b1 AS (SELECT *, CASE WHEN k % 17 = 3 THEN ['A', 'B', 'C'] WHEN k % 17 = 5 THEN ['D', 'C', 'B', 'A'] ELSE ['A', 'B', 'C', 'D'] END AS letters,
    CASE WHEN k % 41 = 10 THEN 'Q. 7 ' ELSE '' END || name || CASE WHEN k % 73 = 17 THEN '' ELSE ' number ' || k END || CASE WHEN k % 67 = 15 THEN ' Page 3 of 9' ELSE '' END || CASE WHEN k % 71 = 16 THEN ' thefollowing' ELSE '' END AS question,
    CASE WHEN k % 23 = 6 THEN 'essay' ELSE kind END AS qtype, CASE WHEN k % 61 = 14 THEN 'q-same' ELSE CASE WHEN k % 31 = 7 THEN 'Q:' ELSE 'q' END || lpad(CAST(k AS VARCHAR), 8, '0') END AS external_id,
    CASE WHEN k % 37 = 9 THEN 3 ELSE m END AS marks, k % 59 = 13 AS lost, k % 53 = 12 AS lacking FROM b0),
  b AS (SELECT *, CASE WHEN kind = 'nat' AND k % 47 <> 8 THEN [] ELSE letters END AS ids, string_split(answer_key, ',') AS keys, coalesce(is_forced, FALSE) AS is_forced2, coalesce(is_moved, FALSE) AND NOT (subject = 'Brand#1' AND topic = 'PROMO') AS misplaced
    FROM b1 LEFT JOIN forced USING (subject, number) LEFT JOIN moved USING (subject, number))"""
_CLOSED = "qtype IN ('mcq', 'msq')"
_ANSWERS = {
    "option_labels": f"{_CLOSED} AND ids <> ['A', 'B', 'C', 'D']", "mcq_answer": "qtype = 'mcq' AND (k % 13 = 2 OR NOT list_contains(ids, keys[1]))", "nat_options": "qtype = 'nat' AND len(ids) > 0", "nat_answer": "qtype = 'nat' AND k % 2 = 0 AND k % 29 = 2",
}
_FOREIGN = "len(list_filter(CASE WHEN k % 19 = 4 THEN ['A'] ELSE keys END, lambda a: NOT list_contains(ids, a))) > 0"
_GATE = "k % 41 = 10 OR k % 67 = 15 OR k % 71 = 16"
_PAST = "NOT safe"
_OPEN = f"NOT ({_CLOSED} AND len(ids) <> 4)"
_WHOLE = "NOT lost AND NOT lacking"
_BANK_RULES = {"not_an_object": "lost", "missing_fields": "NOT lost AND lacking"} | {name: f"{_WHOLE} AND ({rule})" for name, rule in ({
    "external_id": "k % 61 <> 14 AND k % 31 = 7", "question_type": "qtype = 'essay'", "difficulty": "k % 4 = 3", "marks": "marks = 3", "short_explanation": "length(name || ' ' || topic) < 20", "not_four_options": f"NOT ({_OPEN})",
} | {name: f"({_OPEN}) AND ({rule})" for name, rule in (_ANSWERS | {
    "msq_answer": f"qtype = 'msq' AND (k % 13 = 2 OR k % 19 = 4 OR {_FOREIGN})", "provenance": f"{_PAST} AND k % 43 = 11", "forced_review": f"{_PAST} AND is_forced2", "topic_override": f"{_PAST} AND misplaced",
    "boilerplate": f"{_PAST} AND k % 67 = 15", "quality_gate": f"{_PAST} AND ({_GATE})", "number_prefix": f"{_PAST} AND k % 41 = 10",
}).items()}).items()}
_NONE = "CAST(NULL AS BIGINT)"
_TOPIC = "course || '/' || topic"


@query(f"""{_RECORD_SQL}, w AS (SELECT * FROM b WHERE {_WHOLE}), banks AS (SELECT DISTINCT bank FROM b0), t AS (SELECT DISTINCT bank, subject AS course, topic FROM b0),
  n AS (SELECT bank, course, topic AS real, CASE WHEN bank = 'bank-2' AND topic = 'STANDARD' THEN 'OTHER' ELSE topic END AS topic, 2 * first + i AS position FROM (SELECT bank, subject AS course, topic, min(k) AS first FROM b0 GROUP BY ALL), (VALUES (0), (1)) v(i)
    WHERE NOT (bank = 'bank-0' AND topic = 'PROMO') AND (i = 0 OR bank = 'bank-1' AND topic = 'ECONOMY')),
  nt AS (SELECT bank, course, topic, n, t.bank IS NOT NULL AS wanted FROM (SELECT bank, course, topic, count(*) AS n FROM n GROUP BY ALL) FULL JOIN t USING (bank, course, topic)),
  c AS (SELECT bank, subject, count(*) AS questions, count(*) FILTER (WHERE qtype = 'mcq') AS mcq, count(*) FILTER (WHERE qtype = 'msq') AS msq, count(*) FILTER (WHERE qtype = 'nat') AS nat, count(*) FILTER (WHERE marks = 1) AS marks_1, count(*) FILTER (WHERE marks = 2) AS marks_2,
    count(DISTINCT topic || question || CASE WHEN qtype = 'msq' THEN array_to_string(list_sort(ids), '') ELSE '' END) FILTER (WHERE safe) AS variants FROM w GROUP BY ALL),
  g AS (SELECT banks.bank, course, c.* EXCLUDE (bank, subject) FROM banks CROSS JOIN unnest({list(_COURSES)}) x(course) LEFT JOIN c ON c.bank = banks.bank AND c.subject = x.course),
  y AS (SELECT bank, subject AS course, topic, count(DISTINCT qtype) FILTER (WHERE qtype <> 'essay') AS n, count(*) FILTER (WHERE qtype = 'essay') AS other FROM w WHERE subject IN {_COURSES} GROUP BY ALL)
  SELECT bank, 'bank' AS scope, bank AS key, CASE bank WHEN 'bank-1' THEN 'generated_at' ELSE 'schema_version' END AS code, {_NONE} AS found, {_NONE} AS required FROM banks WHERE bank <> 'bank-0'
  UNION ALL SELECT bank, 'note', CAST(position AS VARCHAR), unnest({_codes({'key_points': "topic = 'SMALL'", 'summary': "topic = 'MEDIUM'"})}), {_NONE}, {_NONE} FROM n
  UNION ALL SELECT bank, 'note_topic', {_TOPIC}, unnest({_codes({'missing': 'n IS NULL', 'unexpected': 'NOT wanted', 'repeated': 'n > 1'})}), coalesce(n, 0), {_NONE} FROM nt
  UNION ALL SELECT bank, 'question', CAST(k AS VARCHAR), unnest({_codes(_BANK_RULES)}), {_NONE}, {_NONE} FROM b
  UNION ALL SELECT bank, 'external_id', external_id, 'repeated', count(*), {_NONE} FROM w GROUP BY bank, external_id HAVING count(*) > 1
  UNION ALL SELECT bank, 'content', NULL, 'repeated', count(*), {_NONE} FROM w GROUP BY bank, question, ids HAVING count(*) > 1
  {' '.join(f"UNION ALL SELECT bank, 'course', course, '{code}', coalesce({code}, 0), {n} FROM g WHERE coalesce({code}, 0) < {n}" for code, n in _LEAST.items())}
  UNION ALL SELECT bank, 'topic', {_TOPIC}, 'types_incomplete', n, {_NONE} FROM y WHERE n < 3 OR other > 0""")
def bank_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three banks whole: headers, notes, questions, repeats, courses and topics.  Digests of repeated contents aren't shown."""
    records = _records(spark, sf_dir)
    forced, overrides = _reviews(records)
    header = records.groupBy("bank").agg(F.count("*").cast("string").alias("bank_version")).select(
        "bank", F.lit(True).alias("is_object"), F.when(F.col("bank") == "bank-2", "2.0").otherwise("1.0").alias("schema_version"), "bank_version", F.when(F.col("bank") != "bank-1", "today").alias("generated_at"), F.lit(True).alias("has_questions"), F.lit(True).alias("has_notes"),
    )
    topics = records.groupBy("bank", F.col("subject").alias("course"), "topic").agg(F.min("question_id").alias("first"))
    named = topics.where("NOT (bank = 'bank-0' AND topic = 'PROMO')").withColumn("i", F.explode(F.when(F.expr("bank = 'bank-1' AND topic = 'ECONOMY'"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    points = F.array(F.lit("a"), F.when(F.col("topic") == "SMALL", "a ").otherwise("b"), F.lit("c"))
    note = F.struct(
        F.concat(F.lit(" "), "course").alias("course"), F.when(F.expr("bank = 'bank-2' AND topic = 'STANDARD'"), "OTHER").otherwise(F.col("topic")).alias("topic"), F.col("topic").alias("title"), F.when(F.col("topic") == "MEDIUM", " ").otherwise("short").alias("summary"),
        F.lit("why").alias("reasoning_pattern"), points.alias("key_points"), F.array(F.lit("x"), F.lit("y"), F.lit("z")).alias("common_traps"),
    )
    notes = named.select("bank", (2 * F.col("first") + F.col("i")).alias("position"), F.to_json(note).alias("record"))
    policy = audits.BankPolicy(_COURSES, questions=_LEAST["questions"], per_type=_LEAST["mcq"], variants=_LEAST["variants"])
    found = audits.bank_audit(header, records, notes, topics, forced, overrides, policy)
    return found.withColumn("key", F.when(F.col("scope") != "content", F.col("key")))


_PAPERS = tuple(f"Brand#{n}" for n in (*range(1, 21), 77))
_ASKED = {
    "incomplete_text": "length(question) < 20", "boilerplate": "k % 67 = 15", "quality_gate": _GATE, "number_prefix": "k % 41 = 10", "unknown_topic": "topic = 'PROMO'", "question_type": "qtype = 'essay'", "not_four_options": f"NOT ({_OPEN})",
    "msq_answer": f"qtype = 'msq' AND (k % 13 = 2 OR {_FOREIGN})",
} | _ANSWERS
_PAPER_RULES = {"not_an_object": "lost"} | {name: f"NOT lost AND ({rule})" for name, rule in ({
    "unknown_paper": f"subject NOT IN {_PAPERS}", "year": "k % 43 = 11 OR k % 10 = 9", "topic_override": "misplaced", "forced_is_safe": "is_forced2 AND safe", "forced_reason_missing": "is_forced2 AND k % 7 <> 2",
    "safe_differs": "k % 11 = 5", "review_flags_missing": "NOT safe AND k % 7 <> 2 AND k % 13 = 6",
} | {name: f"safe AND ({rule})" for name, rule in _ASKED.items()}).items()}


@query(f"""{_RECORD_SQL}, o AS (SELECT * FROM b WHERE NOT lost), banks AS (SELECT bank, count(*) AS n FROM b0 GROUP BY bank), p AS (SELECT bank, paper FROM banks CROSS JOIN unnest({list(_PAPERS)}) x(paper)),
  pn AS (SELECT bank, paper, coalesce(n, 0) AS n, p.paper IS NOT NULL AND paper IN {_PAPERS} AS listed FROM p FULL JOIN (SELECT bank, subject AS paper, count(*) AS n FROM o GROUP BY ALL) USING (bank, paper))
  SELECT bank, 'question' AS scope, CAST(k AS VARCHAR) AS key, unnest({_codes(_PAPER_RULES)}) AS code, {_NONE} AS found, {_NONE} AS required FROM b
  UNION ALL SELECT bank, 'external_id', external_id, 'repeated', count(*), {_NONE} FROM o GROUP BY bank, external_id HAVING count(*) > 1
  UNION ALL SELECT bank, 'bank', bank, 'size', n, {len(_PAPERS) * 65} FROM banks WHERE n <> {len(_PAPERS) * 65}
  UNION ALL SELECT bank, 'paper', paper, 'size', n, 65 FROM pn WHERE listed AND n <> 65
  UNION ALL SELECT bank, 'paper', paper, CASE WHEN listed THEN 'absent' ELSE 'unexpected' END, n, {_NONE} FROM pn WHERE NOT listed OR n = 0
  UNION ALL SELECT bank, 'number', paper || '#' || number, 'missing', 0, {_NONE} FROM (SELECT bank, paper, unnest(range(1, 66)) AS number FROM p EXCEPT SELECT bank, subject, number FROM o)""")
def paper_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three editions of consolidated papers whole: rows, repeats, sizes and missing numbers."""
    records = _records(spark, sf_dir)
    forced, overrides = _reviews(records)
    syllabus = records.where("topic <> 'PROMO'").select(F.col("subject").alias("course"), "topic", F.lower("topic").alias("topic_slug"))
    return audits.paper_audit(records, syllabus, forced, overrides, audits.PaperPolicy(_PAPERS))
