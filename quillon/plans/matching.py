"""Queries on candidate pairs, mutual matches and merges of banks and archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import answers, text as tx
from quillon.operators import linkage, papers as paper_ops, progress, quality, sequences, versions
from quillon.plans import learner, linking, papers, star
from quillon.plans.registry import query
from quillon.plans.star import table
from quillon.sources.shared import written


@query(f"""WITH {linking._EDGES}, s AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, slot_id) AS k FROM edge), t AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, source_id) AS k FROM edge),
  a AS (SELECT source_id, max(CASE WHEN k = 1 THEN slot_id END) AS slot_id, max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2, string_agg(slot_id, ',' ORDER BY k) AS pair FROM s WHERE k <= 2 GROUP BY source_id),
  b AS (SELECT slot_id, max(CASE WHEN k = 1 THEN source_id END) AS holder, max(CASE WHEN k = 1 THEN score END) AS t1, max(CASE WHEN k = 2 THEN score END) AS t2 FROM t WHERE k <= 2 GROUP BY slot_id),
  d AS (SELECT source_id, a.slot_id, s1 AS score, coalesce(round(s1 - s2, 6), 1.0) AS source_margin, coalesce(round(t1 - t2, 6), 1.0) AS target_margin, holder = source_id AS mutual, pair FROM a JOIN b USING (slot_id)),
  e AS (SELECT *, CASE WHEN mutual AND source_margin >= 0.08 AND target_margin >= 0.08 THEN 'accepted' ELSE 'review' END AS outcome FROM d)
  SELECT c_custkey AS source_id, slot_id, score, source_margin, target_margin, mutual, coalesce(outcome, 'unmatched') AS outcome, CASE WHEN outcome = 'review' THEN pair END AS candidates FROM customer LEFT JOIN e ON source_id = c_custkey""")
def match_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source with its decision; customers' keys as sources, so that many have no edge."""
    sources = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"))
    decided = linkage.decisions(sources, linking.edges(spark, sf_dir), "source_id", "slot_id", "score")
    return decided.withColumn("candidates", F.array_join(F.transform("candidates", lambda x: x.cast("string")), ","))


def _transcriptions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines of an order as transcriptions, and its slots; `said` is what their texts are made of."""
    q = star.questions(spark, sf_dir).select("question_id", "question_type", "marks", "answer_key", "subject", "topic", F.col("text").alias("stem"))
    rows = papers.rows(spark, sf_dir).drop("shipped").join(q, F.col("question") == F.col("question_id"))
    # sources and slots read the same columns, so that one shuffle by paper serves both and what they are joined and grouped by
    rows = rows.repartition(star.parts(spark, sf_dir), "paper")
    said = F.struct("stem", "topic", "question_type", "subject", "marks", "answer_key")
    source = F.col("source")
    sources = rows.select(
        "paper", F.concat_ws("-", "ordinal", "question", "source", "quantity", "flag").alias("id"), F.when(source % 7 == 3, "essay").otherwise(F.col("question_type")).alias("kind"), F.when(source % 7 == 4, 9).otherwise(F.col("marks")).alias("marks"),
        F.when(source % 7 == 5, F.lit("Z")).otherwise(F.lower("answer_key")).alias("answer"), F.col("subject").alias("course"), F.col("topic"), said.alias("said"), (source % 3 == 0).alias("polite"),
    )
    one = rows.groupBy("paper", "ordinal").agg(F.min(F.struct("question", "question_type", "marks", "answer_key", "subject", "topic", said.alias("said"), "source", "quantity", "flag")).alias("s"))
    slots = one.select("paper", "ordinal", F.col("s.question_type").alias("kind"), "s.marks", F.col("s.answer_key").alias("answer"), F.col("s.subject").alias("course"), "s.topic", "s.said", F.lit(0.8).alias("confidence"))
    return sources, slots


def _text(said: Column) -> Column:
    return F.concat_ws(" ", said["stem"], said["topic"], said["question_type"], F.lit("of course"), said["subject"], F.lit("with"), said["marks"].cast("string"), F.lit("marks and key"), said["answer_key"])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcriptions against the slots of their papers, judged by type, marks, answer, course and topic."""
    sources, slots = _transcriptions(spark, sf_dir)
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    agrees = answers.same_answer(b("kind"), a("answer"), b("answer"))
    similar = tx.token_similarity(F.concat_ws(" ", a("topic"), a("course")), F.concat_ws(" ", b("topic"), b("course")))
    rules = {"question_type_mismatch": a("kind") != b("kind"), "marks_mismatch": a("marks") != b("marks"), "official_answer_mismatch": ~agrees, "topic_evidence_weak": similar < 0.35, "course_mismatch": a("course") != b("course")}
    # pairs meet without their texts, and only those that are looked at get them
    text = F.when(F.col("a_polite"), F.concat(F.lit("please say "), _text(F.col("a_said")))).otherwise(_text(F.col("a_said")))
    return linkage.judged_pairs(sources, slots, ["paper"], rules).withColumns({"a_text": text, "b_text": _text(F.col("b_said"))})


@query(f"""WITH {star.CTE}, {papers._ROWS}, q AS (SELECT r.*, question_type, marks, answer_key, subject, topic FROM r JOIN question ON question_id = r.question),
  a AS (SELECT paper, CASE WHEN source % 7 = 3 THEN 'essay' ELSE question_type END AS kind, CASE WHEN source % 7 = 4 THEN 9 ELSE marks END AS marks, CASE WHEN source % 7 = 5 THEN 'Z' ELSE answer_key END AS answer, subject, topic FROM q),
  b AS (SELECT DISTINCT ON (paper, ordinal) paper, ordinal, question_type AS kind, marks, answer_key AS answer, subject, topic FROM q ORDER BY paper, ordinal, question),
  p AS (SELECT a.kind <> b.kind AS k1, a.marks <> b.marks AS k2, a.answer <> b.answer AS k3, a.subject <> b.subject AS other, a.topic <> b.topic AS elsewhere,
    len(list_intersect(regexp_extract_all(lower(a.topic || ' ' || a.subject), '[a-z0-9]+'), regexp_extract_all(lower(b.topic || ' ' || b.subject), '[a-z0-9]+'))) AS shared FROM a JOIN b USING (paper))
  SELECT CASE WHEN k1 THEN 'question_type_mismatch' WHEN k2 THEN 'marks_mismatch' WHEN k3 THEN 'official_answer_mismatch' WHEN greatest(0.9 * shared / 3, shared / (6 - shared)) < 0.35 THEN 'topic_evidence_weak' WHEN other THEN 'course_mismatch' ELSE 'candidate' END AS reason, count(*) AS pairs FROM p GROUP BY 1""")
def match_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs each rule turns down, the first that does."""
    return linkage.rejections(_pairs(spark, sf_dir))


@query()
def blocked_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcriptions matched to slots by type, marks, answer, course, topic and text; SQL has no sequence similarity, so it is tested against plain Python."""
    pairs = _pairs(spark, sf_dir)
    similar = tx.token_similarity(F.col("a_topic"), F.col("b_topic"))
    edges = linkage.text_edges(pairs, similar, {"original": F.col("b_text"), "recognised": F.reverse(F.col("b_text"))}, "original", F.col("b_text"))
    # edges are ranked by source and by slot: comparing once
    keyed = written(edges.select(F.concat_ws("/", "paper", "a_id").alias("source"), F.concat_ws("/", "paper", "b_ordinal").alias("slot"), "score"), "edges")
    sources = _transcriptions(spark, sf_dir)[0].select(F.concat_ws("/", "paper", "id").alias("source"))
    decided = linkage.decisions(sources, keyed, "source", "slot", "score")
    return decided.withColumn("candidates", F.array_join("candidates", ","))


@query("""WITH e AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN '{"a": {"answer" : 1, "k": [' || props || ']}}' ELSE '{"b": "k: no key"}' END AS body FROM events)
  SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'k' WHEN 1 THEN 'answer,k' ELSE '' END AS found FROM e""")
def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that may not be in a document, however deep they are."""
    k = F.col("event_id") % 3
    body = F.when(k == 0, F.col("props")).when(k == 1, F.concat(F.lit('{"a": {"answer" : 1, "k": ['), "props", F.lit("]}}"))).otherwise('{"b": "k: no key"}')
    return table(spark, sf_dir, "events").select("event_id", F.array_join(quality.forbidden_keys(body, ("answer", "k")), ",").alias("found"))


_OLD = "SELECT CASE WHEN p_partkey % 10 = 3 THEN 'x' ELSE 'q' END || p_partkey AS ext, CASE WHEN p_partkey % 4 <> 0 THEN 1995 + p_size END AS year, p_brand AS paper, p_partkey AS number, p_name AS name, p_size AS size, p_partkey % 9 <> 0 AS managed, p_partkey % 11 <> 0 AS is_active FROM part WHERE p_partkey % 8 <> 0"
_NEW = "SELECT 'q' || CASE WHEN p_partkey % 50 = 7 THEN p_partkey + 2 ELSE p_partkey END AS ext, CASE WHEN p_partkey % 4 <> 0 THEN 1995 + p_size END AS year, p_brand AS paper, p_partkey AS number, p_name AS name, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 7 <> 0"


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}), f AS (SELECT n.*, k.ext AS by_key, p.ext AS by_place FROM n LEFT JOIN o k ON k.ext = n.ext LEFT JOIN o p ON p.year = n.year AND p.paper = n.paper AND p.number = n.number),
  m AS (SELECT *, coalesce(by_key, by_place) AS old_ext, coalesce(by_key <> by_place, FALSE) AS two FROM f), c AS (SELECT *, two OR (old_ext IS NOT NULL AND count(*) OVER (PARTITION BY old_ext) > 1) AS conflict FROM m)
  SELECT o.ext AS old_key, c.ext AS new_key, CASE WHEN conflict THEN 'conflict' WHEN o.ext IS NULL THEN 'insert' WHEN c.ext IS NULL THEN CASE WHEN managed AND is_active THEN 'retire' ELSE 'keep' END WHEN NOT is_active THEN 'reactivate'
    WHEN o.name IS DISTINCT FROM c.name OR o.size IS DISTINCT FROM c.size THEN 'update' ELSE 'unchanged' END AS op FROM o FULL JOIN c ON c.old_ext = o.ext""")
def provenance_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank against its next version, rows matched by key, else by year, paper and number."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    common = [F.when(k % 4 != 0, 1995 + F.col("p_size")).alias("year"), F.col("p_brand").alias("paper"), k.alias("number"), F.col("p_name").alias("name")]
    old = part.where(k % 8 != 0).select(F.concat(F.when(k % 10 == 3, "x").otherwise("q"), k.cast("string")).alias("ext"), *common, F.col("p_size").alias("size"), (k % 9 != 0).alias("managed"), (k % 11 != 0).alias("is_active"))
    new = part.where(k % 7 != 0).select(F.concat(F.lit("q"), F.when(k % 50 == 7, k + 2).otherwise(k).cast("string")).alias("ext"), *common, (F.col("p_size") + F.when(k % 5 == 0, 1).otherwise(0)).alias("size"))
    return versions.bank_plan(old, new, "ext", ["year", "paper", "number"], ["name", "size"], F.col("managed"), "is_active").select("old_key", "new_key", "op")


@query(f"""WITH i AS (SELECT p_partkey AS item, p_name || p_partkey % 40 AS label, 's' || p_size AS sha, p_size <= 35 AS eligible FROM part), r AS (SELECT p_partkey + 100000 AS runtime_id, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey END AS link, p_name || p_partkey % 40 AS label,
    CASE WHEN p_partkey % 5 = 0 THEN 'old' ELSE 's' || p_size END AS sha, p_partkey % 7 <> 0 AS is_active FROM part WHERE p_partkey % 4 <> 0), l AS (SELECT label, CASE WHEN count(*) = 1 THEN min(runtime_id) END AS loose FROM r WHERE link IS NULL GROUP BY label),
  j AS (SELECT i.*, r.runtime_id AS linked, r.sha AS old_sha, is_active, loose FROM i LEFT JOIN r ON r.link = i.item LEFT JOIN l ON l.label = i.label),
  o AS (SELECT *, CASE WHEN eligible AND linked IS NULL AND loose IS NOT NULL THEN 'adopt' WHEN eligible AND linked IS NULL THEN 'insert' WHEN NOT eligible AND linked IS NOT NULL AND is_active THEN 'retire' WHEN NOT eligible THEN 'none' WHEN NOT is_active THEN 'reactivate' WHEN old_sha <> sha THEN 'update' ELSE 'unchanged' END AS op FROM j)
  SELECT item, CASE WHEN linked IS NOT NULL THEN linked WHEN op = 'adopt' THEN loose END AS runtime_id, op FROM o""")
def archive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the runtime bank needs for each archive item; nothing is written, so it is a dry run too."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    label = F.concat("p_name", (k % 40).cast("string")).alias("label")
    sha = F.concat(F.lit("s"), F.col("p_size").cast("string"))
    items = part.select(k.alias("item"), label, sha.alias("sha"), (F.col("p_size") <= 35).alias("eligible"))
    runtime = part.where(k % 4 != 0).select((k + 100000).alias("runtime_id"), F.when(k % 3 != 0, k).alias("link"), label, F.when(k % 5 == 0, "old").otherwise(sha).alias("sha"), (k % 7 != 0).alias("is_active"))
    return versions.materialised(items, runtime, "item", "link", F.col("eligible"), "sha", "label")


@query("""WITH r AS (SELECT p_partkey AS id, p_name || p_size % 9 || p_brand AS fp FROM part), l AS (SELECT id, CASE WHEN id % 30 = 1 THEN 'gone' ELSE fp END AS fp FROM r WHERE id % 3 = 1), k AS (SELECT id FROM r WHERE id % 3 = 0 OR id % 30 = 2), n AS (SELECT fp, count(*) AS n FROM r GROUP BY fp)
  SELECT l.id, CASE WHEN n IS NULL THEN 'fingerprint_unknown' ELSE 'fingerprint_repeated' END AS problem FROM l LEFT JOIN n USING (fp) WHERE n IS NULL OR n > 1 UNION ALL SELECT id, 'kept_unexpectedly' FROM r WHERE id % 3 <> 1 AND id NOT IN (SELECT id FROM k) UNION ALL SELECT id, 'keep_missing' FROM k WHERE id % 3 = 1""")
def cleanup_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A guarded cleanup that is refused: fingerprints that aren't unique, and a keep set that differs from what would stay."""
    k = F.col("id")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", (F.col("p_size") % 9).cast("string"), "p_brand").alias("fp"))
    ledger = rows.where(k % 3 == 1).withColumn("fp", F.when(k % 30 == 1, "gone").otherwise(F.col("fp")))
    return versions.cleanup_findings(rows, ledger, "id", "fp", rows.where((k % 3 == 0) | (k % 30 == 2)))


@query("""WITH a AS (SELECT 'v' || o_custkey AS version, 's' || max(o_orderkey) AS checksum, max(o_orderdate) AS t FROM orders GROUP BY o_custkey), u AS (SELECT 'v' || c_custkey AS version, CASE WHEN c_custkey % 3 = 0 THEN 's' || (SELECT max(o_orderkey) FROM orders WHERE o_custkey = c_custkey) ELSE 'other' END AS checksum FROM customer)
  SELECT u.version, u.checksum, CASE WHEN a.version IS NULL THEN 'apply' WHEN a.checksum <> u.checksum OR u.checksum IS NULL THEN 'refuse' WHEN t = (SELECT max(t) FROM a) THEN 'repeat_latest' ELSE 'repeat_older' END AS state FROM u LEFT JOIN a USING (version)""")
def audit_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"), F.max("o_orderdate").alias("at"))
    audit = last.select(F.concat(F.lit("v"), F.col("o_custkey").cast("string")).alias("version"), F.concat(F.lit("s"), F.col("k").cast("string")).alias("checksum"), "at")
    c = F.col("c_custkey")
    uploads = table(spark, sf_dir, "customer").join(last, c == F.col("o_custkey"), "left").select(F.concat(F.lit("v"), c.cast("string")).alias("version"), F.when(c % 3 == 0, F.concat(F.lit("s"), F.col("k").cast("string"))).otherwise("other").alias("checksum"))
    return versions.audit_state(audit, "version", "at", uploads)


@query(f"""WITH {star.CTE}, u AS (SELECT CASE WHEN user_id < 10 THEN user_id + 10 ELSE user_id END AS user_id, attempt_id, submitted_at FROM (SELECT DISTINCT user_id, attempt_id, submitted_at FROM graded)),
  c AS (SELECT user_id, count(*) AS attempts FROM u GROUP BY user_id), r AS (SELECT user_id, string_agg(attempt_id, ',' ORDER BY submitted_at DESC, attempt_id DESC) AS recent FROM (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, attempt_id DESC) <= 5) GROUP BY user_id),
  q AS (SELECT DISTINCT CASE WHEN user_id < 10 THEN user_id + 10 ELSE user_id END AS user_id, question_id, subject FROM graded), s AS (SELECT user_id, string_agg(subject || '=' || n, ',' ORDER BY subject) AS subjects FROM (SELECT user_id, subject, count(*) AS n FROM q GROUP BY ALL) GROUP BY user_id)
  SELECT user_id, attempts, recent, subjects FROM c JOIN r USING (user_id) LEFT JOIN s USING (user_id)""")
def merged_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dashboards of accounts, ten of which have claimed a guest."""
    owners = spark.range(10).select(F.col("id").alias("guest"), (F.col("id") + 10).alias("account"))
    merged = progress.merged_projection(learner.graded(spark, sf_dir), owners)
    subjects = F.array_join(F.transform("subjects", lambda x: F.concat(x["subject"], F.lit("="), x["n"].cast("string"))), ",")
    return merged.select("user_id", "attempts", F.array_join(F.transform("recent", lambda x: x.cast("string")), ",").alias("recent"), subjects.alias("subjects"))


@query(f"""WITH {papers._ROWS}, g AS (SELECT paper, ordinal, min(question) AS question, max(flag) AS flag, count(*) AS copies FROM r GROUP BY ALL), e AS (SELECT o_orderkey AS paper, unnest(range(1, 6)) AS ordinal FROM orders),
  o AS (SELECT paper, ordinal, 'over ' || question AS text FROM g WHERE copies > 1)
  SELECT e.paper, e.ordinal, coalesce(CASE WHEN flag = 'A' THEN 'canonical ' || question END, text, CASE WHEN question IS NOT NULL THEN 'secondary ' || question END) AS text,
    CASE WHEN flag = 'A' THEN 'canonical' WHEN text IS NOT NULL THEN 'overlay' WHEN question IS NOT NULL THEN 'secondary' END AS origin, CASE WHEN question IS NULL THEN 'gap' WHEN copies > 2 THEN 'review' ELSE 'released' END AS decision
  FROM e LEFT JOIN g USING (paper, ordinal) LEFT JOIN o USING (paper, ordinal)""")
def assembled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every expected slot with its text by precedence from three sources, and what is decided about it."""
    keys = ["paper", "ordinal"]
    found = papers.rows(spark, sf_dir).groupBy(*keys).agg(F.min("question").cast("string").alias("question"), F.max("flag").alias("flag"), F.count("*").alias("copies"))
    overlay = found.where("copies > 1").select(*keys, F.concat(F.lit("over "), "question").alias("over"))
    slots = paper_ops.regime_slots(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.lit(0).alias("year")), "paper", "year", [(0, 5)])
    joined = slots.join(found, keys, "left").join(overlay, keys, "left")
    text = quality.precedence({"canonical": F.when(F.col("flag") == "A", F.concat(F.lit("canonical "), "question")), "overlay": F.col("over"), "secondary": F.concat(F.lit("secondary "), "question")})
    decision = F.when(F.col("question").isNull(), "gap").when(F.col("copies") > 2, "review").otherwise("released")
    return joined.select(*keys, text.alias("t"), decision.alias("decision")).select(*keys, F.col("t.value").alias("text"), F.col("t.source").alias("origin"), "decision")


@query("""WITH RECURSIVE wanted AS (SELECT * FROM (VALUES (1, '1'), (2, '2'), (3, '3'), (4, '1'), (5, '2'), (6, '3')) AS t(k, label)),
  r AS (SELECT DISTINCT l_orderkey AS paper, CAST(1 + l_linenumber % 3 AS VARCHAR) AS label, CAST(l_quantity AS BIGINT) * 1000 + l_suppkey AS "at" FROM lineitem),
  c AS (SELECT p.paper, k, label, coalesce(own, []) AS own FROM (SELECT DISTINCT paper FROM r) p CROSS JOIN wanted LEFT JOIN (SELECT paper, label, list_sort(list("at")) AS own FROM r GROUP BY paper, label) USING (paper, label)),
  f AS (SELECT paper, 0 AS k, CAST(NULL AS BIGINT) AS e, CAST(-1 AS BIGINT) AS last FROM (SELECT DISTINCT paper FROM r)
    UNION ALL SELECT paper, c.k, list_min(list_filter(own, lambda p: p > last)), coalesce(list_min(list_filter(own, lambda p: p > last)), last) FROM f JOIN c USING (paper) WHERE c.k = f.k + 1),
  g AS (SELECT paper, c.k, c.label, CASE WHEN e IS NULL THEN [] ELSE list_filter(own, lambda p: p >= e) END AS own FROM c JOIN f USING (paper, k)),
  b AS (SELECT paper, 7 AS k, CAST(NULL AS BIGINT) AS l, CAST(1000000000 AS BIGINT) AS edge FROM (SELECT DISTINCT paper FROM r)
    UNION ALL SELECT paper, g.k, list_max(list_filter(own, lambda p: p < edge)), coalesce(list_max(list_filter(own, lambda p: p < edge)), edge) FROM b JOIN g USING (paper) WHERE g.k = b.k - 1),
  s AS (SELECT paper, k, label, list_filter(own, lambda p: p <= l) AS own FROM g JOIN b USING (paper, k))
  SELECT paper, CAST(k AS BIGINT) AS number, label, CASE WHEN len(own) = 1 THEN own[1] END AS "at", CASE len(own) WHEN 0 THEN 'missing' WHEN 1 THEN 'chosen' ELSE 'ambiguous' END AS status FROM s""")
def segment_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question numbers 1 to 3, then 1 to 3 of a second section, found among an order's lines."""
    rows = papers.rows(spark, sf_dir).select("paper", (1 + F.col("ordinal") % 3).cast("string").alias("label"), (F.col("quantity") * 1000 + F.col("source")).alias("at"))
    return sequences.segment_markers(rows, "paper", "label", "at", ["1", "2", "3", "1", "2", "3"])
