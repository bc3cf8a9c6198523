"""Queries on the question bank: search, counts, forms, practice batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import catalog, progress, selection
from quillon.plans import learner, star
from quillon.plans.registry import query
from quillon.sources.shared import tasks


@query(f"WITH {star.CTE} SELECT question_id, subject, topic, question_type, year, text FROM question WHERE is_active AND question_type IN ('mcq', 'nat') AND (contains(lower(text), 'ring') OR contains(lower(topic), 'ring'))")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(star.questions(spark, sf_dir), {"question_type": ["mcq", "nat"], "year": None}, " RING ", ["text", "topic"])
    return found.select("question_id", "subject", "topic", "question_type", "year", "text")


@query(f"WITH {star.CTE}, found AS (SELECT * FROM question WHERE is_active AND topic = 'PROMO') SELECT question_id, year, (SELECT count(*) FROM found) AS total FROM found ORDER BY year DESC, question_id LIMIT 20 OFFSET 10")
def catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.search(star.questions(spark, sf_dir), {"topic": "PROMO"}).select("question_id", "year")
    return catalog.page(found, [F.desc("year"), "question_id"], offset=10, limit=20)


@query(f"WITH {star.CTE} SELECT question_id, subject, topic, question_type, marks, year, text, CASE WHEN question_type = 'nat' THEN CAST(0.01 AS DOUBLE) END AS tolerance FROM question")
def public_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.public_view(star.questions(spark, sf_dir))


@query(f"""WITH {star.CTE} SELECT n.n_name AS subject_group, r.r_name AS region, CAST(count(DISTINCT c.c_custkey) AS BIGINT) AS learners, CAST(count(o.o_orderkey) AS BIGINT) AS attempts
  FROM nation n JOIN region r ON n_regionkey = r_regionkey LEFT JOIN customer c ON c_nationkey = n_nationkey LEFT JOIN orders o ON o_custkey = c_custkey GROUP BY ALL""")
def hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension lookups up a hierarchy, zero-filled."""
    nation, region, customer, orders = (star.table(spark, sf_dir, t) for t in ("nation", "region", "customer", "orders"))
    made = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    per = customer.join(made, F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_nationkey").agg(F.count("*").alias("learners"), F.coalesce(F.sum("n"), F.lit(0)).alias("attempts"))
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).join(per, F.col("c_nationkey") == F.col("n_nationkey"), "left").na.fill(0, ["learners", "attempts"])
    return joined.select(F.col("n_name").alias("subject_group"), F.col("r_name").alias("region"), "learners", "attempts")


@query(f"""WITH {star.CTE} SELECT s.subject, coalesce(topics, 0) AS topics, coalesce(active, 0) AS active_questions FROM (SELECT DISTINCT p_brand AS subject FROM part) s
  LEFT JOIN (SELECT subject, count(DISTINCT topic) AS topics, count(*) FILTER (WHERE is_active) AS active FROM question GROUP BY subject) USING (subject)""")
def subject_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = star.questions(spark, sf_dir)
    return catalog.subject_counts(questions.select("subject").distinct(), questions)


@query("""SELECT o_orderkey, c_name, o_orderdate, count(*) OVER () AS total FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE upper(c_mktsegment) = upper('building') AND o_orderstatus = 'F' ORDER BY o_orderdate DESC, c_name, o_orderkey LIMIT 50""")
def archive_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer = star.table(spark, sf_dir, "orders"), star.table(spark, sf_dir, "customer")
    found = orders.where("o_orderstatus = 'F'").join(customer.where(catalog.same_text("c_mktsegment", "building")), F.col("o_custkey") == F.col("c_custkey"))
    return catalog.page(found.select("o_orderkey", "c_name", "o_orderdate"), [F.desc("o_orderdate"), "c_name", "o_orderkey"])


@query(f"WITH {star.CTE} SELECT subject, count(*) FILTER (WHERE question_type = 'mcq') AS mcq, count(*) FILTER (WHERE question_type = 'msq') AS msq, count(*) FILTER (WHERE question_type = 'nat') AS nat FROM question GROUP BY subject")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.type_histogram(star.questions(spark, sf_dir), "subject")


@query(f"""WITH {star.CTE} SELECT subject, question_type, CAST(marks AS VARCHAR) AS marks, topic, count(*) AS questions, count(DISTINCT year) AS years, grouping(subject, question_type, marks, topic) AS facet
  FROM question GROUP BY GROUPING SETS ((subject, question_type), (subject, marks), (subject, topic), (subject), ())""")
def bank_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.manifest(star.questions(spark, sf_dir)).withColumn("marks", F.col("marks").cast("string"))


@query("""SELECT pos, o_orderkey, o_totalprice FROM (SELECT CAST(i AS BIGINT) AS pos, CAST((i * 7919) % 20000 AS BIGINT) AS id FROM range(0, (SELECT count(*) FROM customer)) t(i)) JOIN orders ON o_orderkey = id""")
def ordered_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by a list of keys with their place in it; the list grows with the customers."""
    ids = star.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pos"), F.pmod(F.col("c_custkey") * 7919, F.lit(20000)).alias("id"))
    return catalog.in_order(star.table(spark, sf_dir, "orders"), ids, "o_orderkey").select("pos", "o_orderkey", "o_totalprice")


@query("SELECT o_custkey % 40 AS user_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest, max(o_orderdate) AS at FROM orders GROUP BY 1")
def version_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row per key by (time, id)."""
    attempts = star.attempts(spark, sf_dir)
    return attempts.groupBy("user_id").agg(F.max_by("attempt_id", F.struct("submitted_at", "attempt_id")).alias("latest"), F.max("submitted_at").alias("at"))


@query(f"WITH {star.CTE} SELECT question_id, substr(sha256('seed-7:' || question_id), 1, 16) AS hash_key FROM question WHERE is_active ORDER BY hash_key, question_id LIMIT 65")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.sample(star.questions(spark, sf_dir).where("is_active"), "seed-7", "question_id", 65)
    return found.select("question_id", selection.hash_order("seed-7", F.col("question_id")).alias("hash_key"))


#: Section by topic, and marks: 65 questions and 100 marks.
QUOTAS = {"general-1": 5, "general-2": 5, "maths-1": 5, "maths-2": 4, "core-1": 20, "core-2": 26}
_SECTION = "CASE topic WHEN 'PROMO' THEN 'general' WHEN 'STANDARD' THEN 'maths' ELSE 'core' END || '-' || marks"


@query(f"""WITH {star.CTE}, forms AS (SELECT 'full-' || k AS form FROM range(1, 26) t(k)), dealt AS (
  SELECT form, {_SECTION} AS stratum, question_id AS id, row_number() OVER (PARTITION BY form, {_SECTION} ORDER BY substr(sha256(form || ':' || question_id), 1, 16), question_id) AS place
  FROM question, forms WHERE is_active)
  SELECT d.form, stratum, place, id FROM dealt d JOIN (VALUES {", ".join(f"('{k}', {v})" for k, v in QUOTAS.items())}) q(s, n) ON s = stratum AND place <= n""")
def full_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty-five full forms by quotas."""
    section = F.concat_ws("-", F.when(F.col("topic") == "PROMO", "general").when(F.col("topic") == "STANDARD", "maths").otherwise("core"), F.col("marks").cast("string"))
    forms = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda k: F.concat(F.lit("full-"), k.cast("string")))
    return selection.quota_form(star.questions(spark, sf_dir).where("is_active"), forms, section, QUOTAS, "question_id").select("form", "stratum", "place", "id")


def _hash(what: str, identity: str) -> str:
    return f"substr(sha256({what} || ':' || {identity}), 1, 16)"


def _refused(n: int) -> str:
    return f"""refused AS (SELECT form, CASE WHEN count(*) < {n} THEN 'requires {n}; only ' || count(*) || ' are available' WHEN count(DISTINCT question_type) < 3 THEN
    'missing types: ' || array_to_string(list_filter(['mcq', 'msq', 'nat'], lambda k: NOT list_contains(list(DISTINCT question_type), k)), ', ') END AS reason FROM items GROUP BY form)"""


_ITEMS = "items AS (SELECT subject || '-' || k AS form, topic, question_type, question_id FROM question, range(1, 11) t(k) WHERE is_active)"


def _pick(number: int, kind: str) -> str:
    """One kind's item: of a topic that no earlier pick has, if there is one."""
    known = " UNION ALL ".join(f"SELECT form, topic, question_id FROM pick{k}" for k in range(number)) or "SELECT '' AS form, '' AS topic, -1 AS question_id"
    order = _hash(f"i.form || ':required:{kind}'", "i.question_id")
    return f"pick{number} AS (SELECT i.form, i.topic, i.question_id FROM good i LEFT JOIN (SELECT DISTINCT form, topic FROM ({known})) u USING (form, topic) WHERE question_type = '{kind}' QUALIFY row_number() OVER (PARTITION BY i.form ORDER BY u.form IS NOT NULL, {order}, i.question_id) = 1)"


@query(f"""WITH {star.CTE}, {_ITEMS}, {_refused(12)}, good AS (SELECT i.* FROM items i JOIN refused r USING (form) WHERE reason IS NULL), {_pick(0, 'mcq')}, {_pick(1, 'msq')}, {_pick(2, 'nat')},
  required AS (SELECT *, 0 AS k FROM pick0 UNION ALL SELECT *, 1 FROM pick1 UNION ALL SELECT *, 2 FROM pick2),
  marked AS (SELECT g.*, r.k, h.form IS NOT NULL AS has FROM good g LEFT JOIN required r USING (form, question_id) LEFT JOIN (SELECT DISTINCT form, topic FROM required) h ON h.form = g.form AND h.topic = g.topic),
  stepped AS (SELECT *, CASE WHEN k IS NOT NULL THEN 0 WHEN NOT has AND row_number() OVER (PARTITION BY form, topic, k IS NOT NULL ORDER BY {_hash("form || ':topic:' || topic", "question_id")}, question_id) = 1 THEN 1 ELSE 2 END AS step FROM marked),
  ranked AS (SELECT *, CASE step WHEN 0 THEN k WHEN 1 THEN 0 ELSE row_number() OVER (PARTITION BY form, topic, step ORDER BY {_hash("form || ':group:' || topic", "question_id")}, question_id) END AS turn FROM stepped),
  kept AS (SELECT * FROM ranked QUALIFY row_number() OVER (PARTITION BY form ORDER BY step, turn, CASE step WHEN 1 THEN {_hash("form || ':topics'", "topic")} WHEN 2 THEN {_hash("form || ':groups'", "topic")} ELSE '' END, question_id) <= 12)
  SELECT form, topic, question_type, question_id, row_number() OVER (PARTITION BY form ORDER BY {_hash("form || ':final-order'", "question_id")}, question_id) AS place FROM kept""")
def course_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten balanced forms of twelve questions per subject: every kind, every topic, then the topics in turn."""
    chosen = selection.balanced_form(_form_items(spark, sf_dir), "form", "topic", "question_type", "question_id", ("mcq", "msq", "nat"), 12)
    return chosen.select("form", "topic", "question_type", "question_id", "place")


def _form_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = star.questions(spark, sf_dir).where("is_active")
    questions = questions.repartition(tasks(questions, 50_000), "question_id")
    return questions.withColumn("form", F.explode(F.transform(F.sequence(F.lit(1), F.lit(10)), lambda k: F.concat_ws("-", "subject", k.cast("string"))))).select("form", "topic", "question_type", "question_id")


@query(f"WITH {star.CTE}, {_ITEMS}, {_refused(65)} SELECT form, reason FROM refused WHERE reason IS NOT NULL")
def form_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.refusals(_form_items(spark, sf_dir), "form", "question_type", ("mcq", "msq", "nat"), 65)


@query(f"""WITH {star.CTE}, batched AS (SELECT subject, question_id, CAST(floor((row_number() OVER w - 1) / 10) AS BIGINT) AS batch
    FROM question WHERE is_active WINDOW w AS (PARTITION BY subject ORDER BY substr(sha256('practice:' || question_id), 1, 16), question_id)),
  solved AS (SELECT DISTINCT user_id, question_id FROM graded WHERE status = 'correct' AND is_active), mine AS (SELECT DISTINCT user_id, subject FROM solved JOIN batched USING (question_id)),
  open AS (SELECT m.user_id, m.subject, min(batch) AS batch FROM mine m JOIN batched b USING (subject) LEFT JOIN solved s ON s.user_id = m.user_id AND s.question_id = b.question_id WHERE s.question_id IS NULL GROUP BY ALL)
  SELECT user_id, subject, coalesce(batch, 0) AS batch FROM mine LEFT JOIN open USING (user_id, subject)""")
def practice_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next practice batch of every learner in every subject that they have begun."""
    mine = progress.solved(learner.graded(spark, sf_dir), star.questions(spark, sf_dir))
    return selection.practice_batch(star.questions(spark, sf_dir).where("is_active"), mine, "practice", 10, ["subject"], "question_id")


_TIMES = "((({0}) & 65535) * ({1}) + ((((({0}) >> 16) * ({1})) & 65535) << 16)) & 4294967295"
_DRAW = "list_reduce([x, 15, 7, 14], lambda v, k: CASE k WHEN 15 THEN {a} WHEN 7 THEN xor(v, (v + ({b})) & 4294967295) ELSE xor(v, v >> 14) END)".format(
    a=_TIMES.format("xor(v, v >> 15)", "(v | 1)"), b=_TIMES.format("xor(v, v >> 7)", "(v | 61)")
)


@query(f"""WITH RECURSIVE day AS (SELECT DISTINCT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS day FROM orders), item AS (SELECT list(n_name ORDER BY n_name) AS items, count(*) AS n FROM nation),
  cycle AS (SELECT DISTINCT unnest([day // n, day // n - 1]) AS c FROM day, item),
  seed AS (SELECT c, items, n, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split('daily-focus:' || c, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, x: {_TIMES.format("xor(h, x)", "16777619")}) AS seed FROM cycle, item),
  drawn AS (SELECT *, unnest(range(1, n)) AS i FROM seed), swap AS (SELECT c, i, (seed + (n - i) * 1831565813) & 4294967295 AS x FROM drawn),
  place AS (SELECT c, i, CAST(({_DRAW} * (i + 1)) >> 32 AS BIGINT) AS j FROM swap),
  walk AS (SELECT c, n - 1 AS i, items AS own FROM seed
    UNION ALL SELECT w.c, w.i - 1, list_transform(own, lambda x, k: CASE k - 1 WHEN w.i THEN own[p.j + 1] WHEN p.j THEN own[w.i + 1] ELSE x END) FROM walk w JOIN place p ON p.c = w.c AND p.i = w.i),
  whole AS (SELECT c, own FROM walk WHERE i = 0),
  seam AS (SELECT a.c, CASE WHEN a.own[1] = b.own[-1] THEN list_concat([a.own[2], a.own[1]], a.own[3:]) ELSE a.own END AS own FROM whole a JOIN whole b ON b.c = a.c - 1)
  SELECT day, own[day % n + 1] AS item FROM day, item JOIN seam ON seam.c = day // n""")
def daily_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of 25 topics for every day that has orders."""
    days = star.table(spark, sf_dir, "orders").select(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    return selection.daily_items(star.table(spark, sf_dir, "nation").select(F.col("n_name").alias("item")), days, "day", "item")


@query(f"""WITH {star.CTE}, marked AS (SELECT *, row_number() OVER (PARTITION BY subject, topic, question_type ORDER BY question_id) > 1 AS later FROM question)
  SELECT subject, topic, question_type, question_id, row_number() OVER (PARTITION BY subject, topic ORDER BY later, CASE WHEN later THEN '' ELSE question_type END, question_id) AS place
  FROM marked QUALIFY place <= 3""")
def topic_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = selection.examples(star.questions(spark, sf_dir), ["subject", "topic"], "question_type", "question_id")
    return found.select("subject", "topic", "question_type", "question_id", "place")


@query("""SELECT event_id, CAST(floor((epoch_ms(ts) + 19800000) / 86400000.0) AS BIGINT) AS day, 86400000 - (epoch_us(ts) // 1000 + 19800000) % 86400000 AS ms_left FROM events""")
def local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.table(spark, sf_dir, "events").select("event_id", selection.day_number(F.col("ts")).alias("day"), selection.until_next_day(F.col("ts")).alias("ms_left"))


@query(f"WITH {star.CTE} SELECT question_id, CASE WHEN question_type = 'nat' THEN answer_key || ' ± 0.01' ELSE answer_key END AS shown FROM question")
def accepted_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.questions(spark, sf_dir).select("question_id", catalog.accepted_answer(F.col("question_type"), F.col("answer_key"), F.lit(0.01)).alias("shown"))
