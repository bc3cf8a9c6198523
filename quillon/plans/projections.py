"""Queries of projections, merges and small reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import catalog, linkage, projections, quality, selection
from quillon.plans import learner, papers, star
from quillon.plans.registry import query
from quillon.plans.star import table


@query("""WITH t AS (SELECT p_partkey, [p_name, ' ' || p_brand || ' ', CASE WHEN p_partkey % 3 = 0 THEN '  ' ELSE p_type END, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END] AS xs FROM part),
  k AS (SELECT p_partkey, list_filter(list_transform(xs, lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '') AS xs FROM t)
  SELECT p_partkey, array_to_string(list_transform(xs, lambda x, i: chr(CAST(64 + i AS INT)) || '=' || x), '|') AS options FROM k""")
def option_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    texts = F.array("p_name", F.concat(F.lit(" "), "p_brand", F.lit(" ")), F.when(k % 3 == 0, "  ").otherwise(F.col("p_type")), F.when(k % 5 != 0, F.col("p_size").cast("string")))
    rows = table(spark, sf_dir, "part").select("p_partkey", projections.lettered(texts).alias("o"))
    return rows.select("p_partkey", F.array_join(F.transform("o", lambda o: F.concat(o["id"], F.lit("="), o["text"])), "|").alias("options"))


@query("""WITH o AS (SELECT p_partkey, p_partkey % 4 AS k, p_name, p_brand FROM part)
  SELECT p_partkey, CASE k WHEN 0 THEN 'A=' || p_name || '|B=' || p_brand WHEN 1 THEN 'X=' || p_name || '|B=' || p_brand WHEN 2 THEN 'B=' || p_name || '|B=' || p_brand ELSE 'A=' || p_name || '|K=' || p_brand END AS options, k = 2 AS repeated FROM o""")
def option_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Options under several names of their fields; ids that lack get the letter of their place."""
    k = F.col("p_partkey") % 4
    one = F.when(k == 1, F.create_map(F.lit("label"), F.lit("x"), F.lit("value"), F.col("p_name"))).when(k == 2, F.create_map(F.lit("id"), F.lit(" b "), F.lit("text"), F.col("p_name"))).otherwise(F.create_map(F.lit("text"), F.col("p_name")))
    two = F.when(k == 3, F.create_map(F.lit("id"), F.lit(" "), F.lit("key"), F.lit("k"), F.lit("value"), F.col("p_brand"))).otherwise(F.create_map(F.lit("value"), F.col("p_brand")))
    rows = table(spark, sf_dir, "part").select("p_partkey", projections.named_options(F.array(one, two)).alias("o"))
    return rows.select("p_partkey", F.array_join(F.transform("o", lambda o: F.concat(o["id"], F.lit("="), o["text"])), "|").alias("options"), projections.repeated_ids(F.col("o")).alias("repeated"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'given-' || p_partkey WHEN p_partkey % 2 = 0 AND p_size > 5 THEN 'pyq:' || (1990 + p_size) || ':' || trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || ':q' || p_partkey % 65
  ELSE 'local:' || left(sha256('{"course":"' || p_brand || '","question":"' || p_name || '","topic":"' || p_type || '"}'), 32) END AS external_id FROM part""")
def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, year = F.col("p_partkey"), F.when(F.col("p_size") > 5, 1990 + F.col("p_size"))
    given = F.when(k % 5 == 0, F.concat(F.lit(" given-"), k.cast("string"), F.lit(" ")))
    own = projections.external_id(given, k % 2 == 0, year, F.col("p_brand"), k % 65, {"course": F.col("p_brand"), "topic": F.col("p_type"), "question": F.col("p_name")})
    return table(spark, sf_dir, "part").select("p_partkey", own.alias("external_id"))


@query("""SELECT l_orderkey AS paper, l_linenumber AS ordinal, l_partkey AS question, o_orderpriority AS session, l_returnflag = 'A' AND l_suppkey % 3 <> 0 AS is_ready, CASE WHEN l_returnflag = 'A' AND l_suppkey % 3 <> 0 THEN l_partkey END AS runtime_id
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def archive_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    item = F.struct(F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("question"))
    items = line.select(F.col("l_orderkey").alias("paper"), item.alias("item"), (F.col("l_returnflag") == "A").alias("eligible"), F.when(F.col("l_suppkey") % 3 != 0, F.col("l_partkey")).alias("runtime_id"))
    known = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("paper"), F.col("o_orderpriority").alias("session"))
    return projections.archive_view(items, known, "paper", "item").select("paper", "item.*", "session", "is_ready", "runtime_id")


@query("""WITH s AS (SELECT p_partkey AS question, CASE WHEN p_size % 7 = 0 THEN NULL ELSE '{"p_name":"' || p_name || '","p_type":"' || p_type || '","p_size":' || p_size || '}' END AS body FROM part WHERE p_size <= 20), v AS (SELECT p_partkey AS question, p_name AS body FROM part WHERE p_size <= 45)
  SELECT l_orderkey, l_linenumber, l_partkey AS question, CASE WHEN s.question IS NOT NULL THEN s.body ELSE v.body END AS body, CASE WHEN s.question IS NOT NULL THEN 'snapshot' WHEN v.question IS NOT NULL THEN 'live' ELSE 'missing' END AS origin
  FROM lineitem LEFT JOIN s ON s.question = l_partkey LEFT JOIN v ON v.question = l_partkey""")
def hydrated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each line's question looked like: by its snapshot, else by the live row."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "question")
    snapshots = part.where("p_size <= 20").select("question", F.when(F.col("p_size") % 7 != 0, projections.snapshot(["p_name", "p_type", "p_size"])).alias("body"))
    ids = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("question"))
    return projections.hydrated(ids, snapshots, part.where("p_size <= 45").select("question", F.col("p_name").alias("body")), "question", "body")


@query("""WITH r AS (SELECT l_partkey AS p_partkey, max(l_returnflag) AS status, CASE WHEN count(*) > 30 THEN 'reviewed' END AS p_type FROM lineitem GROUP BY 1 HAVING max(l_discount) > 0.09)
  SELECT p_partkey, p_name, coalesce(r.p_type, p.p_type) AS p_type, r.status, r.p_partkey IS NOT NULL AS reviewed FROM part p LEFT JOIN r USING (p_partkey)""")
def reviewed_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_returnflag").alias("status"), F.when(F.count("*") > 30, "reviewed").alias("p_type"), F.max("l_discount").alias("d"))
    reviews = reviews.where("d > 0.09").drop("d")
    merged = projections.reviewed(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type"), reviews, "p_partkey", ["p_type", "status"])
    return merged.select("p_partkey", "p_name", "p_type", "status", "reviewed")


@query("""WITH t AS (SELECT p_brand, list_sort(list_distinct(list(p_type))) AS points, list_sort(list_distinct(list(CASE WHEN p_size = 50 THEN p_name END))) AS traps FROM part GROUP BY p_brand)
  SELECT p_brand, '# ' || p_brand || chr(10) || chr(10) || '## Key points' || chr(10) || array_to_string(list_transform(points, lambda x: '- ' || x), chr(10)) ||
    CASE WHEN len(list_filter(traps, lambda x: x IS NOT NULL)) > 0 THEN chr(10) || chr(10) || '## Traps' || chr(10) || array_to_string(list_transform(list_filter(traps, lambda x: x IS NOT NULL), lambda x: '- ' || x), chr(10)) ELSE '' END AS note FROM t""")
def note_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_type")).alias("points"), F.array_sort(F.collect_set(F.when(F.col("p_size") == 50, F.col("p_name")))).alias("traps"))
    return lists.select("p_brand", projections.note(F.col("p_brand"), F.lit(" "), {"Key points": F.col("points"), "Traps": F.col("traps")}).alias("note"))


@query("""SELECT doc_id, source, coalesce(lang, '') AS language, sha256(text) AS text_sha, doc_id % 3 <> 0 AS has_notes, CASE WHEN doc_id % 3 <> 0 THEN sha256('note ' || doc_id) END AS notes_sha FROM documents""")
def record_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed columns of a record; of its notes only whether there are any, and a digest."""
    lang = F.coalesce("lang", F.lit(""))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.create_map(lang, F.col("text"), F.concat(F.lit("~"), lang), F.lit("other")).alias("texts"), F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit("note "), F.col("doc_id").cast("string"))).otherwise(" ").alias("notes"))
    return projections.record_view(rows, ["doc_id", "source"], "texts", "notes", "fr").select("doc_id", "source", "language", F.sha2("text", 256).alias("text_sha"), "has_notes", "notes_sha")


@query(f"""WITH {papers._ROWS}, s AS (SELECT paper, list_distinct(list(question ORDER BY quantity, question, source, ordinal, flag)) AS x FROM r WHERE flag <> 'N' GROUP BY paper), o AS (SELECT paper, question, min(row(quantity, question, source, ordinal, flag)) AS k FROM r WHERE flag <> 'N' GROUP BY ALL),
  n AS (SELECT paper, question, row_number() OVER (PARTITION BY paper ORDER BY k) AS place FROM o)
  SELECT r.paper, string_agg(r.question || ':' || r.flag, ',' ORDER BY coalesce(place, 2147483647), r.question, r.flag, r.source, r.quantity) AS events FROM r LEFT JOIN n ON n.paper = r.paper AND n.question = r.question GROUP BY r.paper""")
def attempt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order as events in the order of presentation; questions that weren't presented come last."""
    rows = papers.rows(spark, sf_dir)
    order = F.sort_array(F.collect_list(F.struct("quantity", "question", "source", "ordinal", "flag")))
    sessions = rows.where("flag <> 'N'").groupBy("paper").agg(F.array_distinct(F.transform(order, lambda x: x["question"])).alias("item_ids"))
    listed = projections.attempt_events(rows, sessions, "paper", "question", ["flag", "source", "quantity"])
    return listed.select("paper", F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["question"].cast("string"), e["flag"])), ",").alias("events"))


@query("""SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE CAST(regexp_extract(props, '"k": (\\d+)', 1) AS BIGINT) END AS k, CASE WHEN event_id % 9 = 0 THEN 'broken' WHEN event_id % 7 = 0 THEN 'incomplete' END AS problem FROM events WHERE event_id % 9 <> 0 OR TRUE""".replace("CASE WHEN event_id % 9 = 0 THEN NULL ELSE", "CASE WHEN event_id % 9 = 0 OR event_id % 7 = 0 THEN NULL ELSE").replace("\\\\", "\\"))
def decoded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns from JSON texts; broken and incomplete ones keep their row."""
    k = F.col("event_id")
    body = F.when(k % 9 == 0, F.lit(None).cast("string")).when(k % 7 == 0, F.replace("props", F.lit('"k"'), F.lit('"other"'))).otherwise(F.col("props"))
    return projections.decoded(table(spark, sf_dir, "events").select("event_id", body.alias("body")), "body", "k long", ["k"])


@query("""SELECT p_partkey AS id, p_name AS name, 'remote' AS origin FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, p_brand, 'local' FROM part WHERE p_size < 20 AND p_partkey % 3 = 0""")
def catalogue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A remote catalogue overrides a local one; what only the local one has is appended."""
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    remote = part.where("id % 3 <> 0").select("id", F.col("p_name").alias("name"))
    return projections.keyed_merge(remote, part.where("p_size < 20").select("id", F.col("p_brand").alias("name")), "id")


@query("""WITH u AS (SELECT 0 AS pri, doc_id AS seq, doc_id % 400 AS id, sha256(coalesce(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '')) AS digest FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT 1, doc_id, doc_id % 300, sha256(coalesce(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), '')) FROM documents WHERE doc_id % 2 = 0),
  a AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY pri, seq) = 1) SELECT id, seq, digest FROM a QUALIFY row_number() OVER (PARTITION BY digest ORDER BY pri, seq) = 1""".replace("\\\\", "\\"))
def first_of_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources as one: the first row of each id, then of each content, odd documents before even ones."""
    k = F.col("doc_id")
    digest = F.sha2(F.coalesce(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), F.lit("")), 256)
    rows = table(spark, sf_dir, "documents").select(k.alias("seq"), F.when(k % 2 == 1, k % 400).otherwise(k % 300).alias("id"), digest.alias("digest"))
    return projections.first_of(rows, F.when(F.col("seq") % 2 == 1, 0).otherwise(1), ["id", "digest"], "seq").select("id", "seq", "digest")


@query("""SELECT p_partkey, sha256('{"is_active":' || CASE WHEN p_size = 13 THEN 'true' WHEN p_size <= 40 THEN 'true' ELSE 'false' END || ',"name":"' || p_name || '","price":"' || CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE CAST(p_retailprice AS VARCHAR) END || '"}') AS sha FROM part""")
def portable_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    active = F.when(F.col("p_size") != 13, F.col("p_size") <= 40)
    return table(spark, sf_dir, "part").select("p_partkey", projections.portable({"name": F.col("p_name"), "price": F.col("p_retailprice")}, active).alias("sha"))


@query(f"""WITH {star.CTE} SELECT question_id, sha256('{{"course":"' || subject || '","options":[' || CASE WHEN question_type = 'msq' THEN '"' || lower(least(text, topic)) || '","' || lower(greatest(text, topic)) || '"' ELSE '' END || '],"stem":"' || lower(text) || '"}}') AS sha FROM (SELECT *  REPLACE (lower(topic) AS topic) FROM question)""")
def semantic_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What questions ask, without their request for an answer."""
    ask = F.when(F.col("question_type") == "nat", "  Enter the numerical answer. ").otherwise(" choose the correct value.")
    sha = projections.semantic_digest(F.col("question_type"), F.concat(F.upper("text"), ask), F.array(F.concat(F.col("text"), F.lit(" ")), F.col("topic")), course=F.col("subject"))
    return star.questions(spark, sf_dir).select("question_id", sha.alias("sha"))


@query(f"WITH {star.CTE} SELECT attempt_id, question_id, CASE WHEN status = 'correct' AND question_type = 'nat' THEN 'incorrect' ELSE status END AS status FROM graded")
def client_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses without a tolerance: a numeric answer that is only near counts as wrong."""
    rows = star.responses(spark, sf_dir).join(star.questions(spark, sf_dir).select("question_id", "question_type", "answer_key"), "question_id")
    return rows.select("attempt_id", "question_id", projections.client_status(F.col("question_type"), F.col("answer"), F.col("answer_key")).alias("status"))


@query("""WITH m AS (SELECT p_partkey, p_name, p_size, p_partkey % 5 AS k FROM part) SELECT p_partkey, CASE WHEN k < 4 THEN p_name END AS rest, CASE k WHEN 0 THEN 'Question Number : ' || p_size WHEN 1 THEN 'Q.' || p_size WHEN 2 THEN 'q no. ' || p_size WHEN 3 THEN CAST(p_size AS VARCHAR) END AS marker FROM m""")
def stripped_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without the label that they begin with; a longer number is another label."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    lead = F.when(k == 0, F.concat(F.lit(" Question Number : "), size, F.lit(" "))).when(k == 1, F.concat(F.lit("Q."), size, F.lit(". "))).when(k == 2, F.concat(F.lit("q no. "), size, F.lit("\n"))).when(k == 3, F.concat(size, F.lit(".  "))).otherwise(F.concat(size, F.lit("1. ")))
    rows = table(spark, sf_dir, "part").select("p_partkey", projections.without_marker(F.concat(lead, "p_name"), size).alias("m"))
    return rows.select("p_partkey", "m.rest", "m.marker")


@query("""WITH b AS (SELECT p_brand, CASE WHEN p_partkey % 3 <> 0 THEN p_type END AS old, CASE WHEN p_partkey % 4 <> 0 THEN CASE WHEN p_size > 40 THEN 'NEW' ELSE p_type END END AS new FROM part)
  SELECT p_brand, count(*) AS rows, count(old) AS before, count(new) AS after, count(*) FILTER (WHERE old IS NULL AND new IS NOT NULL) AS gained, count(*) FILTER (WHERE old IS NOT NULL AND new IS NULL) AS lost, count(*) FILTER (WHERE old <> new) AS changed FROM b GROUP BY ROLLUP (p_brand)""")
def policy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a new policy changes, by brand and in total."""
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part").withColumns({"old": F.when(k % 3 != 0, F.col("p_type")), "new": F.when(k % 4 != 0, F.when(F.col("p_size") > 40, "NEW").otherwise(F.col("p_type")))})
    return projections.changed_metrics(part, F.col("old"), F.col("new"), "p_brand")


@query("""WITH b AS (SELECT p_brand, p_size, CASE WHEN p_partkey % 3 <> 0 THEN p_name END AS base, CASE WHEN p_partkey % 4 <> 0 THEN p_name END AS over FROM part)
  SELECT p_brand, count(*) AS rows, count(*) FILTER (WHERE base IS NULL) AS missing_before, count(*) FILTER (WHERE base IS NULL AND over IS NULL) AS missing_after,
    count(*) FILTER (WHERE base IS NULL AND over IS NOT NULL AND p_size > 25) AS exact, count(*) FILTER (WHERE base IS NULL AND over IS NOT NULL AND p_size <= 25) AS review FROM b GROUP BY p_brand""")
def overlay_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return projections.gap_metrics(table(spark, sf_dir, "part"), F.when(k % 3 != 0, F.col("p_name")), F.when(k % 4 != 0, F.col("p_name")), F.col("p_size") > 25, "p_brand")


@query("""WITH w AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS top, l_partkey AS left_edge, l_returnflag || l_suppkey AS text, 1 - 5 * l_discount AS confidence FROM lineitem)
  SELECT l_orderkey, string_agg(text, ' ' ORDER BY top, left_edge, text) AS text, round(avg(confidence), 6) AS confidence, count(*) AS words FROM w WHERE confidence >= 0.7 GROUP BY l_orderkey""")
def page_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recognised words of a page in reading order, without the doubtful ones."""
    line = table(spark, sf_dir, "lineitem")
    words = line.select("l_orderkey", F.col("l_quantity").cast("long").alias("top"), F.col("l_partkey").alias("left"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("text"), (1 - 5 * F.col("l_discount")).alias("confidence"))
    return projections.page_text(words, ["l_orderkey"], 0.7)


@query("""SELECT p_brand, p_type, p_partkey, row_number() OVER (ORDER BY CASE p_type WHEN 'PROMO' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, p_brand, p_partkey) AS place FROM part ORDER BY place LIMIT 40""")
def rank_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list by a custom rank: the first page of it, with places."""
    rank = F.when(F.col("p_type") == "PROMO", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2)
    top = table(spark, sf_dir, "part").orderBy(*projections.ranked_order(rank, "p_brand", "p_partkey")).limit(40)
    from pyspark.sql import Window

    # the page's rows only
    return top.select("p_brand", "p_type", "p_partkey", F.row_number().over(Window.orderBy(rank, "p_brand", "p_partkey")).cast("long").alias("place"))


@query(f"""WITH {star.CTE}, s AS (SELECT user_id, subject, count(*) AS attempted, count(DISTINCT question_id) AS unique_attempted, count(*) FILTER (WHERE status = 'correct') AS correct FROM graded GROUP BY ALL)
  SELECT user_id, subject, attempted, row_number() OVER (PARTITION BY user_id ORDER BY correct / attempted, unique_attempted DESC, subject) AS place FROM s WHERE attempted >= 3 QUALIFY place <= 5""")
def weakest_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five weakest subjects of each learner among those tried three times or more."""
    from pyspark.sql import Window

    sums = learner.met(spark, sf_dir).groupBy("user_id", "subject").agg(F.count("*").alias("attempted"), F.count_distinct("question_id").alias("unique"), F.count_if(F.col("status") == "correct").alias("correct"))
    order = Window.partitionBy("user_id").orderBy(F.col("correct") / F.col("attempted"), F.desc("unique"), "subject")
    return sums.where("attempted >= 3").withColumn("place", F.row_number().over(order).cast("long")).where("place <= 5").select("user_id", "subject", "attempted", "place")


@query("""WITH g AS (SELECT p_brand, count(*) AS have, row_number() OVER (ORDER BY p_brand) - 1 AS n FROM part GROUP BY p_brand), t AS (SELECT count(*) AS groups, greatest(0, 25000 - sum(have)) AS missing FROM g)
  SELECT p_brand, CAST(floor((missing - n + groups - 1) / groups) AS BIGINT) AS fill FROM g, t""")
def cycled_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many questions each subject has to get, in turn, until the bank holds 25,000."""
    return projections.cycled(table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("have")), "p_brand", "p_brand", 25_000, "have")


@query("""WITH q AS (SELECT p_brand, CAST(50 // count(*) OVER () + CASE WHEN row_number() OVER (ORDER BY p_brand) <= 50 % count(*) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM (SELECT DISTINCT p_brand FROM part)),
  r AS (SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS n FROM part) SELECT p_partkey, p_brand, ['mcq', 'msq', 'nat'][1 + n % 3] AS kind, quota FROM r JOIN q USING (p_brand)""")
def dealt_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of a subject given types in turn, beside the subject's share of fifty."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return projections.dealt_kinds(part, "p_brand", "p_partkey", ("mcq", "msq", "nat")).join(projections.shares(50, part.select("p_brand").distinct(), "p_brand"), "p_brand")


@query("SELECT p_partkey, array_to_string(list_concat(xs[1 + p_partkey % 4:], xs[:p_partkey % 4]), '') AS turned FROM (SELECT p_partkey, ['A', 'B', 'C', 'D'] AS xs FROM part)")
def rotated_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(*(F.lit(x) for x in "ABCD"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(selection.rotated(labels, F.col("p_partkey").cast("int")), "").alias("turned"))


@query(f"""WITH {papers._ROWS} SELECT paper, question, source, row_number() OVER (PARTITION BY paper ORDER BY ordinal, question, source, quantity, flag) AS number FROM r""")
def renumbered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order numbered anew after repeated numbers."""
    return quality.renumbered(papers.rows(spark, sf_dir), "paper", ["ordinal", "question", "source", "quantity", "flag"], "number").select("paper", "question", "source", "number")


@query("""SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'cheap' WHEN o_orderstatus = 'P' THEN 'pending' WHEN o_orderpriority = '5-LOW' THEN 'low' END AS reason FROM orders""")
def first_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an order is turned down: the first rule that holds."""
    rules = {"cheap": F.col("o_totalprice") < 50000, "pending": F.col("o_orderstatus") == "P", "low": F.col("o_orderpriority") == "5-LOW"}
    return table(spark, sf_dir, "orders").select("o_orderkey", quality.first_code(rules).alias("reason"))


@query("""SELECT l_orderkey AS paper, count(*) AS n, count(DISTINCT l_linenumber) = count(*) AND count(DISTINCT l_partkey) = count(*) AS bijective FROM lineitem GROUP BY 1""")
def bijections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the numbers and the questions of a paper name each other."""
    return quality.bijection(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "paper"), "paper", "l_linenumber", "l_partkey")


@query("""SELECT DISTINCT o_orderkey, c_custkey FROM (SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey UNION ALL SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_orderkey % 1000 = c_custkey)""")
def any_key_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and customers that agree on either of two keys, each pair once."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 1000).alias("b"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("a"), F.col("c_custkey").alias("b"))
    return linkage.any_key(orders, customer, "o_orderkey", "c_custkey", ["a", "b"])


@query("""WITH n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS key, p_partkey AS id FROM part UNION SELECT regexp_replace(lower(p_brand || '/' || p_partkey), '[^a-z0-9]', '', 'g'), p_partkey FROM part)
  SELECT key, CASE WHEN count(*) = 1 THEN min(id) END AS id FROM n WHERE key <> '' GROUP BY key""")
def alias_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name that leads to one part only."""
    named = table(spark, sf_dir, "part").withColumn("full", F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")))
    return linkage.alias_lookup(named, "p_partkey", ["p_name", "full"])


@query(f"""WITH {star.CTE} SELECT question_id, text FROM question WHERE contains(lower(concat_ws(chr(10), text, subject, topic, question_type, answer_key)), 'bolt' || chr(10) || 'brand#1')""")
def folded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A needle in the joined search text of a question, which may reach over the seam of two fields."""
    found = star.questions(spark, sf_dir).withColumn("search_text", catalog.search_text(["text", "subject", "topic", "question_type", "answer_key"]))
    return found.where(F.contains("search_text", F.lit("bolt\nbrand#1"))).select("question_id", "text")


@query("""WITH t AS (SELECT conv_id, string_agg(lower(coalesce(role, '') || ' ' || coalesce(text, '')), ' ' ORDER BY turn, role, text) AS x FROM conversations GROUP BY conv_id) SELECT conv_id, contains(x, 'assistant th') OR contains(x, 'the') AS found FROM t""")
def nested_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested arrays, searched for either of two needles in all of their texts."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda t: F.array(t["role"], t["text"])).alias("parts"))
    hit = catalog.nested_match("parts", "assistant TH") | catalog.nested_match("parts", " the ".strip())
    return nested.select("conv_id", hit.alias("found"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE coalesce(CASE WHEN l_returnflag <> 'N' THEN l_returnflag = 'A' END, TRUE) AND coalesce(CASE WHEN l_quantity > 10 THEN l_linestatus END, 'F') = 'F'""")
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are safe and verified, where a missing mark counts as that."""
    line = table(spark, sf_dir, "lineitem").withColumns({"safe": F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "A"), "status": F.when(F.col("l_quantity") > 10, F.col("l_linestatus"))})
    return catalog.eligible(line, "safe", "status", "F").select("l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN 'b' ELSE 'a,b' END AS left_open FROM part""")
def remaining_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.operators import evidence

    blockers = F.array(F.lit("b"), F.lit("a"), F.lit("c"))
    satisfied = F.when(F.col("p_size") < 10, F.array(F.lit("a"), F.lit("c"))).otherwise(F.array(F.lit("c"), F.lit("x")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(evidence.remaining(blockers, satisfied), ",").alias("left_open"))


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem), n AS (SELECT source, count(*) > 1 AS reused FROM l GROUP BY source) SELECT source, target, reused FROM l JOIN n USING (source)""")
def source_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that are used for several targets."""
    from quillon.operators import evidence

    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    return evidence.used_once(links, "source", "target").select("source", "target", "reused")


_FLAGGED = "CASE doc_id % 6 WHEN 0 THEN 'Q. 7 ' WHEN 1 THEN '0 GATE 2018 General Aptitude (GA) Set-3 GA 2/3 ' WHEN 2 THEN 'IfP=2 and R=3, thenQ+S=7. ' WHEN 3 THEN 'int main { ' WHEN 4 THEN 'Considerthe following figure shown below ' ELSE '' END"


@query(f"""WITH t AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 4 = 0 AS nested FROM documents)
  SELECT doc_id, array_to_string(list_sort(list_filter([CASE WHEN k = 0 THEN 'embedded_q_label' END, CASE WHEN k = 1 THEN 'paper_header' END, CASE WHEN k = 1 THEN 'section_page_footer' END, CASE WHEN k = 2 THEN 'joined_formula_ocr' END,
    CASE WHEN k = 3 THEN 'unbalanced_code_delimiters' END, CASE WHEN k = 4 THEN 'joined_word_ocr' END, CASE WHEN k = 4 THEN 'visual_dependency' END, CASE WHEN nested THEN 'nested_option_label' END, CASE WHEN doc_id % 5 = 0 THEN 'truncated_prompt' END], lambda v: v IS NOT NULL)), ',') AS flags FROM t""")
def record_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of whole records, with damage that is put in by a rule of the key."""
    k = F.col("doc_id")
    options = F.array(F.when(k % 4 == 0, "see ( b ) too").otherwise("plain"), F.lit("other"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.expr(_FLAGGED), F.when(k % 5 == 0, "value (").otherwise("value")).alias("text"), options.alias("options"))
    return tx.with_quality_flags(rows, "text", "flags", "options").select("doc_id", F.array_join("flags", ",").alias("flags"))


@query("""SELECT p_partkey, CASE WHEN r >= 0.85 THEN 'strong' WHEN r >= 0.60 THEN 'partial' ELSE 'weak' END AS band FROM (SELECT p_partkey, p_size / 50.0 AS r FROM part)""")
def ratio_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.ratio_band(F.col("p_size") / 50.0).alias("band"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(lower(text), '(?s)\$.*?\$|\\\(.*?\\\)|\\\[.*?\\\]', ' ', 'g') AS x, text FROM documents)
  SELECT doc_id, len(list_filter(regexp_extract_all(x, '[a-z]+(?:''[a-z]+)?|\d+(?:\.\d+)?'), lambda t: length(t) >= 3 OR regexp_full_match(t, '\d+'))) AS anchors, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha FROM p""")
def text_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many anchor words a text has beside its formulas, and a digest that line ends don't change."""
    from quillon.functions import digests

    return table(spark, sf_dir, "documents").select("doc_id", F.size(tx.anchors(F.col("text"))).cast("long").alias("anchors"), digests.line_end_free(F.col("text")).alias("sha"))
