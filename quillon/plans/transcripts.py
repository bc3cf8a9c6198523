"""Queries on transcripts, markers and release decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import parsing
from quillon.operators import linkage, quality, sequences, transcripts
from quillon.plans import papers
from quillon.plans.registry import query
from quillon.plans.star import table

_LINE = """CASE doc_id % 8 WHEN 0 THEN 'Q. ' || n || ' ' || x WHEN 1 THEN n || '. ' || x WHEN 2 THEN 'Question Number : ' || n || ' ' || x WHEN 3 THEN 'Q.' || n || ' - Q.' || (n + 4) || ' carry' WHEN 4 THEN 'Q No. ' || n || ' Do not open' WHEN 5 THEN x
  WHEN 6 THEN 'Question ' || n || ' ' || x ELSE 'Q.' || n || '5 ' || x END"""
_YEAR = "CASE doc_id // 8 % 3 WHEN 0 THEN 2005 WHEN 1 THEN 2016 ELSE 2017 END"


@query(f"""WITH d AS (SELECT doc_id, 1 + doc_id % 60 AS n, {_YEAR} AS year, doc_id % 8 AS k FROM documents)
  SELECT doc_id, CAST(CASE WHEN k = 7 THEN n * 10 + 5 ELSE n END AS BIGINT) AS number FROM d WHERE CASE year WHEN 2005 THEN k IN (0, 1, 7) WHEN 2016 THEN k IN (0, 6, 7) ELSE k = 2 END""")
def marked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that begin a question, by the layout of their year; ranges and instructions begin none."""
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "1 + doc_id % 60 AS n", "'what holds' AS x")
    lines = docs.selectExpr("doc_id", _YEAR.replace("doc_id // 8", "doc_id DIV 8") + " AS year", _LINE + " AS line")
    return transcripts.marked_lines(lines, "year", "line").select("doc_id", "number")


@query("""WITH o AS (SELECT o_orderkey, year(o_orderdate) + 18 AS year, unnest(range(1, 66)) AS ordinal FROM orders WHERE o_orderstatus = 'P')
  SELECT o_orderkey, ordinal, CAST(CASE WHEN year = 2017 THEN CASE WHEN ordinal >= 11 THEN ordinal - 10 ELSE ordinal + 55 END WHEN year = 2015 OR year >= 2022 THEN ordinal WHEN year >= 2014 THEN CASE WHEN ordinal >= 11 THEN ordinal - 10 ELSE ordinal END ELSE ordinal END AS BIGINT) AS printed FROM o""")
def printed_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under which number each slot of a paper was printed."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_orderkey", (F.year("o_orderdate") + 18).alias("year"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(65).cast("long"))).alias("ordinal"))
    return orders.select("o_orderkey", "ordinal", transcripts.printed_ordinal(F.col("year"), F.col("ordinal")).cast("long").alias("printed"))


_PROMPT = """CASE doc_id % 6 WHEN 0 THEN 'see the circuit that is shown' WHEN 1 THEN 'as given in table two' WHEN 2 THEN 'which of the following graphs is planar' WHEN 3 THEN '[image: x]' WHEN 4 THEN 'plain words' ELSE ' ' END"""


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS k, doc_id % 7 = 0 AS hint, doc_id % 5 <> 0 AS ready FROM documents),
  s AS (SELECT *, list_sort(list_filter([CASE WHEN k = 3 THEN 'explicit_image_placeholder' END, CASE WHEN k = 0 THEN 'named_visual_shown' END, CASE WHEN k = 1 THEN 'shown_named_visual' END, CASE WHEN k = 0 THEN 'deictic_visual_reference' END, CASE WHEN k = 2 THEN 'visual_option_reference' END,
    CASE WHEN hint THEN 'secondary_remote_visual_locator_hint' END, CASE WHEN k = 5 THEN 'prompt_unavailable_for_visual_audit' END, CASE WHEN NOT ready THEN 'objective_options_not_safely_transcribed' END], lambda v: v IS NOT NULL)) AS s, k < 4 OR hint AS confirmed FROM d)
  SELECT doc_id, array_to_string(s, ',') AS signals, CASE WHEN doc_id % 11 = 0 THEN 'asset_ready' WHEN confirmed AND doc_id % 3 = 0 THEN 'missing' WHEN len(s) > 0 THEN 'review_required' ELSE 'not_required' END AS status,
    CASE WHEN doc_id % 11 = 0 OR confirmed THEN 'confirmed' WHEN len(s) > 0 THEN 'potential' ELSE 'not_detected' END AS evidence FROM s""")
def visual_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", transcripts.visual_signals(F.expr(_PROMPT), k % 7 == 0, k % 5 != 0).alias("signals"))
    found = rows.select("doc_id", "signals", transcripts.dependence(F.col("signals"), k % 3 != 0, k % 11 == 0).alias("d"))
    return found.select("doc_id", F.array_join("signals", ",").alias("signals"), "d.status", "d.evidence")


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'A,C' WHEN 2 THEN p_size || '.0 to ' || (p_size + 1) || '.0' END AS value, CASE WHEN p_partkey % 4 = 3 THEN 'marks_to_all_not_auto_scorable' END AS review
  FROM part WHERE 1 + p_size % 3 < 3""")
def gradable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of key rows as far as they can be graded."""
    key, size = F.col("p_partkey"), F.col("p_size")
    answer = F.element_at(F.array(F.lit("MCQ A"), F.lit("MSQ C; A"), F.concat(F.lit("NAT "), size, F.lit(" to "), size + 1), F.lit("MCQ MTA")), (F.pmod(key, F.lit(4)) + 1).cast("int"))
    line = F.concat_ws(" ", F.lit("7"), answer, (1 + F.pmod(size, F.lit(3))).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", parsing.key_row(line).alias("r")).where("r.number IS NOT NULL")
    return rows.select("p_partkey", transcripts.gradable(F.col("r.kind"), F.col("r.shape"), F.col("r.answer")).alias("g")).select("p_partkey", "g.value", "g.review")


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, 1 - l_discount AS a, 1 - l_tax AS b, l_returnflag, l_linestatus FROM lineitem),
  r AS (SELECT *, least(a, b) AS confidence, CASE WHEN l_returnflag = 'R' THEN 'withdrawn' WHEN l_linestatus = 'O' AND l_quantity > 40 THEN 'open' WHEN least(a, b) < 0.95 THEN 'low_confidence' END AS reason FROM l)
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(confidence, 6) AS confidence, reason, reason IS NULL AS safe FROM r""")
def safe_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").withColumns({"a": 1 - F.col("l_discount"), "b": 1 - F.col("l_tax")})
    rules = {"withdrawn": F.col("l_returnflag") == "R", "open": (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)}
    found = transcripts.split_safe(line, rules, ["a", "b"], 0.95)
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("confidence", 6).alias("confidence"), "reason", "safe")


@query("""SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'kept' WHEN p_partkey % 4 = 0 THEN 'unresolved' WHEN p_size / 50.0 >= 0.85 THEN 'exact' WHEN p_size / 50.0 >= 0.60 THEN 'review' ELSE 'unresolved' END AS status FROM part""")
def overlay_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    status = transcripts.overlay_status(F.when(size <= 10, F.col("p_name")), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")), size / 50.0)
    return table(spark, sf_dir, "part").select("p_partkey", status.alias("status"))


@query(f"""WITH {papers._ROWS}, a AS (SELECT DISTINCT paper, ordinal FROM r WHERE flag = 'A'), n AS (SELECT DISTINCT paper, ordinal FROM r WHERE flag = 'N'), w AS (SELECT DISTINCT paper, ordinal FROM r WHERE flag = 'R'), e AS (SELECT DISTINCT paper, ordinal FROM r)
  SELECT e.paper, e.ordinal, concat_ws(',', CASE WHEN a.paper IS NULL THEN 'accepted' END, CASE WHEN n.paper IS NULL THEN 'normal' END, CASE WHEN w.paper IS NULL THEN 'withdrawn' END) AS absent_from
  FROM e LEFT JOIN a USING (paper, ordinal) LEFT JOIN n USING (paper, ordinal) LEFT JOIN w USING (paper, ordinal) WHERE a.paper IS NULL OR n.paper IS NULL OR w.paper IS NULL""")
def same_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = papers.rows(spark, sf_dir)
    found = transcripts.same_key_sets({"accepted": rows.where("flag = 'A'"), "normal": rows.where("flag = 'N'"), "withdrawn": rows.where("flag = 'R'")}, ["paper", "ordinal"])
    return found.withColumn("absent_from", F.array_join("absent_from", ","))


@query("""WITH s AS (SELECT p_partkey AS id, p_name AS name, p_size AS place FROM part), p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 50 = 3 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 40 = 5 THEN p_size + 1 ELSE p_size END AS place FROM part WHERE p_partkey % 60 <> 9)
  SELECT *, 'source' AS side FROM (FROM s EXCEPT ALL FROM p) UNION ALL SELECT *, 'published' FROM (FROM p EXCEPT ALL FROM s)""")
def mirrored_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What differs between a source and its published copy; their paths and hashes may."""
    k, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    part = table(spark, sf_dir, "part")
    source = part.select(k.alias("id"), name.alias("name"), size.alias("place"), F.lit("/src").alias("path"))
    copy = part.where(k % 60 != 9).select(k.alias("id"), F.when(k % 50 == 3, F.upper(name)).otherwise(name).alias("name"), F.when(k % 40 == 5, size + 1).otherwise(size).alias("place"), F.lit("/out").alias("path"))
    return transcripts.mirrored(source, copy, ["id"], ["path"])


@query("""WITH t AS (SELECT p_partkey, string_split(p_name || ' widget ' || p_name, ' ') AS a, string_split('widget bolt cold widget widget ' || p_name, ' ') AS b FROM part)
  SELECT p_partkey, CAST(list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b, lambda y: y = x))))) AS BIGINT) AS shared FROM t""")
def shared_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.split(F.concat_ws(" ", "p_name", F.lit("widget"), "p_name"), " "), F.split(F.concat(F.lit("widget bolt cold widget widget "), "p_name"), " ")
    return table(spark, sf_dir, "part").select("p_partkey", transcripts.shared_tokens(a, b).alias("shared"))


@query("""SELECT year(o_orderdate) AS year, o_orderpriority AS session, min(o_orderkey) AS paper FROM orders GROUP BY ALL""")
def first_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("session"), F.col("o_orderkey").alias("paper"))
    return sequences.first_by_priority(orders, ["year", "session"], ["paper"])


_LABELS = "WITH l AS (SELECT l_orderkey, list(chr(CAST(64 + CASE WHEN l_linenumber > 4 THEN 1 ELSE l_linenumber END AS INT)) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS ls FROM lineitem GROUP BY l_orderkey)"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    entry = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    label = lambda x: F.char(64 + F.when(x["l_linenumber"] > 4, 1).otherwise(x["l_linenumber"]))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(entry)), label).alias("ls"))


@query(f"""{_LABELS} SELECT l_orderkey, ls = ['A', 'B', 'C', 'D'] AS consecutive, CAST((length(array_to_string(ls, '')) - length(replace(array_to_string(ls, ''), 'ABCD', ''))) // 4 AS BIGINT) AS groups FROM l""")
def option_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an order's labels are A to D once each in order, and how many such runs they hold."""
    rows = _labels(spark, sf_dir)
    return rows.select("l_orderkey", sequences.consecutive_labels(F.col("ls")).alias("consecutive"), sequences.option_groups(F.col("ls")).alias("groups"))


@query("""SELECT l_orderkey, coalesce(min(l_linenumber) FILTER (WHERE l_returnflag = 'R') - 1, 9) AS end_page FROM lineitem GROUP BY l_orderkey""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last page of a paper: the one before its answer key, else what is declared."""
    return sequences.page_range(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber", F.col("l_returnflag") == "R", F.lit(9))


@query("""WITH s AS (SELECT l_orderkey, list(DISTINCT l_partkey) AS starts FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, list_max(list_filter(starts, lambda x: x <= 100)) AS start, len(starts) FROM s""".replace(", len(starts)", ""))
def floor_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which page an offset lies on: the last start that isn't behind it."""
    starts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("starts"))
    return starts.select("l_orderkey", sequences.floor_lookup(F.col("starts"), F.lit(100)).alias("start"))


@query("""WITH g AS (SELECT l_orderkey, list(l_partkey ORDER BY l_partkey, l_suppkey) FILTER (WHERE l_returnflag = 'A') AS a, list(l_suppkey ORDER BY l_suppkey, l_partkey) FILTER (WHERE l_returnflag = 'N') AS b FROM lineitem GROUP BY l_orderkey)
  SELECT l_orderkey, coalesce(len(a), 0) <> coalesce(len(b), 0) AS mismatch, CASE WHEN coalesce(len(a), 0) = coalesce(len(b), 0) THEN coalesce(list_aggregate(list_transform(a, lambda x, i: x || ':' || b[i]), 'string_agg', ','), '') END AS pairs FROM g""")
def zipped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and headings of a page paired by place, if they are as many."""
    line = table(spark, sf_dir, "lineitem")
    listed = lambda flag, a, b: F.transform(F.sort_array(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct(F.col(a).alias("x"), F.col(b).alias("y"))))), lambda s: s["x"])
    rows = line.groupBy("l_orderkey").agg(listed("A", "l_partkey", "l_suppkey").alias("a"), listed("N", "l_suppkey", "l_partkey").alias("b"))
    zipped = linkage.zip_lists(rows, "a", "b")
    text = F.array_join(F.transform("pairs", lambda p: F.concat_ws(":", p["a"].cast("string"), p["b"].cast("string"))), ",")
    return zipped.select("l_orderkey", "mismatch", text.alias("pairs"))


_GRAPH = "node AS (SELECT n_nationkey AS code FROM nation), edge AS (SELECT n_nationkey AS src, (n_nationkey * 2 + 1) % 25 AS dst FROM nation), present AS (SELECT DISTINCT c_nationkey AS code FROM customer WHERE c_acctbal > 8000 UNION SELECT 0)"


@query(f"""WITH {_GRAPH}, k AS (SELECT code FROM node WHERE code IN (SELECT code FROM present)), i AS (SELECT src, dst FROM edge WHERE src IN (SELECT code FROM k) AND dst IN (SELECT code FROM k))
  SELECT src, dst FROM i UNION ALL SELECT code, 0 FROM k WHERE code <> 0 AND code NOT IN (SELECT src FROM i)""")
def repaired_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roadmap among the topics that are there; what leads nowhere leads to the goal."""
    code = F.col("n_nationkey")
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    present = customer.where("c_acctbal > 8000").select(F.col("c_nationkey").alias("code")).unionByName(spark.range(1).select(F.col("id").alias("code"))).distinct()
    return linkage.prune_graph(nation.select(code.alias("code")), nation.select(code.alias("src"), ((code * 2 + 1) % 25).alias("dst")), present, 0)[1]


@query("""WITH p AS (SELECT c_custkey % 50 AS user_id, c_nationkey AS code, c_nationkey // 5 AS level, CAST(max(least(100, CAST(c_acctbal AS BIGINT) // 80)) AS BIGINT) AS percent FROM customer GROUP BY ALL),
  e AS (SELECT n_nationkey AS src, n_nationkey + 1 AS dst FROM nation), d AS (SELECT p.user_id, e.dst AS code, bool_and(p.percent >= 100) AS ready FROM p JOIN e ON e.src = p.code GROUP BY ALL),
  s AS (SELECT p.*, CASE WHEN percent > 0 AND percent < 100 THEN 0 WHEN percent < 100 AND coalesce(ready, TRUE) THEN 1 WHEN percent < 100 THEN 2 ELSE 3 END AS tier FROM p LEFT JOIN d USING (user_id, code))
  SELECT user_id, code, ['in_progress', 'ready', 'incomplete', 'complete'][1 + tier] AS reason FROM s QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY tier, level, code) = 1""")
def next_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each learner is to study next."""
    percent = F.least(F.lit(100), F.floor(F.col("c_acctbal").cast("long") / 80)).cast("long")
    progress = table(spark, sf_dir, "customer").where("c_acctbal IS NOT NULL").groupBy((F.col("c_custkey") % 50).alias("user_id"), F.col("c_nationkey").alias("code"), F.floor(F.col("c_nationkey") / 5).alias("level")).agg(F.max(percent).alias("percent"))
    edges = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), (F.col("n_nationkey") + 1).alias("dst"))
    return linkage.next_node(progress, edges)


@query("""SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS words, doc_id % 3 AS formulas FROM (SELECT doc_id, coalesce(regexp_replace(text, '\\s', ' ', 'g'), '') AS text FROM documents)""".replace("\\\\", "\\"))
def formula_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a document, and formulas that a rule of its key puts behind it."""
    docs = table(spark, sf_dir, "documents")
    with_math = F.concat(F.lit("no "), F.repeat(F.lit("$x+1$ and "), (F.col("doc_id") % 3).cast("int")))
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s"), lambda w: w != "")).cast("long")
    return docs.select("doc_id", words.alias("words"), F.size(parsing.math_parts(with_math)).cast("long").alias("formulas"))


@query("""SELECT c_custkey AS id, coalesce(CASE WHEN c_custkey % 3 = 0 THEN [c_name] END, [n_name], []) AS names FROM customer JOIN nation ON n_nationkey = c_nationkey""".replace("AS names FROM", "AS xs FROM").replace("SELECT c_custkey AS id, coalesce", "SELECT id, array_to_string(xs, ',') AS names FROM (SELECT c_custkey AS id, coalesce").replace("ON n_nationkey = c_nationkey", "ON n_nationkey = c_nationkey)"))
def inherited_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children without an array of their own take their parent's."""
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("n_nationkey"), F.when(F.col("c_custkey") % 3 == 0, F.array("c_name")).otherwise(F.array().cast("array<string>")).alias("names"))
    parents = table(spark, sf_dir, "nation").select("n_nationkey", F.array("n_name").alias("names"))
    return quality.inherited(customer, parents, "n_nationkey", "names").select("id", F.array_join("names", ",").alias("names"))


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1""")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last write of each key."""
    return sequences.last_per_key(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT 'q' || CAST(c AS VARCHAR) AS id, 1 AS n FROM (SELECT 1 AS c) WHERE FALSE UNION ALL SELECT o_orderpriority, count(*) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) AND o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY o_orderpriority")
def open_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that have lines and whose owner isn't closed, counted by priority."""
    from quillon.operators import versions

    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "user_id")
    closed = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    kept = versions.without_owners(orders, closed).join(lines, "o_orderkey", "left_semi")
    return kept.groupBy(F.col("o_orderpriority").alias("id")).agg(F.count("*").alias("n"))


# pieces of a text: as it is written, and what it is: text, or a formula with its value and whether it is displayed
_PIECES = [
    (r"cost \$5 and \$7 ", "text", r"cost \$5 and \$7 ", False), ("$x_1$", "math", "x_1", False), (" is $5 or 6 euros ", "text", " is $5 or 6 euros ", False), (r"\(a + b\)", "math", "a + b", False),
    (" so ", "text", " so ", False), ("$$y^2 = 4$$", "math", "y^2 = 4", True), (r"\[\frac{1}{2}\]", "math", r"\frac{1}{2}", True), (r" and $a\$b + 1$", "math", None, False),
]
_ROWS = ", ".join("({}, '{}', '{}', '{}', {})".format(k, raw, kind if value is not None else "both", value if value is not None else "", str(display).lower()) for k, (raw, kind, value, display) in enumerate(_PIECES))
_COUNT = len(_PIECES)


@query(rf"""WITH piece AS (SELECT * FROM (VALUES {_ROWS}) AS t(k, raw, kind, value, display)), d AS (SELECT doc_id, translate(coalesce(text, ''), '$\', '') || '. ' AS base FROM documents),
  p AS (SELECT doc_id, 0 AS i, base AS raw, 'text' AS kind, base AS value, FALSE AS display FROM d
    UNION ALL SELECT doc_id, i, raw, kind, value, display FROM (SELECT doc_id, unnest(range(1, 5)) AS i FROM d) JOIN piece ON k = (doc_id * i) % {_COUNT} WHERE kind <> 'both'
    UNION ALL SELECT doc_id, i, raw, unnest(['text', 'math']), unnest([' and ', 'a\$b + 1']), FALSE FROM (SELECT doc_id, unnest(range(1, 5)) AS i FROM d) JOIN piece ON k = (doc_id * i) % {_COUNT} WHERE kind = 'both'),
  o AS (SELECT *, CASE WHEN kind = 'text' AND lag(kind) OVER w = 'text' THEN 0 ELSE 1 END AS starts FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i, kind DESC)),
  g AS (SELECT *, sum(starts) OVER (PARTITION BY doc_id ORDER BY i, kind DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM o),
  m AS (SELECT doc_id, s, any_value(kind) AS kind, string_agg(value, '' ORDER BY i, kind DESC) AS value, any_value(display) AS display FROM g GROUP BY doc_id, s)
  SELECT doc_id, count(*) AS segments, count(*) FILTER (WHERE kind = 'math') AS formulas, count(*) FILTER (WHERE display) AS displayed, sha256(string_agg(kind || ':' || value, chr(10) ORDER BY s)) AS digest FROM m GROUP BY doc_id""")
def formula_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with formulas, prices and escaped dollars behind them, as segments in order."""
    raw = F.array(*(F.lit(x[0]) for x in _PIECES))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.translate(F.coalesce("text", F.lit("")), "$\\", ""), F.lit(". ")).alias("base"))
    added = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.get(raw, ((F.col("doc_id") * i) % _COUNT).cast("int"))), "")
    rows = docs.select("doc_id", parsing.math_segments(F.concat("base", added)).alias("s"))
    count = lambda test: F.size(F.filter("s", test)).cast("long")
    return rows.select(
        "doc_id", F.size("s").cast("long").alias("segments"), count(lambda x: x["kind"] == "math").alias("formulas"), count(lambda x: x["display"]).alias("displayed"),
        F.sha2(F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["value"])), "\n"), 256).alias("digest"),
    )
