import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillon.functions import answers, digests, text as tx
from quillon.operators import catalog, linkage, mastery, quality, release, selection, sequences, versions


def one(spark, column, **values):
    df = spark.range(1)
    for name, value in values.items():
        df = df.withColumn(name, value if not isinstance(value, (str, int, float, type(None), list)) else F.lit(value))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "kind,answer,key,marks,expected",
    [
        ("mcq", "B", "A", 1, ("incorrect", -0.333333, 0.333333)),
        ("mcq", "B", "A", 2, ("incorrect", -0.666667, 0.666667)),
        ("mcq", " a ", "A", 2, ("correct", 2.0, 0.0)),
        ("msq", "C,A", "A,C", 2, ("correct", 2.0, 0.0)),
        ("msq", "A", "A,C", 2, ("incorrect", 0.0, 0.0)),
        ("nat", "3.145", "3.14", 1, ("correct", 1.0, 0.0)),
        ("nat", "3d", "3", 1, ("incorrect", 0.0, 0.0)),
        ("nat", "1.5", "1.49 to 1.51", 1, ("correct", 1.0, 0.0)),
        ("nat", None, "3", 1, ("unanswered", 0.0, 0.0)),
        ("msq", " ,; ", "A", 1, ("unanswered", 0.0, 0.0)),
    ],
)
def test_grade(spark, kind, answer, key, marks, expected):
    got = one(spark, answers.grade(F.col("k"), F.col("a"), F.col("key"), F.lit(0.01), F.col("m")), k=kind, a=F.lit(answer).cast("string"), key=key, m=marks)
    assert (got["status"], round(got["awarded"], 6), round(got["negative"], 6)) == expected


def test_intervals_and_fingerprints(spark):
    assert one(spark, answers.interval(F.lit("2 to 1"))) is None
    got = one(spark, answers.contains(F.array(answers.interval(F.lit("1.49:1.51"))), answers.interval(F.lit("1.50"))))
    assert got is True
    same = [one(spark, answers.fingerprint(F.lit("msq"), F.lit(a))) for a in ("B,A", "a; b")]
    assert same[0] == same[1]
    kinds = [one(spark, answers.inferred_kind(F.lit(a))) for a in ("A", "A;C", "1 to 2", "3.5", " ")]
    assert kinds == ["mcq", "msq", "nat", "nat", None]
    assert one(spark, answers.normalized(F.lit("msq"), F.lit("c|a"), F.array(F.lit("A"), F.lit("B"))))["problem"] == "unknown_option"


def test_mastery_example(spark):
    """Ten questions; right today, wrong 30 days ago, right 60 days ago."""
    now = dt.datetime(2024, 3, 1)
    rows = [(1, q, "s", "t", 1, int(s == "correct"), int(s != "correct"), 0, s, now - dt.timedelta(days=d), now - dt.timedelta(days=d)) for q, s, d in ((1, "correct", 0), (2, "incorrect", 30), (3, "correct", 60))]
    found = spark.createDataFrame(rows, "user_id long, question_id long, subject string, topic string, attempt_count long, correct_count long, incorrect_count long, unanswered_count long, latest_status string, latest_answered_at timestamp, last_attempted_at timestamp")
    questions = spark.range(1, 11).select(F.col("id").alias("question_id"), F.lit("s").alias("subject"), F.lit("t").alias("topic"), F.lit(True).alias("is_active"))
    got = mastery.topic_mastery(found, questions, F.lit(now)).first()
    assert (got["mastery"], got["status"]) == (54.79, "developing")


def test_text(spark):
    assert one(spark, tx.slug(F.lit("  Hello, World! "))) == "hello-world"
    assert one(spark, tx.label_key(F.lit("Q.081a"))) == "81.a" and one(spark, tx.label_key(F.lit("2.25"))) == "2.25" and one(spark, tx.label_key(F.lit("24-b"))) == "24.b"
    assert one(spark, tx.note_fields(F.lit("a=1; b = x=y;junk"))) == {"a": "1", "b": "x=y"}
    assert one(spark, tx.set_similarity(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a")))) == pytest.approx(0.9)
    flags = lambda s: one(spark, tx.quality_flags(F.lit(s)))
    assert "joined_formula_ocr" in flags("thenX = 3 holds") and "section_page_footer" in flags("CS 3/12") and flags("A clean question about trees.") == []
    assert tx.shown_text("<p>a&amp;b<script>x()</script></p>​") == "a&b" and tx.shown_text(None) is None
    assert tx.similarity("a b c", "a b c") == (0.0, 0.0, 0.0, 0.0)
    assert tx.similarity("a b c d e f g", "a b c d e f g")[0] == pytest.approx(1.0)
    df = spark.createDataFrame([("one two three four five six", "one two three four five seven")], "a string, b string")
    assert df.select(tx.text_similarity("a", "b").alias("s")).first()["s"]["coverage"] == pytest.approx(5 / 6)
    assert df.select(tx.search_key("a").alias("k")).first()["k"].startswith("one two")


def test_canonical_sha_sorts_keys(spark):
    a = one(spark, digests.canonical_sha({"b": F.lit(1), "a": F.lit(None).cast("string")}))
    import hashlib

    assert a == hashlib.sha256(b'{"a":null,"b":1}').hexdigest()
    assert one(spark, digests.hash_order("k", "7")) == hashlib.sha256(b"k:7").hexdigest()[:16]


def test_mutual_match(spark):
    rows = [("s1", 1, 0.95), ("s1", 2, 0.70), ("s2", 1, 0.75)]
    edges = spark.createDataFrame(rows, "s string, t long, score double")
    got = {r["s"]: r for r in linkage.mutual_best(edges, "s", "t", "score").collect()}
    assert got["s1"]["outcome"] == "accepted" and (got["s1"]["source_margin"], got["s1"]["target_margin"]) == (0.25, 0.2)
    assert got["s2"]["outcome"] == "review"
    close = linkage.mutual_best(spark.createDataFrame([("s1", 1, 0.90), ("s1", 2, 0.85)], "s string, t long, score double"), "s", "t", "score").first()
    assert (close["outcome"], close["source_margin"], close["target_margin"], close["mutual"]) == ("review", 0.05, 1.0, True)


def test_any_key_routes_and_graph(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, "y")], "i long, k string, m string")
    b = spark.createDataFrame([(10, "x", "y"), (11, "z", None)], "j long, k string, m string")
    assert sorted(map(tuple, linkage.any_key(a, b, "i", "j", ["k", "m"]).collect())) == [(1, 10), (2, 10)]
    nodes = spark.createDataFrame([("a",), ("b",), ("end",)], "code string")
    edges = spark.createDataFrame([("a", "b"), ("b", "gone")], "src string, dst string")
    kept, repaired = linkage.prune_graph(nodes, edges, nodes, "end")
    assert sorted(map(tuple, repaired.collect())) == [("a", "b"), ("b", "end")] and kept.count() == 3
    progress = spark.createDataFrame([(1, "a", 1, 100.0), (1, "b", 2, 0.0), (1, "c", 2, 0.0), (2, "a", 1, 10.0), (2, "b", 2, 0.0)], "user_id long, code string, level int, percent double")
    got = {r["user_id"]: (r["code"], r["reason"]) for r in linkage.next_node(progress, spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")).collect()}
    assert got == {1: ("b", "ready"), 2: ("a", "in_progress")}
    zipped = linkage.zip_lists(spark.createDataFrame([([1, 2], ["x", "y"]), ([1], ["x", "y"])], "a array<int>, b array<string>"), "a", "b").collect()
    assert [z["mismatch"] for z in zipped] == [False, True] and zipped[1]["pairs"] is None
    alias = linkage.alias_lookup(spark.createDataFrame([(1, "CS", "Comp Sci"), (2, "cs!", "Other")], "id long, code string, name string"), "id", ["code", "name"])
    assert {r["key"]: r["id"] for r in alias.collect()} == {"cs": None, "compsci": 1, "other": 2}


def test_sequences(spark):
    numbers = F.array(*(F.lit(x).cast("long") for x in (3, 1, 1, 2, 9, 3)))
    assert one(spark, sequences.accepted_sequence(numbers)) == [1, 3, 5]
    labels = F.array(*(F.lit(x) for x in "ABCDABDABCD"))
    assert one(spark, sequences.option_groups(labels)) == 2
    assert one(spark, sequences.floor_lookup(F.array(F.lit(0), F.lit(10)), F.lit(9))) == 0
    docs = spark.createDataFrame([(1, "ab\n\nc")], "id long, text string")
    assert [(r["line_no"], r["start"], r["line"]) for r in sequences.line_table(docs, "id", "text").orderBy("line_no").collect()] == [(0, 0, "ab"), (1, 3, ""), (2, 4, "c")]


def test_forced_markers(spark):
    places = [(0, 1), (10, 2), (12, 2), (20, 3), (5, 3), (30, 4)]
    assert sequences.marker_status(places) == ["forced", "ambiguous", "ambiguous", "forced", "impossible", "forced"]
    assert sequences.marker_status([(0, 1), (10, 3)]) == ["impossible", "impossible"] and sequences.marker_status([(0, 1), (10, 3)], ahead=2) == ["forced", "forced"]
    rows = spark.createDataFrame([("p", a, n) for a, n in places], "paper string, at long, n long")
    got = sequences.forced_markers(rows, "paper", "at", "n").where("status = 'forced'").orderBy("n").collect()
    assert [(r["at"], r["n"]) for r in got] == [(0, 1), (20, 3), (30, 4)]


def test_quality(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 2), ("c", 1), ("d", 0), ("d", 0)], "g string, n int")
    assert {r["g"]: r["contiguous"] for r in quality.contiguity(rows, "g", "n").collect()} == {"a": True, "b": False, "c": False, "d": False}
    assert quality.forbidden_fields(spark.sql("SELECT array(named_struct('secret', 1)) AS a"), {"secret"}) == ["a.secret"]
    gated = quality.gate(rows, {"zero": F.col("n") == 0, "odd": F.col("n") % 2 == 1}).collect()
    assert all(r["eligible"] == (r["n"] == 2) for r in gated)
    kids = spark.createDataFrame([(1, []), (2, ["own"])], "p long, assets array<string>")
    parents = spark.createDataFrame([(1, ["up"]), (2, ["up"])], "p long, assets array<string>")
    assert {r["p"]: r["assets"] for r in quality.inherited(kids, parents, "p", "assets").collect()} == {1: ["up"], 2: ["own"]}


def test_versions(spark):
    old = spark.createDataFrame([(1, "a", True), (2, "b", True), (3, "c", True), (4, "d", False), (5, "e", False)], "id long, v string, live boolean")
    new = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d"), (6, "f")], "id long, v string")
    plan = versions.merge_plan(old, new, "id", ["v"], "live")
    assert {r["id"]: r["op"] for r in plan.collect()} == {1: "unchanged", 2: "update", 3: "retire", 4: "reactivate", 5: "retired", 6: "insert"}
    versions.guard(plan, {"insert": 1, "update": 1})
    with pytest.raises(ValueError):
        versions.guard(plan, {"insert": 2})
    assert {r["id"]: r["op"] for r in versions.inverse(plan).collect()}[6] == "retire"
    assert versions.upload_decision([("v1", "x")], "v1", "y") == "refuse"
    rows = spark.createDataFrame([(1, 1, "k"), (2, 2, "k"), (3, 3, None)], "seq long, id long, k string")
    ops = versions.import_rows(rows.withColumn("k", F.coalesce("k", F.lit("?"))), rows.limit(0), ["k"], quality.codes({"no_key": F.col("k") == "?"}))
    assert {r["seq"]: r["op"] for r in ops.collect()} == {1: "insert", 2: "repeated", 3: "invalid"}


def test_packing(spark):
    import random

    rng = random.Random(3)
    # many blocks, one row, rows of the limit itself, a last block in which no shard begins
    sizes = {"a": [rng.randrange(1, 50) for _ in range(700)], "b": [7], "c": [100] * 40, "d": [rng.choice([1, 99, 100]) for _ in range(300)], "e": [1] * 900, "f": [60] * 13 + [19] + [1] * 3}
    rows = [(k, 3 * i, n) for k, own in sizes.items() for i, n in enumerate(own)]
    want = {}
    for kind, own in sizes.items():
        shard, held = 0, 0
        for i, n in enumerate(own):
            if held + n > 100:
                shard, held = shard + 1, 0
            held += n
            want[kind, 3 * i] = (n, shard)
    df = spark.createDataFrame(rows, "kind string, i long, n long").repartition(6)
    got = {(r["kind"], r["i"]): (r["n"], r["shard"]) for r in release.packed(df, "kind", "i", "n", 100).collect()}
    assert got == want
    assert release.packed(df.limit(0), "kind", "i", "n", 100).count() == 0
    with pytest.raises(Exception, match="exceeds the shard limit"):
        release.packed(df, "kind", "i", "n", 10)


def test_selection(spark):
    assert one(spark, selection.rotated(F.array(F.lit(1), F.lit(2), F.lit(3)), F.lit(4))) == [2, 3, 1]
    assert catalog.page_numbers(1000, 50, 9) == [1, None, 8, 9, 10, None, 20]
    items = spark.createDataFrame([("f", f"g{k % 3}", ("mcq", "msq", "nat")[k % 2], k) for k in range(30)], "form string, g string, kind string, id long")
    chosen = selection.balanced_form(items, "form", "g", "kind", "id", ("mcq", "msq"), 7).collect()
    assert len(chosen) == 7 and {r["kind"] for r in chosen} == {"mcq", "msq"} and {r["g"] for r in chosen} == {"g0", "g1", "g2"}
    picked = selection.quota_form(items, F.array(F.lit("x")), F.col("kind"), {"mcq": 4, "nat": 2}, "id")
    short = selection.shortfalls(picked, {"mcq": 4, "nat": 2}, ["x"]).collect()
    assert [(r["stratum"], r["found"]) for r in short] == [("nat", 0)]


def test_decisions(spark):
    from quillon.functions import parsing
    from quillon.operators import evidence

    assert parsing.resolve_references('[{"a": 1, "b": 2}, "x", [1, 1]]') == '{"a": "x", "b": ["x", "x"]}'
    with pytest.raises(ValueError):
        parsing.resolve_references('[{"a": 1}, [0]]')
    got = spark.createDataFrame([('[[1], 5]',), ("[[0]]",), ("{",), (None,)], "p string").select(parsing.referenced_json("p").alias("j")).collect()
    assert [r["j"] for r in got] == ["[5]", None, None, None]
    row = one(spark, parsing.key_row(F.lit("14 NAT 3.1 to 3.2 2")))
    assert (row["number"], row["kind"], row["answer"], row["marks"], row["shape"]) == (14, "nat", "3.1 to 3.2", 2, "value")
    assert one(spark, parsing.key_row(F.lit("page 3"))) ["number"] is None
    assert one(spark, parsing.heading(F.lit("1.2 Trees: Paper 2014 | Question: 5")))["year"] == 2014
    decided = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "k string, sha string")
    now = spark.createDataFrame([("a", "x"), ("b", "other")], "k string, sha string")
    assert {r["k"]: r["problem"] for r in evidence.drifted(decided, now, "k", "sha").collect()} == {"b": "changed", "c": "gone"}
    with pytest.raises(ValueError):
        evidence.require_no_drift(decided, now, "k", "sha")
