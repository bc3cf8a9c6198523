"""Small functions that no query runs."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import digests, text as tx
from quillon.operators import catalog, evidence, linkage, projections, quality, selection, versions
from quillon.sources import documents, tables


def column(spark, rows, ddl, expr):
    return [r[0] for r in spark.createDataFrame(rows, ddl).select(expr).collect()]


def test_text_keys(spark):
    rows = [("Éa ﬁne  STRAẞE",), ("a-b_c",), ("",), (None,)]
    assert column(spark, rows, "t string", tx.ascii_slug("t")) == ["ea-fine-strae", "a-b-c", "", None]
    assert column(spark, rows, "t string", tx.comparison_key("t"))[1:] == ["a b c", "", None]
    keys = column(spark, [("“Minus” − and – dash… of a line",), ("short",), (None,)], "t string", tx.search_key("t"))
    assert keys == ['"minus" - and - dash... of a line', None, None]
    assert column(spark, [("abcd", "abcx"), ("", ""), (None, "a")], "a string, b string", tx.char_ratio("a", "b")) == [0.75, 1.0, 0.0]
    assert tx.shown("<p>a<img src=x></p><![foo[b]]>c") == ("ac", True)


def test_lookups(spark):
    subjects = spark.createDataFrame([(1, "trees"), (2, "graphs")], "id long, slug string")
    assert catalog.by_reference(subjects, "2").first()["slug"] == "graphs" and catalog.by_reference(subjects, "trees").first()["id"] == 1
    assert tables.point(subjects, "id", 1).count() == 1 and tables.of_owner(subjects, "trees", "slug").count() == 1
    assert catalog.search(subjects, needle="  ", text_columns=["slug"], active_only=False).count() == 2
    options = column(spark, [([(" a ", " x "), (None, "y"), ("b", " ")],)], "o array<struct<id:string,text:string>>", catalog.clean_options(F.col("o")))
    assert [tuple(o) for o in options[0]] == [("A", "x")]
    with pytest.raises(ValueError, match="missing columns"):
        tables.frozen(subjects, ["id", "name"])


def test_pages_and_owners(spark):
    pages = spark.createDataFrame([("d", 1, "x" * 250, "ocr", 0.9), ("d", 2, "x", "ocr", 0.9), ("d", 3, "x", None, None)], "doc string, page long, text string, ocr_text string, ocr_confidence double")
    assert [(r["method"], r["confidence"]) for r in documents.page_text(pages).orderBy("page").collect()] == [("text", 0.98), ("ocr", 0.9), ("low_text", 0.35)]
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "user_id long, x string")
    owners = spark.createDataFrame([(1, 9)], "guest long, account long")
    assert {r["user_id"] for r in versions.transfer_owner(rows, owners).collect()} == {9, 2}


def test_claims_by_meaning(spark):
    rows = [("nat", "3.50", ["3.5", "3.500"]), ("msq", "A,C", ["c a"]), ("mcq", "A", ["B", None]), ("nat", None, ["1", "1.0"]), ("nat", None, ["1", "2"]), ("mcq", None, [])]
    claim = evidence.selected_claim(F.col("c"), F.col("s"), F.col("k"))
    got = [r["status"] for r in column(spark, rows, "k string, c string, s array<string>", claim)]
    assert got == ["canonical", "canonical", "conflict", "corroborated", "conflict", "missing"]


def test_guards(spark):
    items = spark.range(5).withColumnRenamed("id", "q")
    assert selection.session_items(items, "s", "q", 3).count() == 3
    with pytest.raises(ValueError, match="9 questions are wanted, 5"):
        selection.session_items(items, "s", "q", 9)
    assert quality.forbidden_fields(spark.createDataFrame([((1, [(2,)]),)], "a struct<x:long,ys:array<struct<answer:long>>>"), {"answer"}) == ["a.ys.answer"]
    at = column(spark, [("2024-01-02 03:04:05.000006",)], "t string", digests.portable_time(F.col("t").cast("timestamp")))
    assert at == ["2024-01-02T03:04:05.000006"]
    aliases = linkage.alias_lookup(spark.createDataFrame([(1, "Data Structures", "ds"), (2, "Databases", "DS")], "id long, name string, code string"), "id", ["name", "code"])
    assert {r["key"]: r["id"] for r in aliases.collect()} == {"datastructures": 1, "databases": 2, "ds": None}
    merged = projections.keyed_merge(spark.createDataFrame([(1, "r")], "k long, v string"), spark.createDataFrame([(1, "l"), (2, "l")], "k long, v string"), "k")
    assert {(r["k"], r["v"], r["origin"]) for r in merged.collect()} == {(1, "r", "remote"), (2, "l", "local")}


def test_markup_is_read_in_linear_time():
    import time

    from quillon.functions import markup

    for piece in ("<!--x", "<![x", "<a b", "</", "&a", "<", "<?x", "<!x", "<a '\">", "<script></x"):
        start = time.perf_counter()
        sum(1 for _ in markup.tokens(piece * 100_000))
        assert time.perf_counter() - start < 5, piece
    assert list(markup.tokens("a<b c='>'>d</b ><1 &lt;<i")) == [("text", "a", ""), ("open", "b", " c='>'"), ("text", "d", ""), ("close", "b", " "), ("text", "<", ""), ("text", "1 <", "")]
    assert markup.attributes(""" HREF='x&amp;y' alt="" a=b/c href=z it's""") == {"href": "x&y", "alt": "", "a": "b/c", "it's": ""}
    assert [x[:2] for x in markup.tokens("<title>a<b></title><script>if (a < b) '</p>'</script>x<style>y")] == [("open", "title"), ("text", "a<b>"), ("close", "title"), ("open", "script"), ("close", "script"), ("text", "x"), ("open", "style")]
