"""Tables whose extra columns have the names that operators join by, and the tables that a pipeline leaves."""

import os

import pytest
from pyspark.sql import functions as F

from quillon.llm import decontaminate, linededup, mixing, neardup
from quillon.llm.shared import kept, saved, shared_dir, stage

NAMES = ("_line_k1", "LINE_k2", "line_covered", "line_all", "line_left", "near_k1", "near_k2", "near_key", "mix_k1", "mix_k2", "mix_rate", "mix_copies", "leak_k1", "leak_k2", "leaks_of", "k1", "k2", "line_k1", "with.dot")
PASSAGE = "a river runs below the old bridge and over the stones to the wide grey sea"


@pytest.fixture(scope="module")
def docs(spark):
    lines = "one first line\nthe second line\nand a third line\n"
    rows = [(1, lines + "own end of this text"), (2, lines + "another end of that one"), (2, lines + "another end of that one"), (3, PASSAGE), (4, PASSAGE + " again"), (5, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(n) for n in NAMES})


def names_are_kept(df, more=()):
    rows = df.collect()
    assert df.columns == ["doc_id", "text", *NAMES, *more]
    assert rows and all(r[n] == n for r in rows for n in NAMES)
    return rows


def test_lines(docs):
    rows = names_are_kept(linededup.dedup_lines(docs, counts=True), ["n_lines", "n_removed"])
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (2, 3), (2, 3), (3, 0), (4, 0), (5, 0)]


def test_near_copies(docs):
    assert sorted(r["doc_id"] for r in names_are_kept(neardup.drop_near_duplicates(docs))) == [1, 2, 3, 5]


def test_mixture(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    names_are_kept(mixing.mix(docs, labels, {"high": 0.5, "low": 0.3, "toxic": 0.2}), ["rate", "copies"])


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_leaks(spark, docs, block):
    benchmark = spark.createDataFrame([(1, PASSAGE), (2, "nothing of this is held by any text above here")], "item_id long, text string")
    settings = decontaminate.LeakSettings(block_chars=block)
    assert sorted(r["doc_id"] for r in names_are_kept(decontaminate.drop_leaked(docs, benchmark, settings))) == [1, 2, 2, 5]
    assert sorted(r["doc_id"] for r in decontaminate.find_leaks(docs, benchmark, settings).where(F.size("leaks") > 0).collect()) == [3, 4]


def test_stages_leave_only_what_is_read(spark):
    place = shared_dir(spark)
    left = lambda: {n for n in os.listdir(place) if n.startswith("stage-")}
    with stage(spark):
        inner = saved(spark.range(3), "stage-inner")
        out, own = kept(inner.selectExpr("id + 1 AS id"), "stage-out")
        assert len(left()) == 2
    assert [n.split("-")[1] for n in left()] == ["out"] and out.count() == 3
    with pytest.raises(ZeroDivisionError), stage(spark):
        saved(spark.range(3), "stage-broken")
        1 / 0
    own.clear()
    assert not left()
