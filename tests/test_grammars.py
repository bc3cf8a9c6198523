"""Formulas, key tables and outlines: hand-made cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.functions import parsing
from quillon.operators import papers, transcripts

SEGMENTS = {
    r"a $x$ b": ["a ", ("x", False), " b"],
    r"\$5 and \$": [r"\$5 and \$"],
    "cost $5 and $10 then $x_1$": ["cost $5 and $10 then ", ("x_1", False)],
    r"\(a+b\) and \[c\] $$d$$": [("a+b", False), " and ", ("c", True), " ", ("d", True)],
    "$$$$": ["$$$$"],
    "$$ $$": [(" ", True)],
    "": [""],
    "no formula": ["no formula"],
    r"$a\$b = 1$ tail": [(r"a\$b = 1", False), " tail"],
    "open $$ only $y$": ["open $$ only ", ("y", False)],
    r"\\$z$": ["\\\\", ("z", False)],
    r"\\[q\]": ["\\", ("q", True)],
    "$5$ $": [("5", False), " $"],
    "$ $ and $": ["$ ", (" and ", False)],
    r"\(\) \(k\)": [r"\(\) ", ("k", False)],
    "$$a$$$b$": [("a", True), ("b", False)],
    "$two words$ $k+1$": ["$two words$ ", ("k+1", False)],
    "$\\alpha$\n$$\nx\ny\n$$": [("\\alpha", False), "\n", ("\nx\ny\n", True)],
    "é $α<β$ 😀": ["é ", ("α<β", False), " 😀"],
}


def test_math_segments(spark):
    rows = spark.createDataFrame([(t,) for t in SEGMENTS], "t string").select("t", parsing.math_segments(F.col("t")).alias("s")).collect()
    for r in rows:
        got = [(x["value"], x["display"]) if x["kind"] == "math" else x["value"] for x in r["s"]]
        assert got == SEGMENTS[r["t"]], r["t"]
        assert "".join(x["raw"] or x["value"] for x in r["s"]) == r["t"]
    assert spark.createDataFrame([(None,)], "t string").select(parsing.math_segments(F.col("t"))).first()[0] is None


def test_segments_give_the_text_back(spark):
    rng = random.Random(4)
    pieces = ["$", "$$", "\\", "\\[", "\\]", "\\(", "\\)", "x", " 5 ", "+", "\n", "\\$", "ab_1", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 25))) for _ in range(600)] + ["$" * 3001, "\\$" * 3000, "$a" + "\\$" * 5000, "x" * 200_000 + "$y$", "\\" * 500 + "$q$"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.math_segments(F.col("t")).alias("s")).collect()
    for r in rows:
        assert "".join(x["raw"] or x["value"] for x in r["s"]) == r["t"]
        kinds = [x["kind"] for x in r["s"]]
        assert all(a != b or a == "math" for a, b in zip(kinds, kinds[1:])), r["t"]
        assert all(x["value"] for x in r["s"]) or r["t"] == ""


KEYS = [
    ("typed", "1 MCQ CS A 1", [(1, "CS", "MCQ", "A", 1, "options", [["A"]], None, None)]),
    ("typed", "2 MSQ CS-1 A;C 2 0", [(2, "CS", "MSQ", "A;C", 2, "options", [["A", "C"]], None, None)]),
    ("typed", "3 NAT GA 3.1 to 3.2 OR −5 : 6 2", [(3, "GA", "NAT", "3.1 to 3.2 OR -5 : 6", 2, "ranges", None, [("3.1", "3.2"), ("-5", "6")], None)]),
    ("typed", "4 N A T C S 3 to 31", [(4, "CS", "NAT", "3 to 3", 1, "ranges", None, [("3", "3")], None)]),
    ("typed", "5M C Q G A marks  to all 1 6 MCQ CS a or b 1", [(5, "GA", "MCQ", "marks to all", 1, "marks_to_all", None, None, None), (6, "CS", "MCQ", "a or b", 1, "any_of", [["A"], ["B"]], None, None)]),
    ("typed", "7 MCQ CS A,B 1 8 NAT CS seven 1", [(7, "CS", "MCQ", "A,B", 1, "options", [["A", "B"]], None, "several"), (8, "CS", "NAT", "seven 1", None, None, None, None, "tail")]),
    ("typed_session_6", "16MCQ GA C 1 2 MCQ GA A 1", [(1, "GA", "MCQ", "C", 1, "options", [["C"]], None, None)]),
    ("untyped", "GA 1 A 1 CS 2 3.1 to 3.2 2", [(1, "GA", "MCQ", "A", 1, "options", [["A"]], None, None), (2, "CS", "NAT", "3.1 to 3.2", 2, "ranges", None, [("3.1", "3.2")], None)]),
    ("first_booklet", "CS 1B\nCS 2 Marks to All CS 3 x", [(1, "CS", "MCQ", "B", None, "options", [["B"]], None, None), (2, "CS", "MCQ", "Marks to All", None, "marks_to_all", None, None, None)]),
    ("typed", "", []),
]


@pytest.mark.parametrize("profile, text, want", KEYS)
def test_key_table(spark, profile, text, want):
    (row,) = spark.createDataFrame([(text,)], "t string").select(parsing.key_table(F.col("t"), profile).alias("r")).collect()
    got = [(r["number"], r["section"], r["kind"], r["raw"], r["marks"], r["shape"], r["choices"], None if r["ranges"] is None else [tuple(b) for b in r["ranges"]], r["problem"]) for r in row["r"]]
    assert [x if x[8] != "tail" else (*x[:6], None, None, x[8]) for x in got] == want


def test_key_text_is_cleaned_once(spark):
    plan = spark.createDataFrame([("",)], "t string").select(parsing.key_table(F.col("t"), "typed").alias("r"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("x{2212}") == 1


def test_clean_key_text(spark):
    """As by one pattern after the other."""
    rng = random.Random(12)
    pieces = ["M", "C", "Q", "S", "N", "A", "T", "G", "m", "c", "s", "q", "n", "a", "t", "g", " ", "  ", "\n", "\t", "1", "-", "\u2212", "\u2013", "\uf0b7", "é", "MCQ", "N A T", "g a", "C S", "."]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(0, 30))) for _ in range(3000)]

    def want(text):
        steps = (r"[\u2010-\u2014\u2212]", "-"), (r"\uf0b7", " "), *((rf"(?i)(?<![A-Za-z]){blank.join(w)}(?![0-9A-Za-z_é])", w) for w in ("MCQ", "MSQ", "NAT", "GA", "CS")), (r"[ \t\n\x0b\f\r]+", " ")
        for pattern, word in steps:
            text = re.sub(pattern, word, text)
        return text.strip(" ")

    blank = r"[ \t\n\x0b\f\r]*"
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", parsing.clean_key_text(F.col("t")).alias("c")).collect():
        assert r["c"] == want(r["t"]), r["t"]


def test_outline(spark):
    head = "Sets: PAPER CSE 2014 | Question: {}\nWhat?\n"
    pages = [
        ("b", 1, "Contents\n1 Sets and maps (2)\n2 Trees (1)\n3 Never there (4)\n1 Sets again (9)\n"), ("b", 2, "1.1.1\n1.1.2\n" + head.format(1) + head.format(2)),
        ("b", 3, "1.1.3\n" + head.format(1) + head.format(2)), ("b", 4, "no heading"), ("b", 5, "4.1.1\n" + head.format(7)), ("c", 1, head.format(1)), ("c", 2, None),
    ]
    df = spark.createDataFrame(pages, "book string, page long, text string")
    rows = papers.outline(df, "book", "page", "text")
    got = {(r["book"], r["page"], r["k"]): (r["number"], r["chapter"], r["title"], r["declared"], r["status"]) for r in rows.collect()}
    assert got == {
        ("b", 2, 1): ("1.1.1", "1", "Sets and maps", 2, "aligned"), ("b", 2, 2): ("1.1.2", "1", "Sets and maps", 2, "aligned"),
        ("b", 3, 1): (None, "1", "Sets and maps", 2, "withheld"), ("b", 3, 2): (None, "1", "Sets and maps", 2, "withheld"),
        ("b", 5, 1): ("4.1.1", "4", None, None, "aligned"), ("c", 1, 1): (None, None, None, None, "withheld"),
    }
    found = {tuple(r) for r in papers.outline_findings(rows, df, "book", "page", "text").collect()}
    assert found == {("b", "1", None, "count", 2, 4), ("b", "2", None, "count", 1, 0), ("b", "3", None, "count", 4, 0), ("b", "4", None, "unlisted", None, 1), ("b", None, 3, "page", None, 2), ("c", None, 1, "page", None, 1)}
    # the front ends at the longer of the least size and the eighth
    assert papers.contents(df, "book", "page", "text", least=30, share=1000).count() == 1


def test_mirrored_lists(spark):
    one = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 5, "x")], "k string, at long, v string")
    other = spark.createDataFrame([("k", 1, "b"), ("k", 2, "a"), ("m", 9, "x")], "k string, at long, v string")
    assert transcripts.mirrored(one, other, ["k"], [], place="at").count() == 4  # the first list is in another order
    assert transcripts.mirrored(one, other, ["k"], ["at"]).isEmpty() and transcripts.mirrored(one, one, ["k"], [], place="at").isEmpty()
