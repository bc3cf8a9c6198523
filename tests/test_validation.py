"""Rules of validators on hand-made rows, and flags on literal cases."""

import pytest
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import papers, projections, quality, selection, validation


def flags_of(spark, text):
    return spark.createDataFrame([(text,)], "t string").transform(lambda d: tx.with_quality_flags(d, "t")).first()["flags"]


@pytest.mark.parametrize("text, wanted", [
    ("0 GATE 2018 General Aptitude (GA) Set-3 GA 2/3", {"paper_header", "section_page_footer"}),
    ("Six green faces and one red face. CS 1/20", {"section_page_footer"}),
    ("IfP=2 and R=3, thenQ+S=7.", {"joined_formula_ocr"}),
    ("Copyright: GATE 2019 of the institute", {"copyright_footer"}),
    ("Whichoneof these holds", {"joined_word_ocr"}),
    ("the following circuit has two gates", {"visual_dependency"}),
    ("a glyph  here", {"private_use_math_glyph"}),
    ("see a b c d e there", {"spaced_character_ocr"}),
    ("what is returned by f(", {"truncated_prompt"}),
    ("A plain question about trees?", set()),
    ("", set()),
])
def test_quality_flags(spark, text, wanted):
    found = set(flags_of(spark, text))
    assert wanted <= found and (wanted or not found)


def test_record_flags(spark):
    rows = [(1, "int main { return 0;", ["a", "b"]), (2, "plain", ["see (b)", "c"]), (3, "plain", None), (4, None, ["x"])]
    df = tx.with_quality_flags(spark.createDataFrame(rows, "id long, t string, o array<string>"), "t", "flags", "o")
    got = {r["id"]: r["flags"] for r in df.collect()}
    assert "unbalanced_code_delimiters" in got[1] and got[2] == ["nested_option_label"] and got[3] == [] and got[4] == []


def test_question_rules(spark):
    option = "array<struct<id:string,text:string>>"
    good = ("q-1", "mcq", "easy", "original", 1, "What?", "because it is so, as shown", [("A", "1"), ("B", "2"), ("C", "3"), ("D", "4")], ["B"], None, None, None, None)
    row = lambda **kw: tuple(kw.get(n, v) for n, v in zip(names, good))
    names = ["external_id", "question_type", "difficulty", "source_kind", "marks", "text", "explanation", "options", "answer", "range", "source_year", "source_paper", "source_number"]
    schema = f"external_id string, question_type string, difficulty string, source_kind string, marks long, text string, explanation string, options {option}, answer array<string>, range struct<lo:double,hi:double>, source_year long, source_paper string, source_number long"
    cases = {
        (): row(), ("bad_external_id",): row(external_id="Q 1"), ("mcq_answer",): row(answer=["E"]), ("msq_answer",): row(question_type="msq", answer=["A", "A"]),
        ("nat_answer",): row(question_type="nat", options=[], answer=[], range=(3.0, 1.0)), ("nat_options",): row(question_type="nat", answer=[], range=(1.0, 1.0)),
        ("not_four_options",): row(options=good[7][:3]), ("option_labels",): row(options=good[7][::-1]), ("provenance_missing",): row(source_kind="previous_year"), ("number_prefix",): row(text="Q. 12 what?"),
        ("empty_question",): row(text="  "), ("short_explanation",): row(explanation=None), ("bad_marks",): row(marks=5), ("bad_difficulty",): row(difficulty="none"),
    }
    df = spark.createDataFrame(list(cases.values()), schema)
    got = [tuple(r["c"]) for r in df.select(quality.codes(validation.question_rules()).alias("c")).collect()]
    assert got == list(cases)


def test_parsed_options(spark):
    cases = {
        "Which? (A) one (B) two (C) three (D) four": ("parenthesized", None), "Which?\nA. one\nB. two\nC. three\nD. four": ("line_letter", None), "Which?": (None, "no_options"),
        "Which? (A) one (B) two (D) four": (None, "incomplete"), "Which? (B) one (A) two (C) x (D) four": (None, "incomplete"), "Which? (A) (B) two (C) three (D) four": (None, "empty_option"), None: (None, "no_options"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select(validation.parsed_options(F.col("t")).alias("o"))
    assert [(r["o"]["scheme"], r["o"]["reason"]) for r in df.collect()] == list(cases.values())


def test_labels_and_slots(spark):
    slots = spark.createDataFrame([(1, "2.25", 25), (1, "3", 3), (1, "03", 4)], "p long, label string, ordinal long")
    asked = spark.createDataFrame([(1, "Q 2.25"), (1, "3"), (1, "9"), (1, "x"), (2, "2.25"), (1, None)], "p long, label string")
    got = {(r["p"], r["label"]): (r["ordinal"], r["outcome"]) for r in papers.located(asked, slots, "p", "label").collect()}
    assert got == {(1, "Q 2.25"): (25, "linked"), (1, "3"): (None, "ambiguous"), (1, "9"): (None, "missing"), (1, "x"): (None, "unreadable"), (2, "2.25"): (None, "missing"), (1, None): (None, "unreadable")}


def daily_walk(keys, cycles, seed="daily-focus:"):
    """The order of each cycle from 0 on, one after the other, with 32-bit arithmetic."""
    mask = 0xFFFFFFFF

    def numbers(text):
        state = 0x811C9DC5
        for c in text:
            state = (state ^ ord(c)) * 0x01000193 & mask
        while True:
            state = (state + 0x6D2B79F5) & mask
            v = (state ^ state >> 15) * (state | 1) & mask
            v ^= (v + ((v ^ v >> 7) * (v | 61) & mask)) & mask
            yield v ^ v >> 14

    before, out = None, []
    for cycle in range(cycles):
        own, drawn = sorted(keys), numbers(f"{seed}{cycle}")
        for i in range(len(own) - 1, 0, -1):
            j = int(next(drawn) / 2**32 * (i + 1))
            own[i], own[j] = own[j], own[i]
        if len(own) > 1 and own[0] == before:
            own[0], own[1] = own[1], own[0]
        before = own[-1] if own else None
        out.append(own)
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 4, 25, 64])
def test_daily_items(spark, n):
    """The cycles walked one by one; each has every item once, and no seam repeats an item."""
    keys = [f"topic-{k:02}" for k in range(n)]
    items = spark.createDataFrame([(k,) for k in keys[::-1] + keys[:1]], "item string")
    days = spark.createDataFrame([(d,) for d in range(-3, 30 * n)], "day long")
    got = {r["day"]: r["item"] for r in selection.daily_items(items, days, "day", "item").collect()}
    walked = [x for own in daily_walk(keys, 30) for x in own]
    assert [got[d] for d in range(30 * n)] == walked
    assert [got[d] for d in range(-3, 0)] == [keys[d % n] for d in range(-3, 0)]
    assert n == 1 or all(a != b for a, b in zip(walked[n - 1 :: n], walked[n::n]))
    assert selection.daily_items(items.limit(0), days, "day", "item").count() == 0


def test_day_changes_at_local_midnight(spark):
    rows = spark.createDataFrame([("2026-08-11T18:29:59.999Z",), ("2026-08-11T18:30:00.000Z",)], "t string").select(F.col("t").cast("timestamp").alias("t"))
    (d1, left1), (d2, left2) = sorted(tuple(r) for r in rows.select(selection.day_number(F.col("t")), selection.until_next_day(F.col("t"))).collect())
    assert (d2, left1, left2) == (d1 + 1, 1, 86_400_000)


def test_markers_and_options(spark):
    df = spark.createDataFrame([("Question Number: 5 What?", "5"), ("Q.5 What?", "5"), ("5. What?", "5"), ("51. What?", "5"), ("2.5 What?", "2.5")], "t string, label string")
    got = [(r["m"] or (None, None))[0] for r in df.select(projections.without_marker(F.col("t"), F.col("label")).alias("m")).collect()]
    assert got == ["What?", "What?", "What?", None, "What?"]


def test_coverage_names_absent_and_unexpected_groups(spark):
    expected = spark.createDataFrame([("a", 2), ("b", 1), ("c", 5)], "g string, expected long")
    observed = spark.createDataFrame([("a", 1), ("a", 0), ("c", 1), ("z", 1)], "g string, ok long")
    got = {r["g"]: (r["observed"], r["good"], r["grade"]) for r in papers.coverage(expected, observed, ["g"], {"good": F.col("ok") == 1}).collect()}
    assert got == {"a": (2, 1, "complete"), "b": (0, 0, "absent"), "c": (1, 1, "partial"), "z": (1, 1, "unexpected")}
