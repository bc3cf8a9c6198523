"""Transcripts: where questions begin, what they show, which answers can be graded, what may be released."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import answers
from quillon.operators import quality


# How a question's number is printed, by the first year of the layout.  Two years print it in full.
MARKERS = ((0, r"(?i)^[ \t]*(?:Q\.[ \t]*(\d+)(?!\d)|(?:Q[ \t]*)?(\d+)[ \t]*\.)(?!\d)"), (2014, r"(?i)^[ \t]*Q(?:uestion)?(?:\.|[ \t])*(?:No\.?[ \t]*)?(\d+)(?!\d)"))
FULL_MARKER, FULL_YEARS = r"(?i)^[ \t]*Question[ \t]+Number[ \t]*:[ \t]*(\d+)(?!\d)", (2015, 2017)
# What follows a number that begins no question: a range of numbers, or an instruction.
RANGE_AFTER = r"(?i)^[ \t]*(?:[-–—]|to\b)[ \t]*(?:Q\.?[ \t]*)?\d+"
INSTRUCTION_AFTER = r"(?i)^[ \t]*(?:Do not|Take out|On the|This Question|There are|Since|Questions?[ \t]+Q|Unattempted|Calculator|Rough work|Before the start|Mobile phones?)"


def marked_lines(lines: DataFrame, year: str, line: str) -> DataFrame:
    """The lines that begin a question in the layout of their year, with its `number`."""

    def read(pattern: str) -> tuple[Column, Column]:
        groups = [F.nullif(F.regexp_extract(line, pattern, k), F.lit("")) for k in range(1, pattern.count(r"(\d+)") + 1)]
        return F.coalesce(*groups).try_cast("long"), F.regexp_replace(line, pattern, "")

    number, rest = read(MARKERS[0][1])
    for first, pattern in MARKERS[1:]:
        n, tail = read(pattern)
        number, rest = F.when(F.col(year) >= first, n).otherwise(number), F.when(F.col(year) >= first, tail).otherwise(rest)
    n, tail = read(FULL_MARKER)
    number, rest = F.when(F.col(year).isin(*FULL_YEARS), n).otherwise(number), F.when(F.col(year).isin(*FULL_YEARS), tail).otherwise(rest)
    found = lines.withColumns({"number": number, "_rest": rest}).where("number IS NOT NULL")
    return found.where(~F.col("_rest").rlike(RANGE_AFTER) & ~F.col("_rest").rlike(INSTRUCTION_AFTER)).drop("_rest")


def printed_ordinal(year: Column, ordinal: Column) -> Column:
    """The number under which a slot was printed: one layout prints the general section last, recent ones count through,
    those before them count each section on its own, and the oldest have no general section."""
    return (
        F.when(year == 2017, F.when(ordinal >= 11, ordinal - 10).otherwise(ordinal + 55)).when((year == 2015) | (year >= 2022), ordinal)
        .when(year >= 2014, F.when(ordinal >= 11, ordinal - 10).otherwise(ordinal)).otherwise(ordinal)
    )


# What tells that a prompt needs a figure; the first group is proof, the others are signs.
_NAMED = r"(?:figure|diagram|flow\s*chart|circuit|waveform|plot|table)"
SIGNALS = {
    "explicit_image_placeholder": r"(?i)\[(?:image|figure|diagram)\s*:",
    "named_visual_shown": r"(?is)\b(?:figure|diagram|flow\s*chart|circuit|waveform|plot|state\s+(?:transition\s+)?diagram|network\s+diagram|tree\s+diagram|table)\b.{0,72}\b(?:shown|given|depicted|illustrated|below|above|following|presents?)\b",
    "shown_named_visual": rf"(?is)\b(?:shown|given|depicted|illustrated|presented)\b.{{0,72}}\b(?:in|by|as)?\s*(?:the\s+)?(?:following\s+)?{_NAMED}\b",
    "deictic_visual_reference": rf"(?i)\b(?:the|this|following|above|below)\s+{_NAMED}\b",
    "visual_option_reference": r"(?i)\b(?:which|one)\s+of\s+the\s+(?:following\s+)?(?:figures|diagrams|circuits|waveforms|plots|trees|graphs)\b",
}


def visual_signals(prompt: Column, hint: Column, options_ready: Column) -> Column:
    """Sorted signals that a prompt depends on a figure."""
    rules = {name: prompt.rlike(pattern) for name, pattern in SIGNALS.items()}
    rules |= {"secondary_remote_visual_locator_hint": hint, "prompt_unavailable_for_visual_audit": F.coalesce(F.trim(prompt), F.lit("")) == "", "objective_options_not_safely_transcribed": ~options_ready}
    return quality.codes(rules)


def dependence(signals: Column, has_pages: Column, has_crop: Column) -> Column:
    """struct(status, evidence): asset_ready, missing, review_required or not_required; confirmed, potential or not_detected."""
    proof = F.array(*(F.lit(x) for x in (*SIGNALS, "secondary_remote_visual_locator_hint")))
    confirmed = F.arrays_overlap(signals, proof)
    status = F.when(has_crop, "asset_ready").when(confirmed & ~has_pages, "missing").when(F.size(signals) > 0, "review_required").otherwise("not_required")
    evidence = F.when(has_crop | confirmed, "confirmed").when(F.size(signals) > 0, "potential").otherwise("not_detected")
    return F.struct(status.alias("status"), evidence.alias("evidence"))


def gradable(kind: Column, shape: Column, answer: Column) -> Column:
    """struct(value, review) of a verified answer: what can be graded, or why it can't."""
    options, span = answers.options(answer), answers.interval(answer)
    numeric = F.concat_ws(" to ", span["lo"].cast("double").cast("string"), span["hi"].cast("double").cast("string"))
    value = (
        F.when((shape == "value") & (kind == "mcq") & (F.size(options) == 1), F.array_join(options, ","))
        .when((shape == "value") & (kind == "msq") & (F.size(options) > 0), F.array_join(options, ",")).when((shape == "value") & (kind == "nat") & span.isNotNull(), numeric)
    )
    review = (
        F.when(value.isNotNull(), F.lit(None).cast("string")).when(shape == "marks_to_all", "marks_to_all_not_auto_scorable").when(shape == "any_of", "alternative_answers_not_auto_scorable")
        .when(shape == "value", "verified_answer_type_mismatch").otherwise("verified_answer_shape_unsupported")
    )
    return F.struct(value.alias("value"), review.alias("review"))


def split_safe(rows: DataFrame, rules: dict[str, Column], confidences: list[str], least: float) -> DataFrame:
    """Rows with `reason` (the first rule that turns them down, else low_confidence), `confidence` (the least one) and `safe`."""
    lowest = F.least(*confidences) if len(confidences) > 1 else F.col(confidences[0])
    reason = quality.first_code(rules | {"low_confidence": F.coalesce(lowest < least, F.lit(True))})
    return rows.withColumns({"confidence": lowest, "reason": reason, "safe": reason.isNull()})


def overlay_status(base: Column, overlay: Column, ratio: Column, exact_at: float = 0.85, review_at: float = 0.60) -> Column:
    """How an overlay's text stands to a slot: kept, exact, review or unresolved."""
    return F.when(base.isNotNull(), "kept").when(overlay.isNull(), "unresolved").when(ratio >= exact_at, "exact").when(ratio >= review_at, "review").otherwise("unresolved")


def same_key_sets(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(keys, absent_from) of the keys that not all of the inputs have."""
    marked = [df.select(*keys).distinct().withColumn("_in", F.lit(name)) for name, df in frames.items()]
    every = reduce(DataFrame.unionByName, marked).groupBy(*keys).agg(F.collect_set("_in").alias("_in"))
    absent = F.array_sort(F.array_except(F.array(*(F.lit(n) for n in frames)), "_in"))
    return every.select(*keys, absent.alias("absent_from")).where(F.size("absent_from") > 0)


def mirrored(source: DataFrame, published: DataFrame, keys: list[str], neutral: list[str], place: str | None = None) -> DataFrame:
    """Rows that differ between a source and its published copy, apart from the neutral columns.

    With `place`, a column by which the rows of a key are a list, the number of a row in its key's list counts instead of the
    column's value: a reordered list differs, one that only starts elsewhere doesn't.
    """
    columns = [c for c in source.columns if c not in neutral]

    def ranked(df: DataFrame) -> DataFrame:
        if place is None:
            return df.select(*columns)
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(place, *(c for c in columns if c not in (*keys, place))))
        return df.select(*columns).withColumn(place, number.cast("long"))

    left, right = ranked(source), ranked(published)
    return left.exceptAll(right).withColumn("side", F.lit("source")).unionByName(right.exceptAll(left).withColumn("side", F.lit("published")))


def shared_tokens(a: Column, b: Column) -> Column:
    """How many tokens two arrays have in common as multisets; for short arrays."""
    times = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x))).cast("long")
