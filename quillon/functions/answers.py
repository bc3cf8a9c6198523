"""Grading of typed answers as column expressions.

Question types: mcq (one option), msq (a set of options), nat (a number).  An answer is a
string; several options are separated by commas, semicolons, bars or blanks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
CORRECT, INCORRECT, UNANSWERED = "correct", "incorrect", "unanswered"


def is_unanswered(answer: Column) -> Column:
    """Null, blank, or nothing but separators."""
    return F.coalesce(F.trim(F.regexp_replace(answer, r"[\s,;|]+", " ")), F.lit("")) == ""


def option(answer: Column) -> Column:
    return F.upper(F.trim(answer))


def options(answer: Column) -> Column:
    """The sorted distinct upper-case options."""
    parts = F.split(F.upper(F.coalesce(answer, F.lit(""))), r"[\s,;|]+")
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x != "")))


def number(answer: Column) -> Column:
    """The number, null if the text isn't plainly one (a cast alone takes '3d')."""
    return F.when(answer.rlike(NUMBER), answer.try_cast("double"))


def interval(text: Column) -> Column:
    """`a`, `a to b` or `a:b` as struct(lo, hi); null if it is neither or lo > hi."""
    pattern = r"^\s*([+-]?[\d.]+)\s*(?:(?:to|:)\s*([+-]?[\d.]+)\s*)?$"
    lo = F.regexp_extract(text, pattern, 1).try_cast("decimal(20,6)")
    end = F.regexp_extract(text, pattern, 2)
    hi = F.when(end == "", lo).otherwise(end.try_cast("decimal(20,6)"))
    return F.when(lo <= hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def contains(ranges: Column, one: Column) -> Column:
    """Whether one of an array of intervals holds the interval."""
    return F.exists(ranges, lambda r: (r["lo"] <= one["lo"]) & (one["hi"] <= r["hi"]))


def is_correct(kind: Column, answer: Column, key: Column, tolerance: Column) -> Column:
    """nat keys are `value` (within the tolerance) or `lo to hi`."""
    given = number(answer)
    span = interval(key)
    in_span = (given >= span["lo"].cast("double")) & (given <= span["hi"].cast("double"))
    near = F.abs(given - number(key)) <= tolerance
    nat = F.when(key.rlike(NUMBER), near).otherwise(in_span)
    right = F.when(kind == "mcq", option(answer) == option(key)).when(kind == "msq", options(answer) == options(key)).otherwise(nat)
    return F.coalesce(right, F.lit(False))


def penalty(kind: Column, marks: Column) -> Column:
    """A wrong single choice costs a third of its marks; other types cost nothing."""
    return F.when(kind == "mcq", F.round(marks.cast("double") / 3, 6)).otherwise(F.lit(0.0))


def outcome(kind: Column, marks: Column, blank: Column, right: Column) -> Column:
    """struct(status, awarded, negative) of a response that is blank, right or wrong."""
    status = F.when(blank, UNANSWERED).when(right, CORRECT).otherwise(INCORRECT)
    lost = F.when(blank | right, F.lit(0.0)).otherwise(penalty(kind, marks))
    awarded = F.when(blank, F.lit(0.0)).when(right, marks.cast("double")).otherwise(0.0 - lost)
    return F.struct(status.alias("status"), awarded.alias("awarded"), lost.alias("negative"))


def grade(kind: Column, answer: Column, key: Column, tolerance: Column, marks: Column) -> Column:
    """struct(status, awarded, negative)."""
    return outcome(kind, marks, is_unanswered(answer), is_correct(kind, answer, key, tolerance))


def before_deadline(answer: Column, now: Column, expires_at: Column) -> Column:
    """After the deadline every answer counts as none."""
    return F.when(expires_at.isNotNull() & (now >= expires_at), F.lit(None).cast("string")).otherwise(answer)


def fingerprint(kind: Column, answer: Column) -> Column:
    """A text that is equal for equivalent answers: options as a set, numbers by value, else squashed upper case."""
    value = F.when(number(answer).isNotNull(), F.concat(F.lit("nat:"), number(answer).cast("decimal(30,6)").cast("string")))
    several = F.concat(F.lit("set:"), F.array_join(options(answer), ","))
    return F.when(is_unanswered(answer), F.lit(None).cast("string")).when(kind.isin("mcq", "msq"), several).otherwise(F.coalesce(value, F.concat(F.lit("text:"), F.regexp_replace(F.upper(answer), r"\s+", ""))))


def same_answer(kind: Column, left: Column, right: Column) -> Column:
    """Whether the fingerprints of two answers are equal, null if one is unanswered; texts that differ in case only need no fingerprint."""
    equal = F.when(~is_unanswered(left), F.lit(True))
    return F.when(F.upper(left) == F.upper(right), equal).otherwise(fingerprint(kind, left) == fingerprint(kind, right))


def normalized(kind: Column, answer: Column, choices: Column) -> Column:
    """struct(value, problem): the answer in its canonical form, or why it has none."""
    several = options(answer)
    foreign = F.size(F.array_except(several, choices)) > 0
    problem = (
        F.when(is_unanswered(answer), "missing")
        .when((kind == "mcq") & (F.size(several) != 1), "not_one_option")
        .when(kind.isin("mcq", "msq") & foreign, "unknown_option")
        .when((kind == "nat") & number(answer).isNull() & interval(answer).isNull(), "not_numeric")
    )
    value = F.when(kind.isin("mcq", "msq"), F.array_join(several, ",")).otherwise(F.trim(answer))
    return F.struct(F.when(problem.isNull(), value).alias("value"), problem.alias("problem"))


def inferred_kind(answer: Column) -> Column:
    """One label: mcq; several: msq; a number or interval: nat; else null."""
    labels = options(answer)
    lettered = F.forall(labels, lambda x: x.rlike("^[A-Z]$"))
    return F.when(is_unanswered(answer), F.lit(None).cast("string")).when(lettered & (F.size(labels) == 1), "mcq").when(lettered, "msq").when(interval(answer).isNotNull() | number(answer).isNotNull(), "nat")
