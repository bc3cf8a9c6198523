"""Catalogue search: facets, text, pages, lookups and counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def same_text(column: str, value: str) -> Column:
    """Equality that ignores case."""
    return F.lower(column) == value.lower()


def text_match(columns: list[str], needle: str | None) -> Column:
    """The needle, taken literally, occurs in any of the columns, whatever the case; a blank one always does."""
    if needle is None or not needle.strip():
        return F.lit(True)
    low = F.lit(needle.strip().lower())
    return reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), low), F.lit(False)) for c in columns))


def search_text(columns: list[str]) -> Column:
    """The columns in lower case, one per line; a missing one is left out.  Compute it once and search it often."""
    return F.lower(F.concat_ws("\n", *columns))


def nested_match(column: str, needle: str) -> Column:
    """The needle occurs in the joined texts of an array of arrays, whatever the case; a blank one always does."""
    if not needle.strip():
        return F.lit(True)
    whole = F.lower(F.array_join(F.flatten(column), " ", ""))
    return F.coalesce(F.contains(whole, F.lit(needle.strip().lower())), F.lit(False))


def eligible(rows: DataFrame, safe: str, status: str, verified: str = "verified") -> DataFrame:
    """Rows marked safe and verified; a missing mark counts as both."""
    return rows.where(F.coalesce(safe, F.lit(True)) & (F.coalesce(status, F.lit(verified)) == verified))


def search(items: DataFrame, facets: dict[str, object] | None = None, needle: str | None = None, text_columns: list[str] | None = None, active_only: bool = True) -> DataFrame:
    """Conjunction of the facets that are given: a value, a list of values, or None for no filter."""
    out = items.where("is_active") if active_only else items
    for column, value in (facets or {}).items():
        if value is not None:
            out = out.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return out.where(text_match(text_columns or ["text"], needle))


def page(found: DataFrame, order: list, offset: int = 0, limit: int = 50) -> DataFrame:
    """One page with the exact total of the same predicate in each row; 1 to 100 rows."""
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy(*order).offset(max(0, offset)).limit(min(max(limit, 1), 100))
    return rows.join(F.broadcast(total))


def page_numbers(total: int, size: int, current: int) -> list[int | None]:
    """First, last and the neighbours of the current page, None for a gap."""
    last = max(1, -(-total // size))
    current = min(max(current, 1), last)
    wanted = sorted({1, last, *range(max(1, current - 1), min(last, current + 1) + 1)})
    out: list[int | None] = []
    for k in wanted:
        if out and k - (out[-1] or 0) > 1:
            out.append(None)
        out.append(k)
    return out


def by_reference(subjects: DataFrame, reference: str) -> DataFrame:
    """A subject by its id if the reference is digits, else by its slug."""
    return subjects.where(F.col("id") == int(reference)) if reference.isdigit() else subjects.where(F.col("slug") == reference)


def in_order(items: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The items that `ids` (pos, id) asks for with their place; unknown ids are left out, repeats repeat."""
    return ids.join(items, F.col("id") == F.col(id_col)).drop("id")


def public_view(questions: DataFrame) -> DataFrame:
    """Without the answer; the tolerance only for numeric questions."""
    tolerance = F.when(F.col("question_type") == "nat", F.lit(0.01))
    return questions.select("question_id", "subject", "topic", "question_type", "marks", "year", "text", tolerance.alias("tolerance"))


def clean_options(options: Column) -> Column:
    """array<struct<id,text>>: trimmed, without entries that lack an id or text."""
    trimmed = F.transform(options, lambda o: F.struct(F.upper(F.trim(o["id"])).alias("id"), F.trim(o["text"]).alias("text")))
    return F.filter(trimmed, lambda o: o["id"].isNotNull() & (o["id"] != "") & o["text"].isNotNull() & (o["text"] != ""))


def subject_counts(subjects: DataFrame, questions: DataFrame) -> DataFrame:
    """Topics and active questions of each subject, zero-filled."""
    counted = questions.groupBy("subject").agg(F.count_distinct("topic").alias("topics"), F.count_if("is_active").alias("active_questions"))
    return subjects.join(counted, "subject", "left").na.fill(0, ["topics", "active_questions"])


def type_histogram(questions: DataFrame, key: str, kinds: tuple[str, ...] = ("mcq", "msq", "nat")) -> DataFrame:
    """Counts over a fixed domain, zero where a kind is missing."""
    return questions.groupBy(key).agg(*(F.count_if(F.col("question_type") == k).alias(k) for k in kinds))


def manifest(questions: DataFrame) -> DataFrame:
    """Counts by subject x type, subject x marks, subject x topic, subject and in total, in one pass of grouping sets."""
    sets = [["subject", "question_type"], ["subject", "marks"], ["subject", "topic"], ["subject"], []]
    columns = ["subject", "question_type", "marks", "topic"]
    grouped = questions.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count("*").alias("questions"), F.count_distinct("year").alias("years"), F.grouping_id().alias("facet"))
    return grouped.select(*columns, "questions", "years", F.col("facet").cast("long").alias("facet"))


def accepted_answer(kind: Column, key: Column, tolerance: Column) -> Column:
    """How a key is shown: a range in words, a value with its tolerance, else as it is."""
    span = F.regexp_extract(key, r"^\s*(\S+)\s+to\s+(\S+)\s*$", 1)
    shown = F.when(span != "", F.concat(F.trim(key), F.lit(" (inclusive)"))).when(tolerance > 0, F.concat(F.trim(key), F.lit(" ± "), tolerance.cast("string"))).otherwise(F.trim(key))
    return F.when(kind == "nat", shown).otherwise(key)
