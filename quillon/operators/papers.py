"""Papers and their slots: expected grids, locators, adoption of old rows, evidence on pages.

A slot is (paper, ordinal).  Every operator returns a row for each input row or slot with an
outcome; what can't be decided is named, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import text as tx


def regime_slots(papers: DataFrame, paper: str, year: str, regimes: list[tuple[int, int]]) -> DataFrame:
    """(paper, ordinal) of every expected slot; `regimes`: (first year, slots), the last one that has begun holds."""
    count = F.lit(0)
    for first, slots in sorted(regimes):
        count = F.when(F.col(year) >= first, F.lit(slots)).otherwise(count)
    return papers.select(paper, count.cast("long").alias("_n")).where("_n > 0").select(paper, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("ordinal"))


def resolved_papers(locators: DataFrame, papers: DataFrame, year: str, number: str, paper: str) -> DataFrame:
    """The paper of each locator: the only one of its year, else the only one of its year and set number, else none."""
    by_year = papers.groupBy(year).agg(F.when(F.count("*") == 1, F.min(paper)).alias("_by_year"))
    by_set = papers.groupBy(year, number).agg(F.when(F.count("*") == 1, F.min(paper)).alias("_by_set"))
    found = locators.join(by_year, year, "left").join(by_set, [year, number], "left")
    rule = F.when(F.col("_by_year").isNotNull(), "year").when(F.col("_by_set").isNotNull(), "set").otherwise("unresolved")
    return found.withColumns({paper: F.coalesce("_by_year", "_by_set"), "rule": rule}).drop("_by_year", "_by_set")


def located(locators: DataFrame, slots: DataFrame, paper: str, label: str) -> DataFrame:
    """The slot that a locator's printed label means within its paper.

    Labels are compared in canonical form.  `slots`: (paper, label, ordinal).  linked, ambiguous (several slots
    have the label), missing, or unreadable.
    """
    key = tx.label_key(F.col(label))
    known = slots.select(paper, key.alias("_key"), "ordinal").where("_key IS NOT NULL").groupBy(paper, "_key").agg(F.count("*").alias("_n"), F.min("ordinal").alias("_ordinal"))
    found = locators.withColumn("_key", key).join(known, [paper, "_key"], "left")
    outcome = F.when(F.col("_key").isNull(), "unreadable").when(F.col("_n").isNull(), "missing").when(F.col("_n") > 1, "ambiguous").otherwise("linked")
    return found.withColumns({"ordinal": F.when(F.col("_n") == 1, F.col("_ordinal")), "outcome": outcome}).drop("_key", "_n", "_ordinal")


def paired_blocks(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Per key whether both sides have it exactly once: paired, repeated, left_only or right_only."""
    a = left.groupBy(*keys).agg(F.count("*").alias("_a"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_b"))
    outcome = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").when((F.col("_a") == 1) & (F.col("_b") == 1), "paired").otherwise("repeated")
    return a.join(b, keys, "full_outer").select(*keys, outcome.alias("outcome"))


def adopted(rows: DataFrame, slots: DataFrame, keys: list[str], row_id: str, safe: Column) -> DataFrame:
    """Old rows on their slots: verified (safe) or review; missing_slot, collision (several rows on one slot), unmapped (a null key)."""
    there = slots.select(*keys).distinct().withColumn("_there", F.lit(True))
    claims = rows.groupBy(*keys).agg(F.count("*").alias("_claims"))
    null_key = F.lit(False)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    found = rows.withColumn("_safe", F.coalesce(safe, F.lit(False))).join(there, keys, "left").join(claims, keys, "left")
    outcome = F.when(null_key, "unmapped").when(F.col("_there").isNull(), "missing_slot").when(F.col("_claims") > 1, "collision").when(F.col("_safe"), "verified").otherwise("review")
    return found.select(row_id, *keys, outcome.alias("outcome"))


def page_evidence(locators: DataFrame, pages: DataFrame, keys: list[str], label: str, row_id: str) -> DataFrame:
    """Whether the page that a locator names is there and lists its label: confirmed, label_not_on_page, no_page.

    `pages`: (keys, labels), an array of labels.
    """
    known = pages.select(*keys, F.col("labels").alias("_labels"))
    outcome = F.when(F.col("_labels").isNull(), "no_page").when(F.array_contains("_labels", F.col(label)), "confirmed").otherwise("label_not_on_page")
    return locators.join(known, keys, "left").select(row_id, outcome.alias("outcome"))


def reviewed_collisions(rows: DataFrame, ledger: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Slots that several rows claim, settled by a reviewed ledger (keys, chosen, preserved).

    settled: the chosen digest is that of one row, and the preserved ones are those of all the others; else
    not_reviewed, chosen_absent or duplicates_differ.
    """
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(digest)).alias("_digests")).where(F.size("_digests") > 1)
    found = groups.join(ledger, keys, "left")
    times = F.size(F.filter("_digests", lambda d: d == F.col("chosen")))
    others = F.filter("_digests", lambda d: d != F.col("chosen"))
    outcome = F.when(F.col("chosen").isNull(), "not_reviewed").when(times != 1, "chosen_absent").when(others != F.array_sort("preserved"), "duplicates_differ").otherwise("settled")
    return found.select(*keys, F.size("_digests").cast("long").alias("rows"), outcome.alias("outcome"))


def coverage(expected: DataFrame, observed: DataFrame, keys: list[str], counts: dict[str, Column]) -> DataFrame:
    """Expected rows per group against counts of what is there; groups with nothing are in it too.

    `expected`: (keys, expected).  grade: complete, partial, absent, or unexpected (a group that nobody expects).
    """
    found = observed.groupBy(*keys).agg(F.count("*").alias("observed"), *(F.count_if(c).alias(name) for name, c in counts.items()))
    joined = expected.join(found, keys, "full_outer").na.fill(0, ["observed", *counts])
    grade = F.when(F.col("expected").isNull(), "unexpected").when(F.col("observed") == 0, "absent").when(F.col("observed") >= F.col("expected"), "complete").otherwise("partial")
    return joined.withColumn("grade", grade)


def claim_summary(resolved: DataFrame, paper: str, authority: Column) -> DataFrame:
    """Counts of resolutions by status and authority, in total and by paper."""
    rows = resolved.withColumn("authority", authority)
    return rows.groupingSets([[F.col(paper), F.col("status"), F.col("authority")], [F.col("status"), F.col("authority")], [F.col("status")]], paper, "status", "authority").agg(
        F.count("*").alias("slots"), F.grouping_id().cast("long").alias("level")
    )


# An entry of a table of contents (chapter, title, count), and the number that a book gives a question.
CONTENTS_ENTRY = r"(?m)^(\d{1,2})\s+([A-Z][^\r\n]{2,140}?)\s+\((\d+)\)\s*$"
BOOK_NUMBER = r"(?m)^(\d+\.\d+\.\d+)\s*$"
#: A question's heading: a topic, a paper with its year, and the question's label.
HEADING = r"(?m)^[^\r\n]{1,180}?\b(?:19|20)\d{2}\b[^\r\n|]*\|[ \t]*Question:[^\r\n]*$"


def contents(pages: DataFrame, book: str, page: str, text: str, least: int = 10_000, share: int = 8) -> DataFrame:
    """(book, chapter, title, declared) of a book's table of contents.

    It is looked for in the book's front only, its first eighth or 10,000 characters; of several entries of a chapter the
    first counts.  Pages count one more character each than they have.
    """
    size = pages.select(book, page, F.coalesce(F.length(text), F.lit(0)).alias("_size"))
    places = Window.partitionBy(book).orderBy(page)
    # a row of numbers for each page
    fronts = size.select(
        book, page, (F.sum(F.col("_size") + 1).over(places.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size") - 1).alias("_start"), F.sum(F.col("_size") + 1).over(Window.partitionBy(book)).alias("_all")
    )
    limit = F.greatest(F.lit(least), F.floor(F.col("_all") / share))
    front = pages.join(fronts.where(F.col("_start") < limit).withColumn("_take", (limit - F.col("_start")).cast("int")), [book, page])
    lines = front.select(book, page, F.posexplode(F.regexp_extract_all(F.substring(F.col(text), F.lit(1), F.col("_take")), F.lit(CONTENTS_ENTRY), 0)).alias("_k", "_line"))
    part = lambda k: F.regexp_extract("_line", CONTENTS_ENTRY, k)
    entries = lines.select(book, part(1).alias("chapter"), F.struct(page, "_k", F.trim(part(2)).alias("title"), part(3).cast("long").alias("declared")).alias("_e"))
    return entries.groupBy(book, "chapter").agg(F.min("_e").alias("_e")).select(book, "chapter", "_e.title", "_e.declared")


def outline(pages: DataFrame, book: str, page: str, text: str, pattern: str = HEADING) -> DataFrame:
    """(book, page, k, heading, number, chapter, title, declared, status) of every heading.

    A page shows its questions' numbers above its first heading, in the order of the headings.  They are paired only where there
    are as many of both (`aligned`); a page with other counts is `withheld`: its headings get no number, and the
    chapter of the last aligned heading before them in the book.  `title` and `declared` come from the table of contents.
    """
    above = F.get(F.split(F.col(text), pattern, 2), F.lit(0))
    found = pages.select(book, page, F.regexp_extract_all(F.col(text), F.lit(pattern), 0).alias("_h"), F.regexp_extract_all(above, F.lit(BOOK_NUMBER), 1).alias("_n")).where(F.size("_h") > 0)
    same = F.size("_h") == F.size("_n")
    rows = found.select(book, page, same.alias("_same"), F.posexplode(F.arrays_zip("_h", "_n")).alias("k", "_x")).where("_x._h IS NOT NULL")
    rows = rows.select(book, page, (F.col("k") + 1).cast("long").alias("k"), F.trim("_x._h").alias("heading"), F.when(F.col("_same"), F.col("_x._n")).alias("number"), F.when(F.col("_same"), "aligned").otherwise("withheld").alias("status"))
    # the last chapter up to each page, from one row a page
    chapter = F.substring_index("number", ".", 1)
    last = rows.groupBy(book, page).agg(F.max(F.struct("k", chapter.alias("c"))).alias("_m")).select(book, page, F.col("_m.c").alias("_c"))
    carried = last.select(book, page, F.last("_c", ignorenulls=True).over(Window.partitionBy(book).orderBy(page)).alias("_carried"))
    joined = rows.join(carried, [book, page]).withColumn("chapter", F.coalesce(chapter, "_carried")).drop("_carried")
    return joined.join(contents(pages, book, page, text), [book, "chapter"], "left").select(book, page, "k", "heading", "number", "chapter", "title", "declared", "status")


def outline_findings(headings: DataFrame, pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """(book, chapter, page, problem, expected, found): chapters whose headings aren't as many as declared (`count`), that no table of
    contents has (`unlisted`), and pages whose numbers don't pair with their headings (`page`)."""
    counted = headings.where("chapter IS NOT NULL").groupBy(book, "chapter").agg(F.count("*").alias("_found"))
    chapters = contents(pages, book, page, text).join(counted, [book, "chapter"], "full_outer").withColumn("_found", F.coalesce("_found", F.lit(0).cast("long")))
    problem = F.when(F.col("declared").isNull(), "unlisted").when(F.col("declared") != F.col("_found"), "count")
    none = F.lit(None).cast("long")
    by_chapter = chapters.select(book, "chapter", none.alias(page), problem.alias("problem"), F.col("declared").alias("expected"), F.col("_found").alias("found")).where("problem IS NOT NULL")
    withheld = headings.where("status = 'withheld'").groupBy(book, page).agg(F.count("*").alias("found"))
    by_page = withheld.select(book, F.lit(None).cast("string").alias("chapter"), F.col(page).cast("long").alias(page), F.lit("page").alias("problem"), none.alias("expected"), "found")
    return by_chapter.unionByName(by_page)
