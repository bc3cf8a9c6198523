"""Ordered operators: markers in pages, blocks between them, state machines over lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_per_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c for c in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_by_priority(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, start, line): lines with their offsets in the text, both from 0."""
    lines = docs.select(id_col, F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line_no", "line")).withColumn("line_no", F.col("line_no").cast("long"))
    before = Window.partitionBy(id_col).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long")
    return lines.select(id_col, "line_no", start.alias("start"), "line")


def blocks(markers: DataFrame, group: str, offset: str, length: Column) -> DataFrame:
    """Each marker's block ends where the next one of its group begins, the last at the text's length."""
    nxt = F.lead(offset).over(Window.partitionBy(group).orderBy(offset))
    return markers.withColumn("end", F.coalesce(nxt, length))


def accepted_sequence(numbers: Column) -> Column:
    """Places (from 0) of the numbers that are next in 1, 2, 3, ...: a greedy scan of an array."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("want"), F.array().cast("array<bigint>").alias("hits"))

    def step(acc: Column, x: Column) -> Column:
        hit = x == acc["want"]
        return F.struct((acc["at"] + 1).alias("at"), F.when(hit, acc["want"] + 1).otherwise(acc["want"]).alias("want"), F.when(hit, F.concat(acc["hits"], F.array(acc["at"]))).otherwise(acc["hits"]).alias("hits"))

    return F.aggregate(numbers, start, step)["hits"]


def option_groups(labels: Column) -> Column:
    """How many complete A, B, C, D runs an array of labels has: A starts anew, a wrong label ends the run."""
    def step(acc: Column, x: Column) -> Column:
        want = F.element_at(F.array(*(F.lit(c) for c in "ABCD")), acc["n"] + 1)
        n = F.when(x == "A", 1).when((acc["n"] > 0) & (x == want), acc["n"] + 1).otherwise(0)
        return F.struct(F.when(n == 4, 0).otherwise(n).alias("n"), (acc["done"] + (n == 4).cast("int")).alias("done"))

    return F.aggregate(labels, F.struct(F.lit(0).alias("n"), F.lit(0).alias("done")), step)["done"].cast("long")


def consecutive_labels(labels: Column, wanted: str = "ABCD") -> Column:
    """The labels are exactly the wanted ones, once each and in order."""
    return labels == F.array(*(F.lit(c) for c in wanted))


def floor_lookup(starts: Column, offset: Column) -> Column:
    """The last of the starts that isn't after the offset."""
    return F.array_max(F.filter(starts, lambda s: s <= offset))


def page_range(pages: DataFrame, group: str, page_col: str, boundary: Column, declared_end: Column) -> DataFrame:
    """Last page of each group: the one before the first boundary page, else the declared end."""
    return pages.groupBy(group).agg(F.coalesce(F.min(F.when(boundary, F.col(page_col))) - 1, F.max(declared_end)).alias("end_page"))


def marker_status(places: list[tuple[int, int]], ahead: int = 1) -> list[str]:
    """forced, ambiguous or impossible for each candidate (offset, number) of one paper.

    Markers count upwards with their offsets; up to `ahead` - 1 numbers may be missing
    between neighbours.  A candidate lies on a chain if it can be reached from a lowest
    number and can reach a highest one; it is forced if no other candidate of its number
    does.
    """
    order = sorted(range(len(places)), key=lambda i: places[i])
    low, high = (f(n for _, n in places) for f in (min, max)) if places else (0, 0)

    def reach(indices: list[int], start: int, sign: int) -> set[int]:
        # the best offset at which each number was reached so far
        best: dict[int, int] = {}
        found = set()
        for i in indices:
            offset, number = places[i]
            if number == start or any(best.get(number - sign * d, offset) * sign < offset * sign for d in range(1, ahead + 1)):
                found.add(i)
                best.setdefault(number, offset)
        return found

    chained = reach(order, low, 1) & reach(order[::-1], high, -1)
    count: dict[int, int] = {}
    for i in chained:
        count[places[i][1]] = count.get(places[i][1], 0) + 1
    return ["impossible" if i not in chained else "forced" if count[n] == 1 else "ambiguous" for i, (_, n) in enumerate(places)]


def forced_markers(markers: DataFrame, group: str, offset: str, number: str, ahead: int = 1) -> DataFrame:
    """(group, offset, number, status) of every candidate marker; a group is a paper, whose markers fit an array."""

    @F.pandas_udf("array<string>")
    def decide(lists: pd.Series) -> pd.Series:
        return lists.map(lambda found: marker_status([(x["o"], x["n"]) for x in found], ahead))

    listed = markers.groupBy(group).agg(F.collect_list(F.struct(F.col(offset).alias("o"), F.col(number).alias("n"))).alias("_m")).withColumn("_s", decide("_m"))
    rows = listed.select(group, F.explode(F.arrays_zip("_m", "_s")).alias("x"))
    return rows.select(group, F.col("x._m.o").alias(offset), F.col("x._m.n").alias(number), F.col("x._s").alias("status"))


def segment_markers(markers: DataFrame, group: str, label: str, at: str, wanted: list[str]) -> DataFrame:
    """(group, number, label, place, status) for every wanted label of each group; `number` counts from 1.

    Markers (group, label, place) are candidates; of every wanted label one is to be chosen, so that places rise.  A pass from
    the front gives each label its earliest place behind those before it, one from the back its latest place before those
    behind it.  A label with one candidate between the two is `chosen`, as every rising choice takes it; with several it is
    `ambiguous`.  A label without a candidate that the front pass can reach is `missing` and binds no other.
    A group is a paper: its markers are few, and fit an array.
    """
    places = markers.groupBy(group, F.col(label).alias("_label")).agg(F.array_sort(F.collect_set(F.col(at).cast("long"))).alias("_at"))
    by_label = places.where(F.col("_label").isin(wanted)).groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("_label", "_at"))).alias("_by"))
    every = markers.select(group).distinct().join(by_label, group, "left")
    none = F.array().cast("array<bigint>")
    lists = F.array(*(F.coalesce(F.col("_by")[F.lit(w)], none) for w in wanted))

    def passed(found: Column, limit: int, best, beyond) -> Column:
        start = F.struct(F.lit(limit).cast("long").alias("last"), none.alias("places"))

        def step(acc: Column, own: Column) -> Column:
            place = best(F.filter(own, lambda p: beyond(p, acc["last"])))
            return F.struct(F.coalesce(place, acc["last"]).alias("last"), F.concat(acc["places"], F.array(place)).alias("places"))

        return F.aggregate(found, start, step)["places"]

    first = every.withColumn("_lists", lists).withColumn("_first", passed(F.col("_lists"), -(1 << 62), F.array_min, lambda p, last: p > last))
    # what the front pass can't reach has no place in the pass from the back
    reached = F.zip_with("_lists", "_first", lambda own, e: F.when(e.isNotNull(), F.filter(own, lambda p: p >= e)).otherwise(none))
    last = first.withColumn("_reached", reached).withColumn("_last", F.reverse(passed(F.reverse("_reached"), 1 << 62, F.array_max, lambda p, edge: p < edge)))
    between = F.zip_with("_reached", "_last", lambda own, e: F.filter(own, lambda p: p <= e))
    rows = last.select(group, F.posexplode(between).alias("_k", "_own"))
    status = F.when(F.size("_own") == 0, "missing").when(F.size("_own") == 1, "chosen").otherwise("ambiguous")
    labels = F.array(*(F.lit(w) for w in wanted))
    place = F.when(F.size("_own") == 1, F.get("_own", F.lit(0)))
    return rows.select(group, (F.col("_k") + 1).cast("long").alias("number"), F.get(labels, F.col("_k")).alias(label), place.alias(at), status.alias("status"))


def page_blocks(markers: DataFrame, pages: DataFrame, doc: str, page: str, start: str, text: str) -> DataFrame:
    """The text from each marker (doc, page, start) to the next one of its document, over page borders, the last to the document's end.

    Pages (doc, page, text) count up; a page that isn't there is one without text.  `block` is the pieces, one a line, with
    blank runs as one blank; `pages` are those on which the block has a word, or the marker's own.  Ends are exclusive.
    Markers whose place isn't after the one before by page and offset, or behind their page's text, are `reversed` or
    `outside` and have no block.  A block is joined to its pages by their numbers, so no task holds a document.
    """
    sizes = pages.select(F.col(doc), F.col(page).alias("_page"), F.length(text).cast("long").alias("_size"))
    end = pages.groupBy(doc).agg(F.max(F.struct(F.col(page), F.length(text).cast("long").alias("size"))).alias("_end"))
    order = Window.partitionBy(doc).orderBy(page, start)
    placed = markers.withColumn("_next", F.lead(F.struct(F.col(page), F.col(start).alias("size"))).over(order)).join(end, doc).join(sizes.withColumnRenamed("_page", page), [doc, page], "left")
    to = F.coalesce("_next", "_end")
    status = F.when(F.col(start).isNull() | (F.col(start) < 0) | (F.col(start) > F.coalesce("_size", F.lit(0))), "outside").when((F.col("_next") == F.struct(F.col(page), F.col(start))), "reversed").otherwise("found")
    placed = placed.select(doc, page, start, status.alias("status"), to[page].alias("end_page"), to["size"].alias("end"))
    spread = placed.withColumn("_page", F.explode(F.when(F.col("status") == "found", F.sequence(page, "end_page")).otherwise(F.array(page))))
    joined = spread.join(pages.select(doc, F.col(page).alias("_page"), F.col(text).alias("_text")), [doc, "_page"], "left")
    begin = F.when(F.col("_page") == F.col(page), F.col(start)).otherwise(0)
    stop = F.when(F.col("_page") == F.col("end_page"), F.col("end")).otherwise(F.length("_text"))
    squashed = F.trim(F.regexp_replace(F.substring("_text", (begin + 1).cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int")), r"\s+", " "))
    piece = F.when((F.col("status") == "found") & (squashed != ""), F.struct("_page", squashed.alias("text")))
    blocks = joined.groupBy(doc, page, start, "status", "end_page", "end").agg(F.array_sort(F.collect_list(piece)).alias("_p"))
    touched = F.transform("_p", lambda x: x["_page"])
    return blocks.select(
        doc, page, start, "status", "end_page", "end", F.when(F.col("status") == "found", F.array_join(F.transform("_p", lambda x: x["text"]), " ")).alias("block"),
        F.when(F.size("_p") > 0, touched).otherwise(F.array(page)).alias("pages"),
    )
