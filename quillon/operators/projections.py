"""Projections of questions, archives, attempts and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import digests, text as tx


def lettered(texts: Column) -> Column:
    """Plain texts as options with the ids A, B, C, ...; blank ones are left out before they are lettered."""
    kept = F.filter(F.transform(texts, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return F.transform(kept, lambda x, k: F.struct(F.char(k + 65).alias("id"), x.alias("text")))


def named_options(options: Column, names: tuple[str, ...] = ("id", "label", "key"), texts: tuple[str, ...] = ("text", "value")) -> Column:
    """array<map<string,string>> as options: the first synonym that isn't blank, ids in upper case, else the place's letter."""
    first = lambda o, keys: F.coalesce(*(F.nullif(F.trim(F.try_element_at(o, F.lit(k))), F.lit("")) for k in keys))
    return F.transform(options, lambda o, k: F.struct(F.upper(F.coalesce(first(o, names), F.char(k + 65))).alias("id"), first(o, texts).alias("text")))


def repeated_ids(options: Column) -> Column:
    ids = F.transform(options, lambda o: o["id"])
    return F.size(F.array_distinct(ids)) < F.size(ids)


def external_id(explicit: Column, previous: Column, year: Column, paper: Column, number: Column, identity: dict[str, Column]) -> Column:
    """The given id; else that of the provenance, if it is whole; else one from the content's digest."""
    given = F.nullif(F.trim(explicit), F.lit(""))
    whole = previous & year.isNotNull() & paper.isNotNull() & number.isNotNull()
    return F.coalesce(given, F.when(whole, F.concat(F.lit("pyq:"), year.cast("string"), F.lit(":"), tx.slug(paper), F.lit(":q"), number.cast("string"))), F.concat(F.lit("local:"), F.substring(digests.canonical_sha(identity), 1, 32)))


def archive_view(items: DataFrame, papers: DataFrame, paper: str, item: str) -> DataFrame:
    """Archive items with their paper's names; the runtime id only where an item is eligible and materialised."""
    ready = F.coalesce(F.col("eligible"), F.lit(False)) & F.col("runtime_id").isNotNull()
    return items.join(papers, paper).select(item, paper, *(c for c in papers.columns if c != paper), ready.alias("is_ready"), F.when(ready, F.col("runtime_id")).alias("runtime_id"))


def snapshot(columns: list[str]) -> Column:
    """The columns as they are now, as JSON with nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def hydrated(ids: DataFrame, snapshots: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """(ids, value, origin): from the snapshot, else from the live row; `missing` where neither is there."""
    a = snapshots.select(key, F.col(value).alias("_snapshot"), F.lit(True).alias("_a"))
    b = live.select(key, F.col(value).alias("_live"), F.lit(True).alias("_b"))
    origin = F.when(F.col("_a"), "snapshot").when(F.col("_b"), "live").otherwise("missing")
    joined = ids.join(a, key, "left").join(b, key, "left")
    return joined.withColumns({value: F.when(F.col("_a"), F.col("_snapshot")).otherwise(F.col("_live")), "origin": origin}).drop("_snapshot", "_live", "_a", "_b")


def reviewed(questions: DataFrame, reviews: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Questions with a review's values where it has any; `reviewed` tells which rows have one."""
    given = reviews.select(key, *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_reviewed"))
    joined = questions.join(given, key, "left")
    merged = {c: F.coalesce(f"_{c}", c) if c in questions.columns else F.col(f"_{c}") for c in columns}
    return joined.withColumns(merged | {"reviewed": F.coalesce("_reviewed", F.lit(False))}).drop(*(f"_{c}" for c in columns), "_reviewed")


def note(title: Column, summary: Column, lists: dict[str, Column]) -> Column:
    """A note in Markdown: title, summary, and a section of bullets for every list that isn't empty."""
    sections = [F.when(F.size(items) > 0, F.concat(F.lit(f"## {name}\n"), F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))) for name, items in lists.items()]
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.nullif(F.trim(summary), F.lit("")), *sections)


def record_view(rows: DataFrame, allowed: list[str], texts: str, hidden: str, prefer: str = "en") -> DataFrame:
    """Allow-listed columns, the preferred language's text (else the first by name), and of the hidden text only that it is there, and its digest."""
    first = F.get(F.array_sort(F.map_keys(texts)), F.lit(0))
    language = F.when(F.map_contains_key(texts, prefer), F.lit(prefer)).otherwise(first)
    there = F.coalesce(F.trim(hidden), F.lit("")) != ""
    return rows.select(*allowed, language.alias("language"), F.try_element_at(texts, language).alias("text"), there.alias(f"has_{hidden}"), F.when(there, F.sha2(hidden, 256)).alias(f"{hidden}_sha"))


def attempt_events(responses: DataFrame, sessions: DataFrame, session: str, item: str, payload: list[str]) -> DataFrame:
    """(session, events): the responses as one array in the order of presentation, unknown items last, then by id.

    `sessions`: (session, item_ids), the order in which items were presented.
    """
    at = F.array_position("item_ids", F.col(item))
    joined = responses.join(sessions.select(session, "item_ids"), session, "left")
    place = F.when(F.coalesce(at, F.lit(0)) > 0, at).otherwise(F.lit(2**31 - 1).cast("long"))
    listed = joined.groupBy(session).agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), F.col(item), *(F.col(c) for c in payload)))).alias("_all"))
    return listed.select(session, F.transform("_all", lambda x: F.struct(x[item].alias(item), *(x[c].alias(c) for c in payload))).alias("events"))


def decoded(documents: DataFrame, column: str, schema: str, required: list[str]) -> DataFrame:
    """JSON documents as typed columns; `problem` where one is broken or lacks a required field."""
    parsed = documents.withColumn("_doc", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    lacks = F.lit(False)
    for name in required:
        lacks = lacks | F.col(f"_doc.{name}").isNull()
    problem = F.when(F.col("_doc").isNull(), "broken").when(lacks, "incomplete")
    return parsed.select(*(c for c in documents.columns if c != column), "_doc.*", problem.alias("problem"))


def keyed_merge(remote: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Rows of both by key: the remote one wins, local ones that it lacks are appended; `origin` tells which."""
    rest = local.join(remote.select(key).distinct(), key, "left_anti")
    return remote.withColumn("origin", F.lit("remote")).unionByName(rest.withColumn("origin", F.lit("local")), allowMissingColumns=True)


def first_of(rows: DataFrame, priority: Column, keys: list[str], sequence: str) -> DataFrame:
    """A union with precedence: for one key after the other, only the first row by (priority, sequence) of each value stays."""
    out = rows.withColumn("_priority", priority)
    for key in keys:
        best = out.groupBy(key).agg(F.min(F.struct("_priority", sequence)).alias("_first"))
        out = out.join(best, key).where((F.col("_first._priority") == F.col("_priority")) & (F.col(f"_first.{sequence}") == F.col(sequence))).drop("_first")
    return out.drop("_priority")


def portable(columns: dict[str, Column], active: Column) -> Column:
    """A digest that doesn't depend on ids of a database: the flag as true or false, whole numbers without a fraction."""
    as_text = lambda c: F.regexp_replace(c.cast("string"), r"^(-?\d+)\.0+$", "$1")
    return digests.canonical_sha({k: as_text(c) for k, c in columns.items()} | {"is_active": F.coalesce(active, F.lit(True))})


def semantic_digest(kind: Column, stem: Column, options: Column, *, tail: str = r"(?i)\s*(?:Choose the correct value\.|Enter the numerical answer\.)\s*$", **scope: Column) -> Column:
    """A digest of what a question asks, whatever the form of its answer: the stem without the request for an answer,
    and for msq the sorted options."""
    plain = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    own = F.when(kind == "msq", F.array_sort(F.transform(options, plain))).otherwise(F.array().cast("array<string>"))
    return digests.canonical_sha(scope | {"stem": plain(F.regexp_replace(stem, tail, "")), "options": own})


def client_status(kind: Column, answer: Column, key: Column) -> Column:
    """correct, incorrect or unanswered by plain equality: sets of options, or numbers in canonical form, without a tolerance."""
    from quillon.functions import answers

    number = lambda c: F.coalesce(answers.number(c).cast("string"), F.trim(c))
    same = F.when(kind == "nat", number(answer) == number(key)).otherwise(answers.options(answer) == answers.options(key))
    return F.when(answers.is_unanswered(answer), answers.UNANSWERED).when(F.coalesce(same, F.lit(False)), answers.CORRECT).otherwise(answers.INCORRECT)


def without_marker(text: Column, label: Column) -> Column:
    """struct(rest, marker): a block without the question label that it begins with; both null if it begins with another."""
    escaped = F.regexp_replace(label, r"([.()])", r"\\$1")
    pattern = F.concat(F.lit(r"(?is)^\s*(Question\s+Number\s*:\s*"), escaped, F.lit(r"(?!\d)|Q(?:uestion)?(?:\.|\s)*(?:No\.?\s*)?"), escaped, F.lit(r"(?!\d)\.?|"), escaped, F.lit(r"(?!\d)\.?)\s*(.*)$"))
    part = lambda k: F.call_function("regexp_extract", text, pattern, F.lit(k))
    marker = part(1)
    return F.when(marker != "", F.struct(F.trim(part(2)).alias("rest"), F.trim(F.regexp_replace(marker, r"\.$", "")).alias("marker")))


def changed_metrics(rows: DataFrame, before: Column, after: Column, group: str) -> DataFrame:
    """Per group (and in total, group null): rows labelled before and after, gained, lost and changed."""
    old, new = before.isNotNull(), after.isNotNull()
    return rows.withColumns({"_old": before, "_new": after}).rollup(group).agg(
        F.count("*").alias("rows"), F.count_if(old).alias("before"), F.count_if(new).alias("after"), F.count_if(~old & new).alias("gained"),
        F.count_if(old & ~new).alias("lost"), F.count_if(old & new & (before != after)).alias("changed"),
    )


def gap_metrics(rows: DataFrame, base: Column, overlay: Column, exact: Column, group: str) -> DataFrame:
    """Per group how many texts lack before and after an overlay, and how many of those that it fills are exact or for review."""
    filled = base.isNull() & overlay.isNotNull()
    return rows.groupBy(group).agg(
        F.count("*").alias("rows"), F.count_if(base.isNull()).alias("missing_before"), F.count_if(base.isNull() & overlay.isNull()).alias("missing_after"),
        F.count_if(filled & exact).alias("exact"), F.count_if(filled & ~exact).alias("review"),
    )


def page_text(words: DataFrame, page: list[str], least: float) -> DataFrame:
    """Per page the recognised words over a confidence in reading order (top, left), and the mean confidence of these words.

    `words`: (page, top, left, text, confidence).
    """
    sure = words.where(F.col("confidence") >= least)
    listed = sure.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("top", "left", "text"))).alias("_words"), F.avg("confidence").alias("confidence"), F.count("*").alias("words"))
    return listed.select(*page, F.array_join(F.transform("_words", lambda w: w["text"]), " ").alias("text"), F.round("confidence", 6).alias("confidence"), "words")


def ranked_order(rank: Column, *columns: Column | str) -> list:
    """A sort by a custom rank, then by columns."""
    return [rank, *columns]


def cycled(groups: DataFrame, group: str, order: str, target: int, have: str) -> DataFrame:
    """(group, number): what has to be made so that all groups together hold `target` rows, dealt in turn.

    `groups`: (group, order, have) with few rows: a syllabus.  Row i of the fill goes to group i modulo their number.
    """
    count = groups.agg(F.count("*").alias("_groups"), F.sum(have).alias("_have"))
    placed = groups.withColumn("_at", F.row_number().over(Window.orderBy(order)) - 1).crossJoin(F.broadcast(count))
    missing = F.greatest(F.lit(0), F.lit(target) - F.col("_have"))
    mine = F.floor((missing - F.col("_at") + F.col("_groups") - 1) / F.col("_groups"))
    return placed.select(group, mine.cast("long").alias("fill"))


def dealt_kinds(rows: DataFrame, group: str, order: str, kinds: tuple[str, ...]) -> DataFrame:
    """Rows of each group given the kinds in turn, in order."""
    at = F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1
    return rows.withColumn("kind", F.element_at(F.array(*(F.lit(k) for k in kinds)), (F.pmod(at, F.lit(len(kinds))) + 1).cast("int")))


def shares(target: int, groups: DataFrame, group: str) -> DataFrame:
    """(group, quota): `target` split evenly, one more for the first groups by name."""
    n = groups.agg(F.count("*").alias("_n"))
    placed = groups.withColumn("_at", F.row_number().over(Window.orderBy(group)) - 1).crossJoin(F.broadcast(n))
    return placed.select(group, (F.floor(F.lit(target) / F.col("_n")) + (F.col("_at") < F.pmod(F.lit(target), F.col("_n"))).cast("long")).cast("long").alias("quota"))
