"""Validators as rule tables: every rule is a column, every finding a row with a code.

Row rules come from one pass; rules over groups and between tables are aggregates and joins.  Nothing stops at the
first finding, and nothing is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import quality

LABELS = ("A", "B", "C", "D")


def _labels() -> Column:
    return F.array(*(F.lit(x) for x in LABELS))


def question_rules() -> dict[str, Column]:
    """What a question row (external_id, question_type, difficulty, source_kind, marks, text, explanation, options, answer, range) may get wrong.

    `options`: array of (id, text); `answer`: array of labels; `range`: (lo, hi) of a numeric answer.
    """
    kind, ids = F.col("question_type"), F.transform("options", lambda o: o["id"])
    closed, size = kind.isin("mcq", "msq"), F.coalesce(F.size("options"), F.lit(0))
    foreign = F.size(F.array_except("answer", ids)) > 0
    repeats = F.size(F.array_distinct("answer")) < F.size("answer")
    span = F.col("range")
    return {
        "bad_external_id": ~F.coalesce(F.col("external_id").rlike(r"^[a-z0-9][a-z0-9._-]+$"), F.lit(False)),
        "bad_question_type": ~kind.isin("mcq", "msq", "nat"),
        "bad_difficulty": ~F.col("difficulty").isin("easy", "medium", "hard"),
        "bad_source_kind": ~F.col("source_kind").isin("original", "previous_year"),
        "bad_marks": ~F.col("marks").isin(1, 2),
        "empty_question": F.coalesce(F.trim("text"), F.lit("")) == "",
        "short_explanation": F.length(F.coalesce(F.trim("explanation"), F.lit(""))) < 20,
        "not_four_options": closed & (size != 4),
        "option_labels": closed & (size == 4) & (ids != _labels()),
        "mcq_answer": (kind == "mcq") & ((F.size("answer") != 1) | foreign),
        "msq_answer": (kind == "msq") & ((F.size("answer") < 1) | repeats | foreign),
        "nat_options": (kind == "nat") & (size > 0),
        "nat_answer": (kind == "nat") & ~F.coalesce(span["lo"] <= span["hi"], F.lit(False)),
        "provenance_missing": (F.col("source_kind") == "previous_year") & (F.col("source_year").isNull() | F.col("source_paper").isNull() | F.col("source_number").isNull()),
        "number_prefix": F.col("text").rlike(r"(?i)^\s*(?:Q\.?\s*(?:No\.?\s*)?|Question\s+Number\s*:)\d+"),
    }


def row_findings(rows: DataFrame, rules: dict[str, Column], key: str) -> DataFrame:
    """(key, code): one row for each rule that a row breaks; a null rule holds not."""
    return rows.select(F.col(key).alias("key"), F.explode(quality.codes(rules)).alias("code"))


def minima(rows: DataFrame, key: str, least: dict[str, tuple[Column, int]]) -> DataFrame:
    """(key, code, found, required) where a group has fewer rows of some kind than it needs."""
    counted = rows.groupBy(key).agg(*(F.count_if(c).alias(f"_{k}") for k, (c, _) in enumerate(least.values())))
    entries = F.array(*(F.struct(F.lit(code).alias("code"), F.col(f"_{k}").alias("found"), F.lit(n).cast("long").alias("required")) for k, (code, (_, n)) in enumerate(least.items())))
    return counted.select(key, F.explode(entries).alias("e")).select(key, "e.*").where("found < required")


def paper_findings(rows: DataFrame, declared: DataFrame, paper: str, ordinal: str, label: str, digest: str) -> DataFrame:
    """Per paper its codes: absent, count_differs, duplicate_ordinal, not_contiguous, duplicate_label, checksum_differs.

    `declared`: (paper, count, checksum); the checksum is SHA-256 over the sorted row digests, which are listed by paper: its
    ordinals and labels are counted in sets beside them, as distinct counts would send each row three times.
    """
    n = F.count("*")
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")
    found = rows.groupBy(paper).agg(
        n.alias("_n"), distinct(ordinal).alias("_ordinals"), distinct(label).alias("_labels"), F.min(ordinal).alias("_low"), F.max(ordinal).alias("_high"),
        F.sha2(F.array_join(F.sort_array(F.collect_list(digest)), "\n"), 256).alias("_sha"),
    )
    joined = declared.join(found, paper, "left")
    there = F.col("_n").isNotNull()
    rules = {
        "absent": ~there, "count_differs": there & (F.col("_n") != F.col("count")), "duplicate_ordinal": F.col("_ordinals") < F.col("_n"),
        "not_contiguous": there & ~((F.col("_low") == 1) & (F.col("_high") == F.col("_ordinals"))), "duplicate_label": F.col("_labels") < F.col("_n"),
        "checksum_differs": there & (F.col("_sha") != F.col("checksum")),
    }
    return joined.select(paper, quality.codes(rules).alias("codes"))


def consolidation(rows: DataFrame, paper: str, number: str, wanted: int, safe: Column, verified: Column) -> DataFrame:
    """Per paper: rows, whether they are `wanted` ones numbered 1 to `wanted`, the missing numbers, and rows whose `safe` and `verified` differ."""
    found = rows.groupBy(paper).agg(F.count("*").alias("rows"), F.collect_set(number).alias("_numbers"), F.count_if(F.coalesce(safe, F.lit(False)) != F.coalesce(verified, F.lit(False))).alias("safe_differs"))
    missing = F.array_sort(F.array_except(F.sequence(F.lit(1).cast("long"), F.lit(wanted).cast("long")), "_numbers"))
    return found.select(paper, "rows", (F.col("rows") == wanted).alias("complete"), missing.alias("missing"), "safe_differs")


def alias_rules(aliases: DataFrame, items: DataFrame, alias: str = "alias_id", target: str = "canonical_id", key: str = "id") -> DataFrame:
    """(alias, codes): an alias may not name itself, shadow a live item, or lead to an unknown or another alias's id."""
    known = items.select(F.col(key).alias("_id")).distinct()
    names = aliases.select(F.col(alias).alias("_name")).distinct()
    found = (
        aliases.join(known.withColumn("_shadow", F.lit(True)), F.col(alias) == F.col("_id"), "left").drop("_id")
        .join(known.withColumn("_known", F.lit(True)), F.col(target) == F.col("_id"), "left").drop("_id")
        .join(names.withColumn("_chain", F.lit(True)), F.col(target) == F.col("_name"), "left").drop("_name")
    )
    rules = {"self": F.col(alias) == F.col(target), "shadows": F.col("_shadow"), "unknown_target": F.col("_known").isNull(), "chained": F.col("_chain") & (F.col(alias) != F.col(target))}
    return found.select(alias, target, quality.codes(rules).alias("codes"))


def snapshot_counts(parts: dict[str, DataFrame]) -> DataFrame:
    """(rule, violations) of frames that hold the violations of one rule each."""
    counted = [df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, df in parts.items()]
    return reduce(DataFrame.unionByName, counted)


def form_findings(forms: DataFrame, items: DataFrame, form: str, item: str, declared: dict[str, Column], least_kinds: int = 3) -> DataFrame:
    """Per form its codes: repeated_item, unknown_item, inactive_item, kinds_missing, and drift of what is declared.

    `forms`: (form, item); `items`: (item, kind, marks, is_active); `declared`: `count` and `marks`, columns over the form's name.
    """
    joined = forms.join(items.withColumn("_there", F.lit(True)), item, "left")
    found = joined.groupBy(form).agg(
        F.count("*").alias("count"), F.count_distinct(item).alias("_distinct"), F.count_if(F.col("_there").isNull()).alias("_unknown"),
        F.count_if(~F.col("is_active")).alias("_inactive"), F.count_distinct("kind").alias("_kinds"), F.sum("marks").alias("marks"),
    )
    rules = {
        "repeated_item": F.col("_distinct") < F.col("count"), "unknown_item": F.col("_unknown") > 0, "inactive_item": F.col("_inactive") > 0, "kinds_missing": F.col("_kinds") < least_kinds,
        "count_drift": F.col("count") != declared["count"], "marks_drift": F.coalesce(F.col("marks"), F.lit(0)) != declared["marks"],
    }
    return found.select(form, "count", "marks", quality.codes(rules).alias("codes"))


def depth_rules(text: Column, least_words: int, least_lines: int, least_distinct: int) -> dict[str, Column]:
    """Content that is too thin: few words, few lines, few different lines, a blank first line."""
    whole = F.coalesce(text, F.lit(""))
    lines = F.filter(F.transform(F.split(whole, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")
    words = F.size(F.filter(F.split(F.trim(whole), r"\s+"), lambda w: w != ""))
    return {"few_words": words < least_words, "few_lines": F.size(lines) < least_lines, "repeated_lines": F.size(F.array_distinct(lines)) < least_distinct, "blank_title": F.trim(F.split_part(whole, F.lit("\n"), F.lit(1))) == ""}


def content_gates(scores: DataFrame, key: str, gates: dict[str, tuple[Column, float]], lineage: Column) -> DataFrame:
    """(key, codes, passed) of scores against their least values, and the lineage's digests that must agree."""
    rules = {name: F.coalesce(score, F.lit(0.0)) < least for name, (score, least) in gates.items()} | {"lineage_differs": ~F.coalesce(lineage, F.lit(False))}
    return scores.select(key, quality.codes(rules).alias("codes")).withColumn("passed", F.size("codes") == 0)


# How options are marked, in brackets within a line or by a letter at its start.
INLINE_OPTION, LINE_OPTION = r"\(\s*([A-Da-d])\s*\)", r"(?m)^\s*([A-Da-d])[.)]\s+"


def parsed_options(text: Column) -> Column:
    """struct(scheme, stem, options, reason): four choices marked A to D once each and in order, by one scheme only.

    reason is null if that is so; else no_options, ambiguous (both schemes fit), incomplete or empty_option.
    """
    labels = lambda p: F.transform(F.regexp_extract_all(text, F.lit(p), 1), lambda x: F.upper(x))
    inline, line = labels(INLINE_OPTION), labels(LINE_OPTION)
    fits = lambda found: found == _labels()
    scheme = F.when(fits(inline) & ~fits(line), "parenthesized").when(fits(line) & ~fits(inline), "line_letter")
    parts = F.when(scheme == "parenthesized", F.split(text, INLINE_OPTION, -1)).when(scheme == "line_letter", F.split(text, LINE_OPTION, -1))
    clean = F.transform(parts, lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    options = F.slice(clean, 2, 4)
    empty = F.exists(options, lambda x: x == "")
    reason = F.when(fits(inline) & fits(line), "ambiguous").when((F.size(inline) == 0) & (F.size(line) == 0), "no_options").when(scheme.isNull(), "incomplete").when(empty, "empty_option")
    return F.struct(F.when(reason.isNull(), scheme).alias("scheme"), F.when(reason.isNull(), F.get(clean, F.lit(0))).alias("stem"), F.when(reason.isNull(), options).alias("options"), F.when(text.isNull(), "no_options").otherwise(reason).alias("reason"))


def option_rules(options: Column, active_html: str) -> dict[str, Column]:
    """What an array of options (id, text) may get wrong."""
    ids, texts = F.transform(options, lambda o: o["id"]), F.transform(options, lambda o: F.coalesce(F.trim(o["text"]), F.lit("")))
    folded = F.transform(texts, lambda x: F.lower(x))
    return {
        "not_four": F.coalesce(F.size(options), F.lit(0)) != 4, "labels": ids != _labels(), "empty": F.exists(texts, lambda x: x == ""),
        "active_html": F.exists(texts, lambda x: x.rlike(active_html)), "duplicates": F.size(F.array_distinct(folded)) < F.size(folded),
    }


def expanded(parents: DataFrame, children: str, parent: str, decide: Column) -> DataFrame:
    """A row for each child with its number and decision; a parent without children has one row, undecided."""
    rows = parents.select(parent, F.posexplode_outer(children).alias("_at", "child"))
    return rows.select(parent, (F.col("_at") + 1).cast("long").alias("number"), "child", F.when(F.col("child").isNull(), "no_children").otherwise(decide).alias("decision"))


def artifact_coverage(required: DataFrame, artifacts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """(artifact, missing, unexpected, repeated, differing): every artifact must hold each required key once, with its digest.

    `required`: (keys, digest); artifacts: the same columns.
    """
    want = required.select(*keys, F.col("digest").alias("_want"))
    out = None
    for name, rows in artifacts.items():
        has = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("digest").alias("_has"))
        counted = want.join(has, keys, "full_outer").agg(
            F.count_if(F.col("_has").isNull()).alias("missing"), F.count_if(F.col("_want").isNull()).alias("unexpected"),
            F.count_if(F.col("_n") > 1).alias("repeated"), F.count_if(F.col("_want") != F.col("_has")).alias("differing"),
        ).select(F.lit(name).alias("artifact"), "missing", "unexpected", "repeated", "differing")
        out = counted if out is None else out.unionByName(counted)
    return out


def path_rules(path: Column) -> dict[str, Column]:
    """Paths that other machines can't use: absolute, with a drive, upwards, backslashes, doubled slashes, or blank."""
    return {
        "absolute": path.rlike(r"^(/|~)"), "drive": path.rlike(r"^[A-Za-z]:"), "upwards": path.rlike(r"(^|/)\.\.(/|$)"), "backslash": path.contains("\\"),
        "doubled": path.rlike(r"[^:]//"), "blank": F.coalesce(F.trim(path), F.lit("")) == "",
    }


def partition_findings(keep: DataFrame, retire: DataFrame, every: DataFrame, key: str) -> DataFrame:
    """(key, problem) where keep and retire don't divide all keys: in_both, in_neither or unknown."""
    side = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    joined = side(every, "_all").join(side(keep, "_keep"), key, "full_outer").join(side(retire, "_retire"), key, "full_outer")
    problem = F.when(F.col("_all").isNull(), "unknown").when(F.col("_keep") & F.col("_retire"), "in_both").when(F.col("_keep").isNull() & F.col("_retire").isNull(), "in_neither")
    return joined.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def key_year(year: Column, file_name: Column, url: Column) -> Column:
    """The file name's year must be the paper's and the URL's path must hold it: null, or what differs."""
    named = F.regexp_extract(file_name, r"((?:19|20)\d{2})", 1).try_cast("long")
    path = F.regexp_replace(url, r"^[a-z]+://[^/]*", "")
    return F.when(named.isNull(), "no_year_in_name").when(named != year, "name_differs").when(~F.coalesce(path.contains(year.cast("string")), F.lit(False)), "url_differs")


def asset_rules(path: Column, digest: Column, content_sha: Column, allowed: tuple[str, ...]) -> dict[str, Column]:
    """An asset's path must lie in an allowed folder, have a known suffix, and its content the digest that is claimed."""
    inside = reduce(lambda a, b: a | b, (path.startswith(p) for p in allowed), F.lit(False))
    return {"not_allowed": ~inside, "bad_suffix": ~path.rlike(r"(?i)\.(png|svg|webp|jpe?g)$"), "digest_differs": ~F.coalesce(digest == content_sha, F.lit(False))} | {k: v for k, v in path_rules(path).items() if k in ("upwards", "backslash")}


def asset_plan(items: DataFrame, assets: DataFrame, item: str, eligible: Column, folder: str) -> DataFrame:
    """(source, target, items, problem): the assets of eligible items with their content-addressed targets.

    Two different sources with one target are a conflict.
    """
    used = assets.join(items.where(eligible).select(item), item, "left_semi")
    plan = used.groupBy("source", "sha").agg(F.count_distinct(item).alias("items")).withColumn("target", F.concat(F.lit(f"{folder}/"), F.substring("sha", 1, 12), F.lit("."), F.element_at(F.split("source", r"\."), -1)))
    clashes = plan.groupBy("target").agg(F.count_distinct("source").alias("_n"))
    return plan.join(clashes, "target").select("source", "target", "items", F.when(F.col("_n") > 1, "two_sources").alias("problem"))


# What makes third-party typography unsafe to take over.
TEXT_RISKS = {
    "html_or_embedded_markup": r"(?i)<\s*/?\s*[a-z][^>]*>|javascript:",
    "formula_or_latex_requires_visual_review": r"\$|\\\(|\\\[|\\(?:frac|sqrt|sum|int|le|ge|times|cdot|alpha|beta|theta|lambda)\b|[\x{2200}-\x{22FF}]",
    "code_layout_requires_visual_review": r"(?i)#include|\b(?:int|void|char|float|double)\s+\w+\s*\(|\bprintf\s*\(|\bfor\s*\(|\bwhile\s*\(",
    "prompt_depends_on_visual_asset": r"(?i)\b(?:figure|diagram|graph|image|circuit)\s+(?:shown|given|above|below)\b|\b(?:shown|given)\s+(?:above|below)\b",
    "broken_or_private_glyph": r"[\x{FFFD}\x{E000}-\x{F8FF}]",
    "remote_visual_asset_not_copied": r"(?i)\[image:",
}


def text_risks(text: Column) -> Column:
    """Sorted reasons why a text can't be taken over without a look."""
    return quality.codes({name: text.rlike(pattern) for name, pattern in TEXT_RISKS.items()})
