"""Full audits of question banks and of consolidated papers, from records as JSON texts.

A record is parsed once into a variant, and what is read from it is written once; what it may get wrong are rules over typed columns, so that a value of a wrong
type is a finding and never stops the job.  Rules over courses, topics and papers are aggregates with partial sums.  Every
finding is a row (bank, scope, key, code, found, required); `found` and `required` are null for rules of single rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as tx
from quillon.operators import projections, quality
from quillon.sources.shared import tasks, written

# What belongs to the paper and not to a question, the label a text may not begin with, and labels of options.
BOILERPLATE = (
    r"(?i)(?:q\.?\s*\d+\s*[-–—]\s*q\.?\s*\d+.*?carry\s+(?:one|two)|answer\s+key|key\s*/\s*range|question\s+type|page\s+\d+\s+of\s+\d+)",
    r"(?i)q\.?\s*(?:\d+\s*[-–—]\s*q\.?\s*)?\d+\s*carry\s*(?:one|two)\s*marks?\s*each",
)
NUMBER_PREFIX = r"(?i)^\s*(?:Q\.?\s*(?:No\.?\s*)?|Question\s+Number\s*:)\d+"
LABELS = ("A", "B", "C", "D")
KINDS = ("mcq", "msq", "nat")
#: Reviewed by eye: the density rule doesn't apply.
REVIEWED_METHOD = "rapidocr_onnxruntime+visual_review"
BANK_FIELDS = ("external_id", "question", "options", "course", "topic", "correct_answer", "question_type", "difficulty", "marks", "explanation", "numerical_tolerance", "source_kind")
PAPER_FIELDS = ("question", "options", "course", "topic", "correct_answer")

FINDING = "bank string, scope string, key string, code string, found bigint, required bigint"
_NUMBERS = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


@dataclass(frozen=True)
class BankPolicy:
    """What a bank must hold: per listed course so many questions, of each type, and different generated variants."""

    courses: tuple[str, ...]
    questions: int = 200
    per_type: int = 20
    variants: int = 210
    version: str = "1.0"
    note_items: int = 3


@dataclass(frozen=True)
class PaperPolicy:
    """The papers of a consolidation: each has the questions 1 to `numbers`, of the years given."""

    papers: tuple[str, ...]
    numbers: int = 65
    first_year: int = 2017
    last_year: int = 2025
    shortest: int = 20


def _at(value: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(value, f"$.{name}", kind)


def _type(value: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID; null for no value at all."""
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _type_at(value: Column, name: str) -> Column:
    return F.coalesce(_type(_at(value, name, "variant")), F.lit("VOID"))


def _given(value: Column, name: str) -> Column:
    """Whether a field is there and neither null nor empty, false or zero."""
    return ~F.coalesce(_at(value, name), F.lit("")).isin("", "0", "0.0", "false", "[]", "{}")


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def opened(documents: DataFrame, bank: str = "bank", document: str = "document") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A bank's JSON document as (header, records, notes).

    header: (bank, is_object, schema_version, bank_version, generated_at, has_questions, has_notes); records and notes:
    (bank, position, record), a record as JSON text.  Text that isn't JSON is no object.
    """
    root = F.col("_root")
    parsed = documents.select(F.col(bank).cast("string").alias("bank"), F.try_parse_json(document).alias("_root"))
    fields = [F.when(_given(root, n), _at(root, n)).alias(n) for n in ("schema_version", "bank_version", "generated_at")]
    lists = [(_type_at(root, n) == "ARRAY").alias(name) for n, name in (("questions", "has_questions"), ("revision_notes", "has_notes"))]
    header = parsed.select("bank", (F.coalesce(_type(root), F.lit("VOID")) == "OBJECT").alias("is_object"), *fields, *lists)
    rows = lambda n: parsed.select("bank", F.posexplode(_at(root, n, "array<variant>")).alias("position", "_v")).select("bank", F.col("position").cast("long").alias("position"), F.to_json("_v").alias("record"))
    return header, rows("questions"), rows("revision_notes")


def typed_records(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(bank, position, record) with the fields of the record in their types, and the types that were found.

    `option_ids`, `option_texts`: of options that are objects; `n_options`: null if the options are no list; `answer`: an
    answer that is a text; `answers`: one that is a list; `numeric_answer`: a number, or an object of just min <= max.
    """
    v, answer = F.col("_v"), F.col("_answer")
    # parsing takes most of the time: a small file's records are dealt to all cores first
    rows = rows.repartition(tasks(rows, 20_000), "bank", "position")
    parsed = rows.select(F.col("bank").cast("string").alias("bank"), "position", "record", F.try_parse_json("record").alias("_v"))
    parsed = parsed.withColumns({"_options": F.filter(_at(v, "options", "array<variant>"), lambda o: _type(o) == "OBJECT"), "_answer": _at(v, "correct_answer", "variant")})
    number = lambda value, path: F.when(_type(F.try_variant_get(value, path, "variant")).isin(*_NUMBERS), F.try_variant_get(value, path, "double"))
    span = (F.array_sort(F.json_object_keys(F.to_json(answer))) == F.array(F.lit("max"), F.lit("min"))) & (number(answer, "$.min") <= number(answer, "$.max"))
    present = F.json_object_keys("record")
    text = {n: _at(v, n) for n in ("external_id", "course", "topic", "topic_slug", "question_type", "difficulty", "source_kind", "question", "explanation", "source_paper", "status", "extraction_method")}
    whole = {n: F.when(_type_at(v, n) == "BIGINT", _at(v, n, "bigint")) for n in ("source_question_number", "source_year")}
    provenance = ("source_year", "source_paper", "source_question_number", "source_url", "answer_key_url")
    typed = parsed.select(
        "bank", "position", (F.coalesce(_type(v), F.lit("VOID")) == "OBJECT").alias("is_object"), F.array_except(F.array(*(F.lit(f) for f in sorted(fields))), present).alias("missing"),
        *(c.alias(n) for n, c in text.items()), *(c.alias(n) for n, c in whole.items()), F.when(_type_at(v, "marks").isin(*_NUMBERS), _at(v, "marks", "double")).alias("marks"),
        (_type_at(v, "external_id") == "STRING").alias("text_id"), (_type_at(v, "question") == "STRING").alias("text_question"),
        F.size(_at(v, "options", "array<variant>")).alias("n_options"), F.transform("_options", lambda o: _at(o, "id")).alias("option_ids"), F.transform("_options", lambda o: F.coalesce(_at(o, "text"), F.lit(""))).alias("option_texts"),
        F.to_json(_at(v, "options", "variant")).alias("options_json"), F.when(_type(answer) == "STRING", answer.cast("string")).alias("answer"), F.when(_type(answer) == "ARRAY", F.try_variant_get(answer, "$", "array<string>")).alias("answers"),
        F.coalesce(_type(answer).isin(*_NUMBERS) | span, F.lit(False)).alias("numeric_answer"),
        F.coalesce((_type_at(v, "safe_for_quiz") == "BOOLEAN") & _at(v, "safe_for_quiz", "boolean"), F.lit(False)).alias("safe"), F.try_variant_get(v, "$.review_flags", "array<string>").alias("review_flags"),
        F.forall(F.array(*(_given(v, n) for n in provenance)), lambda g: g).alias("has_provenance"),
    )
    flagged = tx.with_quality_flags(typed, "question", "_flags", "option_texts")
    reviewed = F.when(F.col("extraction_method") == REVIEWED_METHOD, F.array_remove("_flags", "dense_missing_space_ocr")).otherwise(F.col("_flags"))
    return flagged.withColumn("flags", reviewed).drop("_flags")


def _with_reviews(records: DataFrame, forced: DataFrame, overrides: DataFrame) -> DataFrame:
    """`forced`: (paper, number, reason) of what must stay in review; `overrides`: (paper, number, course, topic, topic_slug).  The largest of repeated rows counts."""
    key = lambda df: df.select(F.col("paper").alias("_paper"), F.col("number").cast("long").alias("_number"), "value")
    match = (F.col("source_paper") == F.col("_paper")) & (F.col("source_question_number") == F.col("_number"))
    for name, df, value in (("forced_reason", forced, F.col("reason")), ("expected", overrides, F.struct("course", "topic", "topic_slug"))):
        one = df.groupBy("paper", "number").agg(F.max(value).alias("value"))
        records = records.join(key(one), match, "left").drop("_paper", "_number").withColumnRenamed("value", name)
    return records


def _misplaced() -> Column:
    return F.col("expected").isNotNull() & ~F.struct("course", "topic", "topic_slug").eqNullSafe(F.col("expected"))


def _boilerplate() -> Column:
    whole = F.concat_ws(" ", F.coalesce("question", F.lit("")), "option_texts")
    return whole.rlike(BOILERPLATE[0]) | whole.rlike(BOILERPLATE[1])


def _answer_rules(strict_sets: bool) -> dict[str, Column]:
    kind, ids = F.col("question_type"), F.coalesce("option_ids", F.array().cast("array<string>"))
    closed, n = kind.isin("mcq", "msq"), F.col("n_options")
    good_set = F.coalesce((F.size("answers") > 0) & (F.size(F.array_except("answers", ids)) == 0), F.lit(False))
    if strict_sets:
        good_set = good_set & (F.size(F.array_distinct("answers")) == F.size("answers"))
    return {
        "not_four_options": closed & (F.coalesce(n, F.lit(-1)) != 4),
        "option_labels": closed & (ids != F.array(*(F.lit(x) for x in LABELS))),
        "mcq_answer": (kind == "mcq") & ~F.coalesce(F.array_contains(ids, F.col("answer")), F.lit(False)),
        "msq_answer": (kind == "msq") & ~good_set,
        "nat_options": (kind == "nat") & (F.coalesce(n, F.lit(-1)) != 0),
        "nat_answer": (kind == "nat") & ~F.col("numeric_answer"),
    }


def bank_record_rules() -> dict[str, Column]:
    """Rules of one record of a bank.

    A record that lacks fields has that finding alone; one without its four options isn't read further.
    """
    whole = F.col("is_object") & (F.size("missing") == 0)
    right = lambda c: F.coalesce(c, F.lit(False))
    first = {
        "external_id": ~right(F.col("text_id") & F.col("external_id").rlike(r"^[a-z0-9][a-z0-9._-]+\z")),
        "question_type": ~right(F.col("question_type").isin(*KINDS)), "difficulty": ~right(F.col("difficulty").isin("easy", "medium", "hard")), "source_kind": ~right(F.col("source_kind").isin("original", "previous_year")),
        "marks": ~right(F.col("marks").isin(1.0, 2.0)), "empty_question": _blank(F.col("question")), "short_explanation": F.length(F.coalesce(F.trim("explanation"), F.lit(""))) < 20,
    }
    answers = _answer_rules(strict_sets=True)
    lacks_options = right(answers["not_four_options"])
    past = (F.col("source_kind") == "previous_year") & ~lacks_options
    later = {name: rule & ~lacks_options for name, rule in answers.items() if name != "not_four_options"}
    later |= {name: past & rule for name, rule in {
        "provenance": ~F.col("has_provenance"), "forced_review": F.col("forced_reason").isNotNull(), "topic_override": _misplaced(), "boilerplate": _boilerplate(),
        "quality_gate": F.size("flags") > 0, "number_prefix": F.col("question").rlike(NUMBER_PREFIX),
    }.items()}
    rules = {"not_an_object": ~F.col("is_object"), "missing_fields": F.col("is_object") & (F.size("missing") > 0)}
    return rules | {name: whole & rule for name, rule in (first | {"not_four_options": lacks_options} | later).items()}


def _rows(found: DataFrame, scope: str, key: Column, codes: Column) -> DataFrame:
    return found.select("bank", F.lit(scope).alias("scope"), key.cast("string").alias("key"), F.explode(codes).alias("code"), F.lit(None).cast("long").alias("found"), F.lit(None).cast("long").alias("required"))


def _counts(found: DataFrame, scope: str, key: Column, entries: dict[str, tuple[Column, Column]]) -> DataFrame:
    """A row for each (found, required) that differs by the rule of its code: an entry is null where the code doesn't hold."""
    listed = F.array_compact(F.array(*(F.when(rule, F.struct(F.lit(code).alias("code"), n.cast("long").alias("found"))) for code, (rule, n) in entries.items())))
    return found.select("bank", F.lit(scope).alias("scope"), key.cast("string").alias("key"), F.explode(listed).alias("e")).select("bank", "scope", "key", "e.code", "e.found", F.lit(None).cast("long").alias("required"))


def _below(found: DataFrame, scope: str, key: Column, least: dict[str, tuple[Column, int]]) -> DataFrame:
    entries = F.array(*(F.struct(F.lit(code).alias("code"), F.coalesce(n, F.lit(0)).cast("long").alias("found"), F.lit(m).cast("long").alias("required")) for code, (n, m) in least.items()))
    return found.select("bank", F.lit(scope).alias("scope"), key.cast("string").alias("key"), F.explode(entries).alias("e")).select("bank", "scope", "key", "e.*").where("found < required")


def _repeated(rows: DataFrame, column: Column, scope: str, code: str) -> DataFrame:
    counted = rows.groupBy("bank", column.alias("_key")).agg(F.count("*").alias("_n"))
    return _counts(counted, scope, F.col("_key"), {code: (F.col("_n") > 1, F.col("_n"))})


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def header_findings(header: DataFrame, policy: BankPolicy) -> DataFrame:
    there = F.col("is_object")
    rules = {
        "not_an_object": ~there, "schema_version": there & ~F.col("schema_version").eqNullSafe(F.lit(policy.version)), "bank_version": there & F.col("bank_version").isNull(),
        "generated_at": there & F.col("generated_at").isNull(), "questions_not_a_list": there & ~F.col("has_questions"), "notes_not_a_list": there & ~F.col("has_notes"),
    }
    return _rows(header, "bank", F.col("bank"), quality.codes(rules))


def note_findings(notes: DataFrame, topics: DataFrame, policy: BankPolicy) -> DataFrame:
    """Notes (bank, position, record) against the topics (bank, course, topic) that need one each."""
    v = F.col("_v")
    parsed = notes.select(F.col("bank").cast("string").alias("bank"), "position", F.try_parse_json("record").alias("_v"))
    distinct = lambda n: F.size(F.array_remove(F.array_distinct(F.transform(F.coalesce(_at(v, n, "array<string>"), F.array().cast("array<string>")), lambda x: F.coalesce(F.trim(x), F.lit("None")))), ""))
    texts, lists = ("title", "summary", "reasoning_pattern"), ("key_points", "common_traps")
    typed = parsed.select(
        "bank", "position", (F.coalesce(_type(v), F.lit("VOID")) == "OBJECT").alias("is_object"), *(F.coalesce(F.trim(_at(v, n)), F.lit("")).alias(n) for n in ("course", "topic")),
        *(_blank(_at(v, n)).alias(n) for n in texts), *((distinct(n) < policy.note_items).alias(n) for n in lists),
    )
    expected = topics.select(F.col("bank").cast("string").alias("bank"), "course", "topic").distinct()
    named = typed.where("is_object").join(expected, ["bank", "course", "topic"], "left_semi")
    per_topic = typed.where("is_object").groupBy("bank", "course", "topic").agg(F.count("*").alias("_n"))
    matched = per_topic.join(expected.withColumn("_wanted", F.lit(True)), ["bank", "course", "topic"], "full")
    topic = F.concat_ws("/", "course", "topic")
    return _together([
        _rows(typed, "note", F.col("position"), quality.codes({"not_an_object": ~F.col("is_object")})),
        _rows(named, "note", F.col("position"), quality.codes({n: F.col(n) for n in texts + lists})),
        _counts(matched, "note_topic", topic, {"missing": (F.col("_n").isNull(), F.lit(0)), "unexpected": (F.col("_wanted").isNull(), F.col("_n")), "repeated": (F.col("_n") > 1, F.col("_n"))}),
    ])


def course_findings(records: DataFrame, header: DataFrame, policy: BankPolicy) -> DataFrame:
    """What the policy's courses lack in every bank; a course without a question lacks everything."""
    kind = F.col("question_type")
    digest = projections.semantic_digest(F.coalesce(kind, F.lit("")), F.coalesce("question", F.lit("")), F.coalesce("option_texts", F.array().cast("array<string>")), course=F.col("course"), topic=F.col("topic"))
    mine = records.where(F.col("course").isin(*policy.courses)).withColumn("_digest", F.when(F.col("source_kind") == "original", digest))
    counted = mine.groupBy("bank", "course").agg(
        F.count("*").alias("questions"), *(F.count_if(kind == k).alias(k) for k in KINDS), *(F.count_if(F.col("marks") == m).alias(f"marks_{m}") for m in (1, 2)), F.count_distinct("_digest").alias("variants"),
    )
    wanted = header.select("bank", F.explode(F.array(*(F.lit(c) for c in sorted(policy.courses)))).alias("course"))
    least = {"questions": (F.col("questions"), policy.questions)} | {k: (F.col(k), policy.per_type) for k in KINDS} | {f"marks_{m}": (F.col(f"marks_{m}"), 1) for m in (1, 2)} | {"variants": (F.col("variants"), policy.variants)}
    by_topic = mine.groupBy("bank", "course", "topic").agg(*(F.count_if(kind == k).alias(k) for k in KINDS), F.count_if(~F.coalesce(kind.isin(*KINDS), F.lit(False))).alias("other"))
    types = F.array_compact(F.array(*(F.when(F.col(k) > 0, F.lit(k)) for k in KINDS)))
    return _together([
        _below(wanted.join(counted, ["bank", "course"], "left"), "course", F.col("course"), least),
        _counts(by_topic, "topic", F.concat_ws("/", "course", "topic"), {"types_incomplete": ((F.size(types) < len(KINDS)) | (F.col("other") > 0), F.size(types))}),
    ])


def bank_audit(header: DataFrame, records: DataFrame, notes: DataFrame, topics: DataFrame, forced: DataFrame, overrides: DataFrame, policy: BankPolicy) -> DataFrame:
    """Every finding of every bank; `header`, `records` and `notes` as `opened` gives them.

    Records that are no objects or lack fields count in no group rule.  A null key counts as a key of its own.
    """
    typed = written(_with_reviews(typed_records(records, BANK_FIELDS), forced, overrides), "bank-records")
    whole = typed.where(F.col("is_object") & (F.size("missing") == 0))
    content = F.sha2(F.to_json(F.struct(F.trim(F.regexp_replace(F.lower("question"), r"\s+", " ")).alias("question"), F.col("options_json").alias("options"))), 256)
    return _together([
        header_findings(header, policy), note_findings(notes, topics, policy), _rows(typed, "question", F.col("position"), quality.codes(bank_record_rules())),
        _repeated(whole, F.coalesce("external_id", F.lit("None")), "external_id", "repeated"), _repeated(whole, content, "content", "repeated"), course_findings(whole, header, policy),
    ])


def paper_record_rules(policy: PaperPolicy) -> dict[str, Column]:
    """Rules of one record of consolidated papers; those of text and answer apply to records that are safe to ask."""
    there, safe = F.col("is_object"), F.col("safe")
    right = lambda c: F.coalesce(c, F.lit(False))
    rules = {
        "missing_fields": F.size("missing") > 0, "unknown_paper": ~right(F.col("source_paper").isin(*policy.papers)), "number": ~right(F.col("source_question_number").between(1, policy.numbers)),
        "year": ~right(F.col("source_year").between(policy.first_year, policy.last_year)), "topic_override": _misplaced(), "forced_is_safe": F.col("forced_reason").isNotNull() & safe,
        "forced_reason_missing": F.col("forced_reason").isNotNull() & ~right(F.array_contains("review_flags", F.col("forced_reason"))), "safe_differs": safe != right(F.col("status") == "verified"),
        "review_flags_missing": ~safe & ~right(F.size("review_flags") > 0),
    }
    asked = {
        "incomplete_text": ~F.col("text_question") | (F.length(F.coalesce(F.trim("question"), F.lit(""))) < policy.shortest), "boilerplate": _boilerplate(), "quality_gate": F.size("flags") > 0,
        "number_prefix": F.col("question").rlike(NUMBER_PREFIX), "unknown_topic": F.col("_known").isNull(), "question_type": ~right(F.col("question_type").isin(*KINDS)),
    } | _answer_rules(strict_sets=False)
    return {"not_an_object": ~there} | {name: there & rule for name, rule in rules.items()} | {name: there & safe & rule for name, rule in asked.items()}


def paper_audit(records: DataFrame, syllabus: DataFrame, forced: DataFrame, overrides: DataFrame, policy: PaperPolicy) -> DataFrame:
    """Every finding of consolidated papers, per bank (an edition of the consolidation).

    `records`: (bank, position, record); `syllabus`: (course, topic, topic_slug).  A paper of the policy that a bank lacks
    has no rows and misses all numbers; a missing number is a finding of its own, `paper#number`.
    """
    known = syllabus.select("course", "topic", "topic_slug").distinct().withColumn("_known", F.lit(True))
    typed = _with_reviews(typed_records(records, PAPER_FIELDS), forced, overrides).join(known, ["course", "topic", "topic_slug"], "left")
    typed = written(typed, "paper-records")
    objects = typed.where("is_object")
    size = len(policy.papers) * policy.numbers
    number = F.col("source_question_number")
    banks = records.groupBy(F.col("bank").cast("string").alias("bank")).agg(F.count("*").alias("_n"))
    wanted = banks.select("bank", F.explode(F.array(*(F.lit(p) for p in sorted(policy.papers)))).alias("paper"))
    paper = F.coalesce("source_paper", F.lit("None")).alias("paper")
    per_paper = wanted.join(objects.groupBy("bank", paper).agg(F.count("*").alias("_n")), ["bank", "paper"], "full")
    slots = wanted.select("bank", "paper", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(policy.numbers).cast("long"))).alias("number"))
    gaps = slots.join(objects.select("bank", paper, number.alias("number")), ["bank", "paper", "number"], "left_anti")
    listed, count = F.col("paper").isin(*policy.papers), F.coalesce("_n", F.lit(0))
    required = lambda df, n: df.withColumn("required", F.lit(n).cast("long"))
    return _together([
        _rows(typed, "question", F.col("position"), quality.codes(paper_record_rules(policy))),
        _repeated(objects, F.coalesce("external_id", F.lit("None")), "external_id", "repeated"),
        required(_counts(banks, "bank", F.col("bank"), {"size": (F.col("_n") != size, F.col("_n"))}), size),
        required(_counts(per_paper, "paper", F.col("paper"), {"size": (listed & (count != policy.numbers), count)}), policy.numbers),
        _counts(per_paper, "paper", F.col("paper"), {"absent": (listed & (count == 0), count), "unexpected": (~listed, count)}),
        _counts(gaps, "number", F.concat_ws("#", "paper", "number"), {"missing": (F.lit(True), F.lit(0))}),
    ])
