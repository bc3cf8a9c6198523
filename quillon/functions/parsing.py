"""Grammars of answer keys, labels and nested references."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import answers

MOST_NODES, MOST_DEPTH = 100_000, 80


def key_row(text: Column) -> Column:
    """struct(number, kind, answer, marks) of an answer-key row, all null if it isn't one.

    `12 MCQ A 1`, `13 MSQ A;C 2`, `14 NAT 3.1 to 3.2 2`, `15 MCQ MTA 1` (marks to all).
    """
    pattern = r"^\s*(\d{1,3})\s+(MCQ|MSQ|NAT)\s+(.+?)\s+([12])\s*$"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    kind, raw = F.lower(part(2)), part(3)
    shape = F.when(F.upper(raw) == "MTA", "marks_to_all").when(raw.rlike(r"(?i)\bor\b"), "any_of").when((kind == "nat") & answers.interval(raw).isNotNull(), "value").when(kind.isin("mcq", "msq") & raw.rlike(r"^[A-D](\s*[;,]\s*[A-D])*$"), "value")
    return F.struct(part(1).try_cast("long").alias("number"), kind.alias("kind"), raw.alias("answer"), part(4).try_cast("long").alias("marks"), shape.alias("shape"))


# What a cell of a key table looks like.
_NUMBER = r"-?\d+(?:\.\d+)?"
_RANGE = rf"{_NUMBER}\s*(?:to|:)\s*{_NUMBER}"
_OPTIONS = r"MTA|Marks\s+to\s+All|[A-D](?:\s*(?:[,;]|OR)\s*[A-D])*"


@dataclass(frozen=True)
class KeyProfile:
    """The grammar of one layout of key tables.

    `start`: where a row begins, with groups for number, kind ("" without) and section; a row runs to the next start.
    Rows without a kind are NAT if their tail begins with a range, else MCQ.  `tails`: per kind the shapes of a tail in
    the order of trial, each a pattern with groups for key and marks ("" without): the first that fits is taken.
    """

    start: str
    tails: dict[str, tuple[str, ...]]


_CHOICE = (rf"^({_OPTIONS})\s*([12])(?=(?:\s*0)?(?:\s|$))",)
#: The last shape is a range whose end is glued to the marks, as in `3 to 31`: 3 to 3, one mark.
_VALUE = (rf"^({_RANGE}(?:\s+OR\s+{_RANGE})*)\s+([12])(?:\s*0)?(?:\s|$)", rf"^({_NUMBER}\s*(?:to|:)\s*-?\d+(?:\.\d+)?)([12])(?:\s|$)")
_TYPED = {"MCQ": _CHOICE, "MSQ": _CHOICE, "NAT": _VALUE}
KEY_PROFILES = {
    "typed": KeyProfile(r"(?<!\d)(\d{1,2})\s*(MCQ|MSQ|NAT)\s+(GA|CS)(?:-\d)?\s+", _TYPED),
    "typed_session_6": KeyProfile(r"(?<!\d)(\d{1,2})\s*6\s*(MCQ|MSQ|NAT)\s+(GA|CS)(?:-\d)?\s+", _TYPED),
    "untyped": KeyProfile(r"\b(?=(?:GA|CS)\s+(\d{1,2})\s+)()(GA|CS)\s+\d{1,2}\s+", _TYPED),
    "first_booklet": KeyProfile(r"\b(?=CS\s+(\d{1,2})\s*(?:Marks\s+to\s+All|[A-D])(?:\s|$))()(CS)\s+\d{1,2}\s*", {"MCQ": (r"^(Marks\s+to\s+All|[A-D])(?=\s|$)()",)}),
}


# acronyms that may be set letter by letter, and where one stands otherwise than in joined capitals
_ACRONYMS = ("MCQ", "MSQ", "NAT", "GA", "CS")
_SPACED = r"(?=[MNGC])(?<![A-Za-z])(?:(M)\s*([CS])\s*(Q)|(N)\s*(A)\s*(T)|(G)\s*(A)|(C)\s*(S))\b"
_UNUSUAL = rf"(?=[mngcMNGC])(?<![A-Za-z])(?!(?:{'|'.join(_ACRONYMS)})\b)(?i:M\s*[CS]\s*Q|N\s*A\s*T|G\s*A|C\s*S)\b"


def clean_key_text(text: Column) -> Column:
    """Dashes as hyphens, acronyms that were set letter by letter as words, blank runs as one blank.

    Patterns that only few texts need are tried after a test that tells these.
    """
    plain = F.regexp_replace(F.regexp_replace(text, r"[\x{2010}-\x{2014}\x{2212}]", "-"), r"\x{F0B7}", " ")
    text = F.when(F.octet_length(text) == F.length(text), text).otherwise(plain)

    def any_case(joined: Column) -> Column:
        words = joined
        for word in _ACRONYMS:
            words = F.regexp_replace(words, rf"(?i)(?<![A-Za-z]){r'\s*'.join(word)}\b", word)
        return F.when(joined.rlike(_UNUSUAL), words).otherwise(joined)

    return F.trim(F.regexp_replace(_once(F.regexp_replace(text, _SPACED, "$1$2$3$4$5$6$7$8$9$10"), any_case), r"\s\s+|[^\S ]", " "))


def _once(value: Column, read: Callable[[Column], Column]) -> Column:
    """`read` of a value that it names several times, as a lambda's variable: it is computed once."""
    return F.get(F.transform(F.array(value), read), F.lit(0))


def key_table(text: Column, profile: str) -> Column:
    """The rows of a page's key table by a profile's grammar.

    Structs of number, section, kind, raw, marks, shape (`options`, `any_of`, `marks_to_all`, `ranges`), choices (an array for each
    alternative), ranges (least, most as they are written) and problem: null, `tail` if no shape fits the row's tail, which
    is `raw` then, or `several` if a single choice names more options.
    """
    return _once(clean_key_text(text), lambda clean: _key_rows(clean, KEY_PROFILES[profile]))


def _key_rows(clean: Column, grammar: KeyProfile) -> Column:
    starts = f"(?i){grammar.start}"
    heads = F.regexp_extract_all(clean, F.lit(starts), 0)
    rest = F.slice(F.split(clean, starts, -1), 2, 1 << 30)
    part = lambda head, k: F.upper(F.regexp_extract(head, starts, k))
    # a head alone doesn't show what a lookahead saw: it stands before its tail again
    whole = F.zip_with(heads, rest, lambda h, t: F.struct(F.concat(h, t).alias("row"), F.trim(t).alias("tail")))

    def split_row(x: Column) -> Column:
        stated = part(x["row"], 2)
        kind = F.when(stated != "", stated).when(x["tail"].rlike(rf"(?i)^{_NUMBER}\s+(?:to|:)") & F.lit("NAT" in grammar.tails), "NAT").otherwise("MCQ")
        return F.struct(part(x["row"], 1).alias("number"), part(x["row"], 3).alias("section"), kind.alias("kind"), x["tail"].alias("tail"))

    def matched(x: Column, group: int) -> Column:
        found = F.lit(None).cast("string")
        for kind, shapes in reversed(grammar.tails.items()):
            own = F.lit(None).cast("string")
            for shape in reversed(shapes):
                own = F.when(x["tail"].rlike(f"(?i){shape}"), F.regexp_extract(x["tail"], f"(?i){shape}", group)).otherwise(own)
            found = F.when(x["kind"] == kind, own).otherwise(found)
        return found

    read = lambda x: F.struct(*(x[c].alias(c) for c in ("number", "section", "kind", "tail")), matched(x, 1).alias("raw"), matched(x, 2).alias("marks"))

    def keyed(x: Column) -> Column:
        all_get = F.regexp_replace(F.upper(x["raw"]), r"\s+", " ").isin("MTA", "MARKS TO ALL")
        return F.struct(*(x[c].alias(c) for c in ("number", "section", "kind", "tail", "raw", "marks")), all_get.alias("all_get"), F.split(F.upper(x["raw"]), r"\s+OR\s+", -1).alias("alternatives"))

    def told(x: Column) -> Column:
        value, all_get, alternatives = x["kind"] == "NAT", x["all_get"], x["alternatives"]
        choices = F.when(~value & ~all_get, F.transform(alternatives, lambda a: F.regexp_extract_all(a, F.lit("[A-D]"), 0)))
        bounds = F.regexp_extract_all(x["raw"], F.lit(rf"(?i){_RANGE}"), 0)
        ends = lambda b, k: F.regexp_extract(b, rf"(?i)^({_NUMBER})\s*(?:to|:)\s*({_NUMBER})$", k)
        shape = F.when(value, "ranges").when(all_get, "marks_to_all").when(F.size(alternatives) > 1, "any_of").when(x["raw"].isNotNull(), "options")
        several = (x["kind"] == "MCQ") & (shape == "options") & (F.size(F.get(choices, F.lit(0))) > 1)
        return F.struct(
            x["number"].cast("long").alias("number"), x["section"].alias("section"), x["kind"].alias("kind"), F.coalesce(x["raw"], x["tail"]).alias("raw"), F.nullif(x["marks"], F.lit("")).cast("long").alias("marks"),
            F.when(x["raw"].isNotNull(), shape).alias("shape"), choices.alias("choices"), F.when(value, F.transform(bounds, lambda b: F.struct(ends(b, 1).alias("least"), ends(b, 2).alias("most")))).alias("ranges"),
            F.when(x["raw"].isNull(), "tail").when(several, "several").alias("problem"),
        )

    return F.transform(F.transform(F.transform(F.transform(whole, split_row), read), keyed), told)


def resolve_references(payload: str) -> str:
    """A flattened array with back references as nested JSON: element 0 is the root, numbers inside
    objects and arrays are places.  Cycles, excess depth or size are errors."""
    flat = json.loads(payload)
    if not isinstance(flat, list) or not flat:
        raise ValueError("the payload is not a flattened array")
    count = 0

    def value(at: int, path: tuple[int, ...]):
        nonlocal count
        count += 1
        if at < 0:
            return None
        if at in path or len(path) > MOST_DEPTH or count > MOST_NODES or at >= len(flat):
            raise ValueError("the payload has a cycle, a bad reference or is too large")
        item, inner = flat[at], (*path, at)
        if isinstance(item, dict):
            return {k: value(v, inner) for k, v in item.items()}
        return [value(v, inner) for v in item] if isinstance(item, list) else item

    return json.dumps(value(0, ()), sort_keys=True)


@F.pandas_udf(T.StringType())
def referenced_json(payloads: pd.Series) -> pd.Series:
    """`resolve_references`, null where the payload is broken."""

    def one(payload: str) -> str | None:
        try:
            return resolve_references(payload)
        except (ValueError, TypeError):
            return None

    return payloads.map(one, na_action="ignore")


# a dollar behind an odd number of backslashes is escaped; what is before it is looked at only where a dollar is
_ESCAPED = r"\$(?<=(?<!\\)(?:\\\\){0,64}\\\$)"
_PLAIN = r"\$(?<!(?<!\\)(?:\\\\){0,64}\\\$)"
_INSIDE = rf"(?:[^$]*{_ESCAPED}){{0,1000}}?"
# what tells a formula between single dollars from prices: one name or number, a command, or an operator
_LIKELY = rf"(?=\s*[A-Za-z0-9]+(?:[_^][A-Za-z0-9{{}}]+)?\s*\$|{_INSIDE}[^$]*?(?:\\[A-Za-z]|[=+\-*/^_{{}}()\[\]<>≤≥≠≈∈∉⊆⊂∪∩∞ΘΩθλεπΔΣΠ√∑∫]))"
_OPENERS = rf"{_PLAIN}\$|\\\[|\\\("
_FORMULAS = (
    rf"{_PLAIN}\$(?!\$\$)[\s\S]+?\$\$", r"\\\[(?!\\\])[\s\S]+?\\\]", r"\\\((?!\\\))[\s\S]+?\\\)", rf"{_PLAIN}(?!\$){_LIKELY}{_INSIDE}[^$]*{_PLAIN}"
)


def math_segments(text: Column) -> Column:
    r"""A text in order as structs of kind (`text`, `math`), value (a formula without its delimiters), raw and display.

    Formulas stand between `$$`, `\[` and `\]`, `\(` and `\)`, or single dollars.  Escaped dollars delimit nothing, an opener that
    isn't closed or holds nothing is text, and so is a dollar whose content looks like no formula.  Text is one segment up
    to the next formula; an empty text is one empty segment.
    """
    tokens_of = "|".join((*_FORMULAS, _OPENERS))
    tokens = F.transform(F.regexp_extract_all(text, F.lit(tokens_of), 0), lambda t: F.struct(t.alias("raw"), (~t.rlike(r"^(?:\$\$|\\\[|\\\()$")).alias("math")))
    between = F.split(text, tokens_of, -1)
    size = lambda t: F.when(t.rlike(r"^(?:\$\$|\\)"), 2).otherwise(1)
    none, no = F.lit(None).cast("string"), F.lit(False)
    plain = lambda t: F.struct(F.lit("text").alias("kind"), t.alias("value"), none.alias("raw"), no.alias("display"))

    def told(t: Column) -> Column:
        value = F.substring(t["raw"], size(t["raw"]) + 1, F.length(t["raw"]) - 2 * size(t["raw"]))
        formula = F.struct(F.lit("math").alias("kind"), value.alias("value"), t["raw"].alias("raw"), t["raw"].rlike(r"^(?:\$\$|\\\[)").alias("display"))
        return F.when(t["math"], formula).otherwise(plain(t["raw"]))

    pairs = F.flatten(F.zip_with(between, F.concat(tokens, F.array(F.struct(F.lit("").alias("raw"), no.alias("math")))), lambda b, t: F.array(plain(b), told(t))))
    parts = F.filter(pairs, lambda x: (x["kind"] == "math") | (x["value"] != ""))
    # openers without a formula are text like what stands around them
    kind = "array<struct<kind:string,value:string,raw:string,display:boolean>>"

    def joined(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        both = (F.size(done) > 0) & (x["kind"] == "text") & (F.get(done, F.size(done) - 1)["kind"] == "text")
        return F.when(both, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(plain(F.concat(last["value"], x["value"]))))).otherwise(F.concat(done, F.array(x)))

    merged = F.when(F.exists(tokens, lambda t: ~t["math"]), F.aggregate(parts, F.array().cast(kind), joined)).otherwise(parts)
    return F.when(text == "", F.array(plain(text))).otherwise(merged)


def math_parts(text: Column) -> Column:
    """The formulas of a text with their delimiters."""
    return F.transform(F.filter(math_segments(text), lambda x: x["kind"] == "math"), lambda x: x["raw"])


def heading(text: Column) -> Column:
    """struct(number, title, year) of headings like `1.2.3 Title: Paper 2014 | Question: 5`."""
    pattern = r"^\s*(\d+(?:\.\d+)*)\s+(.+?)(?::\s*.*?((?:19|20)\d{2}).*)?$"
    part = lambda k: F.nullif(F.trim(F.regexp_extract(text, pattern, k)), F.lit(""))
    return F.struct(part(1).alias("number"), part(2).alias("title"), part(3).try_cast("long").alias("year"))
