"""Operator 9: secret scans with a password guess-cost dynamic programme.

Patterns find assigned secrets, access keys and long hex strings.  Beside them,
values that stand in a credential context (``user_pwd = ...``, ``login: ...``) are
scored by how many guesses an informed attacker needs: the value is cut into words,
dates, repeats, keyboard walks, sequences and brute-force spans so that the sum of
their log-guesses is least.  Values that stay expensive are spans of kind `guess`.  Words are ranked by how many
documents hold them: `learn_words` counts those of the whole corpus (what stands after
``=`` or ``:`` isn't counted, so that leaked values don't become words) and keeps the most
frequent `WordSettings.words`, which bounds what tasks hold.

Positions count code points, ends are exclusive.  Null text is scanned as empty; empty
texts have no spans; invalid UTF-8 is scanned as U+FFFD, one code point each; a null id is passed through; repeated rows repeat; other columns
are ignored.  Whole texts are scanned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import scratch
from quillon.llm.textbytes import as_bytes, as_texts

#: In the order in which kinds are listed at equal starts.
KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs that [0-9a-f]+ finds, less those that are too short.
HEX = re.compile(r"[0-9a-f]{24,}")
#: What tells that a value is a credential, where ASSIGN's own words don't.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pwd|pass|passphrase|password|passwd|pin|cred|credential|credentials|auth|login|secret|token|key|apikey|bearer|authorization)(?:["']?\x20*(?:[:=]|=>|:=)\x20*|\x20+(?P<is>is)\x20+)["']?(?:Bearer\x20|Basic\x20)?(?P<value>[^\s"'<>,;]{6,})""",
    re.I | re.A,
)
#: One of these, lower-cased, is in every text that ASSIGN or CONTEXT matches.
HINTS = ("pass", "pwd", "pin", "cred", "auth", "login", "secret", "token", "key", "bearer", "api")

#: Frequent parts of passwords, by rank.
COMMON = (
    "password 123456 qwerty letmein welcome admin login dragon monkey football baseball master sunshine princess shadow "
    "summer winter spring autumn secret test user root guest default changeme hello love money star computer internet "
    "server database example sample demo token access public private system office company github google amazon"
).split()
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
LEET = str.maketrans("@4301$57", "aaeoisst")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)?\d\d", re.A)


def _neighbours() -> dict[str, set[str]]:
    near: dict[str, set[str]] = {}
    for r, row in enumerate(ROWS):
        for k, key in enumerate(row):
            near[key] = {ROWS[i][j] for i in (r - 1, r, r + 1) if 0 <= i < len(ROWS) for j in (k - 1, k, k + 1) if 0 <= j < len(ROWS[i])} - {key}
    return near


NEAR = _neighbours()


def _alphabet(c: str) -> float:
    if "0" <= c <= "9":
        return 10.0
    if "a" <= c <= "z" or "A" <= c <= "Z":
        return 26.0
    return 33.0 if c < "\x80" else 100.0


class Words:
    """Ranks of words, from 1."""

    def __init__(self, ranked: Iterable[str] = ()) -> None:
        self.rank = {w: k + 1 for k, w in enumerate(dict.fromkeys([*COMMON, *ranked]))}
        self.longest = max(map(len, self.rank))


_COMMON = Words()


@dataclass(frozen=True)
class WordSettings:
    """At most `words` words of `least` to `most` letters are learned."""

    words: int = 20_000
    least: int = 3
    most: int = 20


def learn_words(docs: DataFrame, settings: WordSettings = WordSettings(), text_col: str = "text") -> Words:
    """The words (runs of a-z) that most documents hold, counted over all whole texts; ranks' ties by the word.

    Words count from a number of documents on that at most `settings.words` words reach; only these, and a histogram of a
    few thousand rows, come to the driver.
    """
    text = F.regexp_replace(F.lower(F.col(text_col).cast("string")), r"[:=]\x20*[\"']?[^\s\"'<>,;]+", " ")
    words = F.array_distinct(F.filter(F.split(text, "[^a-z]+"), lambda w: F.length(w).between(settings.least, settings.most)))
    with scratch(docs.sparkSession) as own:
        # 64 steps for every doubling of the number of documents
        step = F.floor(F.log2("count") * 64).cast("long")
        counts = own.saved(docs.select(F.explode(words).alias("w")).groupBy("w").count().withColumn("step", step), "words")
        total, least = 0, None
        for row in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["step"]):
            total += row["n"]
            if total > settings.words:
                break
            least = row["step"]
        found = [] if least is None else counts.where(F.col("step") >= least).select("w", "count").collect()
    return Words(r["w"] for r in sorted(found, key=lambda r: (-r["count"], r["w"])))


def log_guesses(value: str, limit: float = math.inf, words: Words = _COMMON) -> float:
    """log10 of the guesses that the cheapest segmentation of the value needs; `limit` if it needs that or more.

    Costs of a span: word - its rank, doubled for capitals and for leet spelling;
    date - days in 120 years, or years if it is one; repeat - alphabet times length;
    keyboard walk or sequence - start keys times directions per step; else brute force,
    each character at its class's size.  Every further span costs a doubling.

    Values may be long.  Costs only add up, so no cut goes on from a place that costs the
    limit, and the programme ends when no later place is below it.
    """
    n = len(value)
    low = value.lower()
    plain = low.translate(LEET)
    best = [0.0] + [math.inf] * n
    reach = 0  # the last place below the limit
    same = walk = 0  # where the run of equal characters and the keyboard walk at i end
    ends = {1: 0, -1: 0}  # where the sequence at i ends
    tops = {1: math.inf, -1: math.inf}  # what its end costs at most

    def to(k: int, cost: float) -> None:
        nonlocal reach
        if cost < best[k]:
            best[k] = cost
            if cost < limit and k > reach:
                reach = k

    for i in range(n):
        if i > reach:
            return limit
        if best[i] >= limit:
            continue
        # a brute-force character joins the span before it without a further doubling
        to(i + 1, best[i] + math.log10(_alphabet(value[i])))
        base = best[i] + (0.301 if i else 0.0)
        for j in range(i + 3, min(n, i + words.longest) + 1):
            rank = words.rank.get(low[i:j]) or words.rank.get(plain[i:j])
            if rank:
                part = value[i:j]
                to(j, base + math.log10(rank) + 0.301 * (part != part.lower()) + 0.301 * (low[i:j] not in words.rank))
        if match := DATE.match(value, i):
            to(match.end(), base + math.log10(120.0 if match.end() - i == 4 else 43_800.0))
        if same <= i:
            same = i + 1
            while same < n and low[same] == low[i]:
                same += 1
        for k in (i + 3, same):
            if i + 3 <= k <= same:
                to(k, base + math.log10(_alphabet(value[i]) * (k - i)))
        if walk <= i:
            walk = i + 1
            while walk < n and low[walk] in NEAR.get(low[walk - 1], ()):
                walk += 1
        for k in range(i + 4, walk + 1):
            cost = base + math.log10(47.0) + 0.6 * (k - i - 1) / 2
            if cost >= limit:
                break
            to(k, cost)
        for step in (1, -1):
            if ends[step] <= i + 1:
                j = i + 1
                while j < n and low[j].isalnum() and ord(low[j]) - ord(low[j - 1]) == step:
                    j += 1
                ends[step], tops[step] = j, math.inf
            j = ends[step]
            # from a place that costs what the whole sequence does at most, a part of it is never cheaper
            if j - i >= 3 and base + math.log10(2 * 26.0 * 3) < tops[step]:
                for k in range(i + 3, j + 1):
                    to(k, base + math.log10(2 * 26.0 * (k - i)))
                tops[step] = min(tops[step], base + math.log10(2 * 26.0 * (j - i)))
    return min(best[n], limit)


@dataclass(frozen=True)
class GuessRule:
    """Values of `min_chars` or more that need 10**`min_log_guesses` or more guesses are secrets."""

    min_chars: int = 8
    min_log_guesses: float = 10.0


def scan(text: str | None, rule: GuessRule = GuessRule(), words: Words = _COMMON) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    text = text or ""
    low = text.lower()
    hinted = ("=" in text or ":" in text or " is" in low) and any(hint in low for hint in HINTS)
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if hinted else []
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if hinted:
        for m in CONTEXT.finditer(text):
            value = m["value"].rstrip(".)]}!?:")
            # letters of one case after "is" are prose
            prose = m["is"] and value.isalpha() and (value.islower() or value.isupper())
            if len(value) >= rule.min_chars and not prose and log_guesses(value, rule.min_log_guesses, words) >= rule.min_log_guesses:
                found.append(("guess", m.start("value"), m.start("value") + len(value)))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def find_secrets(docs: DataFrame, rule: GuessRule = GuessRule(), id_col: str = "doc_id", text_col: str = "text", words: Words = _COMMON) -> DataFrame:
    """One row per document with its spans as an array of structs."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([source.schema["doc_id"], T.StructField("spans", T.ArrayType(span))])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(x, rule, shared.value)] for x in as_texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, type=arrow)], names=["doc_id", "spans"])

    return source.mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """Counts per kind, a digest of the base kinds' spans, and all spans as text."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = F.filter("spans", lambda x: x["kind"] != "guess")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def redact(docs: DataFrame, rule: GuessRule = GuessRule(), id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", words: Words = _COMMON) -> DataFrame:
    """The documents with every span replaced by a mask; overlapping spans become one."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, text in zip(as_bytes(batch.column(at)), as_texts(batch.column(at))):
                done, parts = 0, []
                for _, start, end in scan(text, rule, shared.value):
                    if start >= done:
                        parts += [text[done:start], mask]
                    done = max(done, end)
                texts.append("".join([*parts, text[done:]]).encode() if parts else None if raw is None else raw.tobytes())
            columns = [pa.array(texts, type=pa.binary()).view(pa.string()) if k == at else batch.column(k) for k in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, schema)
