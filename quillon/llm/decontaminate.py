"""Operator 5: benchmark decontamination by the q-gram lemma.

Texts and benchmark items are lower-cased, white space runs become one blank.  Items are
cut into overlapping probes (an item up to `probe_chars` is one probe).  If a region of a
text is within k edits of a probe of m characters, they share at least m - q + 1 - k q
q-grams, all on diagonals at most k apart.  So shared q-grams are counted in overlapping
diagonal bands, regions that meet this bound are kept, and a banded alignment verifies
them: an item is leaked if one of its probes lies in the text within its edit budget.

The lemma is exact for every probe with a positive bound.  From some length on all have
one (20 characters by default); shorter items with an edit to spend (17 to 19 characters)
have one for shorter q-grams.  Items without edits are found where they stand in the text
whole and between word boundaries, by a hash of every such place: within a word a few
characters would be no copy.  Invalid UTF-8 counts as U+FFFD.  Null and empty texts and items have no leaks.
Ids of any type and null ids are passed through; repeated documents repeat, items that
repeat id and text count once; other columns are ignored.  A benchmark over `block_chars`
characters is handled in blocks: one pass over the documents each, so that the driver and
the tasks hold one block (or one longer item) at a time; leaks are joined by row keys then.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cache, reduce
from unicodedata import category

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quillon.llm.shared import fresh, row_keys, saved
from quillon.llm.textbytes import U64, as_texts, mix, seeded

_BITS = 22


@dataclass(frozen=True)
class LeakSettings:
    """`budget`: edits per character of a probe, below 1 / q; `block_chars`: benchmark characters per pass.

    `short_q`: size of the q-grams for items that have an edit to spend but no bound with `q`.
    """

    q: int = 10
    short_q: int = 5
    budget: float = 0.06
    probe_chars: int = 120
    block_chars: int = 2_000_000

    def edits(self, m: int) -> int:
        return int(self.budget * m)

    def least_shared(self, m: int) -> int:
        return m - self.q + 1 - self.edits(m) * self.q

    def from_length(self) -> int:
        """The least length from which on every probe's bound is positive."""
        return 1 + max(m for m in range(self.probe_chars + 1) if m == 0 or self.least_shared(m) <= 0)


def normal(text: str) -> np.ndarray:
    """Code points of the normalised text."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def qgrams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    keys = seeded(q, 500) | U64(1)
    wide = points.astype(U64)
    acc = wide[:n] * keys[0]
    for k in range(1, q):
        acc += wide[k : k + n] * keys[k]
    return mix(acc)


@cache
def _word_points() -> np.ndarray:
    """Whether a code point joins words; letters of scripts that are written without blanks don't."""
    joins = np.fromiter((category(chr(c))[0] in "LNM" or c == 0x5F for c in range(0x110000)), dtype=bool, count=0x110000)
    for a, b in ((0x0E00, 0x0F00), (0x1000, 0x10A0), (0x1780, 0x1800), (0x2E80, 0xA4D0), (0xF900, 0xFB00), (0x20000, 0x40000)):
        joins[a:b] = False
    return joins


_FACTOR = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


class ShortIndex:
    """Items that are found as they are, between word boundaries, by hashes of whole items."""

    def __init__(self, items: list[tuple[int, np.ndarray]]) -> None:
        self.by_length: dict[int, dict[int, list[tuple[int, np.ndarray]]]] = {}
        for item, points in items:
            code = int(self._hashes(points, np.zeros(1, dtype=np.int64), len(points))[0])
            self.by_length.setdefault(len(points), {}).setdefault(code, []).append((item, points))
        self.codes = {n: np.array(sorted(codes), dtype=U64) for n, codes in self.by_length.items()}

    @staticmethod
    def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of code points times powers before each place, and the inverse powers."""
        n = len(points)
        one = np.ones(1, dtype=U64)
        powers, inverse = (np.cumprod(np.concatenate((one, np.full(n, x, dtype=U64)))) for x in (_FACTOR, pow(_FACTOR, -1, 1 << 64)))
        return np.concatenate((np.zeros(1, dtype=U64), np.cumsum((points.astype(U64) + U64(1)) * powers[:-1], dtype=U64))), inverse

    def _hashes(self, points: np.ndarray, starts: np.ndarray, size: int, sums: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        total, inverse = sums or self._sums(points)
        return mix((total[starts + size] - total[starts]) * inverse[starts])

    def leaks(self, points: np.ndarray) -> dict[int, tuple[int, int]]:
        """The first place of each item that the text holds."""
        n = len(points)
        if not self.by_length or n < min(self.by_length):
            return {}
        word = _word_points()[points]
        edge = np.concatenate(([True], ~(word[1:] & word[:-1]), [True]))  # before each place
        begins, sums = np.flatnonzero(edge), self._sums(points)
        found: dict[int, tuple[int, int]] = {}
        for size, known in self.by_length.items():
            starts = begins[begins <= n - size]
            starts = starts[edge[starts + size]]
            codes = self._hashes(points, starts, size, sums)
            at = np.searchsorted(self.codes[size], codes)
            same = self.codes[size][np.minimum(at, len(self.codes[size]) - 1)] == codes
            for start, code in zip(starts[same].tolist(), codes[same].tolist()):
                for item, own in known[code]:
                    if item not in found and np.array_equal(points[start : start + size], own):
                        found[item] = (start, start + size)
        return found


def aligned(probe: np.ndarray, region: np.ndarray, lo: int, hi: int, k: int) -> bool:
    """Whether the probe is within k edits of a part of the region, on diagonals lo..hi (region - probe)."""
    # row i of the table: cells j = i + lo .. i + hi; a start at any place is free
    width = hi - lo + 1
    steps = np.arange(width)
    big = k + 1
    diagonal = np.arange(lo, hi + 1)
    row = np.where((diagonal >= 0) & (diagonal <= len(region)), 0, big)
    padded = np.concatenate((np.zeros(max(0, -lo) + 1, dtype=np.int64) - 1, region.astype(np.int64), np.zeros(max(0, len(probe) + hi - len(region)) + 1, dtype=np.int64) - 1))
    shift = max(0, -lo) + 1
    for i in range(1, len(probe) + 1):
        j = diagonal + i
        start = i + lo - 1 + shift
        same = padded[start : start + width] == probe[i - 1]
        take = row + ~same
        drop = np.concatenate((row[1:], [big])) + 1
        row = np.where((j >= 0) & (j <= len(region)), np.minimum(take, drop), big)
        # characters of the region that the probe lacks: along the row
        row = np.minimum(np.minimum.accumulate(row - steps) + steps, big)
        if row.min() > k:
            return False
    return bool(row.min() <= k)


class LeakIndex:
    """The q-grams of a block of benchmark items."""

    def __init__(self, items: list[tuple[int, str]], settings: LeakSettings) -> None:
        self.settings = settings
        self.probes: list[tuple[int, np.ndarray]] = []
        short: list[tuple[int, np.ndarray]] = []
        middle: list[tuple[int, str]] = []
        least = settings.from_length()
        for item, text in items:
            points = normal(text or "")
            size = settings.probe_chars
            if len(points) < least or settings.least_shared(min(size, len(points))) <= 0:
                if settings.edits(len(points)) and settings.q > settings.short_q:
                    middle.append((item, text))
                else:
                    short += [(item, points)] if len(points) else []
                continue
            starts = [0] if len(points) <= size else sorted({*range(0, len(points) - size, size // 2), len(points) - size})
            self.probes += [(item, p) for s in starts if settings.least_shared(len(p := points[s : s + size])) > 0]
        self.short = ShortIndex(short)
        self.middle = LeakIndex(middle, replace(settings, q=settings.short_q)) if middle else None
        grams = [qgrams(p, settings.q) for _, p in self.probes]
        flat = np.concatenate(grams) if grams else np.zeros(0, dtype=U64)
        order = np.argsort(flat, kind="stable")
        self.grams = flat[order]
        sizes = np.array([len(g) for g in grams], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(grams)), sizes)[order]
        self.place = (np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[order]
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.grams >> U64(64 - _BITS)).astype(np.int64)] = True
        self.shortest = min((len(p) for _, p in self.probes), default=0)
        self.least = min((settings.least_shared(len(p)) for _, p in self.probes), default=1)
        self.longest = max((len(p) for _, p in self.probes), default=0)
        self.lengths = np.array([len(p) for _, p in self.probes], dtype=np.int64)
        self.bounds = np.array([settings.least_shared(len(p)) for _, p in self.probes], dtype=np.int64)
        self.edits = np.array([settings.edits(len(p)) for _, p in self.probes], dtype=np.int64)

    def leaks(self, text: str | None) -> list[tuple[int, int, int]]:
        """(item, start, end) of the regions found in the normalised text, one per item, by item."""
        if not text:
            return []
        points = normal(text)
        found = self.short.leaks(points) if self.short.by_length else {}
        for near in (self, self.middle):
            found |= {item: at for item, *at in near._near(points) if item not in found} if near is not None and near.probes else {}
        return [(item, *found[item]) for item in sorted(found)]

    def _near(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """The regions that are within the edit budget of a probe."""
        grams = qgrams(points, self.settings.q)
        if not len(grams):
            return []
        hit = np.flatnonzero(self.bits.take((grams >> U64(64 - _BITS)).astype(np.int64)))
        # the shared q-grams of a region lie within the longest probe and its edits: too few there, no region
        span = self.longest + self.settings.edits(self.longest)
        if len(hit) < self.least:
            return []
        dense = hit[self.least - 1 :] - hit[: len(hit) - self.least + 1] <= span
        if not dense.any():
            return []
        near = np.zeros(len(hit) + 1, dtype=np.int64)
        first = np.flatnonzero(dense)
        np.add.at(near, first, 1)
        np.add.at(near, first + self.least, -1)
        hit = hit[np.cumsum(near[:-1]) > 0]
        values = grams[hit]
        lo, hi = np.searchsorted(self.grams, values, side="left"), np.searchsorted(self.grams, values, side="right")
        n = hi - lo
        if not n.sum():
            return []
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        probe, diagonal, spot = self.owner[at], np.repeat(hit, n) - self.place[at], np.repeat(hit, n)
        found: dict[int, tuple[int, int]] = {}
        # bands of 2k + 2 diagonals that begin every k + 1: any k + 1 neighbours lie within one; a q-gram is
        # one hit of its place in the text
        step = self.edits[probe] + 1
        offset = diagonal + self.longest + 1
        # key: probe, then band; a diagonal lies in its own band and in the one that began before
        key = np.concatenate([probe.astype(np.int64) << 40 | (offset // step - back + 1) for back in (0, 1)])
        spot, diagonal = np.tile(spot, 2), np.tile(diagonal, 2)
        order = np.lexsort((spot, key))
        key, spot, diagonal = key[order], spot[order], diagonal[order]
        cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        enough = np.diff(cut) >= self.bounds[key[cut[:-1]] >> 40]
        for a, b in zip(cut[:-1][enough], cut[1:][enough]):
            p = int(key[a] >> 40)
            item, points_of = self.probes[p]
            if item in found or len(np.unique(spot[a:b])) < self.bounds[p]:
                continue
            k = int(self.edits[p])
            d_lo, d_hi = int(diagonal[a:b].min()), int(diagonal[a:b].max())
            # the alignment's own diagonals are within k of a shared q-gram's
            at, to = max(0, d_lo - k), d_hi + k + len(points_of)
            if aligned(points_of, points[at:to], d_lo - k - at, d_hi + k - at, k):
                found[item] = (max(0, d_lo), min(len(points), d_hi + int(self.lengths[p]) + k))
        return [(item, *found[item]) for item in sorted(found)]


class _Benchmark:
    """The items (id, text), as blocks of bounded size."""

    def __init__(self, benchmark: DataFrame, settings: LeakSettings, item_col: str, text_col: str) -> None:
        self.items = benchmark.where(F.col(text_col).isNotNull()).select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).distinct()
        chars = self.items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
        self.parts = max(1, -(-chars // settings.block_chars))
        self.leaks = T.ArrayType(T.StructType([T.StructField("item_id", self.items.schema["i"].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))

    def block(self, k: int) -> list[tuple]:
        of = self.items if self.parts == 1 else self.items.where(F.pmod(F.xxhash64("t", F.col("i").cast("string")), F.lit(self.parts)) == k)
        return sorted(((r["i"], r["t"]) for r in of.collect()), key=lambda x: (x[0] is not None, x[0], x[1]))


def _scanned(rows: DataFrame, block: list[tuple], settings: LeakSettings, leaks: T.ArrayType) -> DataFrame:
    """The rows with `leaks` in the place of their last column, the text."""
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("leaks", leaks)])
    arrow = to_arrow_type(leaks)
    shared = rows.sparkSession.sparkContext.broadcast(block)  # bounded, see _Benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        index = LeakIndex([(k, text) for k, (_, text) in enumerate(own)], settings)
        for batch in batches:
            found = [[{"item_id": own[k][0], "start": a, "end": b} for k, a, b in index.leaks(x)] for x in as_texts(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, type=arrow)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _by_key(docs: DataFrame, items: _Benchmark, settings: LeakSettings, id_col: str, text_col: str, names: list[str]) -> DataFrame:
    """Row keys and leaks, under the three names, of the rows that leak, from one written pass per block."""
    keyed = docs.select(*row_keys(id_col, text_col), docs[text_col].cast("string").alias("text"))
    passes = [saved(_scanned(keyed, items.block(k), settings, items.leaks).where(F.size("leaks") > 0).dropDuplicates(["k1", "k2"]), "leaks") for k in range(items.parts)]
    every = reduce(DataFrame.unionByName, passes).groupBy("k1", "k2").agg(F.array_sort(F.flatten(F.collect_list("leaks"))).alias("leaks"))
    return saved(every.toDF(*names), "leaks")


def find_leaks(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: doc_id and `leaks`, an array of (item_id, start, end) in the normalised text."""
    items = _Benchmark(benchmark, settings, item_col, item_text_col)
    if items.parts == 1:
        return _scanned(docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text")), items.block(0), settings, items.leaks)
    k1, k2 = row_keys(id_col, text_col)
    own1, own2, leaks = fresh(docs.columns, "leak_k1", "leak_k2", "leaks_of")
    joined = docs.join(_by_key(docs, items, settings, id_col, text_col, [own1, own2, leaks]), (k1 == F.col(own1)) & (k2 == F.col(own2)), "left")
    return joined.select(docs[id_col].alias("doc_id"), F.coalesce(leaks, F.array().cast(items.leaks)).alias("leaks"))


def drop_leaked(docs: DataFrame, benchmark: DataFrame, settings: LeakSettings = LeakSettings(), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents that leak no item, unchanged."""
    items = _Benchmark(benchmark, settings, item_col, item_text_col)
    if items.parts > 1:
        k1, k2 = row_keys(text_col, text_col)
        own1, own2, leaks = fresh(docs.columns, "leak_k1", "leak_k2", "leaks_of")
        return docs.join(_by_key(docs, items, settings, text_col, text_col, [own1, own2, leaks]), (k1 == F.col(own1)) & (k2 == F.col(own2)), "left_anti")
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(items.block(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = LeakIndex(list(enumerate(text for _, text in shared.value)), settings)
        for batch in batches:
            yield batch.filter(pa.array([not index.leaks(text) for text in as_texts(batch.column(at))], type=pa.bool_()))

    # names that hold dots can't pass to tasks
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
