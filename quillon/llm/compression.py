"""Operator 1: quality rules from compression bands.

Each text is compressed with zstandard as a whole and in fixed chunks.  A ratio
(compressed bytes / bytes) below the lower limit of its length class means
repetitive text, one above the upper limit means text without structure; both are
rejected.  Short inputs compress worse, so the limits depend on the length.

Nulls, empty texts: no words, ratios null, `base_failed` true, `kept` false.  A null
id is passed through.  Repeated rows give repeated results.  Whole texts are
compressed, however long; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quillon.llm.textbytes import SPACE, as_bytes, hash_spans, line_spans, repeated, window_hashes, word_spans

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Bands:
    """Limits: (bytes up to, lowest ratio, highest ratio), the last for any length.

    `chunk_bytes`: size of the fixed chunks (a last piece under half of it joins the one before);
    a text also fails if more than `bad_chunk_share` of its chunks are outside their limits.
    """

    level: int = 3
    chunk_bytes: int = 4096
    bad_chunk_share: float = 0.34
    limits: tuple[tuple[float, float, float], ...] = field(
        default=(
            (256, 0.25, 1.02),
            (1024, 0.18, 0.90),
            (4096, 0.12, 0.80),
            (16384, 0.09, 0.72),
            (float("inf"), 0.05, 0.66),
        )
    )

    def outside(self, size: int, ratio: float) -> bool:
        low, high = next((lo, hi) for most, lo, hi in self.limits if size <= most)
        return not low <= ratio <= high


def chunk_bounds(size: int, chunk: int) -> list[int]:
    bounds = list(range(0, size, chunk)) + [size]
    if len(bounds) > 2 and bounds[-1] - bounds[-2] < chunk // 2:
        del bounds[-2]
    return bounds


FIELDS = (
    ("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()),
    ("n_repeat_words", T.LongType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType()),
    ("ratio", T.DoubleType()), ("chunk_ratio_min", T.DoubleType()), ("chunk_ratio_max", T.DoubleType()), ("bad_chunks", T.LongType()),
)


def measure(raw: np.ndarray | None, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple:
    """The values of FIELDS for one text."""
    if raw is None:
        raw = np.zeros(0, dtype=np.uint8)
    starts, ends = word_spans(raw)
    n_words = len(starts)
    white = SPACE[raw]
    word_chars = int(np.count_nonzero(~white & ((raw & 0xC0) != 0x80)))
    n_symbols = int(np.count_nonzero(SYMBOL[raw]))
    n_dup_lines = n_repeat = 0
    if n_words:
        first, last = line_spans(raw)
        worded = np.searchsorted(starts, last) > np.searchsorted(starts, first)
        lines = hash_spans(raw, first[worded], last[worded])
        n_dup_lines = len(lines) - len(np.unique(lines))
        again = repeated(window_hashes(hash_spans(raw, starts, ends), 3)) if n_words >= 3 else np.zeros(0, dtype=bool)
        if again.any():
            covered = np.zeros(n_words, dtype=bool)
            for k in range(3):
                covered[k : k + len(again)] |= again
            n_repeat = int(covered.sum())
    base_failed = n_words < 50 or 100 * n_repeat > 50 * n_words
    if not len(raw):
        return n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, False, None, None, None, 0
    data = raw.tobytes()
    ratio = len(zstd.compress(data)) / len(data)
    bounds = chunk_bounds(len(data), bands.chunk_bytes)
    if len(bounds) == 2:
        ratios = [(len(data), ratio)]
    else:
        ratios = [(b - a, len(zstd.compress(data[a:b])) / (b - a)) for a, b in zip(bounds, bounds[1:])]
    bad = sum(bands.outside(size, r) for size, r in ratios)
    rejected = bands.outside(len(data), ratio) or bad > bands.bad_chunk_share * len(ratios)
    return (
        n_words, word_chars, n_symbols, n_dup_lines, n_repeat, base_failed, not (base_failed or rejected),
        ratio, min(r for _, r in ratios), max(r for _, r in ratios), bad,
    )


def compression_rules(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, word statistics, compression ratios and the verdict."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([source.schema["doc_id"], *(T.StructField(k, t) for k, t in FIELDS)])
    kinds = [pa.bool_() if isinstance(t, T.BooleanType) else pa.float64() if isinstance(t, T.DoubleType) else pa.int64() for _, t in FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=bands.level, write_content_size=True)
        for batch in batches:
            rows = [measure(raw, bands, zstd) for raw in as_bytes(batch.column(1))]
            columns = [pa.array(x, type=kind) for x, kind in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(k for k, _ in FIELDS)])

    return source.mapInArrow(run, schema)
