"""Vectorised tokenising and hashing of UTF-8 texts, shared by the operators that run inside tasks.

A text is a numpy view of its UTF-8 bytes.  Words are runs without the six ASCII
white-space bytes, so byte-wise tokenising equals the regex ``[^\\x20\\x09-\\x0D]+``.
Hashes are 64-bit, deterministic across processes and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_MIX1, _MIX2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15 | 1
_CHUNK = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_WORD = bytes(int(not x) for x in SPACE)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x = x * _MIX1
    x ^= x >> U64(33)
    x *= _MIX2
    x ^= x >> U64(33)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit constants."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))



class _Powers:
    """Powers of the polynomial base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 4096, 2 * len(self.up) if n < _CHUNK else n)
            inverse = pow(_BASE, -1, 1 << 64)
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U64))
        return self.up, self.down


_POWERS = _Powers()


def as_bytes(column: pa.Array) -> Iterator[np.ndarray | None]:
    """The UTF-8 bytes of every value of an Arrow string column, None for null; views, no copies."""
    if pa.types.is_dictionary(column.type):
        column = column.dictionary_decode()
    large = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return
    at = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    nulls = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    for i in range(n):
        yield None if nulls is not None and nulls[i] else raw[at[i] : at[i + 1]]


def as_texts(column: pa.Array) -> Iterator[str | None]:
    """The values as Python strings.

    What isn't valid UTF-8 becomes U+FFFD, one for each maximal part of a character, so that no text stops a
    task; places in such a text count these as one code point each.
    """
    for raw in as_bytes(column):
        yield None if raw is None else raw.tobytes().decode("utf-8", "replace")


def translated(raw: np.ndarray, table: bytes) -> np.ndarray:
    """Each byte through a table of 256."""
    return np.frombuffer(raw.tobytes().translate(table), dtype=np.uint8)


def word_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets (start, end exclusive) of the words."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = np.empty(len(raw) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = np.frombuffer(raw.tobytes().translate(_WORD), dtype=np.int8)
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def hash_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are sorted and may not overlap across chunks."""
    if not len(starts):
        return np.zeros(0, dtype=U64)
    out = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(starts, base + _CHUNK)))
        stop = int(ends[lo:hi].max())
        up, down = _POWERS.get(stop - base + 1)
        sums = np.zeros(stop - base + 1, dtype=U64)
        np.cumsum((raw[base:stop].astype(U64) + U64(1)) * up[: stop - base], out=sums[1:])
        s = starts[lo:hi] - base
        e = ends[lo:hi] - base
        out[lo:hi] = (sums.take(e) - sums.take(s)) * down.take(s) + (e - s).astype(U64)
        lo = hi
    return mix(out)


def line_spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the lines that splitting at \\n gives; an empty text has one empty line."""
    breaks = np.flatnonzero(raw == 10)
    return np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of `width` consecutive hashes."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    keys = seeded(width, 1000 + width)
    acc = hashes[:n] * (keys[0] | U64(1))
    for k in range(1, width):
        acc = acc + hashes[k : k + n] * (keys[k] | U64(1))
    return mix(acc)


def repeated(values: np.ndarray) -> np.ndarray:
    """True where a value occurs twice or more."""
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(values), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out
