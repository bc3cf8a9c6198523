"""Operator 11: fill-in-the-middle transformation.

A text is cut at two token borders into prefix, middle and suffix, which are put in the
order that a model completes: psm `<P>`prefix`<S>`suffix`<M>`middle or spm
`<S>`suffix`<P>`prefix`<M>`middle.  Cuts and form are drawn from a hash of the seed and
the document's id.  Texts that hold a sentinel, and a share of the others, stay plain.

Tokens are found on UTF-8 bytes, lengths are counted in code points.  For that a text has
an index of its exceptions only: the code-point place of every multibyte character and the
excess bytes up to it.  A binary search in this index converts a cut; a text without
exceptions needs arithmetic alone, and one with few has a small index, however long it is.

Null text: as empty, plain.  Null id: hashed as an empty string.  Repeated rows get the same
output.  Invalid UTF-8 is kept byte for byte: a byte 80 to BF counts with the character
before it, any other byte begins a character.  Whole texts are cut, however long; other
columns pass through, but for those that the operator adds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.shared import fresh
from quillon.llm.textbytes import as_bytes, word_spans


@dataclass(frozen=True)
class FimSettings:
    """`rate`: per cent of texts that are transformed; `spm_rate`: per cent of these in spm order.

    The sentinels are told apart wherever they stand: none may begin with the end of one.
    """

    seed: int = 42
    rate: int = 50
    spm_rate: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        overlaps = any(a.endswith(b[:k]) for i, a in enumerate(marks) for j, b in enumerate(marks) for k in range(1, len(b) + (i != j)))
        if not all(marks) or overlaps or any(a in b for a in marks for b in marks if a is not b):
            raise ValueError("sentinels must not be empty, hold or overlap one another")


class Exceptions:
    """The sparse index of one text: where its multibyte characters are and how many bytes more than one they have.

    `bytes`, `points`: place of each multibyte character; `excess`: extra bytes of all before it, and at last of all.
    """

    def __init__(self, raw: np.ndarray) -> None:
        extra = np.flatnonzero((raw & 0xC0) == 0x80)
        if len(extra) and extra[0] == 0:  # a torn character at the start stands for itself
            extra = extra[1:]
        if not len(extra):
            self.bytes = self.points = np.zeros(0, dtype=np.int64)
            self.excess = np.zeros(1, dtype=np.int64)
            return
        first = np.flatnonzero(np.concatenate(([True], np.diff(extra) > 1)))
        self.bytes = extra[first] - 1
        self.excess = np.append(first, len(extra))
        self.points = self.bytes - self.excess[:-1]

    def to_points(self, at: np.ndarray) -> np.ndarray:
        """Byte offsets of character borders as code-point offsets."""
        at = np.asarray(at, dtype=np.int64)
        return at - self.excess[np.searchsorted(self.bytes, at)] if len(self.bytes) else at

    def to_bytes(self, at: np.ndarray) -> np.ndarray:
        """Code-point offsets as byte offsets."""
        at = np.asarray(at, dtype=np.int64)
        return at + self.excess[np.searchsorted(self.points, at)] if len(self.points) else at


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Where the tokens end, in bytes: a word with the blanks before it, and blanks at the end."""
    _, ends = word_spans(raw)
    return np.append(ends, len(raw)) if len(raw) and (not len(ends) or ends[-1] < len(raw)) else ends


def arranged(raw: np.ndarray, draws: tuple[int, int, int, int], settings: FimSettings) -> tuple[int, str, int | None, int | None, bytes]:
    """(tokens, form, code points of the prefix, of the middle, output) of one text."""
    data, ends = raw.tobytes(), token_ends(raw)
    n, (h1, h2, h3, h4) = len(ends), draws
    marks = [x.encode() for x in (settings.prefix, settings.suffix, settings.middle)]
    if not data or h3 % 100 >= settings.rate or any(x in data for x in marks):
        return n, "plain", None, None, data
    cuts = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in cuts)
    to_a, to_b = (int(x) for x in Exceptions(raw).to_points(np.array([a, b])))
    p, s, m = marks
    if h4 % 100 < settings.spm_rate:
        return n, "spm", to_a, to_b - to_a, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
    return n, "psm", to_a, to_b - to_a, b"".join((p, data[:a], s, data[b:], m, data[a:b]))


ADDED = (("fim_tokens", T.LongType(), pa.int64()), ("fim_form", T.StringType(), pa.string()), ("fim_prefix_chars", T.LongType(), pa.int64()), ("fim_middle_chars", T.LongType(), pa.int64()), ("fim_text", T.StringType(), pa.string()))
_PIECE = 1 << 24


def draws(row_id: Column, seed: int) -> Column:
    """Four unsigned 32-bit numbers of the SHA-256 of `seed:id`, as an array."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)))


def fill_in_middle(docs: DataFrame, settings: FimSettings = FimSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the columns of ADDED, of which `fim_text` is the output; columns of these names are replaced."""
    added = [name for name, _, _ in ADDED]
    kept = [c for c in docs.columns if c.lower() not in added]
    of_name, draws_name = fresh(docs.columns, "fim_of", "fim_draws")
    texts, hashes = docs[text_col].cast("string"), draws(docs[id_col], settings.seed)
    rows = docs.select(*(docs[c] for c in kept), texts.alias(of_name), hashes.alias(draws_name))
    schema = T.StructType([*(docs.schema[c] for c in kept), *(T.StructField(name, kind) for name, kind, _ in ADDED)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, numbers = batch.columns[-2], batch.columns[-1].flatten().to_numpy().reshape(-1, 4)
            done, size, found = 0, 0, []

            def piece(stop: int) -> pa.RecordBatch:
                columns = list(zip(*found))
                out = [pa.array(c, type=kind) for c, (_, _, kind) in zip(columns[:-1], ADDED)]
                text = pa.array(columns[-1], type=pa.binary()).view(pa.string())  # the bytes as they are
                return pa.RecordBatch.from_arrays([c.slice(done, stop - done) for c in batch.columns[:-2]] + out + [text], names=schema.names)

            for k, raw in enumerate(as_bytes(of)):
                found.append(arranged(np.zeros(0, dtype=np.uint8) if raw is None else raw, tuple(int(x) for x in numbers[k]), settings))
                size += len(found[-1][-1])
                if size > _PIECE:  # outputs are handed on in pieces of bounded size
                    yield piece(k + 1)
                    done, size, found = k + 1, 0, []
            if found:
                yield piece(batch.num_rows)

    return rows.mapInArrow(run, schema)


def restored(output: Column, form: Column, settings: FimSettings = FimSettings()) -> Column:
    """The text, rebuilt from output and form alone; cuts between sentinels, byte for byte."""
    p, s, m = settings.prefix, settings.suffix, settings.middle
    head, middle = F.substring_index(output, m, 1), F.substring_index(output, m, -1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(found: DataFrame, settings: FimSettings = FimSettings()) -> DataFrame:
    """Id, cuts and form with digests of the output and of the text that it gives back."""
    return found.select(
        "doc_id", F.col("fim_tokens").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        F.sha2("fim_text", 256).alias("output_sha256"), F.sha2(restored(F.col("fim_text"), F.col("fim_form"), settings), 256).alias("restored_sha256"),
    )


#: What counts as a token, for SQL and tests.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
TOKENS = re.compile(TOKEN)

DIGEST_SQL = rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{TOKEN}') AS u, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), drawn AS (
  SELECT doc_id, t, u, len(u) AS n, list_transform([1, 9, 17, 25], lambda k: CAST('0x' || substr(h, k, 8) AS BIGINT)) AS h FROM units
), cuts AS (
  SELECT doc_id, t, u, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM drawn
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cuts
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM parts
"""
