"""Operator 13: exact dedup with a split for frequent texts.

Texts are equal when they are after lower-casing A-Z; of equal ones the row with the
largest id stays.  Only SHA-256 digests, ids and row numbers are compared.

The frequent digests are found first: every task keeps a Misra-Gries summary of its digests
and the summaries are added up.  An entry counts if its sum exceeds n / (counters + 1).
Sums never exceed true counts, so at most `counters` entries do, whatever the data; a
digest loses at most n / (counters + 1) over all tasks, so every digest with 2n / (counters
+ 1) rows or more is among them.  Their exact counts and winners, taken from all rows, are
broadcast - so many rows at most - and their rows are settled in the map tasks.  The others
take an ordinary shuffle, in which no digest has more rows than that.

Null text: as empty.  Null id: stays only if no equal text has an id.  Rows that repeat id and
text are one group like any other, of which one row stays.  Digests are those of the bytes,
valid UTF-8 or not.  An empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import fresh, saved, scratch

COUNTERS = 1024
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text, 32 bytes."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), 256))


class Summary:
    """Misra-Gries over a stream of arrays: at most `counters` keys, each count too low by at most rows / (counters + 1)."""

    def __init__(self, counters: int) -> None:
        self.counters = counters
        self.counts: dict[bytes, int] = {}

    def add(self, keys: list[bytes], counts: list[int]) -> None:
        for key, n in zip(keys, counts):
            self.counts[key] = self.counts.get(key, 0) + n
        if len(self.counts) > self.counters:
            # what the (counters + 1)th largest has is taken from it and from each of those above: so many equal rows of distinct keys go
            values = np.fromiter(self.counts.values(), dtype=np.int64, count=len(self.counts))
            least = int(np.partition(values, len(values) - self.counters - 1)[len(values) - self.counters - 1])
            self.counts = {key: n - least for key, n in self.counts.items() if n > least}


def frequent(rows: DataFrame, key: str, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` values of a binary column, among them all with 2n / (counters + 1) rows or more: (key, n_least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(counters)
        for batch in batches:
            counted = batch.column(0).value_counts()
            summary.add(counted.field(0).to_pylist(), counted.field(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array(summary.counts.keys(), type=pa.binary()), pa.array(summary.counts.values(), type=pa.int64())], names=[key, "n"])

    sums = rows.select(key).mapInArrow(run, f"{key} binary, n long").groupBy(key).agg(F.sum("n").alias("n_least"))
    return sums.where(F.col("n_least") > rows.count() / (counters + 1))


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest its size and the row that stays."""
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("row_id", "row")).alias("best"))


def _settled(docs: DataFrame, counters: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with digests, winners of the frequent digests, winners of the others), the first two as written tables."""
    numbered = docs.select(docs[id_col].alias("row_id"), text_digest(docs[text_col]).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = saved(numbered, "exact-digests")
    with scratch(docs.sparkSession) as own:
        some = own.saved(frequent(rows, "digest", counters), "exact-frequent")
        # at most `counters` rows, see above
        heavy = saved(_winners(rows.join(F.broadcast(some.select("digest")), "digest", "left_semi")), "exact-heavy")
    rest = _winners(rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti"))
    return rows, heavy, rest


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept and the digest of its normalised text (32 bytes)."""
    rows, heavy, rest = _settled(docs, counters, id_col, text_col)
    known = rows.join(F.broadcast(heavy.select("digest", "group_size", "best")), "digest", "left")
    done = known.where(F.col("best").isNotNull())
    others = known.where(F.col("best").isNull()).select("row_id", "digest", "row").join(rest, "digest")
    return done.unionByName(others).select(
        F.col("row_id").alias("doc_id"), F.col("best.row_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "digest"
    )


def drop_exact_duplicates(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns.

    Losers of frequent digests go in the map tasks, before texts are shuffled.  Rows that repeat id
    and text are first reduced by partial aggregation, on the keys of the join that follows.
    """
    _, heavy, rest = _settled(docs, counters, id_col, text_col)
    names = fresh(docs.columns, "digest", "id", "best")
    digest, own_id, best = names
    key = F.coalesce(F.concat(F.lit("="), docs[id_col].cast("string")), F.lit(""))
    best_key = F.coalesce(F.concat(F.lit("="), F.col("best.row_id").cast("string")), F.lit(""))
    marked = docs.withColumns({digest: text_digest(docs[text_col]), own_id: key})
    heavy = heavy.select(F.col("digest").alias(digest), best_key.alias(best))
    left = marked.join(F.broadcast(heavy), digest, "left").where(F.col(best).isNull() | (F.col(best) == F.col(own_id))).drop(best)
    rest = rest.select(F.col("digest").alias(digest), best_key.alias(own_id))
    stay = rest.unionByName(heavy.withColumnRenamed(best, own_id))
    return left.dropDuplicates([digest, own_id]).join(stay, [digest, own_id], "left_semi").select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


#: For row-unique doc_id.
DIGEST_SQL = f"""
WITH texts AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS h FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM texts WINDOW w AS (PARTITION BY h)
"""
