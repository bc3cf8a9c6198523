"""Digests and deterministic order keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical_sha(columns: dict[str, Column]) -> Column:
    """SHA-256 of compact JSON with sorted keys; nulls are written."""
    fields = F.struct(*(columns[k].alias(k) for k in sorted(columns)))
    return F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256)


def hash_order(key: Column | str, identity: Column | str) -> Column:
    """The first 8 bytes of SHA-256(`key:identity`) as hex: sorts like the number."""
    key, identity = (F.lit(x) if isinstance(x, str) else x for x in (key, identity))
    return F.substring(F.sha2(F.concat_ws(":", key.cast("string"), identity.cast("string")), 256), 1, 16)


def group_digest(row_digest: Column) -> Column:
    """An aggregate: one digest of a group's row digests, whatever their order.

    Sorts the digests of a group, so groups are to be shards of bounded size; `release`
    builds larger digests from shards.
    """
    return F.sha2(F.array_join(F.sort_array(F.collect_list(row_digest)), "\n"), 256)


def line_end_free(text: Column) -> Column:
    """SHA-256 that doesn't depend on the kind of line ends."""
    return F.sha2(F.regexp_replace(text, "\r\n?", "\n"), 256)


def portable_time(at: Column) -> Column:
    """A time as ISO text with microseconds, so that digests of it agree between stores."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
