"""Immutable releases: byte-bounded shards, digests up to a root, verification, pointers."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.digests import group_digest
from quillon.sources.shared import running, written


def shard_digests(rows: DataFrame, kind: str, shard: str, row_digest: str) -> DataFrame:
    """(kind, shard, rows, digest), the digest independent of the rows' order."""
    return rows.groupBy(kind, shard).agg(F.count("*").alias("rows"), group_digest(F.col(row_digest)).alias("digest"))


def kind_digests(shards: DataFrame, kind: str) -> DataFrame:
    return shards.groupBy(kind).agg(F.sum("rows").alias("rows"), F.count("*").alias("shards"), group_digest(F.col("digest")).alias("digest"))


def verify(rows: DataFrame, manifest: DataFrame, kind: str, shard: str, row_digest: str) -> DataFrame:
    """Shards whose rows don't give the manifest's count and digest: missing, unexpected, or changed."""
    found = shard_digests(rows, kind, shard, row_digest).select(kind, shard, F.col("rows").alias("_rows"), F.col("digest").alias("_digest"))
    problem = F.when(F.col("_digest").isNull(), "missing").when(F.col("digest").isNull(), "unexpected").when((F.col("_digest") != F.col("digest")) | (F.col("_rows") != F.col("rows")), "changed")
    return manifest.join(found, [kind, shard], "full_outer").select(kind, shard, problem.alias("problem")).where("problem IS NOT NULL")


_WALK = 8


def packed(rows: DataFrame, kind: str, order: str, size: str, limit: int) -> DataFrame:
    """Greedy packing in order: a shard takes rows until the next would exceed `limit` bytes; (kind, order, size, shard).

    Rows stand in blocks of `_WALK` * limit bytes by the bytes before them.  Every row that a shard from the block before can
    leave over is a possible entry; a task walks from each to where that walk leaves its block, by next-start pointers.
    These hops between blocks are composed by pointer doubling, so after log2(blocks) joins each block knows its real entry and
    how many shards lie before it.  No task holds a kind, and there is no limit but the bytes.  Sizes are 1 or more, keys are
    unique in their kind; a row over the limit is an error.
    """
    over = rows.where((F.col(size) > limit) | (F.col(size) < 1)).select(size).first()
    if over:
        raise ValueError(f"a row of {over[0]} bytes exceeds the shard limit of {limit}" if over[0] > limit else "a row has no bytes")
    span = _WALK * limit
    placed = running(rows.select(kind, order, size), kind, [order], size).withColumn("block", F.floor(F.col("before") / span))
    placed = written(placed, "packed-rows")
    # a block sees the rows of the next one in which its last shard can end
    ahead = placed.where((F.col("block") > 0) & (F.col("before") % span <= limit)).withColumn("block", F.col("block") - 1)
    seen = placed.unionByName(ahead)

    def hops(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("before")
        before, block = part["before"].to_numpy(), int(part["block"].iloc[0])
        own, stop = int(np.searchsorted(before, (block + 1) * span)), before[-1] + part[size].iloc[-1]
        following = np.searchsorted(before + part[size].to_numpy(), before[:own] + limit, side="right")
        leaves, shards = following.copy(), np.ones(own, dtype=np.int64)
        for i in range(own - 1, -1, -1):  # a start's walk goes on where its shard ends
            if following[i] < own:
                leaves[i], shards[i] = leaves[following[i]], 1 + shards[following[i]]
        entries = np.arange(1) if block == 0 else np.flatnonzero(before[:own] <= block * span + limit)
        at = np.append(before, stop)[leaves[entries]]
        return pd.DataFrame({kind: part[kind].iloc[0], "entry": before[entries], "exit": at, "shards": shards[entries], "ends": at == stop})

    kinds = rows.schema[kind].dataType.simpleString()
    jumps = written(seen.groupBy(kind, "block").applyInPandas(hops, f"`{kind}` {kinds}, entry long, exit long, shards long, ends boolean"), "packed-hops")
    known = placed.select(kind).distinct().select(kind, F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("shards"), F.lit(False).alias("ends"))
    blocks = placed.agg(F.max("block")).first()[0] or 0
    for _ in range((int(blocks) + 1).bit_length()):
        step = jumps.select(kind, "entry", "exit", F.col("shards").alias("more"), F.col("ends").alias("last"))
        reached = known.join(step, [kind, "entry"]).select(kind, F.col("exit").alias("entry"), (F.col("shards") + F.col("more")).alias("shards"), F.col("last").alias("ends"))
        known = written(known.unionByName(reached), "packed-known")
        beyond = step.select(kind, F.col("entry").alias("exit"), F.col("exit").alias("then"), "more", "last")
        twice = jumps.join(beyond, [kind, "exit"]).select(kind, "entry", F.col("then").alias("exit"), (F.col("shards") + F.col("more")).alias("shards"), F.col("last").alias("ends"))
        jumps = written(twice, "packed-hops")
    # the end of a kind stands for the entry of a last block that no shard begins in
    start = F.struct("entry", "shards")
    at = F.floor((F.col("entry") - F.col("ends").cast("long")) / span)
    starts = known.groupBy(kind, at.alias("block")).agg(F.min(start).alias("start")).select(kind, "block", "start.*")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("before")
        before, sizes, shard = part["before"].to_numpy(), part[size].to_numpy(), np.zeros(len(part), dtype=np.int64)
        first, number = int(np.searchsorted(before, part["entry"].iloc[0])), int(part["shards"].iloc[0])
        shard[:first] = number - 1  # the rest of the shard that began in the block before
        while first < len(part):
            to = int(np.searchsorted(before + sizes, before[first] + limit, side="right"))
            shard[first:to], first, number = number, to, number + 1
        return pd.DataFrame({kind: part[kind], order: part[order], size: sizes, "shard": shard})

    shape = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in (kind, order, size))
    return placed.join(starts, [kind, "block"]).groupBy(kind, "block").applyInPandas(walk, f"{shape}, shard long")


def version_of(inputs: dict[str, str], schema_version: str, counts: dict[str, int]) -> str:
    """A deterministic version: hash of the inputs' digests, schema and counts."""
    text = json.dumps({"counts": counts, "inputs": inputs, "schema": schema_version}, sort_keys=True, separators=(",", ":"))
    return hashlib.sha256(text.encode()).hexdigest()[:24]


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, read by Spark: lineage for manifests."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def lineage_findings(bound: DataFrame, files: DataFrame) -> DataFrame:
    """(path, problem) where files aren't what a manifest (path, bytes, sha256) binds: missing, unbound, size_differs or content_differs."""
    has = files.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unbound").when(F.col("_bytes") != F.col("bytes"), "size_differs").when(F.col("_sha") != F.col("sha256"), "content_differs")
    return bound.join(has, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def publish(spark: SparkSession, root: str, release: str, expected: str | None) -> bool:
    """Moves the pointer to `release` if it still is at `expected` (None: no pointer yet).

    The pointer is a file per step, created exclusively by the file system: of two
    writers that saw the same pointer one fails.
    """
    at, current = pointer(spark, root)
    if current != expected:
        return False
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/pointer/{at + 1:012d}")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = files.create(path, False)
    except Exception as error:
        if "exist" in str(error).lower():
            return False
        raise
    out.write(bytearray(release.encode()))
    out.close()
    return True


def pointer(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """(step, release) of the current pointer; (0, None) without one."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{root}/pointer")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return 0, None
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.getPath().getName().isdigit())
    if not names:
        return 0, None
    return int(names[-1]), spark.read.text(f"{root}/pointer/{names[-1]}", wholetext=True).first()[0]
