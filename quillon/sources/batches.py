"""A table that batches are appended to in bounded chunks, resumable and safe between writers.

The table is a log of commits (`<root>/log/000000000007`), each naming one chunk's folder of rows.  A commit is
created exclusively, so of two writers that saw the same log one wins; the other looks at
what has come in between and tries again.  A batch is cut into chunks by a hash of its keys;
their number is fixed by the batch's first commit.  A run that ends early is taken up at
the first chunk that the log doesn't have, and what was written without a commit is never read.

No key is in the table twice: a chunk is compared with all committed rows of its keys, and a commit
that came in since then makes it be compared again.  A key that is there with the same digest is left
out, one with another digest is an error, and so is a batch that holds a key with two digests.
"""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file that must not be there; False if another writer has."""
    at, files = _files(spark, path)
    try:
        out = files.create(at, False)
    except Exception as error:
        if "exist" in str(error).lower():
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str, seconds: float = 10.0) -> dict:
    """A commit; one that has no content yet is waited for, as its writer is between creating and closing it."""
    at, files = _files(spark, path)
    end = time.monotonic() + seconds
    while not files.getFileStatus(at).getLen():
        if time.monotonic() > end:
            raise RuntimeError(f"the commit {path} is torn: its writer died before it said what it commits; delete it")
        time.sleep(0.05)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


class BatchLog:
    """The commits of a table; what was read once isn't read again."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.commits: list[dict] = []

    def refresh(self) -> list[dict]:
        """The commits that have come since the last look."""
        at, files = _files(self.spark, f"{self.root}/log")
        names = sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
        new = [_read(self.spark, f"{self.root}/log/{n}") for n in names if n.isdigit() and int(n) >= len(self.commits)]
        self.commits += new
        return new

    def rows(self, commits: list[dict] | None = None) -> DataFrame | None:
        """The rows of some commits, of all by default; None if they have none."""
        paths = [f"{self.root}/{c['path']}" for c in (self.commits if commits is None else commits) if c["rows"]]
        return self.spark.read.parquet(*paths) if paths else None

    def commit(self, entry: dict) -> bool:
        """Appends an entry if the log still is as it was last seen."""
        if not _create(self.spark, f"{self.root}/log/{len(self.commits):012d}", json.dumps(entry)):
            return False
        self.commits.append(entry)
        return True


def read_batches(spark: SparkSession, root: str) -> DataFrame:
    """All committed rows."""
    log = BatchLog(spark, root)
    log.refresh()
    found = log.rows()
    if found is None:
        raise ValueError(f"{root} has no committed rows")
    return found


def _chunk(keys: list[str], chunks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(31), *keys), F.lit(chunks))


def append_batch(df: DataFrame, root: str, batch: str, keys: list[str], digest: str, chunk_rows: int = 1_000_000) -> int:
    """Appends a batch's rows whose keys the table doesn't have; how many this run has added.

    `batch` names the batch for a run that takes it up again: the rows must be the same then.  Keys are not null.  Chunks
    have about `chunk_rows` rows, and a commit each.
    """
    spark, log, added = df.sparkSession, BatchLog(df.sparkSession, root), 0
    log.refresh()
    own = [c for c in log.commits if c["batch"] == batch]
    chunks = own[0]["chunks"] if own else max(1, -(-df.count() // chunk_rows))
    done = {c["chunk"] for c in own}
    for k in (k for k in range(chunks) if k not in done):
        rows = df.where(_chunk(keys, chunks) == k)
        twice = rows.groupBy(*keys).agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b")
        if not twice.isEmpty():
            raise ValueError("a key of the batch has two contents")
        seen = log.rows()
        while True:
            fresh = rows.dropDuplicates(keys) if seen is None else _missing(rows.dropDuplicates(keys), seen.where(_chunk(keys, chunks) == k), keys, digest)
            path = f"data/{uuid.uuid4().hex}"
            fresh.write.parquet(f"{log.root}/{path}")
            n = spark.read.schema(df.schema).parquet(f"{log.root}/{path}").count()
            if log.commit({"batch": batch, "chunk": k, "chunks": chunks, "path": path, "rows": n}):
                added += n
                break
            at, files = _files(spark, f"{log.root}/{path}")
            files.delete(at, True)
            if any(c["batch"] == batch and c["chunk"] == k for c in log.refresh()):  # another run of this batch was faster
                break
            seen = log.rows()
    return added


def _missing(rows: DataFrame, seen: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """The rows whose keys aren't there; a key that is there with another digest is an error."""
    there = seen.select(*keys, F.col(digest).alias("_there"))
    same = reduce(lambda a, b: a & b, (F.col(c) == F.col(f"_{c}_there") for c in keys))
    joined = rows.join(there.withColumnsRenamed({c: f"_{c}_there" for c in keys}), same, "left")
    if not joined.where(F.col(digest) != F.col("_there")).isEmpty():
        raise ValueError("a key exists with other content")
    return joined.where(F.col("_there").isNull()).select(*rows.columns)
