"""Table sources and sinks: frozen projections, JDBC, releases, idempotent writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import release


def frozen(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only the reviewed columns; one that is missing is an error, others are ignored."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def jdbc_table(spark: SparkSession, url: str, name: str, columns: list[str], key: str, bounds: tuple[int, int], parts: int = 64, **options: str) -> DataFrame:
    """A table read in parallel over ranges of its numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    ranges = {"partitionColumn": key, "lowerBound": str(bounds[0]), "upperBound": str(bounds[1]), "numPartitions": str(parts)}
    return frozen(reader.options(**ranges).load(), columns)


def decoded(df: DataFrame, flags: list[str] = (), json_columns: dict[str, str] | None = None, defaults: dict[str, object] | None = None) -> DataFrame:
    """SQL values as typed ones: 0/1 as booleans, JSON text by its DDL schema, nulls by defaults."""
    out = df
    for c in flags:
        out = out.withColumn(c, F.col(c).cast("string").isin("1", "true", "t"))
    for c, ddl in (json_columns or {}).items():
        out = out.withColumn(c, F.from_json(c, ddl))
    return out.na.fill(defaults) if defaults else out


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of one key; the filter reaches the scan."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def of_owner(df: DataFrame, owner: str, column: str = "user_key") -> DataFrame:
    return df.where(F.col(column) == F.lit(owner))


def write_release(df: DataFrame, root: str, release_id: str, kind: str, shard: str, digest: str) -> None:
    """Rows and their manifest under release_id; an existing release isn't touched."""
    df.write.mode("errorifexists").partitionBy(kind, shard).parquet(f"{root}/{release_id}/rows")
    release.shard_digests(df, kind, shard, digest).write.mode("errorifexists").parquet(f"{root}/{release_id}/manifest")


def read_release(spark: SparkSession, root: str, kind: str, shard: str, digest: str, tries: int = 2) -> DataFrame:
    """The rows of the current release, verified against its manifest.

    The pointer is read again afterwards: if it moved meanwhile, the read is repeated.
    """
    for _ in range(tries):
        step, release_id = release.pointer(spark, root)
        if release_id is None:
            raise ValueError("there is no current release")
        rows, manifest = (spark.read.parquet(f"{root}/{release_id}/{part}") for part in ("rows", "manifest"))
        bad = release.verify(rows, manifest, kind, shard, digest).limit(20).collect()
        if release.pointer(spark, root)[0] != step:
            continue
        if bad:
            raise ValueError(f"release {release_id} is damaged: {bad}")
        return rows
    raise ValueError("the release changed during every read")


def upsert(spark: SparkSession, root: str, rows: DataFrame, keys: list[str], release_id: str) -> bool:
    """Rows by key over the current release (all of them, if there is none), as a new release that becomes the current one.

    Readers see the old or the new one, never a part.  False if another writer was faster: nothing has changed then.
    """
    _, current = release.pointer(spark, root)
    new = rows
    if current is not None:
        old = spark.read.parquet(f"{root}/{current}/rows")
        new = old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
    new.write.mode("errorifexists").parquet(f"{root}/{release_id}/rows")
    return release.publish(spark, root, release_id, current)


class SnapshotCache:
    """A release's rows in memory until it is replaced; looked at again after `ttl` seconds."""

    def __init__(self, load, current, ttl: float = 300.0) -> None:
        self.load, self.current, self.ttl = load, current, ttl
        self.at, self.release, self.rows = 0.0, None, None

    def get(self, now: float) -> DataFrame:
        if self.rows is not None and now - self.at < self.ttl:
            return self.rows
        release_id = self.current()
        if self.rows is None or release_id != self.release:
            if self.rows is not None:
                self.rows.unpersist()
            self.release, self.rows = release_id, self.load(release_id).persist()
        self.at = now
        return self.rows


def add_missing(df: DataFrame, path: str, keys: list[str], digest: str) -> int:
    """Create-if-missing-or-equal: appends rows whose key isn't there; a key with another digest is an error."""
    spark = df.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys, F.col(digest).alias("_there"))
    except Exception as error:  # the table doesn't exist yet
        if "PATH_NOT_FOUND" not in str(error):
            raise
        there = df.limit(0).select(*keys, F.col(digest).alias("_there"))
    if not df.join(there, keys).where(F.col(digest) != F.col("_there")).isEmpty():
        raise ValueError("a key exists with other content")
    fresh = df.join(there, keys, "left_anti").persist()
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def report(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small table as Markdown; more than `most` rows are an error, not cut."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report has at most {most} rows")
    head = f"# {title}\n\n| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    return head + "".join(f"| {' | '.join('' if v is None else str(v) for v in r)} |\n" for r in found)
