"""Row keys and intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The temporary folder of local applications without a shared one.
_OWN: dict[str, str] = {}
#: Of each stage that runs, the tables that its result reads.
_STAGES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where none is set and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[app]


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written to the shared folder: cuts lineage and survives lost executors.  It stays, as results read it."""
    return Scratch(df.sparkSession).saved(df, name, stays=True)


class Scratch:
    """Written tables of one job, of which those that its result doesn't read are removed at its end."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def saved(self, df: DataFrame, name: str, stays: bool = False) -> DataFrame:
        """`stays`: the result reads the table, so it isn't removed."""
        path = f"{shared_dir(self.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        if not stays:
            self.paths.append(path)
        elif _STAGES:
            _STAGES[-1].append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
        self.paths = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    own = Scratch(spark)
    try:
        yield own
    finally:
        own.clear()


@contextmanager
def stage(spark: SparkSession) -> Iterator[None]:
    """Tables written within, those that results read too, are removed at its end; what is wanted of these must be written by then, by `kept`."""
    own = Scratch(spark)
    _STAGES.append(own.paths)
    try:
        yield
    finally:
        _STAGES.pop()
        own.clear()


def kept(df: DataFrame, name: str) -> tuple[DataFrame, Scratch]:
    """The rows as a table that outlives the stage, and what removes it."""
    own = Scratch(df.sparkSession)
    return own.saved(df, name), own


def quoted(name: str) -> str:
    """A column's name as a reference, whatever signs it holds."""
    return f"`{name.replace('`', '``')}`"


def row_keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits that tell rows apart by id and text; never null, so that equal rows join."""
    row_id, text = F.col(id_col).cast("string"), F.col(text_col)
    return [
        F.xxhash64(F.lit(1), F.coalesce(row_id, F.lit("\0")), text).alias("k1"),
        F.xxhash64(F.lit(2), text, F.coalesce(row_id, F.lit("\0"))).alias("k2"),
    ]


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as make it one that the table doesn't have, in any case."""
    have, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out
