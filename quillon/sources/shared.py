"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the cluster's spark.checkpoint.dir; a temporary one only where none is set and everything runs in one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = shared or tempfile.mkdtemp(prefix=f"spark-{name}-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage and survives lost executors."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(rows: DataFrame, rows_per_task: int) -> int:
    """How many tasks work on the rows, so that none gets more than about `rows_per_task`, and no core is idle.

    For `repartition`: a small file is one task otherwise, and shuffles are joined again by their bytes, whatever memory or
    time a row takes.  The rows are counted, so give a frame whose count is cheap.
    """
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_per_task))


def running(rows: DataFrame, group: str, order: list[str], size: str) -> DataFrame:
    """The rows with `before`, the sum of `size` over the rows of their group that stand before them.

    Rows are dealt by ranges of group and order, of which only the sums by task meet, so no task holds a group.
    """
    dealt = rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    dealt = written(dealt.withColumns({"_task": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "running")
    sums = dealt.groupBy(group, "_task").agg(F.sum(size).alias("_sum"))
    sums = sums.select(group, "_task", F.expr(f"sum(_sum) OVER (PARTITION BY {group} ORDER BY _task) - _sum").alias("_start"))
    inner = F.expr(f"coalesce(sum({size}) OVER (PARTITION BY {group}, _task ORDER BY _at ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)")
    return dealt.withColumn("_inner", inner).join(sums, [group, "_task"]).withColumn("before", F.col("_start") + F.col("_inner")).drop("_task", "_at", "_inner", "_start")
