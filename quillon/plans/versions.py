"""Queries on versions and releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import release, versions
from quillon.plans.registry import query
from quillon.plans.star import table

_OLD = "SELECT p_partkey AS id, p_name AS name, p_size AS size, p_partkey % 11 <> 0 AS is_active FROM part WHERE p_partkey % 10 <> 0"
_NEW = "SELECT p_partkey AS id, p_name AS name, p_size + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS size FROM part WHERE p_partkey % 7 <> 0"
_PLAN = f"""plan AS (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL AND o.is_active THEN 'retire' WHEN n.id IS NULL THEN 'retired'
  WHEN NOT o.is_active THEN 'reactivate' WHEN o.name IS DISTINCT FROM n.name OR o.size IS DISTINCT FROM n.size THEN 'update' ELSE 'unchanged' END AS op, o.size AS old_size, n.size AS new_size FROM ({_OLD}) o FULL JOIN ({_NEW}) n ON o.id = n.id)"""


def old_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), (F.col("p_partkey") % 11 != 0).alias("is_active"))


def new_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").where("p_partkey % 7 <> 0")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), (F.col("p_size") + F.when(F.col("p_partkey") % 5 == 0, 1).otherwise(0)).alias("size"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.merge_plan(old_bank(spark, sf_dir), new_bank(spark, sf_dir), "id", ["name", "size"], "is_active")


@query(f"WITH {_PLAN} SELECT id, op FROM plan")
def bank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).select("id", "op")


@query(f"WITH {_PLAN} SELECT op, count(*) AS rows FROM plan GROUP BY op")
def archive_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.plan_counts(plan(spark, sf_dir))


@query(f"WITH {_PLAN} SELECT id, CAST(coalesce(new_size, old_size) AS BIGINT) AS size, new_size IS NOT NULL AS is_active FROM plan")
def merged_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.applied(plan(spark, sf_dir), "id").select("id", F.col("size").cast("long").alias("size"), "is_active")


@query(f"WITH {_PLAN} SELECT id, CASE op WHEN 'insert' THEN 'retire' WHEN 'retire' THEN 'reactivate' WHEN 'reactivate' THEN 'retire' ELSE op END AS op FROM plan")
def restore_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.inverse(plan(spark, sf_dir)).select("id", "op")


@query(f"WITH o AS (SELECT id, name, size FROM ({_OLD})), n AS (SELECT id, name, size FROM ({_NEW})) SELECT *, 'removed' AS side FROM (FROM o EXCEPT ALL FROM n) UNION ALL SELECT *, 'added' FROM (FROM n EXCEPT ALL FROM o)")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.row_diff(old_bank(spark, sf_dir).select("id", "name", "size"), new_bank(spark, sf_dir).select("id", "name", "size"))


_DIGEST = "sha256(concat_ws('|', id, name, size))"


@query(f"""WITH o AS (SELECT id, {_DIGEST} AS d FROM ({_OLD})), n AS (SELECT id, {_DIGEST} AS d FROM ({_NEW}))
  SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.d IS NULL THEN 'missing' WHEN o.d IS NULL THEN 'extra' WHEN o.d = n.d THEN 'matching' ELSE 'conflict' END AS state FROM o FULL JOIN n ON o.id = n.id""")
def state_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.concat_ws("|", F.col("id").cast("string"), "name", F.col("size").cast("string")), 256).alias("d")
    return versions.backfill_plan(old_bank(spark, sf_dir).select("id", digest), new_bank(spark, sf_dir).select("id", digest), "id", "d")


_ROWS = """row AS (SELECT 'part' AS kind, p_partkey // 500 AS shard, sha256(concat_ws('|', p_partkey, p_name, p_brand, p_type)) AS d FROM part
  UNION ALL SELECT 'customer', c_custkey // 500, sha256(concat_ws('|', c_custkey, c_name, c_mktsegment)) FROM customer
  UNION ALL SELECT 'orders', o_orderkey // 500, sha256(concat_ws('|', o_orderkey, o_custkey, o_orderstatus)) FROM orders),
  shards AS (SELECT kind, shard, count(*) AS rows, sha256(string_agg(d, chr(10) ORDER BY d)) AS digest FROM row GROUP BY kind, shard)"""


def release_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    def rows(name: str, key: str, *columns: str) -> DataFrame:
        digest = F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in (key, *columns))), 256)
        return table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.floor(F.col(key) / 500).alias("shard"), digest.alias("d"))

    return rows("part", "p_partkey", "p_name", "p_brand", "p_type").unionByName(rows("customer", "c_custkey", "c_name", "c_mktsegment")).unionByName(rows("orders", "o_orderkey", "o_custkey", "o_orderstatus"))


@query(f"WITH {_ROWS} SELECT * FROM shards")
def release_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.shard_digests(release_rows(spark, sf_dir), "kind", "shard", "d")


@query(f"WITH {_ROWS} SELECT kind, CAST(sum(rows) AS BIGINT) AS rows, count(*) AS shards, sha256(string_agg(digest, chr(10) ORDER BY digest)) AS digest FROM shards GROUP BY kind")
def release_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return release.kind_digests(release_shards(spark, sf_dir), "kind")


@query("""WITH RECURSIVE r AS (SELECT c_mktsegment AS kind, c_custkey AS id, CAST(strlen(c_name) + 40 + c_custkey % 97 AS BIGINT) AS bytes, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS k FROM customer),
  p AS (SELECT kind, id, bytes, k, bytes AS held, CAST(0 AS BIGINT) AS shard FROM r WHERE k = 1
    UNION ALL SELECT r.kind, r.id, r.bytes, r.k, CASE WHEN p.held + r.bytes > 4096 THEN r.bytes ELSE p.held + r.bytes END, p.shard + CASE WHEN p.held + r.bytes > 4096 THEN 1 ELSE 0 END FROM p JOIN r ON r.kind = p.kind AND r.k = p.k + 1)
  SELECT kind, id, bytes, shard FROM p""")
def packed_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy byte-bounded shards of the customers of each segment, in the order of their ids."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("kind"), F.col("c_custkey").alias("id"), (F.octet_length("c_name") + 40 + F.pmod("c_custkey", F.lit(97))).cast("long").alias("bytes"))
    return release.packed(rows, "kind", "id", "bytes", 4096)
