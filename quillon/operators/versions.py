"""Versioned ingest: plans of inserts, updates, retirements, checked before they are applied."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _differs(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (~F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}")) for c in columns), F.lit(False))


def merge_plan(old: DataFrame, new: DataFrame, key: str, columns: list[str], active: str | None = None) -> DataFrame:
    """Every key with its op: insert, update, reactivate, unchanged, retire, or retired (already).

    `active` names the old side's flag; without it all old rows are active.
    """
    flag = F.col(active) if active else F.lit(True)
    was = old.select(F.col(key).alias("key"), F.struct(*columns).alias("old"), flag.alias("was_active"))
    comes = new.select(F.col(key).alias("key"), F.struct(*columns).alias("new"))
    joined = was.join(comes, "key", "full_outer")
    op = (
        F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull() & F.col("was_active"), "retire").when(F.col("new").isNull(), "retired")
        .when(~F.col("was_active"), "reactivate").when(_differs(columns), "update").otherwise("unchanged")
    )
    return joined.select(F.col("key").alias(key), op.alias("op"), "old", "new")


def bank_plan(old: DataFrame, new: DataFrame, key: str, provenance: list[str], columns: list[str], managed: Column, active: str) -> DataFrame:
    """(old_key, new_key, op, old, new) of a bank against a new version of it.

    A new row is matched by its key, else by its whole provenance.  If both find a row and these differ, or several new
    rows find the same one, the op is `conflict`.  Others: insert, update (a column differs), reactivate, unchanged,
    and, for old rows that nothing has found, retire (managed and active) or keep.
    """
    whole = F.lit(True)
    for c in provenance:
        whole = whole & F.col(c).isNotNull()
    was = old.select(F.col(key).alias("old_key"), *(F.col(c).alias(f"_{c}") for c in provenance), whole.alias("_whole"), F.struct(*columns).alias("old"), F.coalesce(managed, F.lit(False)).alias("_managed"), F.coalesce(active, F.lit(True)).alias("_active"))
    places = was.where("_whole").groupBy(*(f"_{c}" for c in provenance)).agg(F.min("old_key").alias("_by_place"))
    comes = new.select(F.col(key).alias("new_key"), *(F.col(c).alias(f"_{c}") for c in provenance), F.struct(*columns).alias("new"))
    keyed = was.select(F.col("old_key").alias("_by_key"))
    found = comes.join(keyed, F.col("new_key") == F.col("_by_key"), "left").join(places, [f"_{c}" for c in provenance], "left")
    found = found.withColumn("old_key", F.coalesce("_by_key", "_by_place")).withColumn("_two", F.col("_by_key") != F.col("_by_place"))
    claims = found.where("old_key IS NOT NULL").groupBy("old_key").agg((F.count("*") > 1).alias("_shared"))
    found = found.join(claims, "old_key", "left").select("old_key", "new_key", "new", (F.coalesce("_two", F.lit(False)) | F.coalesce("_shared", F.lit(False))).alias("_conflict"))
    joined = was.select("old_key", "old", "_managed", "_active").join(found, "old_key", "full_outer")
    op = (
        F.when(F.col("_conflict"), "conflict").when(F.col("new").isNotNull() & F.col("old").isNull(), "insert").when(F.col("new").isNull(), F.when(F.col("_managed") & F.col("_active"), "retire").otherwise("keep"))
        .when(~F.col("_active"), "reactivate").when(_differs(columns), "update").otherwise("unchanged")
    )
    return joined.select("old_key", "new_key", op.alias("op"), "old", "new")


def require_no_conflicts(plan: DataFrame) -> DataFrame:
    """The plan, if it has no conflict: a version is applied as a whole or not at all."""
    bad = plan.where("op = 'conflict'").select("old_key", "new_key").limit(20).collect()
    if bad:
        raise ValueError(f"rows match different questions by key and by provenance: {bad}")
    return plan


def materialised(items: DataFrame, runtime: DataFrame, item: str, link: str, eligible: Column, digest: str, label: str) -> DataFrame:
    """(item, runtime_id, op): what the runtime table needs for each archive item.

    Eligible items: insert, adopt (an unlinked runtime row has the item's label), update (the linked row's digest
    differs), reactivate, unchanged.  Others: retire a linked active row, else none.
    `runtime`: (runtime_id, link, label, digest, is_active).
    """
    linked = runtime.where(F.col(link).isNotNull()).select(F.col(link).alias(item), F.col("runtime_id").alias("_linked"), F.col(digest).alias("_digest"), F.col("is_active").alias("_active"))
    loose = runtime.where(F.col(link).isNull()).groupBy(label).agg(F.when(F.count("*") == 1, F.min("runtime_id")).alias("_loose"))
    joined = items.withColumn("_eligible", F.coalesce(eligible, F.lit(False))).join(linked, item, "left").join(loose, label, "left")
    there = F.col("_linked").isNotNull()
    op = (
        F.when(F.col("_eligible") & ~there & F.col("_loose").isNotNull(), "adopt").when(F.col("_eligible") & ~there, "insert").when(~F.col("_eligible") & there & F.col("_active"), "retire")
        .when(~F.col("_eligible"), "none").when(~F.col("_active"), "reactivate").when(F.col("_digest") != F.col(digest), "update").otherwise("unchanged")
    )
    return joined.select(item, F.when(there, F.col("_linked")).when(op == "adopt", F.col("_loose")).alias("runtime_id"), op.alias("op"))


def cleanup_findings(rows: DataFrame, ledger: DataFrame, key: str, fingerprint: str, keep: DataFrame) -> DataFrame:
    """(key, problem) of a guarded cleanup: every retired fingerprint must be that of exactly one row, and what stays
    must be the keep set.  `ledger`: (key, fingerprint) of the rows to retire.
    """
    n = rows.groupBy(fingerprint).agg(F.count("*").alias("_n"))
    retired = ledger.join(n, fingerprint, "left").select(key, F.when(F.col("_n").isNull(), "fingerprint_unknown").when(F.col("_n") > 1, "fingerprint_repeated").alias("problem"))
    stays = rows.join(ledger.select(key), key, "left_anti").select(key).distinct()
    wanted = keep.select(key).distinct()
    left = stays.join(wanted, key, "left_anti").withColumn("problem", F.lit("kept_unexpectedly")).unionByName(wanted.join(stays, key, "left_anti").withColumn("problem", F.lit("keep_missing")))
    return retired.where("problem IS NOT NULL").unionByName(left)


def plan_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("op").agg(F.count("*").alias("rows"))


def guard(plan: DataFrame, expected: dict[str, int]) -> None:
    """Raises unless the plan has exactly the expected number of rows of each op: validate, then apply."""
    found = {r["op"]: r["rows"] for r in plan_counts(plan).collect()}
    wrong = {op: (n, found.get(op, 0)) for op, n in expected.items() if found.get(op, 0) != n}
    if wrong:
        raise ValueError(f"plan differs from what is expected: {wrong}")


def applied(plan: DataFrame, key: str) -> DataFrame:
    """The rows after the plan: new values where there are any; retired rows stay, inactive."""
    row = F.coalesce("new", "old")
    return plan.select(key, row.alias("row"), F.col("new").isNotNull().alias("is_active")).select(key, "row.*", "is_active")


def inverse(plan: DataFrame) -> DataFrame:
    """The plan that undoes this one."""
    back = {"insert": "retire", "retire": "reactivate", "reactivate": "retire", "update": "update"}
    op = reduce(lambda rest, kv: F.when(F.col("op") == kv[0], F.lit(kv[1])).otherwise(rest), back.items(), F.col("op"))
    return plan.withColumns({"op": op, "old": F.col("new"), "new": F.when(F.col("op") != "insert", F.col("old"))})


def row_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repeats, that only one side has."""
    return a.exceptAll(b).withColumn("side", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("side", F.lit("added")))


def backfill_plan(source: DataFrame, target: DataFrame, key: str, digest: str) -> DataFrame:
    """What a copy of state needs: missing, matching, conflict, or extra rows of the target."""
    a = source.select(F.col(key), F.col(digest).alias("_a"))
    b = target.select(F.col(key), F.col(digest).alias("_b"))
    state = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").when(F.col("_a") == F.col("_b"), "matching").otherwise("conflict")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def upload_decision(audit: list[tuple[str, str]], version: str, checksum: str) -> str:
    """skip (same version and checksum), refuse (same version, other checksum) or apply."""
    known = dict(audit)
    return "apply" if version not in known else "skip" if known[version] == checksum else "refuse"


def audit_state(audit: DataFrame, version: str, at: str, uploads: DataFrame) -> DataFrame:
    """Each upload (version, checksum) against the audit log (version, checksum, at): apply, refuse (another checksum
    under that version), repeat_latest, or repeat_older (it is there, but a later version is in force)."""
    known = audit.groupBy(version).agg(F.max_by("checksum", at).alias("_sum"), F.max(at).alias("_at"))
    latest = audit.agg(F.max(at).alias("_latest"))
    joined = uploads.join(known, version, "left").crossJoin(F.broadcast(latest))
    state = F.when(F.col("_sum").isNull(), "apply").when(F.col("_sum") != F.col("checksum"), "refuse").when(F.col("_at") == F.col("_latest"), "repeat_latest").otherwise("repeat_older")
    return joined.select(version, "checksum", state.alias("state"))


def import_rows(rows: DataFrame, known: DataFrame, keys: list[str], problems: Column) -> DataFrame:
    """Row importer: op invalid, exists, repeated or insert; the first row of a key by `seq` is inserted."""
    from pyspark.sql import Window

    flagged = rows.withColumn("problems", problems)
    there = known.select(*keys).distinct().withColumn("_there", F.lit(True))
    rank = F.row_number().over(Window.partitionBy(*keys, F.size("problems") > 0).orderBy("seq"))
    op = F.when(F.size("problems") > 0, "invalid").when(F.col("_there"), "exists").when(rank > 1, "repeated").otherwise("insert")
    return flagged.join(there, keys, "left").withColumn("op", op).drop("_there")


def transfer_owner(rows: DataFrame, owners: DataFrame, owner_col: str = "user_id") -> DataFrame:
    """Rows of a guest become those of the account that claimed it (guest, account)."""
    known = owners.select(F.col("guest").alias("_guest"), F.col("account").alias("_account"))
    return rows.join(known, F.col(owner_col) == F.col("_guest"), "left").withColumn(owner_col, F.coalesce("_account", owner_col)).drop("_guest", "_account")


def without_owners(rows: DataFrame, gone: DataFrame, owner_col: str = "user_id") -> DataFrame:
    """A reset: the rows of owners that aren't in `gone`."""
    return rows.join(gone.select(owner_col).distinct(), owner_col, "left_anti")
