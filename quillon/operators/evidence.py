"""Evidence decisions: policies, overrides, corroboration, drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import answers


def compiled_policy(groups: DataFrame, name: str = "label") -> DataFrame:
    """(signature, label) from grouped decisions (label, signatures); a signature with two labels has null and `conflict`."""
    flat = groups.select(F.col(name), F.explode("signatures").alias("signature")).distinct()
    return flat.groupBy("signature").agg(F.when(F.count("*") == 1, F.min(name)).alias(name), (F.count("*") > 1).alias("conflict"))


def classified(slots: DataFrame, policy: DataFrame, overrides: DataFrame, slot: str) -> DataFrame:
    """Each slot's label by precedence: slot override, then verified own label, then its signature's policy.

    `slots`: (slot, signature, own_label, verified); `overrides`: (slot, label, evidence_sha).
    A conflict of the policy withholds what neither an override nor a verified label settles.
    """
    known = policy.withColumnsRenamed({"label": "_policy", "conflict": "_conflict"})
    over = overrides.select(slot, F.col("label").alias("_override"))
    joined = slots.join(known, "signature", "left").join(over, slot, "left")
    own = F.when(F.col("verified"), F.col("own_label"))
    conflict = F.coalesce("_conflict", F.lit(False))
    source = (
        F.when(F.col("_override").isNotNull(), "override").when(own.isNotNull(), "verified").when(conflict, "withheld")
        .when(F.col("_policy").isNotNull(), "policy").when(F.col("own_label").isNotNull(), "candidate").otherwise("unclassified")
    )
    label = F.when(source == "override", F.col("_override")).when(source == "verified", own).when(source == "policy", F.col("_policy")).when(source == "candidate", F.col("own_label"))
    return joined.select(slot, label.alias("label"), source.alias("source"), (source == "candidate").alias("review"))


def drifted(decisions: DataFrame, evidence: DataFrame, key: str, digest: str) -> DataFrame:
    """Decisions whose evidence is gone or has another digest than when they were made."""
    now = evidence.select(key, F.col(digest).alias("_now"))
    problem = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") != F.col(digest), "changed")
    return decisions.join(now, key, "left").select(key, problem.alias("problem")).where("problem IS NOT NULL")


def require_no_drift(decisions: DataFrame, evidence: DataFrame, key: str, digest: str) -> None:
    """Raises if a decision's evidence has changed: it is never quietly classified anew."""
    bad = drifted(decisions, evidence, key, digest).limit(20).collect()
    if bad:
        raise ValueError(f"evidence has drifted: {bad}")


def source_verification(rows: DataFrame, key: str) -> DataFrame:
    """verified (official byte identity, or two independent domains), review, or rejected (an integrity failure).

    `rows`: (key, domain, official, identical, intact).
    """
    found = rows.groupBy(key).agg(
        F.bool_or(F.col("official") & F.col("identical")).alias("official"), F.count_distinct(F.when(F.col("identical"), F.col("domain"))).alias("domains"), F.every("intact").alias("intact")
    )
    decision = F.when(~F.col("intact"), "rejected").when(F.col("official") | (F.col("domains") >= 2), "verified").otherwise("review")
    return found.select(key, decision.alias("decision"), "domains")


def corroborated(rows: DataFrame, key: str, value: str, source: str, least_sources: int = 2, agree: tuple[str, ...] = ()) -> DataFrame:
    """Keys with one value that enough distinct sources give, and one value of each column that has to agree too."""
    found = rows.where(F.col(value).isNotNull()).groupBy(key).agg(
        F.count_distinct(source).alias("sources"), F.count_distinct(value).alias("values"), F.min(value).alias("value"), *(F.count_distinct(c).alias(f"_{k}") for k, c in enumerate(agree))
    )
    one = (F.col("values") == 1) & (F.col("sources") >= least_sources)
    for k in range(len(agree)):
        one = one & (F.col(f"_{k}") <= 1)
    return found.where(one).select(key, "value", "sources")


def selected_claim(canonical: Column, secondary: Column, kind: Column | None = None) -> Column:
    """struct(value, status) from the canonical value and an array of secondary ones (nulls ignored).

    With the question's kind, answers that mean the same count as equal: see `answers.fingerprint`.
    """
    same = (lambda v: v) if kind is None else (lambda v: answers.fingerprint(kind, v))
    given = F.filter(secondary, lambda v: v.isNotNull())
    prints = F.array_distinct(F.transform(given, same))
    others = F.exists(prints, lambda v: v != same(canonical))
    n = F.size(given)
    status = (
        F.when(canonical.isNotNull() & others, "conflict").when(canonical.isNotNull(), "canonical").when(F.size(prints) > 1, "conflict")
        .when(n >= 2, "corroborated").when(n == 1, "single").otherwise("missing")
    )
    value = F.when(status == "canonical", canonical).when(status.isin("corroborated", "single"), F.get(given, F.lit(0)))
    return F.struct(value.alias("value"), status.alias("status"))


def used_once(links: DataFrame, source: str, target: str) -> DataFrame:
    """Links of sources that support one target only; the others are returned with `reused`."""
    n = links.groupBy(source).agg((F.count_distinct(target) > 1).alias("reused"))
    return links.join(n, source)


def remaining(blockers: Column, satisfied: Column) -> Column:
    """Blockers that aren't satisfied yet, sorted."""
    return F.array_sort(F.array_except(blockers, satisfied))
