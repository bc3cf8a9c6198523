"""Operator 3 [native]: mixing sources to target weights with soft membership.

A labelled table (id, domain) trains a naive Bayes classifier on hashed words; it gives
every document posteriors p over the domains.  Projected gradient steps then fit
nonnegative rates r (expected copies of a document) so that the expected tokens of each
domain, sum of tokens * p * r, meet the targets in least squares.  The gradients add up and
their sum is projected, so that a row which once falls to zero can come back:

    y <- y - length * p . D (expected - target),  r = max(0, y), from y = 1

D divides by the sum of tokens * p * p of each domain over the rows with y > 0, which the same pass over
the table computes, and the length is spectral: the inverse of the curvature along the step before (Barzilai and
Borwein), which settles in some ten passes where a fixed length takes hundreds.  Such steps may raise the convex
objective now and then; one that raises it above its last six values is shortened.  As y = 1 - p . m with K numbers m,
no rates are stored between passes; of all rates that meet the targets these are the
nearest to 1 in token-weighted least squares.  A step needs K * (K + 5) / 2 + 1 sums on the
driver, however large the table.  Only where no nonnegative rates meet the targets do such steps stall, as m has no end
there; steps of the whole metric of K * K sums then lead on to the least-squares rates.

Only the labelled rows are bounded: the classifier learns from about
`rows_per_domain` rows of each domain, chosen by a hash of their id.  Null and empty
texts have no tokens, their posteriors are the priors.  Domains without labels have the
prior of one row.  Rows that repeat id and text share one rate; the fit counts each of
them.  Labels of unknown ids or null domains are ignored.  Without tokens at all, rates
stay 1.  The fit ends when the totals meet the targets, or at the least-squares rates where
no nonnegative rates meet them; if neither is so after `most_passes`, it fails rather than
return half a fit.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from math import log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.langid import hash_below
from quillon.llm.shared import fresh, quoted, row_keys, saved


_LOG = logging.getLogger(__name__)


@dataclass(frozen=True)
class MixSettings:
    """`evidence_words`: a text counts as at most so many words of evidence, which keeps membership soft: with few of them most documents
    have about a tenth of every domain, and a small target could only be met by many copies of few documents;
    `tolerance`: largest misfit, as a share of all tokens; `ridge`: the weight of m itself, which keeps it finite where targets can't be met;
    `patience`: steps in which the misfit must halve, else steps of the whole metric follow."""

    buckets: int = 4096
    rows_per_domain: int = 2000
    smoothing: float = 0.5
    evidence_words: float = 384.0
    most_passes: int = 100
    patience: int = 16
    tolerance: float = 1e-4
    ridge: float = 1e-7


def _buckets(text_col: str, buckets: int) -> Column:
    words = F.split(F.lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, k1, k2, n_rows, tokens, p0, p1, ...) with one p per domain, in the order given; one row for the
    `n_rows` rows that repeat id and text.

    `labelled` has the columns `id` and `domain`.
    """
    size = {d: 0 for d in domains} | {r["domain"]: r["count"] for r in labelled.where(F.col("domain").isin(domains)).groupBy("domain").count().collect()}
    share = F.create_map(*(F.lit(x) for d in domains for x in (d, min(1.0, settings.rows_per_domain / max(1, size[d])))))
    # about rows_per_domain rows of each domain: their number is bounded, whatever the table's size
    sample = labelled.where(F.col("domain").isin(domains)).where(hash_below("id", share[F.col("domain")])).select(F.col("id").alias("_id"), "domain")
    docs = docs.select(id_col, text_col)
    learned = docs.join(F.broadcast(sample), F.col(id_col) == F.col("_id")).select("domain", F.explode(_buckets(text_col, settings.buckets)).alias("b"))
    counts = learned.groupBy("b").agg(*(F.sum((F.col("domain") == d).cast("double")).alias(f"n{k}") for k, d in enumerate(domains)))
    counts = saved(counts, "mix-counts")
    total = counts.agg(*(F.coalesce(F.sum(f"n{k}"), F.lit(0.0)).alias(f"n{k}") for k in range(len(domains)))).first()
    # evidence over that of a bucket that no labelled row has
    a = settings.smoothing
    model = counts.select("b", *(F.log((F.col(f"n{k}") + a) / a).alias(f"w{k}") for k in range(len(domains))))
    # keys first: what stands beside explode() is computed for every exploded row
    hashed = docs.select(F.col(id_col).alias("doc_id"), *row_keys(id_col, text_col), _buckets(text_col, settings.buckets).alias("words"))
    words = hashed.select("doc_id", "k1", "k2", F.posexplode_outer("words").alias("at", "b"))
    # the model has at most `buckets` rows
    sums = words.join(F.broadcast(model), "b", "left").groupBy("doc_id", "k1", "k2").agg(
        F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("n_rows"), F.count("b").alias("tokens"), *(F.coalesce(F.sum(f"w{k}"), F.lit(0.0)).alias(f"w{k}") for k in range(len(domains)))
    )
    sums = sums.select("doc_id", "k1", "k2", "n_rows", F.expr("tokens div n_rows").alias("tokens"), *((F.col(f"w{k}") / F.col("n_rows")).alias(f"w{k}") for k in range(len(domains))))
    evidence = F.when(F.col("tokens") > settings.evidence_words, settings.evidence_words / F.col("tokens")).otherwise(1.0)
    n = sum(size.values())
    logits = [
        evidence * (F.col(f"w{k}") + F.col("tokens") * log(a / (total[f"n{k}"] + a * settings.buckets))) + log((size[d] + 1) / (n + len(domains)))
        for k, d in enumerate(domains)
    ]
    scored = sums.select("doc_id", "k1", "k2", "n_rows", "tokens", *(x.alias(f"l{k}") for k, x in enumerate(logits)))
    top = F.greatest(*(F.col(f"l{k}") for k in range(len(domains)))) if len(domains) > 1 else F.col("l0")
    weights = [F.exp(F.col(f"l{k}") - top) for k in range(len(domains))]
    return scored.select("doc_id", "k1", "k2", "n_rows", "tokens", *((w / sum(weights[1:], weights[0])).alias(f"p{k}") for k, w in enumerate(weights)))


def fit_rates(members: DataFrame, targets: list[float], total_tokens: float | None = None, settings: MixSettings = MixSettings()) -> DataFrame:
    """`members` with the column `rate`; `targets`: the weight of each domain, any positive scale.

    `total_tokens`: the expected size of the mixture, by default that of the corpus.
    """
    members = saved(members, "mix-members")
    domains = range(len(targets))
    tokens = F.col("n_rows") * F.col("tokens")

    def rate(m: list[float]) -> Column:
        return F.greatest(F.lit(0.0), 1.0 - sum((F.col(f"p{k}") * float(m[k]) for k in domains), F.lit(0.0)))

    def passed(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Expected totals, sums of tokens * p * p' over the open rows, and that of tokens * rate**2, in one pass."""
        rated = members.select("*", rate(m).alias("rate"))
        total = lambda x: F.coalesce(F.sum(tokens * x), F.lit(0.0))
        pairs = [(j, k) for j in domains for k in domains if j <= k]
        open_ = (F.col("rate") > 0).cast("double")
        row = rated.agg(*(total(F.col(f"p{k}") * F.col("rate")) for k in domains), *(total(F.col(f"p{j}") * F.col(f"p{k}") * open_) for j, k in pairs), total(F.col("rate") * F.col("rate"))).first()
        metric = np.zeros((len(targets), len(targets)))
        for (j, k), x in zip(pairs, row[len(targets) : -1]):
            metric[j, k] = metric[k, j] = x
        return np.array(row[: len(targets)]), metric, row[-1]

    m = np.zeros(len(targets))
    expected, metric, squares = passed(m)
    size = expected
    want = total_tokens if total_tokens is not None else float(size.sum())
    if want <= 0 or size.sum() <= 0:
        return members.withColumn("rate", F.lit(1.0))
    known = size > 0
    goal = np.where(known, want * np.array(targets, dtype=float) / sum(targets), 0.0)
    ridge = settings.ridge * np.where(known, size, 1.0)
    objective = lambda m, squares: squares / 2 + goal @ m + ridge @ (m * m) / 2
    misfit = lambda: np.abs(expected - goal).max() / want
    slope, values, misfits, passes, length = goal - expected, [objective(m, squares)], [misfit()], 1, 1.0
    while misfit() >= settings.tolerance and np.abs(slope).max() >= 0.01 * settings.tolerance * want:
        stalled = len(misfits) > settings.patience and misfits[-1] > misfits[-1 - settings.patience] / 2
        scale = 1.0 / np.maximum(metric.diagonal() + ridge, 1e-12 * want)  # by domain, so that rare ones move as fast as common ones
        step = -np.linalg.solve(metric + np.diag(ridge), slope) if stalled else -length * scale * slope
        limit, share = values[-1] if stalled else max(values[-6:]), 1.0
        while True:
            if passes >= settings.most_passes:
                raise RuntimeError(f"the rates don't settle in {passes} passes: misfit {misfit():.2g} of all tokens")
            expected, metric, squares = passed(m + share * step)
            passes += 1
            if objective(m + share * step, squares) <= limit + 1e-4 * share * (slope @ step) or share < 1e-6:
                break
            share /= 2
        step, before = share * step, slope
        m = m + step
        slope = goal - expected + ridge * m
        bent = step @ (slope - before)
        # the inverse of the curvature along this step, in the metric of the scales
        length = min(1e3, max(1e-3, (step / scale) @ step / bent)) if bent > 0 else 1.0
        values.append(objective(m, squares))
        misfits.append(misfit())
    _LOG.info("rates fitted in %d passes, misfit %.2g of all tokens", passes, misfit())
    return members.withColumn("rate", rate(m))


def copies(rate: Column) -> Column:
    """Whole copies: the rate rounded up or down by a hash of the row, so that the expectation is the rate."""
    part = F.pmod(F.xxhash64(F.lit(9), F.col("k1"), F.col("k2")), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor(rate) + (part < rate - F.floor(rate)).cast("long")).cast("long")


def label_domains(labels: DataFrame) -> DataFrame:
    """The labels table as (id, domain): toxic, high or low quality."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low")
    return labels.select(F.col("doc_id").alias("id"), domain.alias("domain")).where(F.col("domain").isNotNull())


#: Weights of the domains in the registered query and the pipeline.
TARGETS = {"high": 0.80, "low": 0.18, "toxic": 0.02}


def rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, settings: MixSettings = MixSettings()) -> DataFrame:
    """(doc_id, k1, k2, n_rows, tokens, p..., rate); one row for the rows that repeat id and text."""
    return fit_rates(posteriors(docs, label_domains(labels), list(targets), settings), list(targets.values()), settings=settings)


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] = TARGETS, settings: MixSettings = MixSettings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that the mixture holds, with `rate` and `copies` (one or more); columns of these names are replaced."""
    own1, own2, own_rate, n = fresh(docs.columns, "mix_k1", "mix_k2", "mix_rate", "mix_copies")
    rate = rates(docs, labels, targets, settings).select(F.col("k1").alias(own1), F.col("k2").alias(own2), F.col("rate").alias(own_rate), copies(F.col("rate")).alias(n))
    k1, k2 = row_keys(id_col, text_col)
    joined = docs.join(rate.where(F.col(n) > 0), (k1 == F.col(own1)) & (k2 == F.col(own2)))
    left = [quoted(c) for c in docs.columns if c not in ("rate", "copies")]
    return joined.select(*left, F.round(own_rate, 6).alias("rate"), F.col(n).alias("copies"))
