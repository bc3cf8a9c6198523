"""Mastery analytics from evidence: accuracy, recency, volume and coverage by topic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALF_LIFE_DAYS = 30.0
TOPIC_TARGET, OVERALL_TARGET = 10, 50


def recency_weight(at: Column, now: Column) -> Column:
    """Halves every 30 days; future times count as now."""
    days = F.greatest(F.lit(0.0), (F.unix_micros(now) - F.unix_micros(at.cast("timestamp"))) / 86_400e6)
    return F.pow(F.lit(0.5), days / HALF_LIFE_DAYS)


def mastery(accuracy: Column, recency: Column, answered: Column, coverage: Column, target: int) -> Column:
    volume = F.least(answered / target, F.lit(1.0))
    return 100 * (0.45 * accuracy + 0.20 * recency + 0.20 * volume + 0.15 * coverage)


def status(answered: Column, accuracy: Column, recency: Column, score: Column) -> Column:
    """Decided on unrounded values."""
    strong = (answered >= 5) & (accuracy >= 0.75) & (recency >= 0.70) & (score >= 65)
    weak = (accuracy < 0.60) | (recency < 0.55) | (score < 50)
    return F.when(answered == 0, "unattempted").when(strong, "strong").when(weak, "needs_practice").otherwise("developing")


def analytics(evidence: DataFrame, questions: DataFrame, groups: list[str], now: Column, target: int) -> DataFrame:
    """Per learner and group of active questions (all groups of each learner): counts, shares, mastery, status.

    Accuracy and recency use each question's latest answered status; solved is ever right.
    """
    active = questions.where("is_active")
    available = active.groupBy(*groups).agg(F.count("*").alias("available")) if groups else active.agg(F.count("*").alias("available"))
    right = (F.col("latest_status") == "correct").cast("double")
    weight = F.when(F.col("latest_status").isNotNull(), recency_weight(F.col("latest_answered_at"), now))
    counts = {
        "attempts": F.sum("attempt_count"), "attempted": F.count("*"), "answered": F.count("latest_status"), "solved": F.count_if(F.col("correct_count") > 0),
        "correct": F.count_if(F.col("latest_status") == "correct"), "incorrect": F.count_if(F.col("latest_status") == "incorrect"), "unanswered": F.sum("unanswered_count"),
    }
    others = {"right_weight": F.sum(weight * right), "weight": F.sum(weight), "last_attempted_at": F.max("last_attempted_at")}
    # questions that aren't active keep their learner, in a group of their own that is taken out below
    joined = evidence.drop(*groups).join(active.select("question_id", *groups, F.lit(True).alias("_active")), "question_id", "left")
    sums = joined.groupBy("user_id", "_active", *groups).agg(*(c.alias(name) for name, c in (counts | others).items()))
    filled = zero_filled(sums.where("user_id IS NOT NULL"), available, groups, list(counts), list(others), F.col("_active"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    shares = filled.select(
        "*", share(F.col("correct"), F.col("answered")).alias("_accuracy"), share(F.col("right_weight"), F.col("weight")).alias("_recency"),
        share(F.col("attempted"), F.col("available")).alias("_attempted"), share(F.col("solved"), F.col("available")).alias("_solved"),
    ).withColumn("_score", mastery(F.col("_accuracy"), F.col("_recency"), F.col("answered"), F.col("_attempted"), target))
    return shares.select(
        "user_id", *groups, "available", "attempts", "attempted", "answered", "solved", "correct", "incorrect", "unanswered",
        F.round(F.col("_accuracy") * 100, 2).alias("accuracy"), F.round(F.col("_recency") * 100, 2).alias("recency"), F.round(F.col("_attempted") * 100, 2).alias("attempted_percent"),
        F.round(F.col("_solved") * 100, 2).alias("solved_percent"), F.round("_score", 2).alias("mastery"), status(F.col("answered"), F.col("_accuracy"), F.col("_recency"), F.col("_score")).alias("status"), "last_attempted_at",
    )


def zero_filled(sums: DataFrame, every: DataFrame, groups: list[str], counts: list[str], others: list[str], real: Column, learner: str = "user_id") -> DataFrame:
    """Each learner of `sums` with all groups of `every`: counts are 0, other columns null, where they have no row.

    A learner's groups are gathered into one row and matched with the array of all groups, so `sums` is computed once.
    The groups of a syllabus are few: they fit an array.  `real`: which rows of sums count.
    """
    columns = [*counts, *others]
    key = lambda x: F.to_json(F.struct(*(x(g).alias(g) for g in groups))) if groups else F.lit("")
    entry = F.struct(key(F.col).alias("key"), F.struct(*columns).alias("value"))
    own = sums.groupBy(learner).agg(F.map_from_entries(F.collect_list(F.when(F.coalesce(real, F.lit(False)), entry))).alias("_own"))
    listed = every.select(F.struct(*every.columns).alias("g"), key(F.col).alias("key")).agg(F.collect_list(F.struct("g", "key")).alias("_all"))
    spread = own.crossJoin(F.broadcast(listed)).select(learner, F.explode("_all").alias("_e"), "_own")  # one row on the right
    matched = spread.select(learner, "_e.g.*", F.try_element_at("_own", F.col("_e.key")).alias("_v"))
    return matched.select(learner, *every.columns, *(F.coalesce(f"_v.{c}", F.lit(0)).alias(c) for c in counts), *(F.col(f"_v.{c}").alias(c) for c in others))


def topic_mastery(evidence: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    return analytics(evidence, questions, ["subject", "topic"], now, TOPIC_TARGET)


def overall_mastery(evidence: DataFrame, questions: DataFrame, now: Column) -> DataFrame:
    return analytics(evidence, questions, [], now, OVERALL_TARGET)


def ranked(topics: DataFrame, wanted: str, k: int | None = None) -> DataFrame:
    """Topics of one status in display order: strong by mastery, weak by lack of it and attempts."""
    from pyspark.sql import Window

    order = {"strong": [F.desc("mastery"), "subject", "topic"], "needs_practice": [F.asc("mastery"), F.desc("attempts"), "subject", "topic"]}.get(wanted, ["subject", "topic"])
    out = topics.where(F.col("status") == wanted).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def roadmap(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """Topic and subject rows (topic null) per learner; accuracy is null where nothing was answered."""
    joined = evidence.drop("subject", "topic").join(questions.where("is_active").select("question_id", "subject", "topic"), "question_id")
    rolled = joined.rollup("user_id", "subject", "topic").agg(
        F.sum("attempt_count").alias("attempted"), F.count_if(F.col("correct_count") > 0).alias("solved"),
        F.count_if(F.col("latest_status") == "correct").alias("correct"), F.count_if(F.col("latest_status") == "incorrect").alias("incorrect"),
    ).where("subject IS NOT NULL")
    right, wrong = F.col("correct"), F.col("incorrect")
    return rolled.withColumn("accuracy", F.when(right + wrong > 0, F.round(right / (right + wrong) * 100, 2)))
