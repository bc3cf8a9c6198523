"""Learner progress from graded responses.

A graded response: (attempt_id, user_id, submitted_at, question_id, position, subject,
topic, question_type, marks, status, awarded).  Every operator is a group-by with partial
sums; ties of time are broken by the attempt's id, then the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions import answers
from quillon.operators import mastery


def grade_responses(responses: DataFrame, attempts: DataFrame, questions: DataFrame, tolerance: float = 0.01, use_deadline: bool = False) -> DataFrame:
    """Responses with status, awarded and negative marks; late answers count as none if `use_deadline`."""
    joined = responses.join(attempts, "attempt_id").join(questions, "question_id")
    answer = answers.before_deadline(F.col("answer"), F.col("submitted_at"), F.col("expires_at")) if use_deadline else F.col("answer")
    # columns of their own, so that a response is compared once and not for each field of the outcome
    blank = joined.withColumn("_answer", answer).withColumn("_blank", answers.is_unanswered(F.col("_answer")))
    right = F.when(F.col("_blank"), F.lit(False)).otherwise(answers.is_correct(F.col("question_type"), F.col("_answer"), F.col("answer_key"), F.lit(tolerance)))
    graded = answers.outcome(F.col("question_type"), F.col("marks"), F.col("_blank"), F.col("_right"))
    return blank.withColumn("_right", right).withColumn("graded", graded).select(
        "attempt_id", "user_id", "submitted_at", "question_id", "position", "subject", "topic", "question_type", "marks", "is_active",
        "graded.status", "graded.awarded", "graded.negative", (F.col("expires_at").isNotNull() & (F.col("submitted_at") >= F.col("expires_at"))).alias("timed_out"),
    )


def _count(status: str) -> Column:
    return F.count_if(F.col("status") == status)


def attempt_scores(graded: DataFrame) -> DataFrame:
    """One row per attempt: score, maximum, counts by status."""
    return graded.groupBy("attempt_id", "user_id", "submitted_at").agg(
        F.round(F.sum("awarded"), 6).alias("score"), F.sum("marks").alias("max_score"), _count("correct").alias("correct_count"),
        _count("incorrect").alias("incorrect_count"), _count("unanswered").alias("unanswered_count"), F.count("*").alias("question_count"),
    )


def attempt_percent() -> Column:
    return F.when(F.col("max_score") > 0, F.col("score") / F.col("max_score") * 100).otherwise(F.lit(0.0))


def accuracy(correct: Column, incorrect: Column, empty: float | None = 0.0) -> Column:
    """Percent right of what was answered, to two places; `empty` if nothing was."""
    none = F.lit(empty).cast("double")
    return F.when(correct + incorrect > 0, F.round(correct / (correct + incorrect) * 100, 2)).otherwise(none)


def user_totals(scores: DataFrame) -> DataFrame:
    """Per learner: attempts, counts, marks, the mean of percentages (not the percentage of sums), accuracy."""
    correct, incorrect = F.sum("correct_count"), F.sum("incorrect_count")
    return scores.groupBy("user_id").agg(
        F.count("*").alias("attempts"), F.sum("question_count").alias("responses"), correct.alias("correct"), incorrect.alias("incorrect"),
        F.sum("unanswered_count").alias("unanswered"), F.round(F.sum("score"), 4).alias("score"), F.sum("max_score").alias("max_score"),
        F.round(F.avg(attempt_percent()), 4).alias("mean_percent"), accuracy(correct, incorrect).alias("accuracy"),
    )


def subject_progress(graded: DataFrame, subjects: DataFrame) -> DataFrame:
    """Per learner and subject, zero-filled over all subjects.

    A question counts as unique in the subject under which the learner met it first, so
    that a question that moves between subjects counts once.
    """
    sums = {
        "attempted": F.count("*"), "correct": _count("correct"), "incorrect": _count("incorrect"), "unanswered": _count("unanswered"),
        "marks_available": F.sum("marks"), "marks_earned": F.sum("awarded"),
    }
    # by question first, so that the responses are read once: a question's subjects are few
    by_question = graded.groupBy("user_id", "question_id", "subject").agg(F.min(F.struct("submitted_at", "attempt_id", "position")).alias("at"), *(c.alias(name) for name, c in sums.items()))
    listed = by_question.groupBy("user_id", "question_id").agg(F.collect_list(F.struct("subject", "at", *sums)).alias("all"))
    least = F.array_min(F.transform("all", lambda x: x["at"]))
    rows = listed.select("user_id", least.alias("least"), F.explode("all").alias("r")).select("user_id", "r.*", (F.col("r.at") == F.col("least")).cast("long").alias("unique_questions"))
    totals = rows.groupBy("user_id", "subject").agg(*(F.sum(c).alias(c) for c in (*sums, "unique_questions")))
    counts = ["attempted", "unique_questions", "correct", "incorrect", "unanswered", "marks_available"]
    filled = mastery.zero_filled(totals, subjects.select("subject").distinct(), ["subject"], counts, ["marks_earned"], F.lit(True))
    return filled.withColumns({"marks_earned": F.round(F.coalesce("marks_earned", F.lit(0.0)), 4), "accuracy": accuracy(F.col("correct"), F.col("incorrect"))})


def evidence(graded: DataFrame) -> DataFrame:
    """Per learner and question: counts, the latest answered status and times.

    The latest status ignores unanswered responses, the last attempt's time doesn't.
    """
    order = F.struct("submitted_at", "attempt_id", "position")
    answered = F.col("status") != answers.UNANSWERED
    latest = F.max(F.when(answered, F.struct(order.alias("at"), F.col("status"))))
    newest = F.max(F.struct(order.alias("at"), F.col("subject"), F.col("topic")))
    return (
        graded.groupBy("user_id", "question_id")
        .agg(
            F.count("*").alias("attempt_count"), _count("correct").alias("correct_count"), _count("incorrect").alias("incorrect_count"), _count("unanswered").alias("unanswered_count"),
            F.max("submitted_at").alias("last_attempted_at"), latest.alias("latest"), newest.alias("newest"),
        )
        .select(
            "user_id", "question_id", F.col("newest.subject").alias("subject"), F.col("newest.topic").alias("topic"), "attempt_count", "correct_count", "incorrect_count", "unanswered_count",
            F.col("latest.status").alias("latest_status"), F.col("latest.at.submitted_at").alias("latest_answered_at"), F.col("latest.at.attempt_id").alias("latest_attempt"), "last_attempted_at",
        )
    )


def merge_evidence(*parts: DataFrame) -> DataFrame:
    """Evidence of several sources as one: counts add, the latest answer wins, ties go to the source named first."""
    rows = None
    for rank, part in enumerate(parts):
        part = part.withColumn("_rank", F.lit(-rank))
        rows = part if rows is None else rows.unionByName(part)
    order = F.struct("latest_answered_at", "latest_attempt", "_rank", "latest_status")
    latest = F.max(F.when(F.col("latest_status").isNotNull(), order))
    newest = F.max(F.struct("last_attempted_at", "_rank", "subject", "topic"))
    merged = rows.groupBy("user_id", "question_id").agg(
        *(F.sum(c).alias(c) for c in ("attempt_count", "correct_count", "incorrect_count", "unanswered_count")),
        F.max("last_attempted_at").alias("last_attempted_at"), latest.alias("latest"), newest.alias("newest"),
    )
    return merged.select(
        "user_id", "question_id", F.col("newest.subject").alias("subject"), F.col("newest.topic").alias("topic"), "attempt_count", "correct_count", "incorrect_count", "unanswered_count",
        F.col("latest.latest_status").alias("latest_status"), F.col("latest.latest_answered_at").alias("latest_answered_at"), F.col("latest.latest_attempt").alias("latest_attempt"), "last_attempted_at",
    )


def projection(scores: DataFrame, found: DataFrame, k: int = 5) -> DataFrame:
    """Per learner what a dashboard keeps: counts of attempts, all attempt ids, the last k attempts, and how many questions
    of each subject they have met.  `scores`: attempts; `found`: evidence."""
    return _projected(scores, found, k)


def merged_projection(graded: DataFrame, owners: DataFrame, k: int = 5) -> DataFrame:
    """The projection of accounts of which some claim guests (`owners`: guest, account): counts add, ids unite, the last k are
    chosen anew, and the subjects' questions are counted from the merged evidence (ties of time go to the guest's).

    Responses get their owner first, so that guests and accounts are folded together and not each for itself.
    """
    known = owners.select(F.col("guest").alias("_guest"), F.col("account").alias("_account"))
    owned = graded.join(F.broadcast(known), F.col("user_id") == F.col("_guest"), "left")
    owned = owned.withColumns({"user_id": F.coalesce("_account", "user_id"), "_claimed": F.col("_guest").isNotNull()})
    newest = F.max(F.struct("submitted_at", "_claimed", "attempt_id", "position", "subject", "topic"))
    found = owned.groupBy("user_id", "question_id").agg(newest.alias("_newest")).select("user_id", "question_id", F.col("_newest.subject").alias("subject"))
    return _projected(owned, found, k)


def _projected(rows: DataFrame, found: DataFrame, k: int, parts: int = 64) -> DataFrame:
    """`rows`: of attempts, or of their responses."""
    once = rows.where("user_id IS NOT NULL").groupBy("user_id", "attempt_id").agg(F.max("submitted_at").alias("submitted_at")).withColumn("_part", F.pmod(F.xxhash64("attempt_id"), F.lit(parts)))
    # by parts of a learner's attempts, so that these are read once, and no task holds a learner's
    newest = Window.partitionBy("user_id", "_part").orderBy(F.desc("submitted_at"), F.desc("attempt_id"))
    top = F.collect_list(F.when(F.col("_k") <= k, F.struct("submitted_at", "attempt_id")))
    by_part = once.withColumn("_k", F.row_number().over(newest)).groupBy("user_id", "_part").agg(F.count("*").alias("_n"), top.alias("_top"))
    last = F.slice(F.sort_array(F.flatten(F.collect_list("_top")), asc=False), 1, k)
    attempts = by_part.groupBy("user_id").agg(F.sum("_n").alias("attempts"), F.transform(last, lambda x: x["attempt_id"]).alias("recent"))
    subjects = found.groupBy("user_id", "subject").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("subject", "n"))).alias("subjects"))
    return attempts.join(subjects, "user_id", "left")


def resolve_aliases(rows: DataFrame, aliases: DataFrame, id_col: str = "question_id") -> DataFrame:
    """`id_col` becomes the canonical id of `aliases` (alias_id, canonical_id); ids without an alias stay."""
    known = aliases.select(F.col("alias_id").alias("_alias"), F.col("canonical_id").alias("_to"))
    joined = rows.join(known, F.col(id_col) == F.col("_alias"), "left")
    return joined.withColumn(id_col, F.coalesce("_to", id_col)).drop("_alias", "_to")


def merge_aliases(found: DataFrame, aliases: DataFrame) -> DataFrame:
    """Evidence with that of aliases folded into the canonical questions."""
    return merge_evidence(resolve_aliases(found, aliases))


def rebuilt_marks(found: DataFrame, questions: DataFrame) -> DataFrame:
    """Marks per learner and subject from the counts of evidence; taxonomy and type from the questions."""
    lost = answers.penalty(F.col("question_type"), F.col("marks"))
    joined = found.drop("subject", "topic").join(questions.select("question_id", "subject", "question_type", "marks"), "question_id")
    return joined.groupBy("user_id", "subject").agg(
        F.round(F.sum(F.col("marks") * F.col("correct_count") - lost * F.col("incorrect_count")), 4).alias("marks"), F.count_distinct("question_id").alias("questions")
    )


def recent_attempts(scores: DataFrame, k: int = 5) -> DataFrame:
    """The last k attempts of each learner, by time and id."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("submitted_at"), F.desc("attempt_id"))
    return scores.withColumn("rank", F.row_number().over(newest).cast("long")).where(F.col("rank") <= k)


def solved(graded: DataFrame, questions: DataFrame) -> DataFrame:
    """Learner and question pairs once answered rightly; a semi-join in which repeats don't multiply."""
    right = graded.where(F.col("status") == answers.CORRECT).select("user_id", "question_id").distinct()
    return right.join(questions.where("is_active").select("question_id"), "question_id", "left_semi")


def coverage(practised: DataFrame, questions: DataFrame) -> DataFrame:
    """Percent of the active questions that each learner has practised, at most 100."""
    total = questions.where("is_active").agg(F.count("*").alias("total"))
    seen = practised.groupBy("user_id").agg(F.count_distinct("question_id").alias("practised"))
    percent = F.when(F.col("total") > 0, F.round(F.least("practised", "total") / F.col("total") * 100, 2)).otherwise(F.lit(0.0))
    return seen.join(F.broadcast(total)).select("user_id", "practised", "total", percent.alias("percent"))


def attempt_by_subject(graded: DataFrame) -> DataFrame:
    """Per attempt and subject, only for attempts in which every response has a known status."""
    known = F.col("status").isin(answers.CORRECT, answers.INCORRECT, answers.UNANSWERED)
    summed = graded.where("attempt_id IS NOT NULL").groupBy("attempt_id", "subject").agg(
        F.count("*").alias("questions"), _count("correct").alias("correct"), F.round(F.sum(F.when(F.col("awarded") < 0, -F.col("awarded")).otherwise(0.0)), 6).alias("negative_marks"),
        (F.count("*") - F.count_if(known)).alias("_unknown"),
    )
    # an attempt's subjects are few: the responses are read once
    return summed.withColumn("_unknown", F.sum("_unknown").over(Window.partitionBy("attempt_id"))).where("_unknown = 0").drop("_unknown")
