"""Queries on learners: scoring, progress, mastery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import mastery, progress
from quillon.plans import star
from quillon.plans.registry import query

def _now():
    return F.lit(star.NOW).cast("timestamp")

_NOW = f"TIMESTAMP '{star.NOW}'"


def graded(spark: SparkSession, sf_dir: str, use_deadline: bool = False) -> DataFrame:
    return progress.grade_responses(star.responses(spark, sf_dir), star.attempts(spark, sf_dir), star.questions(spark, sf_dir), use_deadline=use_deadline)


def met(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded responses, those of a learner and question in one task: what is summed by both needs no other shuffle."""
    return graded(spark, sf_dir).repartition(star.parts(spark, sf_dir), "user_id", "question_id")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.attempt_scores(graded(spark, sf_dir))


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.evidence(met(spark, sf_dir))


def aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth question is an old name of the one before it."""
    ids = star.questions(spark, sf_dir).where("question_id % 10 = 9")
    return ids.select(F.col("question_id").alias("alias_id"), (F.col("question_id") - 1).alias("canonical_id"))


@query(f"WITH {star.CTE} SELECT attempt_id, question_id, status, awarded, CASE WHEN awarded < 0 THEN -awarded ELSE 0.0 END AS negative FROM graded")
def score_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir).select("attempt_id", "question_id", "status", "awarded", "negative")


@query(f"""WITH {star.CTE} SELECT attempt_id, question_id, CASE WHEN timed_out THEN 'unanswered' ELSE status END AS status,
  CASE WHEN timed_out THEN 0.0 ELSE awarded END AS awarded, timed_out FROM graded""")
def deadline_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graded(spark, sf_dir, use_deadline=True).select("attempt_id", "question_id", "status", "awarded", "timed_out")


_SCORES = """attempt_score AS (
  SELECT attempt_id, user_id, submitted_at, round(sum(awarded), 6) AS score, CAST(sum(marks) AS BIGINT) AS max_score,
    count(*) FILTER (WHERE status = 'correct') AS correct_count, count(*) FILTER (WHERE status = 'incorrect') AS incorrect_count,
    count(*) FILTER (WHERE status = 'unanswered') AS unanswered_count, count(*) AS question_count
  FROM graded GROUP BY attempt_id, user_id, submitted_at)"""


@query(f"WITH {star.CTE}, {_SCORES} SELECT * FROM attempt_score")
def attempt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir)


@query(f"""WITH {star.CTE}, {_SCORES} SELECT user_id, count(*) AS attempts, CAST(sum(question_count) AS BIGINT) AS responses, CAST(sum(correct_count) AS BIGINT) AS correct,
  CAST(sum(incorrect_count) AS BIGINT) AS incorrect, CAST(sum(unanswered_count) AS BIGINT) AS unanswered, round(sum(score), 4) AS score, CAST(sum(max_score) AS BIGINT) AS max_score,
  round(avg(CASE WHEN max_score > 0 THEN score / max_score * 100 ELSE 0 END), 4) AS mean_percent,
  CASE WHEN sum(correct_count + incorrect_count) > 0 THEN round(sum(correct_count) / sum(correct_count + incorrect_count) * 100, 2) ELSE 0.0 END AS accuracy
  FROM attempt_score GROUP BY user_id""")
def user_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.user_totals(scores(spark, sf_dir))


@query(f"""WITH {star.CTE}, first_seen AS (
  SELECT user_id, question_id, arg_min(subject, (submitted_at, attempt_id, position)) AS subject FROM graded GROUP BY ALL
), uniq AS (SELECT user_id, subject, count(*) AS n FROM first_seen GROUP BY ALL), sums AS (
  SELECT user_id, subject, count(*) AS attempted, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'incorrect') AS incorrect,
    count(*) FILTER (WHERE status = 'unanswered') AS unanswered, round(sum(awarded), 4) AS earned, CAST(sum(marks) AS BIGINT) AS available FROM graded GROUP BY ALL
) SELECT u.user_id, s.subject, coalesce(attempted, 0) AS attempted, coalesce(correct, 0) AS correct, coalesce(incorrect, 0) AS incorrect, coalesce(unanswered, 0) AS unanswered,
  coalesce(earned, 0.0) AS marks_earned, coalesce(available, 0) AS marks_available, coalesce(n, 0) AS unique_questions,
  CASE WHEN coalesce(correct + incorrect, 0) > 0 THEN round(correct / (correct + incorrect) * 100, 2) ELSE 0.0 END AS accuracy
  FROM (SELECT DISTINCT user_id FROM graded) u CROSS JOIN (SELECT DISTINCT subject FROM question) s LEFT JOIN sums USING (user_id, subject) LEFT JOIN uniq USING (user_id, subject)""")
def subject_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.subject_progress(met(spark, sf_dir), star.questions(spark, sf_dir))


_EVIDENCE = "user_id, question_id, attempt_count, correct_count, incorrect_count, unanswered_count, latest_status, latest_answered_at, last_attempted_at"


@query(f"WITH {star.CTE} SELECT {_EVIDENCE} FROM evidence")
def question_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(spark, sf_dir).select(*_EVIDENCE.split(", "))


@query(f"WITH {star.CTE} SELECT {_EVIDENCE} FROM evidence")
def evidence_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two halves of the log, folded apart and merged, equal the whole."""
    rows = met(spark, sf_dir)
    halves = [progress.evidence(rows.where(F.col("attempt_id") % 2 == k)) for k in (0, 1)]
    return progress.merge_evidence(*halves).select(*_EVIDENCE.split(", "))


@query(f"""WITH {star.CTE}, canonical AS (SELECT *, CASE WHEN question_id % 10 = 9 THEN question_id - 1 ELSE question_id END AS cid FROM graded)
  SELECT user_id, cid AS question_id, count(*) AS attempt_count, count(*) FILTER (WHERE status = 'correct') AS correct_count,
    count(*) FILTER (WHERE status = 'incorrect') AS incorrect_count, count(*) FILTER (WHERE status = 'unanswered') AS unanswered_count,
    max(submitted_at) AS last_attempted_at, max(submitted_at) FILTER (WHERE status <> 'unanswered') AS latest_answered_at
  FROM canonical GROUP BY user_id, cid""")
def alias_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = progress.merge_aliases(evidence(spark, sf_dir), aliases(spark, sf_dir))
    return merged.select("user_id", "question_id", "attempt_count", "correct_count", "incorrect_count", "unanswered_count", "last_attempted_at", "latest_answered_at")


@query(f"""WITH {star.CTE} SELECT e.user_id, q.subject, count(*) AS questions,
  round(sum(q.marks * correct_count - CASE WHEN q.question_type = 'mcq' THEN round(q.marks / 3.0, 6) ELSE 0 END * incorrect_count), 4) AS marks
  FROM evidence e JOIN question q USING (question_id) GROUP BY e.user_id, q.subject""")
def rebuilt_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.rebuilt_marks(evidence(spark, sf_dir), star.questions(spark, sf_dir))


@query(f"""WITH {star.CTE}, {_SCORES} SELECT user_id, attempt_id, submitted_at, score, row_number() OVER (PARTITION BY user_id ORDER BY submitted_at DESC, attempt_id DESC) AS rank
  FROM attempt_score QUALIFY rank <= 5""")
def recent_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.recent_attempts(scores(spark, sf_dir)).select("user_id", "attempt_id", "submitted_at", "score", "rank")


@query(f"WITH {star.CTE} SELECT DISTINCT user_id, question_id FROM graded WHERE status = 'correct' AND is_active")
def solved_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.solved(graded(spark, sf_dir), star.questions(spark, sf_dir))


@query(f"""WITH {star.CTE}, total AS (SELECT count(*) AS total FROM question WHERE is_active), seen AS (SELECT user_id, count(DISTINCT question_id) AS practised FROM graded GROUP BY user_id)
  SELECT user_id, practised, total, CASE WHEN total > 0 THEN round(least(practised, total) / total * 100, 2) ELSE 0.0 END AS percent FROM seen, total""")
def practice_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.coverage(graded(spark, sf_dir), star.questions(spark, sf_dir))


@query(f"""WITH {star.CTE} SELECT attempt_id, subject, count(*) AS questions, count(*) FILTER (WHERE status = 'correct') AS correct,
  round(sum(CASE WHEN awarded < 0 THEN -awarded ELSE 0.0 END), 6) AS negative_marks FROM graded GROUP BY attempt_id, subject""")
def attempt_by_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return progress.attempt_by_subject(graded(spark, sf_dir))


def _analytics_sql(groups: str, target: int) -> str:
    g = f", {groups}" if groups else ""
    on = f"USING (user_id, {groups})" if groups else "USING (user_id)"
    return f"""WITH {star.CTE}, avail AS (SELECT count(*) AS available{g} FROM question WHERE is_active {"GROUP BY " + groups if groups else ""}),
  weighed AS (SELECT *, CASE WHEN latest_answered_at IS NOT NULL THEN pow(CAST(0.5 AS DOUBLE), greatest(0.0, (epoch_us({_NOW}) - epoch_us(latest_answered_at)) / 86400e6) / 30.0) END AS w FROM evidence WHERE is_active),
  sums AS (SELECT user_id{g}, CAST(sum(attempt_count) AS BIGINT) AS attempts, count(*) AS attempted, count(latest_status) AS answered, count(*) FILTER (WHERE correct_count > 0) AS solved,
    count(*) FILTER (WHERE latest_status = 'correct') AS correct, count(*) FILTER (WHERE latest_status = 'incorrect') AS incorrect, CAST(sum(unanswered_count) AS BIGINT) AS unanswered,
    sum(w) FILTER (WHERE latest_status = 'correct') AS rw, sum(w) AS tw, max(last_attempted_at) AS last_attempted_at FROM weighed GROUP BY user_id{g}),
  shares AS (SELECT user_id{g}, available, coalesce(attempts, 0) AS attempts, coalesce(attempted, 0) AS attempted, coalesce(answered, 0) AS answered, coalesce(solved, 0) AS solved,
    coalesce(correct, 0) AS correct, coalesce(incorrect, 0) AS incorrect, coalesce(unanswered, 0) AS unanswered, last_attempted_at,
    CASE WHEN answered > 0 THEN correct / answered ELSE CAST(0 AS DOUBLE) END AS acc, CASE WHEN tw > 0 THEN coalesce(rw, CAST(0 AS DOUBLE)) / tw ELSE CAST(0 AS DOUBLE) END AS rec, coalesce(attempted, 0) / available AS att, coalesce(solved, 0) / available AS sol
    FROM (SELECT DISTINCT user_id FROM evidence) u CROSS JOIN avail LEFT JOIN sums {on}),
  scored AS (SELECT *, 100 * (0.45 * acc + 0.20 * rec + 0.20 * least(answered / {target}.0, 1.0) + 0.15 * att) AS score FROM shares)
  SELECT user_id{g}, available, attempts, attempted, answered, solved, correct, incorrect, unanswered, round(acc * 100, 2) AS accuracy, round(rec * 100, 2) AS recency,
    round(att * 100, 2) AS attempted_percent, round(sol * 100, 2) AS solved_percent, round(score, 2) AS mastery,
    CASE WHEN answered = 0 THEN 'unattempted' WHEN answered >= 5 AND acc >= 0.75 AND rec >= 0.70 AND score >= 65 THEN 'strong'
      WHEN acc < 0.60 OR rec < 0.55 OR score < 50 THEN 'needs_practice' ELSE 'developing' END AS status, last_attempted_at FROM scored"""


TOPIC_SQL = _analytics_sql("subject, topic", 10)


@query(TOPIC_SQL)
def topic_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery.topic_mastery(evidence(spark, sf_dir), star.questions(spark, sf_dir), _now())


@query(_analytics_sql("", 50))
def overall_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery.overall_mastery(evidence(spark, sf_dir), star.questions(spark, sf_dir), _now())


@query(f"""SELECT user_id, subject, topic, mastery, row_number() OVER (PARTITION BY user_id ORDER BY mastery DESC, subject, topic) AS rank FROM ({TOPIC_SQL}) WHERE status = 'strong'""")
def strong_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery.ranked(topic_mastery(spark, sf_dir), "strong").select("user_id", "subject", "topic", "mastery", "rank")


@query(f"""SELECT user_id, subject, topic, mastery, row_number() OVER (PARTITION BY user_id ORDER BY mastery, attempts DESC, subject, topic) AS rank
  FROM ({TOPIC_SQL}) WHERE status = 'needs_practice' QUALIFY rank <= 5""")
def needs_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery.ranked(topic_mastery(spark, sf_dir), "needs_practice", 5).select("user_id", "subject", "topic", "mastery", "rank")


@query(f"""WITH {star.CTE} SELECT user_id, subject, topic, CAST(sum(attempt_count) AS BIGINT) AS attempted, count(*) FILTER (WHERE correct_count > 0) AS solved,
  count(*) FILTER (WHERE latest_status = 'correct') AS correct, count(*) FILTER (WHERE latest_status = 'incorrect') AS incorrect,
  CASE WHEN count(latest_status) > 0 THEN round(count(*) FILTER (WHERE latest_status = 'correct') / count(latest_status) * 100, 2) END AS accuracy
  FROM evidence WHERE is_active GROUP BY GROUPING SETS ((user_id, subject, topic), (user_id, subject))""")
def roadmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mastery.roadmap(evidence(spark, sf_dir), star.questions(spark, sf_dir))
