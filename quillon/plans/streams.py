"""Queries on the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.plans.registry import query
from quillon.plans.star import table
from quillon.sources import shared
from quillon.streaming import evidence as ev

_RESPONSE = """response AS (SELECT event_id, ts AS submitted_at, user_id, event_id % 97 AS question_id,
  CASE WHEN event_type IN ('purchase', 'signup') THEN 'correct' WHEN event_type = 'error' THEN 'incorrect' ELSE 'unanswered' END AS status FROM events)"""
_STATE = """SELECT user_id, question_id, count(*) AS attempt_count, count(*) FILTER (WHERE status = 'correct') AS correct_count, count(*) FILTER (WHERE status = 'incorrect') AS incorrect_count,
  count(*) FILTER (WHERE status = 'unanswered') AS unanswered_count, arg_max(status, (submitted_at, event_id)) FILTER (WHERE status <> 'unanswered') AS latest_status,
  max(submitted_at) FILTER (WHERE status <> 'unanswered') AS latest_answered_at, max(submitted_at) AS last_attempted_at FROM response GROUP BY user_id, question_id"""


@query(f"WITH {_RESPONSE} {_STATE}")
def stream_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, folded into state and read back."""
    folder = shared.folder(spark, "stream")
    events = spark.readStream.schema(ev.EVENTS).parquet(f"{sf_dir}/events.parque[t]")  # a pattern: a stream of one file needs one
    ev.start(events, folder).awaitTermination()
    return ev.current(spark, folder)


@query(f"WITH {_RESPONSE} {_STATE}")
def batch_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground truth of the stream: the same fold over the whole log."""
    return ev.flat(ev.evidence(ev.once(ev.responses(table(spark, sf_dir, "events")))))


@query(f"""WITH {_RESPONSE} SELECT user_id, count(*) AS responses, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE NOT late AND status = 'correct') AS correct
  FROM (SELECT *, submitted_at >= TIMESTAMP '2024-01-01' + to_days(CAST(10 + user_id % 5 AS INT)) AS late FROM response) GROUP BY user_id""")
def late_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deadline per learner: late answers count as none, the rows stay."""
    rows = ev.responses(table(spark, sf_dir, "events"))
    deadline = F.timestamp_add("DAY", (10 + F.pmod("user_id", F.lit(5))).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    judged = ev.late_as_unanswered(rows, deadline)
    return judged.groupBy("user_id").agg(F.count("*").alias("responses"), F.count_if(F.col("submitted_at") >= deadline).alias("late"), F.count_if(F.col("status") == "correct").alias("correct"))


@query(f"WITH {_RESPONSE} SELECT user_id, array_to_string(list_sort(list(DISTINCT question_id)), ',') AS solved FROM response WHERE status = 'correct' GROUP BY user_id")
def solved_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ev.solved_sets(ev.responses(table(spark, sf_dir, "events")))
    return found.select("user_id", F.array_join("solved", ",").alias("solved"))
