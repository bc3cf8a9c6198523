"""The question-bank star over the driver's tables, in DataFrames and in SQL.

question = part, subject = brand, topic = (brand, type); attempt = orders, learner =
customer modulo 40; response = the cheapest line of each (order, part).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.sources.shared import tasks

LEARNERS = 40
#: The day on which analytics are taken.
NOW = "2001-09-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    key_of = F.col("p_partkey")
    letter = lambda k: F.char(65 + F.pmod(key_of + k, F.lit(4)))
    kind = F.element_at(F.array(F.lit("mcq"), F.lit("msq"), F.lit("nat")), (F.pmod(key_of, F.lit(3)) + 1).cast("int"))
    key = F.when(kind == "mcq", letter(0)).when(kind == "msq", F.concat_ws(",", letter(0), letter(1))).otherwise(F.format_string("%d.25", F.pmod(key_of, F.lit(100))))
    return part.select(
        key_of.alias("question_id"), F.col("p_brand").alias("subject"), F.col("p_type").alias("topic"), kind.alias("question_type"),
        (1 + F.pmod("p_size", F.lit(2))).cast("long").alias("marks"), (F.col("p_size") <= 40).alias("is_active"), F.col("p_name").alias("text"),
        (1995 + F.pmod("p_size", F.lit(30))).cast("long").alias("year"), key.alias("answer_key"), F.col("p_retailprice").alias("price"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("attempt_id"), F.pmod("o_custkey", F.lit(LEARNERS)).alias("user_id"), F.col("o_orderdate").alias("submitted_at"),
        F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate")).otherwise(F.timestamp_add("DAY", F.lit(1), "o_orderdate")).alias("expires_at"),
    )


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks work on rows that are as many as the responses: a task has about 250,000."""
    return tasks(table(spark, sf_dir, "lineitem"), 250_000)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(attempt_id, question_id, position, answer): flag A answers rightly, R wrongly, N not at all."""
    line = table(spark, sf_dir, "lineitem")
    # by attempt: the choice of lines, the join with attempts and sums by attempt need no other shuffle
    line = line.repartition(parts(spark, sf_dir), "l_orderkey")
    first = Window.partitionBy("l_orderkey", "l_partkey").orderBy("l_extendedprice", "l_suppkey", "l_linenumber", "l_quantity")
    one = line.withColumn("rn", F.row_number().over(first)).where("rn = 1")
    q = F.col("l_partkey")
    letter = lambda k: F.lower(F.char(65 + F.pmod(q + k, F.lit(4))))
    kind = F.pmod(q, F.lit(3))
    right = F.when(kind == 0, F.concat(F.lit(" "), letter(0))).when(kind == 1, F.concat_ws(" ; ", letter(1), letter(0))).otherwise(F.format_string("%d.255", F.pmod(q, F.lit(100))))
    wrong = F.when(kind == 0, letter(2)).when(kind == 1, letter(0)).otherwise(F.lit("-1"))
    answer = F.when(F.col("l_returnflag") == "A", right).when(F.col("l_returnflag") == "R", wrong)
    return one.select(F.col("l_orderkey").alias("attempt_id"), q.alias("question_id"), F.col("l_linenumber").cast("long").alias("position"), answer.alias("answer"))


#: The same star as common table expressions, up to graded responses.
CTE = """
question AS (
  SELECT p_partkey AS question_id, p_brand AS subject, p_type AS topic, CASE p_partkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'msq' ELSE 'nat' END AS question_type,
    CAST(1 + p_size % 2 AS BIGINT) AS marks, p_size <= 40 AS is_active, p_name AS text, CAST(1995 + p_size % 30 AS BIGINT) AS year, p_retailprice AS price,
    CASE p_partkey % 3 WHEN 0 THEN chr(CAST(65 + p_partkey % 4 AS INT)) WHEN 1 THEN chr(CAST(65 + p_partkey % 4 AS INT)) || ',' || chr(CAST(65 + (p_partkey + 1) % 4 AS INT))
      ELSE CAST(p_partkey % 100 AS VARCHAR) || '.25' END AS answer_key
  FROM part
), attempt AS (
  SELECT o_orderkey AS attempt_id, o_custkey % 40 AS user_id, o_orderdate AS submitted_at, o_orderstatus = 'P' AS timed_out FROM orders
), response AS (
  SELECT l_orderkey AS attempt_id, l_partkey AS question_id, CAST(l_linenumber AS BIGINT) AS position, l_returnflag AS flag
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_extendedprice, l_suppkey, l_linenumber, l_quantity) = 1
), graded AS (
  SELECT r.attempt_id, a.user_id, a.submitted_at, a.timed_out, r.question_id, r.position, q.subject, q.topic, q.question_type, q.marks, q.is_active,
    CASE r.flag WHEN 'A' THEN 'correct' WHEN 'R' THEN 'incorrect' ELSE 'unanswered' END AS status,
    CASE r.flag WHEN 'A' THEN CAST(q.marks AS DOUBLE) WHEN 'R' THEN CASE WHEN q.question_type = 'mcq' THEN -round(q.marks / 3.0, 6) ELSE 0.0 END ELSE 0.0 END AS awarded
  FROM response r JOIN attempt a USING (attempt_id) JOIN question q USING (question_id)
), evidence AS (
  SELECT user_id, question_id, any_value(subject) AS subject, any_value(topic) AS topic, any_value(is_active) AS is_active,
    count(*) AS attempt_count, count(*) FILTER (WHERE status = 'correct') AS correct_count, count(*) FILTER (WHERE status = 'incorrect') AS incorrect_count,
    count(*) FILTER (WHERE status = 'unanswered') AS unanswered_count, max(submitted_at) AS last_attempted_at,
    max(submitted_at) FILTER (WHERE status <> 'unanswered') AS latest_answered_at,
    arg_max(status, (submitted_at, attempt_id)) FILTER (WHERE status <> 'unanswered') AS latest_status
  FROM graded GROUP BY user_id, question_id
)
"""
