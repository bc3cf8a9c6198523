"""Incremental learner evidence with Structured Streaming.

Responses arrive as events.  The evidence of each (learner, question) is keyed state in
Spark's state store (RocksDB, so it need not fit in memory): every micro-batch folds its events
into the keys that it touches, and a failed one starts from the state before it.  An event
counts once, at its first delivery, whatever timestamp later ones bear, and none is dropped as
late, however old it is.

Each access to the store crosses to the JVM, which takes most of the time, so a key of the store
is a learner and a run of 16 questions, read and written once a batch.

What bounds the state: a question keeps one row of evidence and the ids that it has seen: up to
16 of them in the row, then in containers of 65,536 ids: two bytes an id, 8,192 bytes a container
at most.  Ids are never forgotten, so this is exact; a batch reads the rows of the runs that its
questions lie in, 16 at most each, and the containers that its ids fall in.  An event's
learner and question must be the same at each delivery; of deliveries within one batch the
earliest counts.  Events without an id count as one event.  The batch operators are the
ground truth that the stream must reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
QUESTIONS = 97
STATUSES = ("correct", "incorrect", "unanswered")


def responses(events: DataFrame) -> DataFrame:
    """Events as responses: purchase and signup are right, error is wrong, view and click are unanswered."""
    kind = F.col("event_type")
    status = F.when(kind.isin("purchase", "signup"), "correct").when(kind == "error", "incorrect").otherwise("unanswered")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("submitted_at"), "user_id", F.pmod("event_id", F.lit(QUESTIONS)).alias("question_id"), status.alias("status"))


def late_as_unanswered(rows: DataFrame, deadline: Column) -> DataFrame:
    """An answer after its deadline counts as none; the attempt stays: nothing is dropped as late data."""
    late = F.col("submitted_at") >= deadline
    return rows.withColumn("status", F.when(late, F.lit("unanswered")).otherwise(F.col("status")))


def once(rows: DataFrame) -> DataFrame:
    """Each event of a batch once, however often it was delivered."""
    return rows.dropDuplicates(["event_id"])


def without_closed(rows: DataFrame, closed: DataFrame) -> DataFrame:
    """Rows of learners that no tombstone (user_id) closes; the control table is static."""
    return rows.join(closed.select("user_id").distinct(), "user_id", "left_anti")


def evidence(rows: DataFrame) -> DataFrame:
    """Per learner and question: counts, the latest answered status, times.  Order of arrival doesn't matter."""
    count = lambda s: F.count_if(F.col("status") == s)
    answered = F.when(F.col("status") != "unanswered", F.struct("submitted_at", "event_id", "status"))
    return rows.groupBy("user_id", "question_id").agg(
        F.count("*").alias("attempt_count"), count("correct").alias("correct_count"), count("incorrect").alias("incorrect_count"), count("unanswered").alias("unanswered_count"),
        F.max(answered).alias("latest"), F.max("submitted_at").alias("last_attempted_at"),
    )


def flat(state: DataFrame) -> DataFrame:
    return state.select(
        "user_id", "question_id", "attempt_count", "correct_count", "incorrect_count", "unanswered_count",
        F.col("latest.status").alias("latest_status"), F.col("latest.submitted_at").alias("latest_answered_at"), "last_attempted_at",
    )


#: A learner's evidence on a run of questions as it is kept in the state store; times are microseconds, `latest_at` and `latest_id` those of the latest answer.
#: `ids` are those that were seen, null once they are in containers.
STATE = "questions array<struct<question_id: long, attempt_count: long, correct_count: long, incorrect_count: long, unanswered_count: long, latest_at: long, latest_id: long, latest_status: string, last_at: long, ids: array<long>>>"
RUN_BITS, INLINE = 4, 16
_CONTAINER, _DENSE = 1 << 16, 4096


def add_ids(held: bytes | None, offsets: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Which of the distinct, sorted offsets (below 65,536) a container doesn't hold yet, and the container with all of them.

    A container of under 4,096 offsets is their list, two bytes each, a fuller one a bitmap of 8,192 bytes.
    """
    held = held or b""
    if len(held) < _CONTAINER // 8:
        there = np.frombuffer(held, dtype=np.uint16)
        new = ~np.isin(offsets, there)
        both = np.sort(np.concatenate((there, offsets[new].astype(np.uint16))))
        if len(both) < _DENSE:
            return new, both.tobytes()
        bits = np.zeros(_CONTAINER, dtype=np.uint8)
        bits[both] = 1
    else:
        bits = np.unpackbits(np.frombuffer(held, dtype=np.uint8))
        new = bits[offsets] == 0
        bits[offsets] = 1
    return new, np.packbits(bits).tobytes()


class Evidence:
    """What a learner has shown on one question."""

    def __init__(self, row: Any = None) -> None:
        self.counts = [0, 0, 0, 0] if row is None else list(row[1:5])
        self.latest = (None, None, None) if row is None else tuple(row[5:8])
        self.last = None if row is None else row[8]
        self.ids: set[int] | None = set() if row is None else None if row[9] is None else set(row[9])

    def add(self, event: int, moment: int, status: str) -> None:
        self.counts[0] += 1
        self.counts[1 + STATUSES.index(status)] += 1
        self.last = moment if self.last is None else max(self.last, moment)
        if status != "unanswered" and (self.latest[0] is None or (moment, event) > self.latest[:2]):
            self.latest = (moment, event, status)

    def row(self, question: int | None) -> tuple:
        return question, *self.counts, *self.latest, self.last, None if self.ids is None else sorted(self.ids)


class EvidenceState(StatefulProcessor):
    """Folds a key's new events into its evidence; ids that don't fit the row are kept by containers of 65,536 ids, of which a batch reads those that it has ids of."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.totals = handle.getValueState("evidence", STATE)
        self.seen = handle.getMapState("seen", "question long, container long", "ids binary")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self.totals.get()
        found = {row[0]: Evidence(row) for row in held[0]} if held else {}
        for part in batched(rows, 10_000):  # of any number of rows
            first: dict[int | None, dict[int, tuple[int, str]]] = {}
            for r in part:
                own, seen = first.setdefault(r["question_id"], {}), (r["at"], r["status"])
                own[r["event_id"]] = min(own.get(r["event_id"], seen), seen)
            for question, events in first.items():
                evidence = found.setdefault(question, Evidence())
                for event in self.unseen(question, evidence, sorted(events)):
                    evidence.add(event, *events[event])
        self.totals.update(([evidence.row(question) for question, evidence in found.items()],))
        yield Row(user_id=key[0], run=key[1], questions=len(found))

    def unseen(self, question: int | None, evidence: Evidence, events: list[int]) -> list[int]:
        """Those of the distinct, sorted events that haven't been seen; they have been then."""
        if evidence.ids is not None:
            new = [event for event in events if event not in evidence.ids]
            evidence.ids.update(new)
            if len(evidence.ids) > INLINE:
                self.contained(question, sorted(evidence.ids))
                evidence.ids = None
            return new
        return self.contained(question, events)

    def contained(self, question: int | None, events: list[int]) -> list[int]:
        """Those that no container of the question held; they do then."""
        by_container: dict[int, list[int]] = {}
        for event in events:
            by_container.setdefault(event // _CONTAINER, []).append(event)
        out = []
        for container, own in by_container.items():
            at = (-1 if question is None else question, container)
            held = self.seen.getValue(at)[0] if self.seen.containsKey(at) else None
            new, ids = add_ids(held, np.array([event % _CONTAINER for event in own]))
            if new.any():
                self.seen.updateValue(at, (ids,))
                out += [event for event, fresh in zip(own, new) if fresh]
        return out

    def close(self) -> None:
        pass


def start(events: DataFrame, checkpoint: str) -> StreamingQuery:
    """Folds a stream of events into keyed state at `checkpoint`; stops when what is there has been read.

    The state is the result: `current` reads it, there is no log beside it and no batch reads what it has no events of.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = responses(events).select(
        "user_id", "question_id", F.coalesce("event_id", F.lit(-(1 << 63))).alias("event_id"), F.coalesce(F.unix_micros("submitted_at"), F.lit(0)).alias("at"), "status"
    )
    folded = rows.withColumn("run", F.shiftright("question_id", RUN_BITS)).groupBy("user_id", "run").transformWithState(EvidenceState(), "user_id long, run long, questions long", outputMode="update", timeMode="none")
    return folded.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The state of each key after the last batch."""
    rows = spark.read.format("statestore").option("stateVarName", "evidence").load(checkpoint)
    rows = rows.select("key.user_id", F.explode("value.questions").alias("q"))
    time = lambda c: F.timestamp_micros(F.col(f"q.{c}"))
    return rows.select(
        "user_id", "q.question_id", "q.attempt_count", "q.correct_count", "q.incorrect_count", "q.unanswered_count",
        F.col("q.latest_status").alias("latest_status"), time("latest_at").alias("latest_answered_at"), time("last_at").alias("last_attempted_at"),
    )


def solved_sets(rows: DataFrame) -> DataFrame:
    """Questions ever answered rightly, per learner: a set that only grows."""
    return rows.where("status = 'correct'").groupBy("user_id").agg(F.array_sort(F.collect_set("question_id")).alias("solved"))
