import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators import release
from quillon.sources import batches, documents, tables
from quillon.streaming import evidence as ev


def test_question_documents(spark, tmp_path):
    q = {"external_id": "e1", "question": "What?", "type": "numerical", "answer": "3"}
    (tmp_path / "a.json").write_text("﻿" + json.dumps([q]), encoding="utf-8")
    (tmp_path / "b.json").write_text(json.dumps({"bank_version": "v2", "items": [q | {"question_type": "MCQ"}]}, indent=1))
    rows = {r["bank_version"]: r for r in documents.question_documents(spark, str(tmp_path / "*.json")).collect()}
    assert rows["v2"]["question_type"] == "mcq" and rows["v2"]["text"] == "What?"
    other = next(r for v, r in rows.items() if v != "v2")
    assert other["question_type"] == "nat" and len(other["bank_version"]) == 12


def test_json_lines(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("v", T.LongType())])
    path = tmp_path / "x.jsonl"
    path.write_text('{"k":"a","seq":1,"v":1}\n{"k":"a","seq":2,"v":2}\n{"k":"b","se')
    assert [tuple(r) for r in documents.json_lines(spark, str(path), schema, ["k"], "seq").select("k", "v").collect()] == [("a", 2)]
    path.write_text('{"k":"a","seq":1,"v":1}\n{"broken\n{"k":"b","seq":1,"v":1}\n')
    with pytest.raises(Exception, match="broken line"):
        documents.json_lines(spark, str(path), schema, ["k"], "seq").collect()


def test_release_round_trip(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(20).select(F.lit("q").alias("kind"), F.pmod("id", F.lit(3)).alias("shard"), "id", F.sha2(F.col("id").cast("string"), 256).alias("d"))
    tables.write_release(rows, root, "r1", "kind", "shard", "d")
    assert release.publish(spark, root, "r1", None) and not release.publish(spark, root, "r1", None)
    assert tables.read_release(spark, root, "kind", "shard", "d").count() == 20
    manifest = release.shard_digests(rows, "kind", "shard", "d")
    problems = release.verify(rows.where("id <> 4"), manifest, "kind", "shard", "d").collect()
    assert [(r["shard"], r["problem"]) for r in problems] == [(1, "changed")]


def test_add_missing(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "id long, d string")
    path = str(tmp_path / "t")
    assert tables.add_missing(rows, path, ["id"], "d") == 2
    assert tables.add_missing(rows.unionByName(spark.createDataFrame([(3, "z")], rows.schema)), path, ["id"], "d") == 1
    with pytest.raises(ValueError):
        tables.add_missing(spark.createDataFrame([(1, "other")], rows.schema), path, ["id"], "d")


def test_frozen_and_report(spark):
    df = spark.createDataFrame([(1, "1", '{"a": 2}')], "id long, flag string, doc string")
    with pytest.raises(ValueError):
        tables.frozen(df, ["id", "nope"])
    row = tables.decoded(df, ["flag"], {"doc": "a long"}).first()
    assert row["flag"] is True and row["doc"]["a"] == 2
    assert "| 1 | 1 |" in tables.report(df.select("id", "flag"), "R")


def test_cache(spark):
    loads = []
    now = {"r": "r1"}
    cache = tables.SnapshotCache(lambda r: loads.append(r) or spark.range(1), lambda: now["r"], ttl=10)
    cache.get(100), cache.get(105), cache.get(111)
    now["r"] = "r2"
    cache.get(115), cache.get(130)
    assert loads == ["r1", "r2"]


def test_stream_in_many_batches_equals_batch(spark, tmp_path):
    """Files one by one, one of them twice: the state equals the batch result."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    folder = tmp_path / "in"
    for k in (2, 0, 1):
        events.where(f"event_id % 3 = {k}").coalesce(1).write.mode("append").parquet(str(folder))
    events.where("event_id % 3 = 1").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(ev.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    ev.start(stream, str(tmp_path / "cp")).awaitTermination()
    got, want = ev.current(spark, str(tmp_path / "cp")), ev.flat(ev.evidence(ev.once(ev.responses(events))))
    assert got.count() == want.count() and set(got.collect()) == set(want.collect())
    assert ev.without_closed(ev.responses(events), events.select("user_id")).isEmpty()


def test_stream_drops_nothing_as_late(spark, tmp_path):
    """An event from months before, and one that comes a second time, in later batches."""
    folder = tmp_path / "in"
    batches = [[(1, "2024-06-01"), (2, "2024-06-02")], [(3, "2024-01-01"), (1, "2024-06-01")], [(4, "2023-05-05"), (4, "2023-05-05")], [(3, "2024-01-01")]]
    for rows in batches:
        df = spark.createDataFrame([(i, day, 7, "error", 1.0, "{}") for i, day in rows], "event_id long, day string, user_id long, event_type string, value double, props string")
        df.selectExpr("event_id", "cast(day as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(folder))
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(ev.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        ev.start(stream, str(tmp_path / "cp")).awaitTermination()
        state = ev.current(spark, str(tmp_path / "cp"))
        assert state.groupBy().sum("attempt_count", "incorrect_count").first() == (4, 4)


def test_an_event_counts_once_whatever_its_timestamp(spark, tmp_path):
    """Redelivered on another day, in the same batch and in later ones, also after a restart."""
    folder = tmp_path / "in"
    runs = [[[(1, "2024-06-01", "error"), (1, "2024-06-03", "purchase"), (98, "2024-06-02", "purchase")]], [[(1, "2025-01-01", "purchase")], [(195, "2024-06-05", "view"), (98, "2020-01-01", "error")]]]
    for batches in runs:
        for rows in batches:
            df = spark.createDataFrame([(i, day, 7, kind, 1.0, "{}") for i, day, kind in rows], "event_id long, day string, user_id long, event_type string, value double, props string")
            df.selectExpr("event_id", "cast(day as timestamp_ntz) as ts", "user_id", "event_type", "value", "props").coalesce(1).write.mode("append").parquet(str(folder))
        stream = spark.readStream.schema(ev.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
        ev.start(stream, str(tmp_path / "cp")).awaitTermination()
    (row,) = ev.current(spark, str(tmp_path / "cp")).collect()
    assert (row["question_id"], row["attempt_count"], row["correct_count"], row["incorrect_count"], row["unanswered_count"]) == (1, 3, 1, 1, 1)
    assert row["latest_status"] == "correct" and str(row["latest_answered_at"])[:10] == "2024-06-02" and str(row["last_attempted_at"])[:10] == "2024-06-05"


def test_containers_hold_every_id():
    import random

    import numpy as np

    rng = random.Random(2)
    held, true = None, set()
    for step in range(60):
        ids = sorted({rng.randrange(65_536) for _ in range(rng.choice([1, 5, 200]))} | ({0, 65_535} if step == 30 else set()))
        new, held = ev.add_ids(held, np.array(ids))
        assert new.tolist() == [i not in true for i in ids]
        true |= set(ids)
        assert len(held) == (2 * len(true) if len(true) < 4096 else 8192)
    assert len(true) > 4096


def test_strict_documents(spark, tmp_path):
    import hashlib

    from pyspark.sql import types as T

    from quillon.sources import documents

    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("name", T.StringType())])
    good = '{"id": 1,\n "name": "x"}'
    (tmp_path / "good.json").write_text(good)
    row = documents.strict_documents(spark, str(tmp_path / "good.json"), schema).first()
    assert (row["id"], row["name"], row["checksum"]) == (1, "x", hashlib.sha256(good.encode()).hexdigest())
    for name, text in (("extra", '{"id": 1, "more": 2}'), ("lacks", '{"name": "x"}'), ("list", "[1]")):
        (tmp_path / f"{name}.json").write_text(text)
        with pytest.raises(Exception, match="unknown fields more|required field|not an object"):
            documents.strict_documents(spark, str(tmp_path / f"{name}.json"), schema).collect()


def test_canonical_json_upsert_and_lineage(spark, tmp_path):
    from quillon.operators import release
    from quillon.sources import documents, tables

    rows = spark.createDataFrame([(2, "b", None), (1, "a", 1.5)], "z long, a string, m double")
    documents.write_canonical_json(rows.coalesce(1), str(tmp_path / "json"))
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "json")).collect())
    assert lines == ['{"a":"a","m":1.5,"z":1}', '{"a":"b","m":null,"z":2}']
    root = str(tmp_path / "bank")
    assert tables.upsert(spark, root, rows, ["z"], "r1")
    assert tables.upsert(spark, root, spark.createDataFrame([(2, "c", 9.0), (3, "d", None)], rows.schema), ["z"], "r2")
    assert {(r["z"], r["a"]) for r in spark.read.parquet(f"{root}/r2/rows").collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert not release.publish(spark, root, "r9", "r1")
    files = release.file_digests(spark, f"{root}/r2/rows/*.parquet").cache()
    assert release.lineage_findings(files, files).isEmpty()
    broken = files.limit(1).selectExpr("path", "bytes", "'x' AS sha256").union(spark.createDataFrame([("gone", 1, "y")], files.schema))
    assert {r["problem"] for r in release.lineage_findings(broken, files).collect()} >= {"missing", "content_differs"}


def batch_rows(spark, first, last, text="x"):
    return spark.createDataFrame([(k, f"{text}{k}") for k in range(first, last)], "k long, v string").withColumn("d", F.sha2("v", 256))


def test_a_batch_is_taken_up_where_it_ended(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path / "t"), batch_rows(spark, 0, 100)
    create, calls = batches._create, []

    def dies(spark, path, text):
        calls.append(path)
        if len(calls) == 4:
            raise KeyboardInterrupt
        return create(spark, path, text)

    monkeypatch.setattr(batches, "_create", dies)
    with pytest.raises(KeyboardInterrupt):
        batches.append_batch(rows, root, "b1", ["k"], "d", chunk_rows=10)
    half = batches.read_batches(spark, root).count()
    assert 0 < half < 100 and len(batches.BatchLog(spark, root).refresh()) == 3
    # the second run writes the chunks from the fourth on, also if it is asked for other ones
    assert batches.append_batch(rows, root, "b1", ["k"], "d", chunk_rows=50) == 100 - half
    log = batches.BatchLog(spark, root)
    assert [(c["chunk"], c["chunks"]) for c in log.refresh()] == [(k, 10) for k in range(10)]
    assert sorted(r["k"] for r in batches.read_batches(spark, root).collect()) == list(range(100))
    assert batches.append_batch(rows, root, "b1", ["k"], "d") == 0


def test_two_writers_never_append_a_key_twice(spark, tmp_path, monkeypatch):
    root, create, turns = str(tmp_path / "t"), batches._create, []

    def interrupted(spark, path, text):
        """Before the first commit of the one writer, the other one commits its whole batch."""
        if not turns:
            turns.append(1)
            assert batches.append_batch(batch_rows(spark, 50, 150), root, "other", ["k"], "d", chunk_rows=40) == 100
        return create(spark, path, text)

    monkeypatch.setattr(batches, "_create", interrupted)
    assert batches.append_batch(batch_rows(spark, 0, 100), root, "own", ["k"], "d", chunk_rows=30) == 50
    assert sorted(r["k"] for r in batches.read_batches(spark, root).collect()) == list(range(150))
    monkeypatch.undo()
    with pytest.raises(ValueError, match="other content"):
        batches.append_batch(batch_rows(spark, 149, 151, "y"), root, "wrong", ["k"], "d")
    with pytest.raises(ValueError, match="two contents"):
        batches.append_batch(batch_rows(spark, 300, 301).union(batch_rows(spark, 300, 301, "y")), root, "torn", ["k"], "d")
    # the same batch by two runs at once: a chunk is committed by one of them
    turns.clear()

    def same(spark, path, text):
        if not turns:
            turns.append(1)
            batches.append_batch(batch_rows(spark, 200, 240), root, "both", ["k"], "d", chunk_rows=10)
        return create(spark, path, text)

    monkeypatch.setattr(batches, "_create", same)
    assert batches.append_batch(batch_rows(spark, 200, 240), root, "both", ["k"], "d", chunk_rows=10) == 0
    assert batches.read_batches(spark, root).where("k >= 200").count() == 40
    (tmp_path / "t" / "log" / f"{len(batches.BatchLog(spark, root).refresh()):012d}").write_text("")
    with pytest.raises(RuntimeError, match="torn"):
        batches._read(spark, f"{root}/log/{len(list((tmp_path / 't' / 'log').glob('[0-9]*'))) - 1:012d}", 0.1)


def test_tables_over_jdbc(spark):
    """Against a database in memory: a frozen projection, ranges of the key, flags, JSON, nulls and a missing column."""
    url = "jdbc:derby:memory:bank;create=true"
    driver = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = [(k, k % 2, f"t{k}" if k % 5 else None, f'{{"a": {k}}}', "internal") for k in range(1, 201)]
    df = spark.createDataFrame(rows, "id int, is_active int, topic string, doc string, secret string")
    df.write.jdbc(url, "QUESTIONS", mode="overwrite", properties=driver)
    columns = ["id", "is_active", "topic", "doc"]
    found = tables.jdbc_table(spark, url, "QUESTIONS", columns, "id", (1, 200), parts=4, **driver)
    assert found.rdd.getNumPartitions() == 4 and [c.lower() for c in found.columns] == columns
    got = tables.decoded(found, ["is_active"], {"doc": "a long"}, {"topic": "none"}).orderBy("id").collect()
    assert [(r["id"], r["is_active"], r["topic"], r["doc"]["a"]) for r in got] == [(k, k % 2 == 1, f"t{k}" if k % 5 else "none", k) for k in range(1, 201)]
    # the filter reaches the database
    assert "PushedFilters: [*IsNotNull(id), *EqualTo(id,7)]" in tables.point(found, "id", 7)._jdf.queryExecution().toString().replace("ID", "id")
    with pytest.raises(ValueError, match="missing columns"):
        tables.jdbc_table(spark, url, "QUESTIONS", [*columns, "gone"], "id", (1, 200), **driver)


def test_a_run_of_questions_is_one_key_of_the_store(spark, tmp_path):
    """Also where a question's ids no longer fit its row: repeats in the same and in later batches count once."""
    folder = tmp_path / "in"
    ids = [97 * k + q for k in range(60) for q in (3, 5, 40)] + [(1 << 40) - (1 << 40) % 97 + 3]
    for own in (ids[:30], ids[10:], ids, ids[::7]):
        df = spark.createDataFrame([(i, 8, "purchase") for i in own * 2] + [(None, 8, "error")], "event_id long, user_id long, event_type string")
        df.selectExpr("event_id", "cast('2024-06-01' as timestamp_ntz) + make_interval(0, 0, 0, 0, 0, 0, coalesce(event_id % 1000, 0)) as ts", "user_id", "event_type", "0d as value", "'' as props").coalesce(1).write.mode("append").parquet(str(folder))
    stream = spark.readStream.schema(ev.EVENTS).option("maxFilesPerTrigger", 1).parquet(str(folder))
    ev.start(stream, str(tmp_path / "cp")).awaitTermination()
    got = {r["question_id"]: (r["attempt_count"], r["correct_count"]) for r in ev.current(spark, str(tmp_path / "cp")).collect()}
    assert got == {3: (61, 61), 5: (60, 60), 40: (60, 60), None: (1, 0)}
    store = spark.read.format("statestore").option("stateVarName", "evidence").load(str(tmp_path / "cp"))
    assert store.count() == 3
