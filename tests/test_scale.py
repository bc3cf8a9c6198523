"""Work is dealt to all cores, whatever the files it comes from: one task must not do it all."""

from pyspark.sql import functions as F

from quillon.operators import audits, progress, quality, selection, validation
from quillon.plans import bank, learner, matching, papers
from quillon.sources import shared

SF = "/root/testdata/sf0.001"


def test_tasks_grow_with_rows(spark):
    cores = spark.sparkContext.defaultParallelism
    assert shared.tasks(spark.range(10), 5) == 2 * cores
    assert shared.tasks(spark.range(1001), 10) == 101


def test_quota_form_deals_items(spark, capsys):
    items = spark.range(2000).coalesce(1)
    form = selection.quota_form(items, F.array(F.lit("f"), F.lit("g")), F.lit("s"), {"s": 3}, "id")
    form.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    assert form.count() == 6


def test_course_forms_deal_items(spark, capsys):
    bank._form_items(spark, "/root/testdata/sf0.001").explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def _parsed_in(spark, fields):
    rows = spark.range(2000).coalesce(1).select(F.lit("b").alias("bank"), F.col("id").alias("position"), F.lit('{"question": "x"}').alias("record"))
    return audits.typed_records(rows, fields).select(F.spark_partition_id()).distinct().count()


def test_paper_records_are_dealt(spark):
    assert _parsed_in(spark, audits.PAPER_FIELDS) > 1


def test_bank_records_are_dealt(spark):
    assert _parsed_in(spark, audits.BANK_FIELDS) > 1


def test_responses_meet_in_tasks_of_bounded_rows(spark, capsys):
    """By attempt, then by learner and question; what is summed by these keys takes no further shuffle."""
    learner.graded(spark, SF).explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    learner.evidence(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("REPARTITION_BY_NUM") == 2 and plan.index("SortAggregate") < plan.index("hashpartitioning(user_id")
    assert "ENSURE_REQUIREMENTS" not in plan.split("hashpartitioning(user_id")[0]


def test_attempts_of_unknown_states_are_left_out(spark):
    rows = [(1, "a", "correct", 1.0), (1, "b", "odd", 0.0), (2, "a", "incorrect", -0.5), (2, "b", "correct", 1.0), (3, "a", None, 0.0), (None, "a", "correct", 1.0)]
    found = progress.attempt_by_subject(spark.createDataFrame(rows, "attempt_id long, subject string, status string, awarded double"))
    assert sorted(map(tuple, found.collect())) == [(2, "a", 1, 0, 0.5), (2, "b", 1, 1, 0.0)]


def test_attempts_are_read_once(spark, capsys):
    rows = spark.createDataFrame([(1, "a", "correct", 1.0)], "attempt_id long, subject string, status string, awarded double")
    progress.attempt_by_subject(rows).explain()
    assert "Join" not in capsys.readouterr().out


def test_key_differences_deal_keys(spark, capsys):
    keys = lambda *ns: spark.createDataFrame([(n,) for n in ns], "k long")
    found = quality.key_differences(keys(1, 1, 2), keys(2, 3, 3), ["k"])
    found.explain()
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out
    assert sorted(map(tuple, found.collect())) == [(1, "missing"), (3, "unexpected")]


def test_paper_findings_send_rows_once(spark, capsys):
    rows = spark.createDataFrame([(1, 1, "x", "a"), (1, 2, "y", "b"), (2, 1, "x", "c"), (2, 1, None, "d"), (3, None, "x", "e")], "paper long, ordinal long, label string, sha string")
    declared = spark.createDataFrame([(1, 2, "?"), (2, 1, "?"), (3, 1, "?"), (4, 0, "?")], "paper long, count long, checksum string")
    found = validation.paper_findings(rows, declared, "paper", "ordinal", "label", "sha")
    found.explain()
    assert "Expand" not in capsys.readouterr().out
    assert {r["paper"]: set(r["codes"]) for r in found.collect()} == {
        1: {"checksum_differs"}, 2: {"count_differs", "duplicate_ordinal", "duplicate_label", "checksum_differs"}, 3: {"duplicate_ordinal", "checksum_differs"}, 4: {"absent"},
    }


def test_papers_are_digested_where_they_meet(spark, capsys):
    papers.digested(spark, SF, by_paper=True).explain()
    plan = capsys.readouterr().out
    assert plan.index("sha2") < plan.index("REPARTITION_BY_NUM")


def test_guests_and_accounts_are_folded_together(spark):
    rows = [(u, a, t, q, 1, s, "t") for u, a, t, q, s in [(1, 1, 5, 7, "guest"), (11, 2, 5, 7, "account"), (11, 3, 4, 8, "x"), (11, 3, 4, 9, "x"), (12, 4, 1, 7, "y"), (2, 5, 9, 7, "z"), (None, 6, 1, 1, "n")]]
    rows += [(11, 10 + k, 6 + k % 2, 9, 1, "x", "t") for k in range(5)]
    graded = spark.createDataFrame(rows, "user_id long, attempt_id long, submitted_at long, question_id long, position long, subject string, topic string")
    owners = spark.createDataFrame([(1, 11)], "guest long, account long")
    found = progress.merged_projection(graded, owners)
    got = {r["user_id"]: (r["attempts"], list(r["recent"]), {x["subject"]: x["n"] for x in r["subjects"]}) for r in found.collect()}
    assert got == {11: (8, [13, 11, 14, 12, 10], {"guest": 1, "x": 2}), 12: (1, [4], {"y": 1}), 2: (1, [5], {"z": 1})}


def test_merged_projection_scans_lines_twice(spark, capsys):
    matching.merged_projection(spark, SF).explain()
    assert capsys.readouterr().out.count("lineitem.parquet") == 2


def test_transcriptions_meet_in_one_shuffle(spark, capsys):
    matching._pairs(spark, SF).explain()
    plan = capsys.readouterr().out
    assert plan.count("REPARTITION_BY_NUM") == 2 and not [x for x in plan.splitlines() if "ENSURE_REQUIREMENTS" in x and "Broadcast" not in x]
