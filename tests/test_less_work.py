"""What queries of translation and metrics need not write or make again."""

from pyspark.sql import functions as F

from telarium.operators import evidence, reports
from telarium.plans import fleet


def test_typed_events_are_not_written(spark):
    rows = fleet.shaped(spark, "/root/testdata/sf0.001")
    files = rows.inputFiles()
    assert files and all("/raw-" in f for f in files)


def test_findings_as_the_decisions_count_them(spark):
    events = spark.createDataFrame([("a", "process_start"), ("a", "dns_query"), ("b", "dns_query")], "host string, kind string")
    decided = spark.createDataFrame([("a", True, "auto", 2), ("a", False, "auto", 1)], "host string, acts boolean, verdict string, n_findings long")
    fates = spark.createDataFrame([("a", "emit")], "host string, fate string")
    findings = spark.createDataFrame([("a",)] * 3, "host string")
    told = lambda f: {tuple(r) for r in reports.run_metrics(events, f, decided, fates).collect()}
    assert told(None) == told(findings) == {("a", 2, 1, 3, 1, 0, 1, 0, 0), ("b", 1, 0, 0, 0, 0, 0, 0, 0), (None, 3, 1, 3, 1, 0, 1, 0, 0)}


def test_plan_of_responses_needs_no_events(spark):
    decided = spark.createDataFrame([(1, 7, 0.99, "freeze process", "freeze", "approval", "T1", "b"), (2, None, 0.99, "freeze process", "freeze", "auto", "T1", "b"), (3, 8, 0.5, "raise alert", "alert", "auto", "T1", "b")], "id long, key long, p double, action string, action_kind string, verdict string, technique string, body string")
    fates = spark.createDataFrame([("h", "x", i, i, "emit" if i < 4 else "fold", 1, 3) for i in (1, 2, 3)], "host string, rule string, us long, id long, fate string, n long, rank int")
    rows = evidence.alert_rows(decided, fates)
    want = {("h-1", 7, "suspend", False), ("h-2", None, "suspend", True)}
    assert {tuple(r) for r in evidence.response_plan(rows).collect()} == want
    pids = decided.select("id", F.col("key").alias("pid"))
    assert {tuple(r) for r in evidence.response_plan(rows, pids).collect()} == want
