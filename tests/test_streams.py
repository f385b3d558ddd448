"""Streams against the batch operators, on feeds of several micro-batches."""

import random
import time

from pyspark.sql import functions as F

from telarium.operators import evidence as ev
from telarium.operators import facts, reports
from telarium.streaming import jobs


def feed(spark, rows, schema, path, parts=3):
    """``rows`` as a batch table and as a stream of one file each micro-batch, in the order given."""
    size = -(-len(rows) // parts)
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    return spark.createDataFrame(rows, schema), spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def drained(stream, tmp_path, name="out", timers=False):
    """All that a stream gives until its input ends. Timers of the clock (``timers``) ask for batches without end, so those without data are off then."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", str(not timers).lower())
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert q.awaitTermination(60)
    return spark.read.schema(stream.schema).parquet(str(tmp_path / name)).collect()


def test_process_state(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        start = rng.random() < 0.75
        rows.append((i, f"h{rng.randrange(2)}", i // 2, "process_start" if start else "process_exit", rng.randrange(12), rng.randrange(12), rng.choice(("A.exe", "a.exe", "b.exe")) if start else None))
    table, stream = feed(spark, rows, "id long, host string, us long, kind string, pid long, parent_pid long, image string", str(tmp_path / "in"))
    want = {r.id: r for r in facts.with_facts(table).collect()}
    got = drained(jobs.process_parents(stream), tmp_path, "parents", timers=True)
    assert {r.id: (r.parent_id, r.parent_image, r.siblings) for r in got} == {i: (r.parent_id, r.parent_image, r.siblings) for i, r in want.items()} and len(got) == len(want)
    assert any(r.parent_id is None for r in got) and any(r.siblings > 1 for r in got)
    seen = drained(jobs.image_sightings(stream), tmp_path, "sightings")
    assert {r.id: r.sighting for r in seen} == {i: r.sighting for i, r in want.items()} and len(seen) == len(want)


def test_decayed_evidence(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i // 2, f"h{i % 3}", i // 2 * 7_000_000, i // 2 % 4, rng.choice((0.5, 0.9)), 0.01, "r", i % 2, "t") for i in range(240)]
    rows = [(i, f"h{i % 3}", us, p, hit, miss, r, o, t) for i, _, us, p, hit, miss, r, o, t in rows]
    table, stream = feed(spark, rows, "id long, host string, us long, pid long, hit double, miss double, rule string, ord int, technique string", str(tmp_path / "in"))
    want = {r.id: r.log_odds for r in ev.evidence(table, 60.0).collect()}
    got = {r.id: r.log_odds for r in drained(jobs.decayed_evidence(stream, 60.0), tmp_path, timers=True)}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)


FIRINGS = "id long, host string, rule string, us long, rank int"


def test_coalescing_emits_as_the_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, f"h{rng.randrange(3)}", "r", i * 40, rng.choice((0, 1, 2, 3))) for i in range(300)]
    table, stream = feed(spark, rows, FIRINGS, str(tmp_path / "in"))
    names = F.element_at(F.lit(["info", "low", "medium", "high", "critical"]), F.col("rank") + 1)
    decided = table.select("id", "host", "rule", "us", F.lit(True).alias("acts"), F.lit("auto").alias("verdict"), names.alias("severity"))
    want = {(r.host, r.id): (r.n, r["rank"]) for r in ev.coalesced(decided, window_us=500).where("fate = 'emit'").collect()}
    got = {(r.host, r.alert): (r.n, r["rank"]) for r in drained(jobs.coalesced(stream, 500, 2, restate_ms=3_600_000), tmp_path, timers=True)}
    assert got == want and len(want) > 10


def test_restatement_by_timer_into_the_merged_table(spark, tmp_path):
    _, stream = feed(spark, [(1, "h", "r", 0, 3), (2, "h", "r", 10, 4), (3, "h", "r", 20, 0), (4, "k", "r", 0, 0)], FIRINGS, str(tmp_path / "in"), parts=1)
    at = str(tmp_path / "alerts")
    q = jobs.coalesced(stream, 500, 2, restate_ms=300).writeStream.foreachBatch(jobs.merge_alerts(at)).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()
    try:
        until, got = time.time() + 60, []
        while time.time() < until and [r.n for r in got] != [3]:
            assert q.isActive, q.exception()
            time.sleep(1)
            got = jobs.merged_alerts(spark, at).collect()
    finally:
        q.stop()
    assert [(r.host, r.alert, r.n, r["rank"]) for r in got] == [("h", 1, 3, 4)]


def test_a_batch_sent_again_counts_once(spark, tmp_path):
    rows = [(f"b{i % 20}", i) for i in range(60)]
    table = spark.createDataFrame(rows, "batch_id string, n long").withColumn("sent_at", F.timestamp_seconds(F.col("n") * 10))
    table, stream = feed(spark, [tuple(r) for r in table.collect()], table.schema, str(tmp_path / "in"))
    got = drained(jobs.deduplicated(stream), tmp_path)
    assert sorted(r.batch_id for r in got) == sorted({b for b, _ in rows})


def test_gaps(spark, tmp_path):
    rng = random.Random(8)
    shapes = [("dns", False), ("file", True), ("net", True), ("wmi", False)]
    rows = sorted((rng.randrange(20) * 600_000_000 + rng.randrange(600_000_000), f"h{rng.randrange(3)}", rng.choice(shapes)[0], rng.choice((None, None, "no name"))) for _ in range(150))
    table, _ = feed(spark, rows, "us long, host string, shape string, failure string", str(tmp_path / "unused"), parts=1)
    kinds = spark.createDataFrame(shapes, "shape string, kernel boolean")
    want = {tuple(r) for r in reports.telemetry_gaps(table, kinds).collect()}
    rows.append((10**15, "closing", "dns", None))  # closes all windows before it
    _, stream = feed(spark, rows, "us long, host string, shape string, failure string", str(tmp_path / "in"))
    closed = jobs.closed_windows(stream, shapes)
    drained(closed, tmp_path, "closed")
    follow = spark.readStream.schema(closed.schema).parquet(str(tmp_path / "closed"))
    got = [tuple(r) for r in drained(jobs.gaps(follow, shapes), tmp_path)]
    assert set(got) == want and len(got) == len(want) and {r[3] for r in got} == {"silent", "decode_failure"}


def test_liveness(spark, tmp_path):
    beats = [("a", 0), ("b", 0), ("a", 1000), ("a", 500), ("a", 2100), ("b", 5000), ("a", 2200), ("c", 10**9)]
    base = 1_000_000  # a stream's first watermark is the epoch, and what is not after it is late
    _, stream = feed(spark, [(s, base + ms) for s, ms in beats], "sensor string, ms long", str(tmp_path / "in"), parts=4)
    got = drained(jobs.liveness(stream, 1000, 100), tmp_path)
    assert sorted((r.sensor, r.at_ms - base, r.state) for r in got) == [("a", 0, "alive"), ("a", 3301, "stale"), ("b", 0, "alive"), ("b", 1101, "stale"), ("b", 5000, "alive"), ("b", 6101, "stale"), ("c", 10**9, "alive")]


def test_counters(spark, tmp_path):
    counters = jobs.Counters()
    spark.streams.addListener(counters)
    try:
        _, stream = feed(spark, [(i,) for i in range(30)], "id long", str(tmp_path / "in"))
        drained(jobs.metered(stream, "loop", raw_seen=F.count("*"), scored=F.count_if(F.col("id") % 3 == 0)), tmp_path)
        bad = stream.select(F.when(F.col("id") >= 0, F.raise_error(F.lit("bad"))).alias("x"))
        q = bad.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "bad")).trigger(availableNow=True).start()
        try:
            q.awaitTermination(60)
        except Exception:  # noqa: BLE001 - the failure is what is counted
            pass
        until = time.time() + 20
        while time.time() < until and counters.totals() != {"errors": 1, "raw_seen": 30, "scored": 10}:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(counters)
    assert counters.totals() == {"errors": 1, "raw_seen": 30, "scored": 10}
