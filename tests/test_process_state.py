"""The process-state stream against the batch operators: disorder, restarts, late rows, forgetting."""

import random

import pytest
from pyspark.sql import functions as F

from telarium.operators import facts
from telarium.streaming import process_state
from test_streams import drained, feed

SCHEMA = "id long, host string, us long, kind string, pid long, parent_pid long, image string"
MINUTE = 60_000_000


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", process_state.ROCKSDB)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def made(n, seed, base=10**9):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        start = rng.random() < 0.75
        parent = rng.randrange(9) if start and rng.random() < 0.9 else None
        rows.append((i, f"h{rng.randrange(2)}", base + i // 2 * MINUTE, "process_start" if start else "process_exit", rng.randrange(9), parent, rng.choice(("A.exe", "a.exe", "b.exe", "c.exe")) if start else None))
    return rows


def wanted(table):
    edges = {r.id: r.score for r in facts.edge_novelty(facts.process_edges(table)).collect()}
    return {r.id: (r.host, r.us, r.parent_id, r.parent_image, r.sighting, r.image_is_novel, r.siblings, edges.get(r.id)) for r in facts.with_facts(table).collect()}


def given(rows):
    got = {r.id: (r.host, r.us, r.parent_id, r.parent_image, r.sighting, r.image_is_novel, r.siblings, r.edge_score) for r in rows}
    assert len(got) == len(rows)
    return got


def closing(host, us):
    """A row so late in time that the watermark passes all others."""
    return (10**9, host, us, "process_exit", 10**6, None, None)


def test_stream_equals_the_batch_operators(rocks, tmp_path):
    rows = made(240, 5)
    want = wanted(rocks.createDataFrame(rows, SCHEMA))
    # five micro-batches, out of order by less than the watermark's delay
    rng = random.Random(1)
    mixed = sorted(rows, key=lambda r: r[2] + rng.randrange(9 * MINUTE))
    _, stream = feed(rocks, [*mixed, closing("h0", 10**14)], SCHEMA, str(tmp_path / "in"), parts=5)
    got = given(drained(process_state.process_facts(stream), tmp_path))
    assert got == want
    scores = [v[-1] for v in got.values()]
    assert {0.0, 0.5, 1.0, None} == set(scores) and any(v[6] > 2 for v in got.values())


def test_restart_and_a_late_row(rocks, tmp_path):
    rows = made(160, 6)
    half, at = len(rows) // 2, str(tmp_path / "in")
    late = (5000, "h0", rows[10][2], "process_start", 3, 4, "late.exe")  # its time has long passed when it comes
    rocks.createDataFrame(rows[:half], SCHEMA).coalesce(1).write.parquet(at)
    stream = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
    first = drained(process_state.process_facts(stream), tmp_path)
    rocks.createDataFrame([late, *rows[half:]], SCHEMA).coalesce(1).write.mode("append").parquet(at)
    rocks.createDataFrame([closing("h0", 10**14)], SCHEMA).coalesce(1).write.mode("append").parquet(at)
    # a new query on the old checkpoint goes on with its state
    again = rocks.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(at)
    got = given(drained(process_state.process_facts(again), tmp_path))
    assert 0 < len(first) < len(got)
    assert got == wanted(rocks.createDataFrame(rows, SCHEMA))


def test_untouched_processes_are_forgotten(rocks, tmp_path):
    day = 86_400_000_000
    rows = [(1, "h", 10 * day, "process_start", 7, None, "p.exe"), (2, "h", 10 * day + 1, "process_start", 8, 7, "q.exe"), (3, "h", 20 * day, "process_start", 9, 7, "q.exe"), (4, "h", 60 * day, "process_start", 1, None, "r.exe"), (5, "h", 61 * day, "process_start", 2, 7, "q.exe")]
    _, stream = feed(rocks, [*rows, closing("h", 10**14)], SCHEMA, str(tmp_path / "in"), parts=6)
    got = given(drained(process_state.process_facts(stream), tmp_path))
    assert [got[i][2] for i in range(1, 6)] == [None, 1, 1, None, None]  # the last parent was touched 41 days before
    assert got[5][4] == 3 and got[5][7] == 1.0 and got[3][7] == 0.0  # images and edges are remembered
