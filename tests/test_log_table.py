"""Tables that take each epoch once: replays, lost commits, rivals, merging, size."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telarium.sources import telemetry as src
from telarium.sources.log_table import LogTable
from telarium.streaming import jobs
from test_streams import drained, feed

ROWS = "k long, n long, name string"


def batch(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def keyed(spark, path, **more):
    return LogTable(spark, str(path), ROWS, ["k"], {"n": F.max, "name": lambda c: F.max_by(c, F.col("n"))}, **more)


def rows_of(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_replay_adds_nothing(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), ROWS)
    assert rows_of(table) == []
    assert table.append(batch(spark, [(1, 1, "a"), (None, 2, None)]), "w", 0)
    assert not table.append(batch(spark, [(1, 1, "a"), (None, 2, None)]), "w", 0)
    assert table.append(batch(spark, []), "w", 1) and not table.append(batch(spark, [(9, 9, "z")]), "w", 1)
    assert table.append(batch(spark, [(1, 1, "a")]), "other", 0)
    again = LogTable(spark, str(tmp_path / "t"), ROWS)  # as after a restart
    assert not again.append(batch(spark, [(7, 7, "x")]), "w", 1)
    assert sorted(again.read().collect(), key=str) == sorted(batch(spark, [(1, 1, "a"), (None, 2, None), (1, 1, "a")]).collect(), key=str)
    assert again.version().epochs == {"w": 1, "other": 0} and len(again.version().runs) == 2


def test_killed_before_the_commit(spark, tmp_path, monkeypatch):
    table = keyed(spark, tmp_path / "t")
    table.append(batch(spark, [(1, 1, "a")]), "w", 0)

    class Killed(Exception):
        pass

    def killed(self, version):
        raise Killed

    with monkeypatch.context() as m:
        m.setattr(LogTable, "_publish", killed)
        with pytest.raises(Killed):
            table.append(batch(spark, [(1, 5, "b")]), "w", 1)
    assert rows_of(table) == [(1, 1, "a")]
    assert table.append(batch(spark, [(1, 5, "b")]), "w", 1) and rows_of(table) == [(1, 5, "b")]
    left = list((tmp_path / "t").glob("run=*"))
    assert len(left) == 3 and table.vacuum() == 1 and rows_of(table) == [(1, 5, "b")]


def test_rivals(spark, tmp_path, monkeypatch):
    """Two writers between whose look at the log and whose commit the other commits; and one epoch sent by both."""
    one, two = keyed(spark, tmp_path / "t", fanout=100), keyed(spark, tmp_path / "t", fanout=100)
    publish, waiting = LogTable._publish, [lambda: two.append(batch(spark, [(2, 2, "two")]), "two", 0), lambda: two.append(batch(spark, [(1, 9, "late")]), "one", 0)]

    def late(self, version):
        if self is one and waiting:
            waiting.pop(0)()
        return publish(self, version)

    monkeypatch.setattr(LogTable, "_publish", late)
    # tries again on top of the other's; then finds its own epoch committed by someone else
    assert not one.append(batch(spark, [(1, 50, "one")]), "one", 0)
    assert rows_of(one) == [(1, 9, "late"), (2, 2, "two")]
    waiting.append(lambda: two.append(batch(spark, [(3, 3, "three")]), "two", 1))
    assert one.append(batch(spark, [(1, 60, "x")]), "one", 1)
    assert rows_of(one) == [(1, 60, "x"), (2, 2, "two"), (3, 3, "three")] and one.version().number == 4


def test_many_epochs_stay_few_files(spark, tmp_path):
    table = keyed(spark, tmp_path / "t", fanout=4)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        for epoch in range(100):
            table.append(batch(spark, [(epoch % 7, epoch, f"e{epoch}"), (1000 + epoch, epoch, "own")]).coalesce(1), "w", epoch)
            assert len(table.version().runs) <= 3 * 4
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    want = {k: max(e for e in range(100) if e % 7 == k) for k in range(7)}
    assert rows_of(table) == sorted([(k, e, f"e{e}") for k, e in want.items()] + [(1000 + e, e, "own") for e in range(100)])
    assert table.vacuum(keep=2) > 50
    assert len(list((tmp_path / "t").rglob("*.parquet"))) < 30 and len(list((tmp_path / "t" / "_log").glob("*.json"))) == 2
    assert len(rows_of(table)) == 107
    assert max(level for _, level, _ in table.version().runs) >= 3
    older = table.read(table.version().number - 1)
    assert older.count() in (106, 107)


def test_files_have_at_most_so_many_rows(spark, tmp_path):
    table = LogTable(spark, str(tmp_path / "t"), ROWS, rows_per_file=40, fanout=2)
    for epoch in range(2):
        table.append(batch(spark, [(i, i, "x") for i in range(100)]).coalesce(1), "w", epoch)
    (run,) = table.version().runs
    assert run[1:] == (1, 200)
    files = list((tmp_path / "t" / run[0]).glob("*.parquet"))
    assert max(spark.read.parquet(str(f)).count() for f in files) <= 40


def test_events_by_date_and_host(spark, tmp_path):
    events = spark.createDataFrame([(i, f"h{i % 3}", i * 3_600_000_000) for i in range(100)], "id long, host string, us long")
    table = jobs.event_table(spark, str(tmp_path / "t"), events)
    _, stream = feed(spark, [tuple(r) for r in events.collect()], events.schema, str(tmp_path / "in"), parts=4)
    sink = table.sink("stream")
    for _ in range(2):  # the second time on a checkpoint that has lost its last commit, as after a kill
        q = jobs.laid(stream).writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        commits = sorted((tmp_path / "cp" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
        for p in (commits[-1], commits[-1].with_name(f".{commits[-1].name}.crc")):
            p.unlink(missing_ok=True)
    assert sorted(r.id for r in table.read().collect()) == list(range(100))
    assert table.version().epochs == {"stream": 3}
    day = table.read().where("date = DATE '1970-01-02'")
    assert day.count() == 24 and "date" in day._jdf.queryExecution().executedPlan().toString().split("PartitionFilters")[1][:80]


def test_ingest_counts_a_batch_once(spark, tmp_path, monkeypatch):
    deliveries = [(f"b{i % 12}", [i % 12 * 10 + j for j in range(3)]) for i in range(40)]
    schema = "batch_id string, ids array<long>"
    _, stream = feed(spark, deliveries, schema, str(tmp_path / "in"), parts=4)
    inbox, table = LogTable(spark, str(tmp_path / "inbox"), schema, ["batch_id"], {"ids": F.first}), LogTable(spark, str(tmp_path / "rows"), "batch_id string, id long")
    write = jobs.ingest(inbox, table, "w", lambda new: new.select("batch_id", F.explode("ids").alias("id")))
    append, fail = LogTable.append, [True]

    def once(self, *args):
        if self is inbox and args[2] == 1 and fail:
            fail.clear()
            raise RuntimeError("killed between the two")
        return append(self, *args)

    monkeypatch.setattr(LogTable, "append", once)
    run = lambda: stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    with pytest.raises(Exception, match="killed between"):
        run().awaitTermination(60)
    run().awaitTermination(60)
    assert sorted(r.id for r in table.read().collect()) == sorted({i for _, ids in deliveries for i in ids})
    assert inbox.read().count() == 12


def test_log_is_readable(spark, tmp_path):
    table = keyed(spark, tmp_path / "t")
    table.append(batch(spark, [(1, 1, "a")]), "w", 3)
    (file,) = (tmp_path / "t" / "_log").glob("*.json")
    assert json.loads(file.read_text())["epochs"] == {"w": 3} and not list((tmp_path / "t" / "_log").glob("_*"))
    assert isinstance(table.schema, T.StructType) and src.SCHEMA_VERSION == 2 and drained
