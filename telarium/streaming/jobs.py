"""Streams: the batch operators' column functions on unbounded tables.

Late rows (more than ``LATE`` between time and receipt) are copied to a table
of their own before the watermark; the batch job picks them up.
"""

from __future__ import annotations

import threading
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from telarium.functions.scalars import log_ratio
from telarium.operators import rules, sigma
from telarium.sources.log_table import LogTable

LATE = "10 minutes"


def detect(events: DataFrame, compiled: list | None = None) -> DataFrame:
    """Stateless rules (and SIGMA rules) over a stream of telemetry."""
    native = rules.findings(events, [r for r in rules.rules() if not r.needs_facts])
    return native if not compiled else native.unionByName(sigma.hits(events, compiled))


def split_late(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in time, late) by receipt."""
    late = F.coalesce(F.col("received_at") - F.col("timestamp") > F.expr(f"INTERVAL {LATE}"), F.lit(False))
    return events.where(~late), events.where(late)


def process_parents(events: DataFrame, forget_ms: int = 30 * 86_400_000) -> DataFrame:
    """(id, host, parent_id, parent_image, siblings) of each process start, as ``facts.with_facts`` gives them.

    The state is that of one (host, pid), three values, so a busy host is not
    one task: a start is a record under its own pid and a look-up under its
    parent's. It goes with the process's exit, or ``forget_ms`` after the last
    event that touched it. Order is (us, id) inside a micro-batch.
    """
    rows = events.where("kind IN ('process_start', 'process_exit')")
    lookup = F.struct(F.col("parent_pid").alias("key"), F.lit(0).alias("turn"))
    own = F.struct(F.col("pid").alias("key"), F.when(F.col("kind") == "process_start", 1).otherwise(2).alias("turn"))
    turns = F.when(F.col("kind") == "process_start", F.array(lookup, own)).otherwise(F.array(own))
    rows = rows.select("host", "us", "id", "image", F.explode(turns).alias("t")).select("host", "t.key", "t.turn", "us", "id", "image")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parent, image, children = state.get if state.exists else (None, None, 0)
        out = []
        for turn, row, name in pd.concat(list(batches)).sort_values(["us", "id", "turn"])[["turn", "id", "image"]].itertuples(index=False, name=None):
            if turn == 0:
                out.append((int(row), key[0], parent, image, children if parent is not None else 0))
                children += parent is not None
            else:
                parent, image, children = (int(row), name, 0) if turn == 1 else (None, None, 0)
        if parent is not None:
            state.update((parent, image, children))
            state.setTimeoutDuration(forget_ms)
        elif state.exists:
            state.remove()
        made = pd.DataFrame(out, columns=["id", "host", "parent_id", "parent_image", "siblings"])
        yield made.astype({"parent_id": "Int64"})

    schema = "id long, host string, parent_id long, parent_image string, siblings long"
    return rows.groupBy("host", "key").applyInPandasWithState(step, schema, "parent long, image string, children long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def image_sightings(events: DataFrame) -> DataFrame:
    """(id, host, sighting) of each process start: how often its host started that image up to it. The state of an image is one number."""
    rows = events.where("kind = 'process_start'").select("host", F.lower("image").alias("name"), "us", "id")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        new = pd.concat(list(batches)).sort_values(["us", "id"])
        state.update((seen + len(new),))
        yield pd.DataFrame({"id": new["id"], "host": key[0], "sighting": range(seen + 1, seen + len(new) + 1)})

    return rows.groupBy("host", "name").applyInPandasWithState(step, "id long, host string, sighting long", "seen long", "append", GroupStateTimeout.NoTimeout)


def decayed_evidence(findings: DataFrame, half_life_s: float) -> DataFrame:
    """Evidence of each (host, key) after each event; a key's state is two numbers."""
    rows = findings.select("host", F.col("pid").alias("key"), "us", "id", log_ratio(F.col("hit"), F.col("miss")).alias("gain"))
    half = half_life_s * 1e6

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, last = state.get if state.exists else (0.0, None)
        if state.hasTimedOut:
            state.remove()
            return
        out = []
        for _, row in pd.concat(list(batches)).groupby(["us", "id"], sort=True)["gain"].sum().reset_index().iterrows():
            now = int(row["us"])
            if last is not None and now > last:
                total *= 2.0 ** (-(now - last) / half)
            last = now if last is None else max(now, last)
            total += float(row["gain"])
            out.append((key[0], key[1], now, int(row["id"]), total))
        state.update((total, last))
        state.setTimeoutDuration(int(64 * half_life_s * 1000))  # what is left by then is below 2**-64
        yield pd.DataFrame(out, columns=["host", "key", "us", "id", "log_odds"])

    return rows.groupBy("host", "key").applyInPandasWithState(step, "host string, key long, us long, id long, log_odds double", "total double, last long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def coalesced(firings: DataFrame, window_us: int, least_rank: int, restate_ms: int = 2000) -> DataFrame:
    """Alerts of each (host, rule); a timer restates the last one with what was folded."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        folded, worst, last, alert, count = state.get if state.exists else (0, 0, None, None, 0)
        out = []
        if state.hasTimedOut:
            if folded and alert is not None:
                count, folded = count + folded, 0
                out.append((key[0], key[1], alert, count, worst))
                state.update((folded, worst, last, alert, count))
        else:
            for us, row, rank in pd.concat(list(batches)).sort_values(["us", "id"])[["us", "id", "rank"]].itertuples(index=False, name=None):
                folded, worst = folded + 1, max(worst, int(rank))
                if worst >= least_rank and (last is None or us - last >= window_us):
                    alert, last, count, folded = int(row), int(us), folded, 0
                    out.append((key[0], key[1], alert, count, worst))
            state.update((folded, worst, last, alert, count))
            state.setTimeoutDuration(restate_ms)
        yield pd.DataFrame(out, columns=["host", "rule", "alert", "n", "rank"])

    schema = "host string, rule string, alert long, n long, rank int"
    return firings.groupBy("host", "rule").applyInPandasWithState(step, schema, "folded long, worst int, last long, alert long, count long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def causal_links(trace: DataFrame, horizon: str = "1 hour", late: str = LATE) -> DataFrame:
    """``algebra.causal_links`` on a stream of (id, us, actor, target): a join of the stream with itself
    in an interval of time; each side's state goes when the watermark has passed the horizon."""
    rows = trace.withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", late)
    a = rows.withColumn("key", F.explode(F.array_distinct(F.array("actor", "target")))).select(F.col("key").alias("a_key"), F.col("id").alias("a_id"), F.col("us").alias("a_us"), F.col("ts").alias("a_ts"))
    b = rows.select(F.col("actor").alias("b_key"), F.col("id").alias("b_id"), F.col("us").alias("b_us"), F.col("ts").alias("b_ts"))
    near = F.expr(f"b_ts >= a_ts AND b_ts <= a_ts + INTERVAL {horizon}")
    return a.join(b, (F.col("a_key") == F.col("b_key")) & near & ((F.col("a_us") < F.col("b_us")) | (F.col("a_id") < F.col("b_id")))).select("a_id", "b_id")


def deduplicated(batches: DataFrame, horizon: str = "1 hour") -> DataFrame:
    """A batch id seen within the horizon is not counted again."""
    return batches.withWatermark("sent_at", horizon).dropDuplicatesWithinWatermark(["batch_id"])


def closed_windows(raw: DataFrame, shapes: list[tuple[str, bool]], window: str = "10 minutes") -> DataFrame:
    """One row of counts for each host and window that the watermark has passed, to be written as a table that ``gaps`` follows.

    ``shapes``: (shape, whether the kernel's side fires it), a fixed list of at most 63.
    """
    rows = raw.where("shape IS NOT NULL").withColumn("ts", F.timestamp_micros("us")).withWatermark("ts", LATE)
    counts = [F.count_if(F.col("shape") == name).alias(f"a{i}") for i, (name, _) in enumerate(shapes)]
    counts += [F.count_if((F.col("shape") == name) & F.col("failure").isNull()).alias(f"m{i}") for i, (name, _) in enumerate(shapes)]
    closed = rows.groupBy("host", F.window("ts", window).alias("w")).agg(*counts)
    return closed.select("host", F.expr("unix_micros(w.start) div (unix_micros(w.end) - unix_micros(w.start))").alias("win"), *(c for c in closed.columns if c[0] in "am" and c[1:].isdigit()))


def gaps(closed: DataFrame, shapes: list[tuple[str, bool]]) -> DataFrame:
    """Silent shapes and decode failures of each closed window, as ``reports.telemetry_gaps`` gives them.

    The state of a host is one number whose bits say which shapes have ever fired.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (fired,) = state.get if state.exists else (0,)
        out = []
        for row in pd.concat(list(batches)).sort_values("win").to_dict("records"):
            tried = [int(row[f"a{i}"]) for i in range(len(shapes))]
            active = {side: any(n for n, (_, kernel) in zip(tried, shapes, strict=True) if kernel == side) for side in (True, False)}
            for i, (name, kernel) in enumerate(shapes):
                mapped = int(row[f"m{i}"])
                if not tried[i] and fired >> i & 1 and active[not kernel]:
                    out.append((key[0], int(row["win"]), name, "silent", 2, 0, 0))
                elif tried[i] > mapped:
                    out.append((key[0], int(row["win"]), name, "decode_failure", 1, tried[i], mapped))
            fired |= sum(1 << i for i, n in enumerate(tried) if n)
        state.update((fired,))
        yield pd.DataFrame(out, columns=["host", "win", "shape", "state", "severity", "attempted", "mapped"])

    schema = "host string, win long, shape string, state string, severity int, attempted long, mapped long"
    return closed.groupBy("host").applyInPandasWithState(step, schema, "fired long", "append", GroupStateTimeout.NoTimeout)


def liveness(beats: DataFrame, interval_ms: int, grace_ms: int, late: str = LATE) -> DataFrame:
    """(sensor, at_ms, state) whenever a sensor (sensor, ms) turns alive or stale.

    It is stale from the first millisecond after its deadline, which a timer
    watches in event time; a beat from before the latest one changes nothing.
    """
    rows = beats.withColumn("ts", F.timestamp_millis("ms")).withWatermark("ts", late)
    patience = interval_ms + max(grace_ms, 0)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, alive = state.get if state.exists else (-1, False)
        out = []
        if not state.hasTimedOut:
            for ms in sorted(int(x) for batch in batches for x in batch["ms"]):
                if alive and ms > last + patience:
                    out.append((key[0], last + patience + 1, "stale"))
                    alive = False
                last = max(last, ms)
                if not alive and ms == last:
                    out.append((key[0], ms, "alive"))
                    alive = True
        if alive and last + patience < state.getCurrentWatermarkMs():
            out.append((key[0], last + patience + 1, "stale"))
            alive = False
        state.update((last, alive))
        if alive:
            state.setTimeoutTimestamp(last + patience + 1)
        yield pd.DataFrame(out, columns=["sensor", "at_ms", "state"])

    return rows.groupBy("sensor").applyInPandasWithState(step, "sensor string, at_ms long, state string", "last long, alive boolean", "append", GroupStateTimeout.EventTimeTimeout)


def metered(rows: DataFrame, name: str, **counts: Column) -> DataFrame:
    """``rows``, whose ``counts`` (aggregates) a ``Counters`` listener adds up under their names."""
    return rows.observe(name, *(F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, c in counts.items()))


class Counters(StreamingQueryListener):
    """Totals over all micro-batches of the session's streams: what ``metered`` counts, and ``errors``, the queries that failed."""

    def __init__(self):
        self._lock, self._totals = threading.Lock(), {"errors": 0}

    def totals(self) -> dict[str, int]:
        with self._lock:
            return dict(self._totals)

    def _add(self, name: str, n: int) -> None:
        with self._lock:
            self._totals[name] = self._totals.get(name, 0) + n

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for row in event.progress.observedMetrics.values():
            for name, n in row.asDict().items():
                self._add(name, int(n or 0))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception is not None:
            self._add("errors", 1)


ALERTS = "host string, rule string, alert long, n long, rank int"


def alert_table(spark: SparkSession, path: str) -> LogTable:
    """One row for each alert; of a restated one the larger count stands."""
    return LogTable(spark, path, ALERTS, ["host", "rule", "alert"], {"n": F.max, "rank": F.max})


def merge_alerts(path: str, writer: str = "alerts"):
    """A ``foreachBatch`` sink into ``alert_table``; a replayed batch changes nothing."""
    return lambda batch, epoch: alert_table(batch.sparkSession, path).sink(writer)(batch, epoch)


def merged_alerts(spark: SparkSession, path: str) -> DataFrame:
    return alert_table(spark, path).read()


def event_table(spark: SparkSession, path: str, events: DataFrame, rows_per_file: int = 5_000_000) -> LogTable:
    """Events of the columns of ``events``, laid out by date and a bucket of hosts, in files of bounded size."""
    schema = StructType([*events.schema.fields, *StructType.fromDDL("date date, host_bucket int").fields])
    return LogTable(spark, path, schema, rows_per_file=rows_per_file, partition_by=("date", "host_bucket"))


def laid(events: DataFrame) -> DataFrame:
    """``events`` with the columns that ``event_table`` is laid out by."""
    return events.withColumn("date", F.to_date(F.timestamp_micros("us"))).withColumn("host_bucket", F.pmod(F.xxhash64("host"), F.lit(64)).cast("int"))


def ingest(inbox: LogTable, table: LogTable, writer: str, rows_of):
    """A ``foreachBatch`` sink for deliveries (batch_id, ...): each batch id counts once, however late it comes again.

    ``rows_of`` gives a delivery's rows for ``table``; ``inbox`` keeps the ids.
    Rows are added before ids, and both skip an epoch that they have: whatever
    the moment of a failure, the replay of the micro-batch completes it.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        new = batch.dropDuplicates(["batch_id"]).join(inbox.read().select("batch_id"), "batch_id", "left_anti").persist()
        try:
            table.append(rows_of(new), writer, epoch)
            inbox.append(new, writer, epoch)
        finally:
            new.unpersist()

    return write
