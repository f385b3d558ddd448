"""Decaying evidence, decisions, alert rows.

Evidence is a sum of log-ratios that halves every ``half_life_s``. It is
computed without a pair of events ever being compared: within a block of 256
half-lives the sum is a running one, scaled to the block's start, and the block
before it adds what is left of its total; what is older is below 2**-256.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from telarium.checkpoint import cut
from telarium.functions.scalars import SEVERITIES, half_life_weight, log_ratio, minimise, logit, severity_band, severity_rank, sigmoid
from telarium.operators.rules import title_of

PRIOR, HALF_LIFE_S, COST_FALSE_ALARM, COST_MISS, WINDOW_US = 0.01, 600.0, 1.0, 20.0, 300_000_000
BLOCK = 256


def evidence(findings: DataFrame, half_life_s: float = HALF_LIFE_S, prior: float = PRIOR) -> DataFrame:
    """One row for each event with findings: log-odds after it, posterior, primary finding,
    and ``body``, the minimised details of its findings in rule order (a few dozen at most)."""
    ratio = log_ratio(F.col("hit"), F.col("miss"))
    best = F.max(F.struct(ratio.alias("ratio"), "ord", "rule", "technique"))
    if "detail" not in findings.columns:
        findings = findings.withColumn("detail", F.lit(None).cast("string"))
    events = findings.groupBy("id", "host", "us", F.col("pid").alias("key")).agg(F.sum(ratio).alias("gain"), best.alias("best"), F.count("*").cast("long").alias("n_findings"), F.sort_array(F.collect_list(F.struct("ord", "technique", "detail"))).alias("told"))
    body = F.array_join(F.transform("told", lambda x: F.concat(x["technique"], F.lit(": "), F.coalesce(minimise(x["detail"]), F.lit("")))), "; ")
    unit = half_life_s * 1e6
    age = F.col("us") / unit
    block = F.floor(age / BLOCK)
    lift = F.pow(F.lit(2.0), age - block * BLOCK)
    rows = events.withColumn("block", block).withColumn("lift", lift).withColumn("x", F.col("gain") * lift)
    inside = Window.partitionBy("host", "key", "block").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("host", "key").orderBy("block").rangeBetween(-1, -1)
    total = F.sum("x").over(inside) + F.coalesce(F.sum("x").over(before), F.lit(0.0)) * half_life_weight(F.lit(BLOCK * half_life_s), half_life_s)
    return (
        rows.withColumn("log_odds", total / F.col("lift"))
        .withColumn("p", sigmoid(logit(F.lit(prior)) + F.col("log_odds")))
        .select("id", "host", "us", "key", "n_findings", F.col("best.rule").alias("rule"), F.col("best.technique").alias("technique"), "log_odds", "p", body.alias("body"))
    )


def threshold(false_alarm: float = COST_FALSE_ALARM, miss: float = COST_MISS) -> float:
    return 0.0 if false_alarm + miss == 0 else false_alarm / (false_alarm + miss)


#: Fixed values: (least posterior, action, kind, severity, reversible, disruptive), strongest first.
LADDER = ((0.995, "isolate host", "isolate", 5, False, True), (0.98, "freeze process", "freeze", 4, True, True), (0.90, "apply compensating control", "compensating_control", 3, True, True), (None, "raise alert", "alert", 2, True, False))


def _from_ladder(p: Column, field: int) -> Column:
    out = F.lit(LADDER[-1][field])
    for step in reversed(LADDER[:-1]):
        out = F.when(p >= step[0], F.lit(step[field])).otherwise(out)
    return out


#: What an action is in the order of escalation, weakest first.
RANKS = ("observe", "alert", "compensating_control", "freeze", "isolate")


def admissible(actions: DataFrame, max_severity: Column | int, require_reversible: bool = True) -> DataFrame:
    """The actions (kind, severity, reversible, ...) that may be taken, as a ladder: ``step`` by kind, then severity."""
    allowed = actions.where((F.col("severity") <= max_severity) & (F.col("reversible") if require_reversible else F.lit(True)))
    rank = F.array_position(F.lit(list(RANKS)), F.col("kind"))
    return allowed.withColumn("rank", rank)


def govern(severity: Column, reversible: Column, disruptive: Column, autonomy: str = "approve", max_auto: int = 2, require_reversible: bool = True) -> Column:
    """struct(verdict, reason). The verdicts and reasons."""
    say = lambda verdict, reason: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).alias("reason"))
    out = F.when(~disruptive, say("auto", "not disruptive"))
    if autonomy in ("observe", "alert"):
        return out.otherwise(say("denied", "observe-only autonomy"))
    if autonomy == "approve":
        return out.otherwise(say("approval", "approval autonomy level"))
    out = out.when(severity > max_auto, say("approval", "exceeds max_auto severity"))
    if require_reversible:
        out = out.when(~reversible, say("approval", "irreversible action requires approval"))
    return out.otherwise(say("auto", "within policy"))


def decisions(scored: DataFrame, false_alarm: float = COST_FALSE_ALARM, miss: float = COST_MISS, autonomy: str = "approve", **policy) -> DataFrame:
    """``scored`` with acts, severity, action, verdict and reason."""
    p = F.col("p")
    rows = scored.withColumn("acts", false_alarm * (1 - p) < miss * p).withColumn("severity", severity_band(p)).withColumn("action", _from_ladder(p, 1)).withColumn("action_kind", _from_ladder(p, 2))
    verdict = govern(_from_ladder(p, 3), _from_ladder(p, 4), _from_ladder(p, 5), autonomy, **policy)
    return rows.withColumn("v", verdict).select("*", "v.verdict", "v.reason").drop("v")


def audit(decided: DataFrame) -> DataFrame:
    """One row for each governed decision, also those folded later."""
    return decided.where("acts").select("host", "us", "id", "action", "verdict", "reason")


FATES = "host string, rule string, us long, id long, fate string, n long, rank int, alert long"
_SUMMARY = "host string, rule string, part int, n long, last_us long, tail long, high int, first_us long, first_id long, first_after long, upto array<long>, exit_us array<long>, exit_id array<long>, exit_after array<long>"
_ENTRY = "part int, folded long, since long, worst int, last long, chain long"


def coalesced(decided: DataFrame, window_us: int = WINDOW_US, floor: str = "medium", flush_us: int | None = None) -> DataFrame:
    """Firings that act, each with its fate: emit (with count and severity), fold, below_floor.

    A fold over each (host, rule) in time order, which steps from alert to
    alert, not from row to row. With ``flush_us`` there is a flush at every
    multiple of it: what was folded before a flush belongs to the alert it was
    folded into, what comes after it to the next alert.

    Firings lie in ranges of (host, rule, time), so a busy key is many
    partitions, which are folded side by side. Each is summarised first: for
    whatever alert stood last before it, which alert stands last behind it (a
    step function of the time of the former, found by jumping from alert to
    next alert in doubling strides). A key's summaries are put together in
    order, a block at a time, and give each partition the state that it starts
    with, six numbers a partition.
    """
    least = SEVERITIES.index(floor)
    firings = cut(decided.where("acts AND verdict <> 'denied'").select("host", "rule", "us", "id", severity_rank(F.col("severity")).alias("rank")))
    order = ["host", "rule", "us", "id"]
    rows = cut(firings.repartitionByRange(*order).sortWithinPartitions(*order))
    entries = _entries(rows, window_us, least, flush_us)
    sent = rows.sparkSession.sparkContext.broadcast({r.part: (r.folded, r.since, r.worst, r.last, r.chain) for r in entries.collect()})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entry = None, sent.value.get(TaskContext.get().partitionId())
        for batch in batches:
            if not len(batch):
                continue
            h, r = _codes(batch)
            us, ids, rank = (batch.column(c).to_numpy() for c in ("us", "id", "rank"))
            fate, n = np.full(len(us), 1, np.int8), np.zeros(len(us), np.int64)  # 0 below the floor, 1 fold, 2 emit
            high, alert = np.empty(len(us), np.int32), np.full(len(us), -1, np.int64)
            for a, b in _segments(h, r):
                mine = (batch.column("host")[a].as_py(), batch.column("rule")[a].as_py())
                if mine != key:
                    folded, since, worst, last, chain = entry if key is None and entry is not None else (0, 0, int(rank[a]), None, -1)
                    key = mine
                high[a:b] = np.maximum(np.maximum.accumulate(rank[a:b]), worst)
                worst = int(high[b - 1])
                i = a + int(np.searchsorted(high[a:b], least))
                fate[a:i] = 0
                folded += i - a
                while i < b:
                    if last is not None:  # rows before the window lapses are folded
                        until = i + int(np.searchsorted(us[i:b], last + window_us))
                        alert[i:until] = chain
                        if until > i:
                            flush = int(us[until - 1]) // flush_us if flush_us else 0
                            new = until - max(i, int(np.searchsorted(us[:until], flush * flush_us))) if flush_us else until - i
                            folded, since = (folded if flush == since else 0) + new, flush
                        i = until
                        if i == b:
                            break
                        if flush_us and int(us[i]) // flush_us != since:
                            folded = 0
                    fate[i], n[i], alert[i], last, chain = 2, folded + 1, ids[i], int(us[i]), int(ids[i])
                    folded, since = 0, last // flush_us if flush_us else 0
                    i += 1
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("rule"), batch.column("us"), batch.column("id"), pa.array(np.array(["below_floor", "fold", "emit"], object)[fate]), pa.array(n), pa.array(high), pa.array(alert, mask=alert < 0)], names=["host", "rule", "us", "id", "fate", "n", "rank", "alert"])

    return rows.mapInArrow(fold, FATES)


def _codes(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for c in ("host", "rule")]


def _segments(h: np.ndarray, r: np.ndarray) -> list[tuple[int, int]]:
    heads = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])))).tolist()
    return list(zip(heads, [*heads[1:], len(h)], strict=True))


def last_alerts(us: np.ndarray, window_us: int) -> np.ndarray:
    """For each row as an alert, the last alert of the chain that it starts: jumps from alert to next alert, doubled until none goes on."""
    jump = np.searchsorted(us, us + window_us)
    jump = np.where(jump < len(us), jump, np.arange(len(us)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return jump
        jump = further


def _summary(key: tuple, part: int, us: np.ndarray, ids: np.ndarray, rank: np.ndarray, window_us: int, least: int, flush_us: int | None, entered: bool) -> dict:
    """What a block does to any state; ``entered``: whether another block of the key may stand before it."""
    n, ends = len(us), last_alerts(us, window_us)
    tail = n - int(np.searchsorted(us, us[-1] // flush_us * flush_us)) if flush_us else n
    out = dict(zip(("host", "rule"), key, strict=True)) | {"part": part, "n": n, "last_us": int(us[-1]), "tail": tail, "high": int(rank.max())}
    reached = np.flatnonzero(rank >= least)
    end = int(ends[reached[0]]) if len(reached) else None
    out |= {"first_us": None if end is None else int(us[end]), "first_id": None if end is None else int(ids[end]), "first_after": None if end is None else n - 1 - end}
    # the last alert before the block is not later than its first row, so the first one in it is among these
    m = min(n, int(np.searchsorted(us, us[0] + window_us)) + 1) if entered else 0
    stops = np.flatnonzero(np.diff(ends[:m], append=-1) != 0)
    return out | {"upto": us[stops].tolist(), "exit_us": us[ends[stops]].tolist(), "exit_id": ids[ends[stops]].tolist(), "exit_after": (n - 1 - ends[stops]).tolist()}


def _entries(rows: DataFrame, window_us: int, least: int, flush_us: int | None) -> DataFrame:
    """The state with which each partition begins that continues a key."""
    told_as, entry_as = (to_arrow_schema(T.StructType.fromDDL(d)) for d in (_SUMMARY, _ENTRY))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, key, held = TaskContext.get().partitionId(), 0, None, []

        def told() -> pa.RecordBatch:
            us, ids, rank = (np.concatenate(x) for x in zip(*held, strict=True))
            return pa.RecordBatch.from_pylist([_summary(key, part, us, ids, rank, window_us, least, flush_us, number == 1)], told_as)

        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(c).to_numpy() for c in ("us", "id", "rank")]
            for a, b in _segments(*_codes(batch)):
                mine = (batch.column("host")[a].as_py(), batch.column("rule")[a].as_py())
                if mine != key:
                    if number == 1:  # keys that lie in the midst of a partition concern no other
                        yield told()
                    key, held, number = mine, [], number + 1
                held.append([c[a:b] for c in columns])
        if key is not None:
            yield told()

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if (x["host"], x["rule"]) != key:
                    key, state = (x["host"], x["rule"]), (0, 0, -1, None, -1)
                else:
                    out.append(dict(zip(("folded", "since", "worst", "last", "chain"), state, strict=True)) | {"part": x["part"]})
                state = _behind(x, state, window_us, least, flush_us)
            yield pa.RecordBatch.from_pylist(out, entry_as)

    summaries = rows.mapInArrow(summarise, _SUMMARY)
    return summaries.repartition("host", "rule").sortWithinPartitions("host", "rule", "part").mapInArrow(compose, _ENTRY)


def _behind(x: dict, state: tuple, window_us: int, least: int, flush_us: int | None) -> tuple:
    """The state behind a block, given its summary and the state before it."""
    folded, since, worst, last, chain = state
    now, flush = max(worst, x["high"]), x["last_us"] // flush_us if flush_us else 0
    if worst < least:
        if x["first_us"] is None:
            return folded + x["n"], since, now, last, chain
        exit_ = (x["first_us"], x["first_id"], x["first_after"])
    else:
        k = bisect_left(x["upto"], last + window_us)
        if k == len(x["upto"]):
            return (folded if flush == since or not flush_us else 0) + x["tail"], flush, now, last, chain
        exit_ = (x["exit_us"][k], x["exit_id"][k], x["exit_after"][k])
    return min(exit_[2], x["tail"]), flush, now, exit_[0], exit_[1]


def restated(fates: DataFrame, flush_us: int | None = None) -> DataFrame:
    """Alerts raised by what was folded into them before a flush: the one at the end
    of the data, and with ``flush_us`` those at its multiples (as in ``coalesced``)."""
    span = F.lit(0) if flush_us is None else F.floor(F.col("us") / flush_us)
    emitted, rank = F.col("fate") == "emit", F.col("rank")
    told = fates.where("alert IS NOT NULL").groupBy("host", "rule", "alert", span.alias("span")).agg(
        F.sum("n").alias("n"), F.count_if(F.col("fate") == "fold").alias("folded"), F.max(F.when(emitted, F.col("us"))).alias("at"),
        F.max(F.when(emitted, rank)).alias("raised"), F.max(rank).alias("worst"),
    )
    # an alert's rows end where the next alert of its key begins, so only alerts are put in order, each with its few spans
    each = told.groupBy("host", "rule", "alert").agg(F.sum("n").alias("n"), F.max("at").alias("at"), F.max("raised").alias("raised"), F.collect_list(F.struct("span", "folded", "worst")).alias("spans"))
    each = each.withColumn("then", F.lead("at").over(Window.partitionBy("host", "rule").orderBy("at", "alert")))
    last = F.col("then").isNull()
    flushed = F.filter("spans", lambda s: last if flush_us is None else last | (s["span"] < F.floor(F.col("then") / flush_us)))
    rows = each.withColumn("flushed", flushed)
    folded = F.aggregate("flushed.folded", F.lit(0).cast("long"), lambda a, b: a + b)
    out = rows.select("host", "rule", "alert", "n", folded.alias("folded"), F.greatest("raised", F.array_max("flushed.worst")).alias("rank"))
    return out.where("folded > 0").select("host", "rule", "alert", (F.col("n") + F.col("folded")).alias("n"), "rank")


def alert_rows(decided: DataFrame, fates: DataFrame, titles: dict[str, str] | None = None) -> DataFrame:
    """Emitted alerts with title, description (with the body) and severity. ``titles``: of SIGMA rules, by id."""
    emitted = fates.where("fate = 'emit'").select("host", "rule", "id", "us", "n", "rank")
    rows = emitted.join(decided.select("id", "key", "p", "action", "action_kind", "verdict", "technique", "body"), "id")
    title = F.concat(title_of(F.col("rule"), titles), F.when(F.col("verdict") == "approval", " \u2014 awaiting approval").otherwise(""))
    severity = F.element_at(F.lit(list(SEVERITIES)), F.col("rank") + 1)
    text = F.format_string("%s (p=%.4f, n=%d) via %s; %s", "action", "p", "n", "rule", "body")
    return rows.select(F.concat_ws("-", "host", F.col("id").cast("string")).alias("alert_id"), "host", "rule", "id", "us", "technique", title.alias("title"), text.alias("description"), severity.alias("severity"), F.col("n").alias("count"), "action_kind", "verdict", "key")


def alert_queue(fates: DataFrame) -> DataFrame:
    """Detections: one row for each host and rule, worst severity and latest first."""
    rows = fates.groupBy("host", "rule").agg(F.count("*").alias("firings"), F.count_if(F.col("fate") == "emit").alias("alerts"), F.max("rank").alias("severity_rank"), F.max("us").alias("last_seen_us")).where("alerts > 0")
    return rows.orderBy(F.desc("severity_rank"), F.desc("last_seen_us"), "host", "rule")


def by_severity(queue: DataFrame) -> DataFrame:
    """How many detections a filter on each severity would show; none is a row of 0."""
    ranks = queue.sparkSession.createDataFrame([(i, name) for i, name in enumerate(SEVERITIES)], "severity_rank int, severity string")
    counts = queue.groupBy("severity_rank").agg(F.count("*").alias("detections"))
    return ranks.join(counts, "severity_rank", "left").select("severity", F.coalesce("detections", F.lit(0)).alias("detections"))


#: Images that are never acted against while they run from the system's directory.
CRITICAL_IMAGES = ("system", "registry", "memory compression", "idle", "smss.exe", "csrss.exe", "wininit.exe", "services.exe", "lsass.exe", "winlogon.exe", "explorer.exe", "dwm.exe", "fontdrvhost.exe", "svchost.exe")


def refusal(pid: Column, image: Column, own_pid: Column, own_image: Column, system_directory: Column) -> Column:
    """Why nothing may be done to a process; null if nothing forbids it."""
    folded = lambda c: F.lower(F.translate(F.regexp_replace(F.trim(c), r"[\\/]+$", ""), "/", "\\"))
    name = F.trim(F.regexp_extract(folded(image), r"([^\\]*)$", 1))
    inside = folded(image).startswith(F.concat(folded(system_directory), F.lit("\\"))) & (folded(system_directory) != "")
    return (
        F.when(pid <= 4, "system process").when(pid == own_pid, "own process").when(F.coalesce(F.trim(image), F.lit("")) == "", "unknown image")
        .when(F.lower(F.trim(image)) == F.lower(F.trim(own_image)), "own image").when(name.isin(*CRITICAL_IMAGES) & inside, "critical image")
    )


def response_plan(alerts: DataFrame, pids: DataFrame | None = None) -> DataFrame:
    """Proposed suspensions: a plan, nothing acts. Without ``pids``, of the process (``key``) whose evidence an alert tells."""
    frozen = alerts.where("action_kind = 'freeze'")
    frozen = frozen.withColumn("pid", F.col("key")) if pids is None else frozen.join(pids.select("id", "pid"), "id")
    return frozen.select("alert_id", "pid", F.lit("suspend").alias("response"), (F.col("verdict") == "auto").alias("automatic"))
