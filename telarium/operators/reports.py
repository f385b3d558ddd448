"""Reports over findings, decisions and raw events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telarium.checkpoint import cut
from telarium.functions.scalars import capacity, entropy


def ratio(part: Column, whole: Column, empty: float = 1.0) -> Column:
    return F.when(whole > 0, part / whole).otherwise(empty)


def rule_firings(findings: DataFrame) -> DataFrame:
    """Firings of each rule, and the pair of its first one."""
    first = F.min_by(F.struct("hit", "miss"), F.struct("us", "id"))
    return findings.groupBy("rule").agg(F.count("*").alias("firings"), first.alias("x")).select("rule", "firings", "x.hit", "x.miss")


def rule_capacity(firings: DataFrame) -> DataFrame:
    return firings.withColumn("capacity", capacity(F.col("hit"), F.col("miss"))).withColumn("fano", entropy(1 - F.col("hit")))


def stack_capacity(firings: DataFrame) -> DataFrame:
    return rule_capacity(firings).agg(F.coalesce(F.avg("capacity"), F.lit(0.0)).alias("capacity"), F.count("*").alias("rules"))


def run_metrics(events: DataFrame, findings: DataFrame | None, decided: DataFrame, fates: DataFrame) -> DataFrame:
    """Counters by host and for the fleet (host null). Without ``findings``, those that ``decided`` counts by event."""
    parts = [
        events.groupBy("host").agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "process_start").alias("process_starts")),
        decided.groupBy("host").agg(F.sum("n_findings").alias("findings")) if findings is None else findings.groupBy("host").agg(F.count("*").alias("findings")),
        decided.groupBy("host").agg(F.count_if(~F.col("acts")).alias("abstained"), F.count_if(F.col("acts") & (F.col("verdict") == "denied")).alias("withheld")),
        fates.groupBy("host").agg(F.count_if(F.col("fate") == "emit").alias("alerts"), F.count_if(F.col("fate") == "fold").alias("suppressed"), F.count_if(F.col("fate") == "below_floor").alias("below_floor")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "host", "left")
    names = [c for c in out.columns if c != "host"]
    return out.fillna(0).rollup("host").agg(*(F.sum(c).alias(c) for c in names))


def coverage(events: DataFrame) -> DataFrame:
    starts = events.where("kind = 'process_start'").groupBy("host").agg(F.count("*").alias("entities"), F.count_distinct("pid").alias("observed"))
    cover = F.least(F.lit(1.0), ratio(F.col("observed"), F.col("entities")))
    return starts.withColumn("coverage", cover).withColumn("blind_spot", 1 - cover).withColumn("gap", F.greatest(F.col("entities") - F.col("observed"), F.lit(0)))


def novelty_summary(events: DataFrame, key: Column, since_us: int | None = None) -> DataFrame:
    """By host: distinct keys, sightings, the share of sightings that were the first, and what part of all
    keys has probably been seen: distinct / (distinct + first sightings since ``since_us``; null: all)."""
    keys = events.groupBy("host", key.alias("key")).agg(F.count("*").alias("n"), F.min("us").alias("first"))
    novel = F.count("*") if since_us is None else F.count_if(F.col("first") >= since_us)
    counts = keys.groupBy("host").agg(F.count("*").alias("distinct"), F.sum("n").alias("total"), novel.alias("novel"))
    return counts.select("host", "distinct", "total", ratio(F.col("distinct"), F.col("total"), 0.0).alias("novelty_rate"), "novel", ratio(F.col("distinct"), F.col("distinct") + F.col("novel")).alias("coverage_estimate"))


def fanout_ratio(edges: DataFrame) -> DataFrame:
    degree = edges.groupBy("src").agg(F.count("*").alias("degree"))
    return degree.crossJoin(F.broadcast(degree.agg(F.max("degree").alias("most")))).select("src", "degree", (F.col("degree") / F.col("most")).alias("fanout"))


#: Providers that are named in a histogram of unrecognised events.
NAMED_PROVIDERS = 512


def unrecognised(raw: DataFrame, named: int = NAMED_PROVIDERS) -> DataFrame:
    """Count by (provider, event_id) of rows without a shape; the first ``named`` providers
    (by time of their first row) have their name, all others are one row of nulls."""
    counts = raw.where("shape IS NULL").groupBy("provider", "event_id").agg(F.count("*").alias("n"), F.min(F.struct("us", "id")).alias("first"))
    order = counts.groupBy("provider").agg(F.min("first").alias("first")).orderBy("first", "provider").limit(named).select("provider", F.lit(True).alias("named"))
    rows = counts.join(F.broadcast(order), "provider", "left")
    shown = lambda c: F.when(F.col("named"), F.col(c)).alias(c)
    return rows.select(shown("provider"), shown("event_id"), "n").groupBy("provider", "event_id").agg(F.sum("n").alias("n"))


#: Forms in which an event arrives that no typed event can be made of.
LOST_FORMS = ("classic", "string_only", "trace_message")


def sensor_accounting(rows: DataFrame, most_verbose: int = 4) -> DataFrame:
    """By host: what became of every received event, whether the sum closes, what was lost, coverage, mean payload bytes.

    ``rows``: host, level, shape, failure, payload_bytes, and ``form``:
    ``manifest`` or one of ``LOST_FORMS``, which are lost before they are
    looked at. ``received`` counts all rows. A row of a form that the sensor
    doesn't count (null, or another) is in no class, so the sum doesn't close.
    """
    counted = F.coalesce(F.col("form") == "manifest", F.lit(False))
    ok = F.col("shape").isNotNull() & F.col("failure").isNull()
    passed = F.col("level") <= most_verbose
    out = rows.groupBy("host").agg(
        F.count("*").alias("received"), *(F.count_if(F.col("form") == f).alias(f) for f in LOST_FORMS),
        F.count_if(counted & ~passed).alias("filtered"), F.count_if(counted & passed & ok).alias("delivered"), F.count_if(counted & passed & ~ok).alias("dropped"),
        F.sum(F.when(counted & passed & ok, F.col("payload_bytes"))).alias("bytes"),
    )
    parts = (*LOST_FORMS, "filtered", "delivered", "dropped")
    closes = F.col("received") == sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    mean = F.when(F.col("delivered") > 0, F.col("bytes") / F.col("delivered")).otherwise(0.0)
    return out.select("host", "received", *parts, closes.alias("closes"), (F.col("received") - F.col("delivered")).alias("lost"), ratio(F.col("delivered"), F.col("received")).alias("coverage"), mean.alias("mean_payload_bytes"))


def patch_latency(patches: DataFrame, group: str, days: str, weaponised_after: float, q: float = 0.9) -> DataFrame:
    """Mean and percentile of days to patch, and how long the mean leaves open after an exploit exists."""
    mean = patches.groupBy(group).agg(F.avg(days).alias("mean_days"))
    rows = mean.join(nearest_rank(patches, group, days, q).withColumnRenamed("value", "percentile"), group)
    return rows.withColumn("exposure", F.greatest(F.lit(0.0), F.col("mean_days") - weaponised_after))


def shape_counts(raw: DataFrame, shapes: DataFrame) -> DataFrame:
    """attempted, mapped, undecodable for all shapes, zeros included."""
    counts = raw.where("shape IS NOT NULL").groupBy("shape").agg(F.count("*").alias("attempted"), F.count_if(F.col("failure").isNull()).alias("mapped"), F.count_if(F.col("failure").isNotNull()).alias("undecodable"))
    return shapes.select("shape").join(counts, "shape", "left").fillna(0)


#: Relative error of the sketch by which ranks are narrowed.
RANK_ACCURACY = 10_000
#: Groups whose bounds are broadcast.
GROUPS_SENT = 100_000


def nearest_rank(rows: DataFrame, group: str, value: str, q: float) -> DataFrame:
    """The value at index round((n - 1) * q) of a group's values in order, half away from zero; nulls first.

    No group is sorted: a sketch gives bounds around the rank, one pass counts
    what lies below them and each value between them, and the rank is looked
    for among those few. Partial sums come before every shuffle, so a group of
    all rows is spread over all tasks. Should a bound be wrong, that group's
    bounds are widened and it is counted again.
    """
    rows = rows.select(F.col(group).alias("g"), F.col(value).alias("v"))
    sides = lambda off: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.lit(q + off)))
    found, left, off = None, None, 4.0 / RANK_ACCURACY
    while True:
        some = rows if left is None else rows.join(left, rows["g"].eqNullSafe(left["miss"]), "left_semi")
        ends = some.groupBy("g").agg(F.count("*").alias("n"), F.percentile_approx("v", sides(-off), RANK_ACCURACY).alias("low"), F.percentile_approx("v", sides(off), RANK_ACCURACY).alias("high"))
        ends = cut(ends.select(F.col("g").alias("of"), F.floor((F.col("n") - 1) * q + 0.5).alias("rank"), *([F.lit(None).cast(rows.schema["v"].dataType).alias(c) for c in ("low", "high")] if off > 1 else ["low", "high"])))
        joined = some.join(F.broadcast(ends) if ends.count() <= GROUPS_SENT else ends, some["g"].eqNullSafe(ends["of"]))
        before = F.col("v").isNull() | (F.col("v") < F.col("low"))
        # all below are one row, all above are none of use
        key = F.when(~F.coalesce(before & F.col("low").isNotNull(), F.lit(False)), F.col("v"))
        counts = joined.where(F.col("v").isNull() | F.col("high").isNull() | (F.col("v") <= F.col("high"))).groupBy("g", "rank", F.coalesce(before & F.col("low").isNotNull(), F.lit(False)).alias("below"), key.alias("v")).agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"))
        order = Window.partitionBy("g").orderBy(F.desc("below"), F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
        placed = cut(counts.withColumn("upto", F.sum("n").over(order)).where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("n"))))
        # among what lies below, the rank is known only if all of it are nulls
        good = placed.where(~F.col("below") | (F.col("nulls") == F.col("n"))).select(F.col("g").alias(group), F.col("v").alias("value"))
        found = good if found is None else found.unionAll(good)
        missing = cut(ends.select(F.col("of").alias("miss")).join(good.select(F.col(group).alias("has"), F.lit(1).alias("one")), F.col("miss").eqNullSafe(F.col("has")), "left").where("one IS NULL").select("miss"))
        if missing.isEmpty():
            return found
        left, off = missing, off * 64


def telemetry_gaps(raw: DataFrame, shapes: DataFrame, window_us: int = 600_000_000) -> DataFrame:
    """Silent shapes and decode failures for each host and window."""
    counts = raw.where("shape IS NOT NULL").groupBy("host", F.floor(F.col("us") / window_us).alias("win"), "shape").agg(F.count("*").alias("attempted"), F.count_if(F.col("failure").isNull()).alias("mapped"))
    grid = counts.select("host", "win").distinct().crossJoin(F.broadcast(shapes.select("shape", "kernel")))
    dense = grid.join(counts, ["host", "win", "shape"], "left").fillna(0, ["attempted", "mapped"])
    before = Window.partitionBy("host", "shape").orderBy("win").rowsBetween(Window.unboundedPreceding, -1)
    side = Window.partitionBy("host", "win")
    other = F.when(F.col("kernel"), F.max(F.when(~F.col("kernel"), F.col("attempted")).otherwise(0)).over(side)).otherwise(F.max(F.when(F.col("kernel"), F.col("attempted")).otherwise(0)).over(side))
    rows = dense.withColumn("fired", F.coalesce(F.max("attempted").over(before), F.lit(0)) > 0).withColumn("other", other)
    state = F.when((F.col("attempted") == 0) & F.col("fired") & (F.col("other") > 0), "silent").when(F.col("attempted") > F.col("mapped"), "decode_failure")
    severity = F.when(state == "silent", 2).otherwise(1)
    return rows.withColumn("state", state).where("state IS NOT NULL").select("host", "win", "shape", "state", severity.alias("severity"), "attempted", "mapped")


def in_gap_order(gaps: DataFrame) -> DataFrame:
    """The worst gaps of each window first, then by shape."""
    return gaps.orderBy("host", "win", F.desc("severity"), "shape")


def technique_coverage(rules: DataFrame, findings: DataFrame) -> DataFrame:
    seen = findings.groupBy("technique").agg(F.count("*").alias("findings"), F.count_distinct("host").alias("hosts"))
    return rules.groupBy("technique").agg(F.count("*").alias("rules")).join(seen, "technique", "left").fillna(0)


def unobserved(universe: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Members of the universe that were never seen, once each."""
    return universe.select(key).distinct().join(seen.select(key).distinct(), key, "left_anti")


def throughput(rows: DataFrame) -> DataFrame:
    """By host: raw rows, those that became events, their rate over the span of ``us``, and their share."""
    span = (F.max("us") - F.min("us")) / 1e6
    scored = F.count_if(F.col("shape").isNotNull() & F.col("failure").isNull())
    out = rows.groupBy("host").agg(F.count("*").alias("raw"), scored.alias("scored"), span.alias("span"))
    rate = F.when(F.col("span") > 0, F.col("scored") / F.col("span")).otherwise(0.0)
    return out.select("host", "raw", "scored", rate.alias("per_second"), ratio(F.col("scored"), F.col("raw")).alias("coverage"))


def duty(sensors: DataFrame, beats: DataFrame) -> DataFrame:
    """Beats on time and missed by sensor, and their share; a sensor without any counts as available."""
    each = beats.groupBy("sensor").agg(F.count_if("on_time").alias("observed"), F.count_if(~F.col("on_time")).alias("missed"))
    rows = sensors.join(each, "sensor", "left").fillna(0, ["observed", "missed"])
    expected = F.col("observed") + F.col("missed")
    return rows.withColumn("availability", F.when(expected == 0, 1.0).otherwise(F.col("observed") / expected))


def liveness(now_ms: Column, last_ms: Column, interval_ms: int, grace_ms: int) -> Column:
    """alive up to and including the deadline, also when the clock went back; else stale or never_seen."""
    return F.when(last_ms.isNull(), "never_seen").when(now_ms <= last_ms + interval_ms + max(grace_ms, 0), "alive").otherwise("stale")


def wire_volume(events: DataFrame) -> DataFrame:
    """By kind: events, mean bytes of an event as JSON, bytes a day over the kind's own span."""
    size = F.octet_length(F.to_json(F.struct("*")))
    days = (F.max("us") - F.min("us")) / 86_400e6
    rows = events.withColumn("bytes", size).groupBy("kind").agg(F.count("*").alias("events"), F.avg("bytes").alias("mean_bytes"), (F.sum("bytes") / F.when(days > 0, days)).alias("bytes_per_day"))
    return rows
