"""Alert coalescing of busy keys over many partitions against a loop over rows."""

import random

import pytest
from pyspark.sql import functions as F

from telarium.functions.scalars import SEVERITIES
from telarium.operators import evidence as ev


def loop(rows, window, least, flush):
    """{id: (fate, n, rank, alert)} by the rule, row by row."""
    out, states = {}, {}
    for host, rule, us, i, rank in sorted(rows, key=lambda r: (r[2], r[3])):
        folded, since, worst, last, chain = states.get((host, rule), (0, 0, -1, None, None))
        worst = max(worst, rank)
        if worst < least:
            out[i], folded = ("below_floor", 0, worst, None), folded + 1
        else:
            if last is not None and flush and us // flush != since:
                folded, since = 0, us // flush
            if last is None or us - last >= window:
                out[i], folded, last, chain, since = ("emit", folded + 1, worst, i), 0, us, i, us // flush if flush else 0
            else:
                out[i], folded = ("fold", 0, worst, chain), folded + 1
        states[host, rule] = (folded, since, worst, last, chain)
    return out


def decided(spark, rows):
    table = spark.createDataFrame(rows, "host string, rule string, us long, id long, rank int")
    return table.select("host", "rule", "us", "id", F.lit(True).alias("acts"), F.lit("auto").alias("verdict"), F.element_at(F.lit(list(SEVERITIES)), F.col("rank") + 1).alias("severity"))


@pytest.fixture
def many(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("span,window,flush,calm", [(20_000, 100, None, 0), (20_000, 3_000, None, 900), (20_000, 50_000, 4_000, 300), (3_000, 700, 500, 0), (500, 60, 100, 1500), (20_000, 1, 7, 0)])
def test_one_busy_key(many, span, window, flush, calm):
    rng = random.Random(span + window)
    rows = [("h", "busy", rng.randrange(span), i, 0 if i < calm else rng.choice((0, 1, 2, 3))) for i in range(2000)]
    if calm:  # below the floor for some partitions
        rows = [(h, r, us if k >= 2 else us // 2, i, k if us > span // 3 else min(k, 1)) for h, r, us, i, k in rows]
    rows += [(rng.choice(("a", "h", "z")), rng.choice(("busy", "calm", None)), rng.randrange(span), 5000 + i, rng.choice((0, 1, 2))) for i in range(60)]
    got = ev.coalesced(decided(many, rows), window_us=window, flush_us=flush)
    assert got.rdd.getNumPartitions() == 13
    busy = got.withColumn("p", F.spark_partition_id()).where("host = 'h' AND rule = 'busy'").select("p").distinct().count()
    assert busy > 8
    found = got.collect()
    assert len(found) == len(rows)
    assert {r.id: (r.fate, r.n, r["rank"], r.alert) for r in found} == loop(rows, window, 2, flush)


def test_no_firings_and_dense_ties(many):
    assert ev.coalesced(decided(many, [("h", "r", 1, 1, 2)]).where("false"), 10).count() == 0
    rows = [("h", "r", i // 400, i, 2) for i in range(2000)]
    got = {r.id: (r.fate, r.n, r["rank"], r.alert) for r in ev.coalesced(decided(many, rows), 2).collect()}
    assert got == loop(rows, 2, 2, None)


def test_restatements_of_a_busy_key(many):
    rng = random.Random(8)
    rows = [("h", "r", rng.randrange(5000), i, rng.choice((1, 2, 4))) for i in range(900)]
    for flush in (None, 450):
        fates = ev.coalesced(decided(many, rows), 300, flush_us=flush)
        emitted = {r.id: r.n for r in fates.where("fate = 'emit'").collect()}
        again = {r.alert: r.n for r in ev.restated(fates, flush).collect()}
        below = fates.where("fate = 'below_floor'").count()
        if flush is None:
            last = max(emitted, key=lambda i: next(r[2:4] for r in rows if r[3] == i))
            assert sum(emitted.values()) + sum(n - emitted[i] for i, n in again.items()) == 900 and set(again) <= {last} and below >= 0


def test_restatements_cost_by_alert_not_by_row(many):
    """Against a loop, null rules too; nothing looks ahead from every row to the end of its key."""
    rng = random.Random(11)
    rows = [("h", rng.choice(("r", "s", None)), rng.randrange(3000), i, rng.choice((1, 2, 4))) for i in range(600)]
    for flush in (None, 170):
        told = sorted(((*r, *loop(rows, 300, 2, flush)[r[3]]) for r in rows), key=lambda r: (r[2], r[3]))
        want = {}
        for k, (h, r, us, _, _, fate, n, rank, alert) in enumerate(told):
            then = next((x[2] for x in told[k + 1 :] if x[:2] == (h, r) and x[5] == "emit"), None)
            if alert is not None:
                flushed = then is None or bool(flush) and us // flush < then // flush
                total, folded, worst = want.get((h, r, alert), (0, 0, -1))
                want[h, r, alert] = (total + n, folded + (fate == "fold" and flushed), max(worst, rank) if fate == "emit" or flushed else worst)
        table = many.createDataFrame([(h, r, us, i, fate, n, rank, alert) for h, r, us, i, _, fate, n, rank, alert in told], ev.FATES)
        got = ev.restated(table, flush)
        assert {(x.host, x.rule, x.alert): (x.n, x["rank"]) for x in got.collect()} == {k: (n + folded, rank) for k, (n, folded, rank) in want.items() if folded}
    assert "unboundedfollowing" not in got._jdf.queryExecution().executedPlan().toString().lower().replace("$", "")
