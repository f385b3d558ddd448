"""Greedy folds against a loop, over batches, refusals, free and odd costs."""

import random

import numpy as np
import pytest

from telarium.operators import algebra


def loop(costs, limit):
    spent, out = 0.0, []
    for c in costs:
        ok = spent + c <= limit
        out.append(ok)
        spent = spent + c if ok else spent
    return out, spent


@pytest.mark.parametrize("seed", range(12))
def test_charged_equals_a_loop(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n = rng.randrange(0, 400)
        costs = np.array([rng.choice((rng.random(), 0.1, 5 * rng.random(), 1e-9)) for _ in range(n)])
        limit = rng.choice((0.0, 1.0, 7.3, 1e9, float(costs.sum())))
        taken, spent = algebra.charged(costs, 0.0, limit)
        assert (taken.tolist(), spent) == loop(costs.tolist(), limit)
        left = limit
        want = []
        for c in costs.tolist():
            want.append(c <= left)
            left -= c if c <= left else 0.0
        taken, rest = algebra.charged(costs, limit, 0.0, np.subtract)
        assert taken.tolist() == want and rest == left


def test_one_queue_over_many_batches(spark):
    rng = random.Random(3)
    rows = [(rng.choice(("q", "q", "r", None)), i, rng.random() * 10, rng.choice((0.0, -1.0, None, rng.random(), 3 * rng.random()))) for i in range(6000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "257")
    try:
        got = {r.id: r.taken for r in algebra.triage(spark.createDataFrame(rows, "queue string, id long, utility double, cost double"), 120.0).collect()}
        eps = {r.id: r.taken for r in algebra.privacy_budget(spark.createDataFrame([(q, i, i // 2, c) for q, i, _, c in rows], "analyst string, id long, us long, eps double"), 40.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for name in ("q", "r", None):
        mine = [r for r in rows if r[0] == name]
        left = 120.0
        ratio = lambda r: float("inf") if r[3] is not None and r[3] <= 0 else r[2] / r[3] if r[3] is not None else -1.0
        for _, i, _, c in sorted(mine, key=lambda r: (-ratio(r), r[1])):
            ok = c is not None and (c <= 0 or c <= left)
            assert got[i] == ok, i
            left -= c if ok and c > 0 else 0.0
        spent = 0.0
        for _, i, _, c in mine:
            ok = c is not None and c > 0 and spent + c <= 40.0 + 1e-12
            assert eps[i] == ok, i
            spent += c if ok else 0.0
    assert 100 < sum(got.values()) < 6000 and 20 < sum(eps.values()) < 3000


def test_more_incidents_are_more_tasks(spark, monkeypatch):
    from telarium.operators import algebra as al

    rows = [(i, j, float((i * 7 + j * 3) % 11), (i + j) % 3 != 0) for i in range(60) for j in range(6)]
    steps = spark.createDataFrame(rows, "incident long, step int, seconds double, parallel boolean")
    plain = {tuple(r) for r in al.mttr(steps).collect()}
    monkeypatch.setattr(al, "ROWS_A_TASK", 20)
    cut = al.mttr(steps)
    assert {tuple(r) for r in cut.collect()} == plain and len(plain) == 60
    assert cut.rdd.getNumPartitions() == 18
