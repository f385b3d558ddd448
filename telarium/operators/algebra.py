"""Small numeric operators as table operators: windows, aggregates, folds."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telarium.checkpoint import cut, folder
from telarium.functions.scalars import entropy


def coarsen(series: DataFrame, level: int) -> DataFrame:
    size = 1 << min(level, 20)
    return series.groupBy("series", F.floor(F.col("pos") / size).alias("pos")).agg(F.avg("value").alias("value"))


def fuse(values: DataFrame) -> DataFrame:
    """Weighted mean by series; negative and missing weights are 0; all zero: plain mean."""
    w = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    rows = values.groupBy("series").agg(F.sum(w).alias("w"), F.sum(F.col("value") * w).alias("wv"), F.avg("value").alias("plain"))
    return rows.select("series", F.when(F.col("w") > 0, F.col("wv") / F.col("w")).otherwise(F.col("plain")).alias("value"))


def refinement_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("series", "pos", F.col("value").alias("x")).join(b.select("series", "pos", F.col("value").alias("y")), ["series", "pos"])
    return both.groupBy("series").agg(F.sum(F.abs(F.col("x") - F.col("y"))).alias("delta"))


def information_set(rows: DataFrame) -> DataFrame:
    """Positive weights, normalised in each case, with the best marked (first wins ties)."""
    good = rows.where("weight > 0 AND NOT isnan(weight) AND weight < double('Infinity')")
    w = Window.partitionBy("case")
    best = F.row_number().over(w.orderBy(F.desc("weight"), "ord")) == 1
    return good.withColumn("share", F.col("weight") / F.sum("weight").over(w)).withColumn("best", best)


def refined(rows: DataFrame, keep: Column) -> DataFrame:
    """An information set without the hypotheses that ``keep`` rules out, normalised anew."""
    return information_set(rows.where(keep))


def uncertainty_split(rows: DataFrame, group: str, p: str) -> DataFrame:
    out = rows.groupBy(group).agg(entropy(F.avg(p)).alias("total"), F.avg(entropy(F.col(p))).alias("aleatoric"))
    return out.withColumn("epistemic", F.greatest(F.col("total") - F.col("aleatoric"), F.lit(0.0)))


def load_factor(used: Column, budget: Column) -> Column:
    return F.when(budget <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), used / budget)))


def overload(rate: Column, capacity: Column) -> Column:
    """Offered load over capacity; at no capacity 0 without load, else infinite."""
    return F.when(capacity > 0, rate / capacity).when(rate <= 0, 0.0).otherwise(float("inf"))


def noisy_counts(counts: DataFrame, epsilon: float, sensitivity: float = 1.0) -> DataFrame:
    """Laplace noise by inverse CDF on the column ``u`` in (0, 1)."""
    scale = sensitivity / max(epsilon, 1e-9)
    x = F.col("u") - 0.5
    noise = -F.lit(scale) * F.signum(x) * F.log(F.greatest(1 - 2 * F.abs(x), F.lit(1e-300)))
    return counts.withColumn("noisy", F.col("n") + noise).withColumn("utility_loss", F.lit(2 * scale * scale))


def decoy_yield(decoys: DataFrame) -> DataFrame:
    fidelity = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("fidelity")))
    value = fidelity * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("trip_rate")))
    return decoys.groupBy("site").agg(F.sum(value).alias("yield"), F.max_by("decoy", F.struct(value, -F.col("decoy"))).alias("best"))


def residual_risk(gaps: DataFrame, controls: DataFrame) -> DataFrame:
    """What is left of each gap's severity after its best control (the least id among equals); no control leaves all."""
    covered = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("coverage")))
    best = controls.groupBy("gap").agg(F.max(F.struct(covered.alias("coverage"), (-F.col("control")).alias("minus"))).alias("best"))
    rows = gaps.join(best, "gap", "left")
    severity = F.greatest(F.col("severity"), F.lit(0.0))
    return rows.select("gap", (-F.col("best.minus")).alias("control"), (severity * (1 - F.coalesce("best.coverage", F.lit(0.0)))).alias("residual"))


#: Rows of a task that sorts and sums whole incidents.
ROWS_A_TASK = 500_000


def mttr(steps: DataFrame) -> DataFrame:
    """Serial steps add; each run of parallel steps costs its longest.

    A run is named by the serial steps before it, which repeated rows can't tell apart.
    More rows are more tasks, not larger ones.
    """
    parts = -(-steps.count() // ROWS_A_TASK)
    if parts > int(steps.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        steps = steps.repartition(parts, "incident")
    in_order = Window.partitionBy("incident").orderBy("step", "parallel", "seconds")
    before = F.count_if(~F.col("parallel")).over(in_order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    runs = steps.withColumn("island", F.when(F.col("parallel"), before).otherwise(F.row_number().over(in_order)))
    cost = runs.groupBy("incident", "parallel", "island").agg(F.max("seconds").alias("most"), F.sum("seconds").alias("total"))
    return cost.groupBy("incident").agg(F.sum("most").alias("mttr"), F.sum("total").alias("serial"))


def availability(mttf: Column, mttr: Column) -> Column:
    """Share of time up; negative times count as 0, and what never fails nor mends is up."""
    up, down = F.greatest(mttf, F.lit(0.0)), F.greatest(mttr, F.lit(0.0))
    return F.when(up + down > 0, up / (up + down)).otherwise(1.0)


def resilience(rows: DataFrame) -> DataFrame:
    """``rows`` (detection, containment, recovery, clamped) with their product and the weakest of
    them; of equals, the one that comes first."""
    stages = ("detection", "containment", "recovery")
    rows = rows.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c))) for c in stages})
    d, c, r = map(F.col, stages)
    return rows.withColumn("score", d * c * r).withColumn("weakest", F.when((d <= c) & (d <= r), "detection").when(c <= r, "containment").otherwise("recovery"))


def expected_loss(p: Column, false_alarm: Column, miss: Column, acted: Column) -> Column:
    return F.when(acted, false_alarm * (1 - p)).otherwise(miss * p)


def regret(p: Column, false_alarm: Column, miss: Column, acted: Column) -> Column:
    """Loss of what was done over that of the better choice."""
    best = F.least(false_alarm * (1 - p), miss * p)
    return F.greatest(F.lit(0.0), expected_loss(p, false_alarm, miss, acted) - best)


def minimax_acts(false_alarm: Column, miss: Column) -> Column:
    """Whether acting has the smaller worst case, whatever the evidence."""
    return false_alarm <= miss


def robust_threshold(false_alarm: Column, miss: Column, doubt: Column) -> Column:
    """Threshold with the cost of false alarms raised and that of misses lowered by ``doubt`` (0 to below 1)."""
    u = F.greatest(F.lit(0.0), F.least(F.lit(1 - 2.0**-52), doubt))
    high, low = false_alarm * (1 + u), miss * (1 - u)
    return F.when(high + low > 0, high / (high + low)).otherwise(0.0)


def trust(value: Column) -> Column:
    """Clamped to 0..1; unknown (null) and NaN are 0.5."""
    return F.when(value.isNull() | F.isnan(value), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def propagated(origin: Column, decay: Column, hops: Column) -> Column:
    return trust(trust(origin) * F.pow(F.greatest(F.lit(0.0), F.least(F.lit(1.0), decay)), hops))


def degraded(sources: DataFrame, incidents: DataFrame) -> DataFrame:
    """``sources`` (source, trust) with trust cut by the factor of every incident (source, factor)."""
    factor = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("factor")))
    cut_by = incidents.groupBy("source").agg(F.count_if(factor == 0).alias("zeros"), F.sum(F.when(factor > 0, F.log(factor))).alias("logs"))
    rows = sources.join(cut_by, "source", "left")
    left = F.when(F.col("zeros") > 0, 0.0).otherwise(F.exp(F.coalesce("logs", F.lit(0.0))))
    return rows.select("source", (trust(F.col("trust")) * left).alias("trust"))


def trust_weighted(findings: DataFrame, known: DataFrame, ratio: str = "ratio") -> DataFrame:
    """log-ratio times the trust of its source (absent or NaN: 0.5), clamped to 0..1, and times
    ``similarity`` (clamped too), if there is such a column, for rules taken from elsewhere."""
    similar = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity"))) if "similarity" in findings.columns else F.lit(1.0)
    return findings.join(known, "source", "left").withColumn("weighted", F.col(ratio) * trust(F.col("trust")) * similar)


def happens_before(a: Column, b: Column) -> Column:
    """Vector clocks as maps: componentwise <=, and different."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.forall(keys, lambda k: at(a, k) <= at(b, k)) & F.exists(keys, lambda k: at(a, k) < at(b, k))


def concurrent(a: Column, b: Column) -> Column:
    """Neither clock is componentwise at most the other."""
    at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    keys = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.exists(keys, lambda k: at(a, k) < at(b, k)) & F.exists(keys, lambda k: at(a, k) > at(b, k))


def clock_merge(clocks: DataFrame, group: str, clock: str) -> DataFrame:
    each = clocks.select(group, F.explode(clock).alias("actor", "n")).groupBy(group, "actor").agg(F.max("n").alias("n"))
    return each.groupBy(group).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("actor", "n")))).alias(clock))


def trace_actions(trace: DataFrame) -> DataFrame:
    """The actions of each actor in order, one row each; no actor's trace is held at once."""
    place = F.row_number().over(Window.partitionBy("actor").orderBy("us", "id"))
    return trace.select("actor", place.alias("place"), "action")


def _steps(pattern: tuple) -> list[tuple]:
    """A pattern as numbered states with moves (state, action or None for any, next); empty moves are ("", ...)."""
    moves: list[tuple] = []
    count = iter(range(1 << 30))

    def build(p: tuple) -> tuple[int, int]:
        a, b = next(count), next(count)
        kind, *inner = p
        if kind == "atom":
            moves.append((a, inner[0], b))
        elif kind == "any":
            moves.append((a, None, b))
        elif kind == "seq":
            at = a
            for x in inner:
                start, end = build(x)
                moves.append((at, "", start))
                at = end
            moves.append((at, "", b))
        elif kind == "alt":
            for x in inner:
                start, end = build(x)
                moves.extend(((a, "", start), (end, "", b)))
        else:  # star
            start, end = build(inner[0])
            moves.extend(((a, "", b), (a, "", start), (end, "", start), (end, "", b)))
        return a, b

    start, end = build(pattern)
    return [("start", start), ("end", end), *moves]


class Matcher:
    """A pattern over actions, step by step: ("atom", x), ("any",), ("seq", ...), ("alt", ...), ("star", p)."""

    def __init__(self, pattern: tuple):
        (_, start), (_, self.end), *self.moves = _steps(pattern)
        self.start = self._closed({start})
        self.known: dict[tuple, frozenset] = {}

    def _closed(self, states: set[int]) -> frozenset:
        todo, out = list(states), set(states)
        while todo:
            at = todo.pop()
            for a, action, b in self.moves:
                if a == at and action == "" and b not in out:
                    out.add(b)
                    todo.append(b)
        return frozenset(out)

    def step(self, states: frozenset, action: str) -> frozenset:
        if (states, action) not in self.known:
            self.known[states, action] = self._closed({b for a, x, b in self.moves if a in states and x != "" and x in (None, action)})
        return self.known[states, action]


def matching_traces(trace: DataFrame, pattern: tuple) -> DataFrame:
    """(actor, matches): whether the pattern matches an actor's whole trace.

    Rows are dealt by actor and sorted by Spark; the matcher keeps a set of
    states, whatever the length of a trace.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(pattern)
        key, states, begun = None, matcher.start, False
        for batch in batches:
            actors, found = [], []
            for actor, action in zip(batch.column("actor").to_pylist(), batch.column("action").to_pylist(), strict=True):
                if not begun or actor != key:
                    if begun:
                        actors.append(key)
                        found.append(matcher.end in states)
                    key, states, begun = actor, matcher.start, True
                states = matcher.step(states, action)
            yield pa.RecordBatch.from_arrays([pa.array(actors, batch.schema.field("actor").type), pa.array(found, pa.bool_())], names=["actor", "matches"])
            kind = batch.schema.field("actor").type
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([matcher.end in states])], names=["actor", "matches"])

    kind = trace.schema["actor"].dataType.simpleString()
    return trace.select("actor", "us", "id", "action").repartition("actor").sortWithinPartitions("actor", "us", "id").mapInArrow(walk, f"actor {kind}, matches boolean")


def causal_links(trace: DataFrame, horizon_us: int) -> DataFrame:
    """Directed links (a before b, at most ``horizon_us``): same actor, or a's target is b's actor.

    Both sides meet in stretches of time as long as the horizon, an earlier row
    in its own and in the next one, so the rows of a busy actor are split by
    time and a task holds two horizons of an actor at most. A pair meets once,
    so nothing has to be made distinct.
    """
    span = F.floor(F.col("us") / (horizon_us + 1))
    b = trace.select(F.col("actor").alias("b_actor"), F.col("us").alias("b_us"), F.col("id").alias("b_id"), span.alias("b_span"))
    a = trace.select("actor", "target", F.col("us").alias("a_us"), F.col("id").alias("a_id"), F.explode(F.array(span, span + 1)).alias("a_span"))
    # once under its actor and once under its target, unless they are one
    a = a.withColumn("key", F.explode(F.array_distinct(F.array("actor", "target")))).where("key IS NOT NULL")
    later = (F.struct("a_us", "a_id") < F.struct("b_us", "b_id")) & (F.col("b_us") - F.col("a_us") <= horizon_us)
    return a.join(b, (F.col("key") == F.col("b_actor")) & (F.col("a_span") == F.col("b_span")) & later).select("a_id", "b_id")


def charged(costs: np.ndarray, spent: float, limit: float, step: Callable = np.add) -> tuple[np.ndarray, float]:
    """Which of the costs are taken in order, each if what is spent with it is within the limit; and what is spent.

    Runs of costs that fit are found by one accumulation each (the same
    additions in the same order as one by one), and from a refused cost on the
    next that fits is looked for in stretches that double.
    """
    taken, at, stretch = np.zeros(len(costs), bool), 0, 64
    while at < len(costs):
        sums = step.accumulate(np.concatenate(([spent], costs[at : at + stretch])))
        over = np.flatnonzero(sums[1:] > limit) if step is np.add else np.flatnonzero(sums[1:] < limit)
        n = int(over[0]) if len(over) else len(sums) - 1
        taken[at : at + n], spent = True, float(sums[n])
        at, stretch = at + n, 2 * stretch if not len(over) else 64
        look = 64
        while len(over) and at < len(costs):  # stands at a cost that doesn't fit
            rest = step(spent, costs[at : at + look])
            fits = np.flatnonzero(rest <= limit) if step is np.add else np.flatnonzero(rest >= limit)
            if len(fits):
                at += int(fits[0])
                break
            at, look = at + look, 2 * look
    return taken, spent


def _folded(rows: DataFrame, group: str, order: list, cost: Column, start: float, limit: float, step: Callable) -> DataFrame:
    """``rows`` with ``taken``, by ``charged`` over each group in order; a null cost is always taken, NaN never.

    Rows are dealt by group and sorted by Spark; the fold holds one number.
    """
    rows = rows.withColumn("cost__", cost)
    columns = [c for c in rows.columns if c != "cost__"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, start
        for batch in batches:
            if not len(batch):
                continue
            keys = batch.column(group).dictionary_encode(null_encoding="encode")
            code, costs = keys.indices.to_numpy(zero_copy_only=False), batch.column("cost__")
            free, costs = np.asarray(costs.is_null()), costs.to_numpy(zero_copy_only=False).astype(float)
            out = free.copy()
            heads = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(code)], strict=True):
                mine = keys.dictionary[int(code[a])]
                if key is None or not mine.equals(key):
                    key, state = mine, start
                paid = np.flatnonzero(~free[a:b] & ~np.isnan(costs[a:b])) + a
                out[paid], state = charged(costs[paid], state, limit, step)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(out)], names=[*columns, "taken"])

    schema = T.StructType([*(rows.schema[c] for c in columns), T.StructField("taken", T.BooleanType())])
    return rows.repartition(group).sortWithinPartitions(group, *order).mapInArrow(fold, schema)


def triage(rows: DataFrame, budget: float) -> DataFrame:
    """Greedy by utility per cost; free items are always taken; what does not fit is skipped."""
    free = F.col("cost") <= 0
    ratio = F.when(free, F.lit(float("inf"))).otherwise(F.col("utility") / F.col("cost"))
    cost = F.when(free, None).otherwise(F.coalesce(F.col("cost").cast("double"), F.lit(float("nan"))))
    return _folded(rows.withColumn("ratio", ratio), "queue", [F.desc("ratio"), "id"], cost, budget, 0.0, np.subtract)


def privacy_budget(rows: DataFrame, budget: float) -> DataFrame:
    """Charges ``eps`` in order (us, id), or refuses; a refusal spends nothing."""
    eps = F.when(F.col("eps") > 0, F.col("eps").cast("double")).otherwise(F.lit(float("nan")))
    return _folded(rows, "analyst", ["us", "id"], eps, 0.0, budget + 1e-12, np.add)


def reachable(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node): reflexive-transitive, cycle-safe, whatever the length of a path.

    A frontier join per step; each frontier is written once in the shared
    folder and read back, and nothing that was reached before is written again.
    """
    spark = edges.sparkSession
    at = f"{folder(spark)}/reach-{uuid.uuid4().hex}"
    edges = cut(edges.select(F.col("src").alias("e_src"), F.col("dst").alias("e_dst")).distinct())
    sources.select(F.col("node").alias("src"), "node").distinct().write.parquet(f"{at}/step=0")
    schema, step = spark.read.parquet(f"{at}/step=0").schema, 0
    while not (frontier := spark.read.schema(schema).parquet(f"{at}/step={step}")).isEmpty():
        visited = spark.read.schema(schema).parquet(*(f"{at}/step={i}" for i in range(step + 1)))
        reached = frontier.join(edges, frontier["node"] == edges["e_src"]).select("src", F.col("e_dst").alias("node")).distinct()
        step += 1
        reached.join(visited, ["src", "node"], "left_anti").write.parquet(f"{at}/step={step}")
    return spark.read.schema(schema).parquet(*(f"{at}/step={i}" for i in range(step + 1)))
