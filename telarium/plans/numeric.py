"""Queries of the algebra: series, sets, folds, graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.functions import scalars as sc
from telarium.functions import dynamic as dy
from telarium.operators import algebra as al
from telarium.operators import facts, prefixes, reports
from telarium.plans.register import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SERIES = "s AS (SELECT o_orderpriority AS series, CAST(datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS pos, sum(o_totalprice) AS value, avg(o_custkey % 7 - 1.0) AS weight FROM orders GROUP BY ALL)"


def _series(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series"), F.datediff(F.to_date("o_orderdate"), F.to_date(F.lit("1990-01-01"))).cast("bigint").alias("pos"), "o_totalprice", "o_custkey")
    return rows.groupBy("series", "pos").agg(F.sum("o_totalprice").alias("value"), F.avg(F.col("o_custkey") % 7 - 1.0).alias("weight"))


@R.query(f"WITH {_SERIES} SELECT series, pos // 8 AS pos, round(avg(value), 6) AS value FROM s GROUP BY series, pos // 8")
def coarsen(spark, sf_dir):
    return al.coarsen(_series(spark, sf_dir), 3).select("series", "pos", F.round("value", 6).alias("value"))


@R.query(f"WITH {_SERIES} SELECT series, round(CASE WHEN sum(greatest(weight, 0)) > 0 THEN sum(value * greatest(weight, 0)) / sum(greatest(weight, 0)) ELSE avg(value) END, 3) AS value FROM s GROUP BY series")
def fuse(spark, sf_dir):
    return al.fuse(_series(spark, sf_dir)).select("series", F.round("value", 3).alias("value"))


@R.query(f"WITH {_SERIES}, b AS (SELECT series, pos + 1 AS pos, value FROM s) SELECT s.series, round(sum(abs(s.value - b.value)), 2) AS delta FROM s JOIN b ON s.series = b.series AND s.pos = b.pos GROUP BY s.series")
def refinement_delta(spark, sf_dir):
    a = _series(spark, sf_dir)
    return al.refinement_delta(a, a.withColumn("pos", F.col("pos") + 1)).select("series", F.round("delta", 2).alias("delta"))


@R.query("WITH h AS (SELECT c_nationkey AS c, c_mktsegment AS hypothesis, sum(c_acctbal) - 5000 AS weight FROM customer GROUP BY ALL), g AS (SELECT * FROM h WHERE weight > 0) SELECT c, hypothesis, round(weight / sum(weight) OVER (PARTITION BY c), 6) AS share, row_number() OVER (PARTITION BY c ORDER BY weight DESC, hypothesis) = 1 AS best FROM g")
def information_set(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("case"), F.col("c_mktsegment").alias("ord")).agg((F.sum("c_acctbal") - 5000).alias("weight"))
    return al.information_set(rows).select(F.col("case").alias("c"), F.col("ord").alias("hypothesis"), F.round("share", 6).alias("share"), "best")


_H = "CASE WHEN {p} > 0 AND {p} < 1 THEN -({p}) * log2({p}) - (1 - ({p})) * log2(1 - ({p})) ELSE 0 END"


@R.query(f"WITH p AS (SELECT l_suppkey AS g, l_discount * 5 AS p FROM lineitem), a AS (SELECT g, avg(p) AS m, avg({_H.format(p='(p)')}) AS al FROM p GROUP BY g) SELECT g, round({_H.format(p='m')}, 6) AS total, round(al, 6) AS aleatoric, round(greatest({_H.format(p='m')} - al, 0), 6) AS epistemic FROM a")
def uncertainty_split(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("g"), (F.col("l_discount") * 5).alias("p"))
    return al.uncertainty_split(rows, "g", "p").select("g", *(F.round(c, 6).alias(c) for c in ("total", "aleatoric", "epistemic")))


@R.query("WITH d AS (SELECT p_brand AS brand, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY days) AS rn, count(*) OVER (PARTITION BY brand) AS n FROM d) SELECT brand, CAST(days AS INTEGER) AS value FROM r WHERE rn = floor((n - 1) * 0.9 + 0.5) + 1")
def nearest_rank(spark, sf_dir):
    return reports.nearest_rank(_latency(spark, sf_dir), "brand", "days", 0.9)


def _latency(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate").join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.select(F.col("p_brand").alias("brand"), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("days"))


@R.query("WITH d AS (SELECT p_brand AS brand, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY brand ORDER BY days) AS rn, count(*) OVER (PARTITION BY brand) AS n FROM d) SELECT brand, round(avg(days), 6) AS mean_days, CAST(max(days) FILTER (rn = floor((n - 1) * 0.9 + 0.5) + 1) AS INTEGER) AS percentile, round(greatest(0, avg(days) - 15), 6) AS exposure FROM r GROUP BY brand")
def patch_latency(spark, sf_dir):
    rows = reports.patch_latency(_latency(spark, sf_dir), "brand", "days", 15)
    return rows.select("brand", F.round("mean_days", 6).alias("mean_days"), "percentile", F.round("exposure", 6).alias("exposure"))


@R.query("WITH s AS (SELECT l_orderkey AS incident, l_linenumber AS step, l_quantity * 60 AS seconds, l_returnflag = 'N' AS parallel FROM lineitem), i AS (SELECT *, row_number() OVER (PARTITION BY incident ORDER BY step, parallel, seconds) AS rn, count(*) FILTER (NOT parallel) OVER (PARTITION BY incident ORDER BY step, parallel, seconds) AS before FROM s), c AS (SELECT incident, parallel, CASE WHEN parallel THEN before ELSE rn END AS isl, max(seconds) AS most, sum(seconds) AS total FROM i GROUP BY ALL) SELECT incident, round(sum(most), 3) AS mttr, round(sum(total), 3) AS serial, round(86400 / (86400 + sum(most)), 6) AS availability FROM c GROUP BY incident")
def mttr(spark, sf_dir):
    steps = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("incident"), F.col("l_linenumber").alias("step"), (F.col("l_quantity") * 60).alias("seconds"), (F.col("l_returnflag") == "N").alias("parallel"))
    return al.mttr(steps).select("incident", F.round("mttr", 3).alias("mttr"), F.round("serial", 3).alias("serial"), F.round(al.availability(F.lit(86400.0), F.col("mttr")), 6).alias("availability"))


@R.query("WITH s AS (SELECT s_nationkey AS site, avg(s_acctbal) / 5000 AS d, 0.5 + s_nationkey / 40.0 AS c, count(*) / 40.0 AS r FROM supplier GROUP BY s_nationkey), k AS (SELECT site, greatest(0, least(1, d)) AS d, greatest(0, least(1, c)) AS c, greatest(0, least(1, r)) AS r FROM s) SELECT site, round(d * c * r, 6) AS score, CASE WHEN d <= c AND d <= r THEN 'detection' WHEN c <= r THEN 'containment' ELSE 'recovery' END AS weakest FROM k")
def resilience(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("site")).agg((F.avg("s_acctbal") / 5000).cast("double").alias("detection"), (F.count("*") / 40.0).alias("recovery")).withColumn("containment", 0.5 + F.col("site") / 40.0)
    return al.resilience(rows).select("site", F.round("score", 6).alias("score"), "weakest")


@R.query("WITH d AS (SELECT p_brand AS site, p_partkey AS decoy, least(1, p_size / 50.0) AS f, (p_partkey % 10) / 10.0 AS t FROM part) SELECT site, round(sum(f * t), 6) AS yield, arg_max(decoy, (f * t, -decoy)) AS best FROM d GROUP BY site")
def decoy_yield(spark, sf_dir):
    rows = _t(spark, sf_dir, "part").select(F.col("p_brand").alias("site"), F.col("p_partkey").alias("decoy"), (F.col("p_size") / 50.0).alias("fidelity"), ((F.col("p_partkey") % 10) / 10.0).alias("trip_rate"))
    return al.decoy_yield(rows).select("site", F.round("yield", 6).alias("yield"), "best")


@R.query("WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY event_type), u AS (SELECT *, (length(event_type) * 7 % 10 + 0.5) / 11 - 0.5 AS x FROM c) SELECT event_type, round(n - 2.0 * sign(x) * ln(greatest(1 - 2 * abs(x), 1e-300)), 6) AS noisy, CAST(8.0 AS DOUBLE) AS utility_loss FROM u")
def noisy_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).withColumn("u", (F.length("event_type") * 7 % 10 + 0.5) / 11)
    return al.noisy_counts(rows, 0.5).select("event_type", F.round("noisy", 6).alias("noisy"), "utility_loss")


@R.query("SELECT o_custkey % 10 AS queue, round(least(1, greatest(0, sum(o_orderkey % 7) / 2000.0)), 6) AS utilisation FROM orders GROUP BY 1")
def load_factor(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").groupBy((F.col("o_custkey") % 10).alias("queue")).agg(F.sum(F.col("o_orderkey") % 7).alias("used"))
    return rows.select("queue", F.round(al.load_factor(F.col("used"), F.lit(2000.0)), 6).alias("utilisation"))


@R.query("""WITH RECURSIVE r AS (SELECT o_custkey % 10 AS queue, o_orderkey AS id, o_orderkey % 7 AS cost, row_number() OVER (PARTITION BY o_custkey % 10 ORDER BY CASE WHEN o_orderkey % 7 <= 0 THEN 1e308 ELSE o_totalprice / (o_orderkey % 7) END DESC, o_orderkey) AS rn FROM orders),
f AS (SELECT queue, id, rn, CASE WHEN cost <= 0 THEN true ELSE cost <= 500 END AS taken, 500.0 - CASE WHEN cost > 0 AND cost <= 500 THEN cost ELSE 0 END AS budget FROM r WHERE rn = 1
  UNION ALL SELECT r.queue, r.id, r.rn, r.cost <= 0 OR r.cost <= f.budget, f.budget - CASE WHEN r.cost > 0 AND r.cost <= f.budget THEN r.cost ELSE 0 END FROM f JOIN r ON r.queue = f.queue AND r.rn = f.rn + 1)
SELECT queue, id, taken FROM f""")
def triage_select(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select((F.col("o_custkey") % 10).alias("queue"), F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("utility"), (F.col("o_orderkey") % 7).cast("double").alias("cost"))
    return al.triage(rows, 500.0).select("queue", "id", "taken")


@R.query("""WITH RECURSIVE r AS (SELECT user_id AS analyst, event_id AS id, coalesce(value, 0) / 100 AS eps, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT analyst, id, rn, eps > 0 AND eps <= 20.0 + 1e-12 AS taken, CASE WHEN eps > 0 AND eps <= 20.0 + 1e-12 THEN eps ELSE 0.0 END AS spent FROM r WHERE rn = 1
  UNION ALL SELECT r.analyst, r.id, r.rn, r.eps > 0 AND f.spent + r.eps <= 20.0 + 1e-12, CASE WHEN r.eps > 0 AND f.spent + r.eps <= 20.0 + 1e-12 THEN f.spent + r.eps ELSE f.spent END FROM f JOIN r ON r.analyst = f.analyst AND r.rn = f.rn + 1)
SELECT analyst, id, taken FROM f""")
def privacy_budget(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").selectExpr("user_id AS analyst", "event_id AS id", "coalesce(value, 0) / 100 AS eps", "unix_micros(cast(ts AS timestamp)) AS us")
    return al.privacy_budget(rows, 20.0).select("analyst", "id", "taken")


_EDGES = "e AS (SELECT l_suppkey AS src, 100000 + l_partkey AS dst, 'supplies' AS label, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS seq FROM lineitem)"


def _edges(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 100000).alias("dst"), F.lit("supplies").alias("label"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("seq"))
    return rows


@R.query(f"WITH {_EDGES}, n AS (SELECT node, min(seq) AS first FROM (SELECT src AS node, seq FROM e UNION ALL SELECT dst, seq FROM e) GROUP BY node), k AS (SELECT e.*, min(seq) OVER (PARTITION BY src, dst) AS fe FROM e) SELECT CAST(score AS DOUBLE) AS score, count(*) AS n FROM (SELECT CASE WHEN fe < k.seq THEN 0.0 WHEN a.first < k.seq AND b.first < k.seq THEN 0.5 ELSE 1.0 END AS score FROM k JOIN n a ON a.node = src JOIN n b ON b.node = dst) GROUP BY score")
def edge_novelty(spark, sf_dir):
    return facts.edge_novelty(_edges(spark, sf_dir)).groupBy("score").agg(F.count("*").alias("n"))


@R.query(f"WITH {_EDGES} SELECT src, count(*) AS degree, round(count(*) / (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY src)), 6) AS fanout FROM e GROUP BY src")
def fanout_ratio(spark, sf_dir):
    return reports.fanout_ratio(_edges(spark, sf_dir)).select("src", "degree", F.round("fanout", 6).alias("fanout"))


@R.query("WITH e AS (SELECT c_custkey AS src, c_custkey * 7 % 200 AS dst FROM customer) SELECT DISTINCT src AS node FROM e WHERE src NOT IN (SELECT dst FROM e)")
def isolated_nodes(spark, sf_dir):
    """Nodes that no edge leads to."""
    edges = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("src"), (F.col("c_custkey") * 7 % 200).alias("dst"))
    return reports.unobserved(edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node")), "node")


@R.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5)")
def known_edges(spark, sf_dir):
    known = _t(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("l_suppkey"))
    return _t(spark, sf_dir, "lineitem").join(known, "l_suppkey", "left_semi").select("l_orderkey", "l_linenumber")


_GRAPH = """g AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || c_custkey, 'c' || (c_custkey % 25) FROM customer),
rc AS (SELECT 'n' || n_nationkey AS src, 'n' || n_nationkey AS node FROM nation UNION SELECT rc.src, g.dst FROM rc JOIN g ON rc.node = g.src)"""


def _graph(spark, sf_dir):
    n, c = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "customer")
    edges = n.selectExpr("concat('r', n_regionkey) AS src", "concat('n', n_nationkey) AS dst").unionAll(c.selectExpr("concat('n', c_nationkey)", "concat('c', c_custkey)")).unionAll(c.selectExpr("concat('c', c_custkey)", "concat('c', c_custkey % 25)"))
    return al.reachable(edges, n.selectExpr("concat('n', n_nationkey) AS node"))


@R.query(f"WITH RECURSIVE {_GRAPH} SELECT src, node FROM rc")
def reachable(spark, sf_dir):
    return _graph(spark, sf_dir)


@R.query(f"WITH RECURSIVE {_GRAPH} SELECT src, count(*) AS size FROM rc GROUP BY src")
def blast_radius(spark, sf_dir):
    return _graph(spark, sf_dir).groupBy("src").agg(F.count("*").alias("size"))


_TRUST = "CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_nationkey / 20.0 END"


@R.query(f"SELECT s_suppkey, round(2.5 * CASE WHEN t IS NULL THEN 0.5 ELSE least(1, t) END * least(1, greatest(0, s_suppkey % 7 / 5.0 - 0.2)), 6) AS weighted FROM supplier LEFT JOIN (SELECT n_nationkey AS k, {_TRUST} AS t FROM nation WHERE n_nationkey % 7 <> 3) ON s_nationkey = k")
def trust_weighted(spark, sf_dir):
    trust = _t(spark, sf_dir, "nation").where("n_nationkey % 7 <> 3").selectExpr("n_nationkey AS source", f"cast({_TRUST} AS double) AS trust")
    rows = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("source"), F.lit(2.5).alias("ratio"), (F.col("s_suppkey") % 7 / 5.0 - 0.2).alias("similarity"))
    return al.trust_weighted(rows, trust).select("s_suppkey", F.round("weighted", 6).alias("weighted"))


@R.query("SELECT s_suppkey, round(n_nationkey / 25.0 * power(0.8, s_suppkey % 5), 6) AS trust, round(least(n_nationkey / 25.0, 0.5), 6) AS meet, round(greatest(n_nationkey / 25.0, 0.5), 6) AS join_ FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def trust_propagate(spark, sf_dir):
    rows = _t(spark, sf_dir, "supplier").join(_t(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    origin = F.col("n_nationkey") / 25.0
    both = (al.trust(origin), al.trust(F.lit(None).cast("double")))
    return rows.select("s_suppkey", F.round(al.propagated(origin, F.lit(0.8), F.col("s_suppkey") % 5), 6).alias("trust"), F.round(F.least(*both), 6).alias("meet"), F.round(F.greatest(*both), 6).alias("join_"))


@R.query("WITH i AS (SELECT s_nationkey AS source, CASE WHEN s_suppkey % 50 = 0 THEN 0.0 ELSE 0.9 END AS f FROM supplier WHERE s_suppkey % 3 = 0), g AS (SELECT source, product(f) AS f FROM i GROUP BY source) SELECT n_nationkey AS source, round(n_nationkey / 25.0 * coalesce(f, 1), 6) AS trust FROM nation LEFT JOIN g ON source = n_nationkey")
def trust_degrade(spark, sf_dir):
    sources = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("source"), (F.col("n_nationkey") / 25.0).alias("trust"))
    incidents = _t(spark, sf_dir, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("source"), F.when(F.col("s_suppkey") % 50 == 0, 0.0).otherwise(0.9).alias("factor"))
    return al.degraded(sources, incidents).select("source", F.round("trust", 6).alias("trust"))


@R.query("SELECT user_id AS actor, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place, event_type AS action FROM events")
def trace_actions(spark, sf_dir):
    return al.trace_actions(_trace(spark, sf_dir))


def _trace(spark, sf_dir):
    return _t(spark, sf_dir, "events").selectExpr("event_id AS id", "unix_micros(cast(ts AS timestamp)) AS us", "user_id AS actor", "event_type AS action", "(user_id * 7) % 150 AS target")


@R.query("WITH t AS (SELECT user_id AS actor, string_agg(event_type, '>' ORDER BY ts, event_id) AS actions FROM events GROUP BY user_id) SELECT actor, regexp_full_match(actions, '.*signup>(view>|click>)*purchase.*') AS matches FROM t")
def trace_pattern(spark, sf_dir):
    anything = ("star", ("any",))
    browsing = ("star", ("alt", ("atom", "view"), ("atom", "click")))
    return al.matching_traces(_trace(spark, sf_dir), ("seq", anything, ("atom", "signup"), browsing, ("atom", "purchase"), anything))


@R.query("WITH c AS (SELECT user_id, max(event_id % 1000) FILTER (event_type = 'click') AS a, max(event_id % 1000) FILTER (event_type = 'view') AS b FROM events GROUP BY user_id), k AS (SELECT user_id, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM c), p AS (SELECT x.user_id, x.a, x.b, y.a AS c, y.b AS d FROM k x JOIN k y ON y.user_id = x.user_id + 1) SELECT user_id, a <= c AND b <= d AND (a < c OR b < d) AS before, (a < c OR b < d) AND (a > c OR b > d) AS concurrent FROM p")
def happens_before(spark, sf_dir):
    """Each actor's clock against the next actor's."""
    rows = _t(spark, sf_dir, "events").where("event_type IN ('click', 'view')").select("user_id", F.create_map("event_type", F.col("event_id") % 1000).alias("clock"))
    known = _t(spark, sf_dir, "events").select("user_id").distinct()
    clocks = known.join(al.clock_merge(rows, "user_id", "clock"), "user_id", "left").withColumn("clock", F.coalesce("clock", F.create_map().cast("map<string,bigint>")))
    pairs = clocks.join(clocks.select((F.col("user_id") - 1).alias("user_id"), F.col("clock").alias("next")), "user_id")
    return pairs.select("user_id", al.happens_before(F.col("clock"), F.col("next")).alias("before"), al.concurrent(F.col("clock"), F.col("next")).alias("concurrent"))


@R.query("WITH t AS (SELECT event_id AS id, epoch_us(ts) AS us, user_id AS actor, (user_id * 7) % 150 AS target FROM events) SELECT DISTINCT a.id AS a_id, b.id AS b_id FROM t a JOIN t b ON (a.actor = b.actor OR a.target = b.actor) AND (a.us < b.us OR a.us = b.us AND a.id < b.id) AND b.us - a.us <= 21600000000")
def causal_links(spark, sf_dir):
    return al.causal_links(_trace(spark, sf_dir), 21_600_000_000)


@R.query("""WITH a AS (SELECT event_id, '10.' || (user_id % 40) || '.' || (event_id % 250) || '.7' AS address, CASE WHEN user_id % 40 < 25 THEN '10.' || (user_id % 40) || '.99.0/16' ELSE '10.0.0.0/8' END AS network FROM events
UNION ALL SELECT event_id, '2001:db8:' || format('{:x}', user_id % 60) || '::' || format('{:x}', event_id % 5000), CASE WHEN user_id % 60 < 25 THEN '2001:db8:' || format('{:x}', user_id % 60) || '::/48' WHEN user_id % 60 < 32 THEN '2001:DB8::/43' END FROM events
UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_id % 50 = 0) SELECT * FROM a""")
def cidr_lookup(spark, sf_dir):
    """The innermost network of each address, of both versions, nested ones and text that is no address."""
    e, n = _t(spark, sf_dir, "events"), _t(spark, sf_dir, "nation")
    nets = n.selectExpr("concat('10.', n_nationkey, '.99.0/16') AS network").unionAll(n.selectExpr("concat('2001:db8:', lower(hex(n_nationkey)), '::/48')"))
    nets = nets.unionAll(n.where("n_nationkey = 0").selectExpr("explode(array('10.0.0.0/8', '2001:DB8::/43', '10.0.0.0/99', 'none', '::1::/8'))"))
    rows = e.selectExpr("event_id", "concat('10.', user_id % 40, '.', event_id % 250, '.7') AS address").unionAll(e.selectExpr("event_id", "concat('2001:db8:', lower(hex(user_id % 60)), '::', lower(hex(event_id % 5000)))"))
    rows = rows.unionAll(e.where("event_id % 50 = 0").select("event_id", "event_type"))
    return prefixes.networks_of(rows, F.col("address"), nets).select("event_id", "address", F.col("found.network").alias("network"))


_PAYLOAD = """concat('{"k": ', cast(event_id % 9 AS string), ', "v": ', CASE event_id % 8 WHEN 0 THEN 'null' WHEN 1 THEN 'true' WHEN 2 THEN cast(event_id AS string) WHEN 3 THEN '2.5' WHEN 4 THEN '"text"' WHEN 5 THEN '""' WHEN 6 THEN concat('[', cast(event_id AS string), ', {"in": "x"}]') ELSE '{}' END, ', "user": {"id": ', cast(user_id AS string), '}}')"""


@R.query(f"""WITH p AS (SELECT event_id, json({_PAYLOAD.replace("AS string", "AS varchar")}) AS j FROM events), v AS (SELECT *, json_extract(j, '$.v') AS v, json_type(j, '$.v') AS t FROM p)
SELECT event_id, CAST(json_extract(j, '$.k') AS BIGINT) AS k, CAST(json_extract(j, '$.user.id') AS BIGINT) AS user_id,
  CASE t WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'bool' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'object' END AS type,
  CASE WHEN t = 'BOOLEAN' THEN CAST(v AS BOOLEAN) END AS as_bool, CASE WHEN t = 'UBIGINT' THEN CAST(v AS BIGINT) END AS as_int, CASE WHEN t IN ('UBIGINT', 'DOUBLE') THEN CAST(v AS DOUBLE) END AS as_float, CASE WHEN t = 'VARCHAR' THEN v->>'$' END AS as_string,
  CASE WHEN t = 'ARRAY' THEN CAST(json_extract(v, '$[0]') AS BIGINT) END AS first, json_extract(v, '$[1].in')->>'$' AS inner_, t = 'NULL' OR CAST(v AS VARCHAR) IN ('""', '[]', '{{}}') AS empty, json_extract(j, '$.missing') IS NULL AS absent FROM v""")
def payload_access(spark, sf_dir):
    """Fields, places of arrays, typed reads, type names and emptiness of payloads of all kinds."""
    payload = F.parse_json(F.expr(_PAYLOAD))
    v = dy.at(payload, "v")
    return _t(spark, sf_dir, "events").select(
        "event_id", dy.as_int(dy.at(payload, "k")).alias("k"), dy.as_int(dy.at(payload, "user", "id")).alias("user_id"), dy.type_name(v).alias("type"),
        dy.as_bool(v).alias("as_bool"), dy.as_int(v).alias("as_int"), dy.as_float(v).alias("as_float"), dy.as_string(v).alias("as_string"),
        dy.as_int(dy.at(v, 0)).alias("first"), dy.as_string(dy.at(v, 1, "in")).alias("inner_"), dy.is_empty(v).alias("empty"), dy.at(payload, "missing").isNull().alias("absent"),
    )


@R.query("WITH e AS (SELECT event_type, least(1, greatest(0, value / 1000.0)) AS p, event_id % 2 = 0 AS acted, 1.0 + event_id % 3 AS a, 1.0 + event_id % 5 AS b FROM events WHERE value IS NOT NULL) SELECT event_type, round(avg(greatest(0, CASE WHEN acted THEN a * (1 - p) ELSE b * p END - least(a * (1 - p), b * p))), 6) AS regret, count(*) FILTER (a <= b) AS minimax_acts, round(avg(a * 1.2 / (a * 1.2 + b * 0.8)), 6) AS robust_threshold FROM e GROUP BY event_type")
def regret(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").where("value IS NOT NULL")
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("value") / 1000.0))
    a, b = 1.0 + F.col("event_id") % 3, 1.0 + F.col("event_id") % 5
    return rows.groupBy("event_type").agg(F.round(F.avg(al.regret(p, a, b, F.col("event_id") % 2 == 0)), 6).alias("regret"), F.count_if(al.minimax_acts(a, b)).alias("minimax_acts"), F.round(F.avg(al.robust_threshold(a, b, F.lit(0.2))), 6).alias("robust_threshold"))


@R.query("WITH h AS (SELECT c_nationkey AS c, c_mktsegment AS hypothesis, sum(c_acctbal) - 5000 AS weight FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY ALL), g AS (SELECT * FROM h WHERE weight > 0) SELECT c, hypothesis, round(weight / sum(weight) OVER (PARTITION BY c), 6) AS share FROM g")
def information_refined(spark, sf_dir):
    rows = _t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("case"), F.col("c_mktsegment").alias("ord")).agg((F.sum("c_acctbal") - 5000).alias("weight"))
    return al.refined(rows, F.col("ord") != "BUILDING").select(F.col("case").alias("c"), F.col("ord").alias("hypothesis"), F.round("share", 6).alias("share"))


@R.query("SELECT o_custkey % 10 AS queue, CASE WHEN o_custkey % 10 = 3 THEN CAST('Infinity' AS DOUBLE) ELSE round(sum(o_orderkey % 7) / (o_custkey % 10 - 3.0), 6) END AS overload FROM orders WHERE o_custkey % 10 >= 3 GROUP BY o_custkey % 10")
def overload(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").where("o_custkey % 10 >= 3").groupBy((F.col("o_custkey") % 10).alias("queue")).agg(F.sum(F.col("o_orderkey") % 7).alias("rate"))
    return rows.select("queue", F.round(al.overload(F.col("rate"), F.col("queue") - 3.0), 6).alias("overload"))


@R.query("SELECT event_id, least(60000, 500 * power(2, least(event_id % 40, 30))::BIGINT) AS delay_ms, event_id % 40 < 5 AS restart FROM events")
def restart_backoff(spark, sf_dir):
    n = F.col("event_id") % 40
    return _t(spark, sf_dir, "events").select("event_id", sc.backoff(n, 500, 60_000).alias("delay_ms"), sc.may_restart(n, 5).alias("restart"))
