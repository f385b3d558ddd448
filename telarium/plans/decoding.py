"""Queries of raw decoding, field classes, supervision and residual risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from telarium.functions import decoding as dec
from telarium.functions import privacy
from telarium.operators import algebra as al
from telarium.operators import reports
from telarium.plans.register import TEL, Registry
from telarium.sources.telemetry import telemetry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@R.query("WITH n AS (SELECT event_id, (event_id * 2654435761) % 4294967296 AS n FROM events) SELECT event_id, concat(n & 255, '.', (n >> 8) & 255, '.', (n >> 16) & 255, '.', n >> 24) AS ip FROM n")
def ip_normalise(spark, sf_dir):
    number = (F.col("event_id") * F.lit(2_654_435_761)) % F.lit(1 << 32)
    return _t(spark, sf_dir, "events").select("event_id", dec.ip4_of_number(number).alias("ip"))


_TYPES = " ".join(f"WHEN {n} THEN '{name}'" for n, name in dec.QUERY_TYPES.items())
_LEVELS = " ".join(f"WHEN 'S-1-16-{n}' THEN '{name}'" for n, name in dec.INTEGRITY_LEVELS.items())


@R.query(f"SELECT event_id, CASE event_id % 300 {_TYPES} ELSE cast(event_id % 300 AS VARCHAR) END AS query_type, CASE concat('S-1-16-', 4096 * (user_id % 8)) {_LEVELS} END AS integrity FROM events")
def code_lookup(spark, sf_dir):
    sid = F.concat(F.lit(" S-1-16-"), (4096 * (F.col("user_id") % 8)).cast("string"))
    return _t(spark, sf_dir, "events").select("event_id", dec.query_type(F.col("event_id") % 300).alias("query_type"), dec.integrity_level(sid).alias("integrity"))


@R.query("SELECT event_id, CASE WHEN event_id % 12 IN (1, 2, 7) THEN props WHEN event_id % 12 IN (4, 5, 11) THEN cast(event_id AS VARCHAR) ELSE lower(hex(props)) END AS value FROM events")
def registry_value(spark, sf_dir):
    kind = (F.col("event_id") % 12).cast("int")
    byte = lambda i: F.unhex(F.lpad(F.hex(F.shiftright("event_id", 8 * i).bitwiseAND(255)), 2, "0"))
    number = F.concat(*(byte(i) for i in range(8)))
    raw = F.when(kind.isin(1, 2, 7), F.encode("props", "UTF-16LE")).when(kind.isin(4, 5, 11), number).otherwise(F.encode("props", "UTF-8"))
    return _t(spark, sf_dir, "events").select("event_id", dec.registry_value(kind, raw).alias("value"))


def _process(spark, sf_dir):
    rows = telemetry(spark, sf_dir).where("kind = 'process_start'")
    inner = F.struct("pid", F.col("image").alias("image_path"), F.struct(F.col("host").alias("hostname"), F.col("k").alias("note")).alias("extra"))
    return rows.select("id", F.struct("id", inner.alias("process"), "kind").alias("record"))


@R.query(f"WITH {TEL} SELECT id, concat('{{\"id\":', id, ',\"process\":{{\"pid\":', pid, ',\"image_path\":\"[REDACTED]\",\"extra\":{{\"hostname\":\"', host, '\",\"note\":\"[REDACTED]\"}}}},\"kind\":\"process_start\"}}') AS record FROM tel WHERE kind = 'process_start'")
def redact_nested(spark, sf_dir):
    rows = _process(spark, sf_dir)
    return rows.select("id", F.to_json(privacy.redact(F.col("record"), rows.schema["record"].dataType)).alias("record"))


@R.query(f"WITH {TEL} SELECT id, concat('{{\"id\":', id, ',\"kind\":\"process_start\"}}') AS record FROM tel WHERE kind = 'process_start'")
def strip_nested(spark, sf_dir):
    rows = _process(spark, sf_dir)
    return rows.select("id", F.to_json(privacy.strip(F.col("record"), rows.schema["record"].dataType)).alias("record"))


@R.query("SELECT event_id, '{\"k\":\"[REDACTED]\"}' AS payload FROM events")
def redact_payload(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", privacy.redact_json(F.col("props")).alias("payload"))


@R.query("SELECT event_id, sha256(concat('{\"actor\":{\"k\":', regexp_extract(props, '([0-9]+)', 1), ',\"user\":', user_id, '},\"kind\":\"', event_type, '\"}')) AS digest FROM events")
def canonical_hash(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.struct(F.col("event_type").alias("kind"), F.struct(F.col("user_id").alias("user"), F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k")).alias("actor")).alias("record"))
    return rows.select("event_id", privacy.canonical_hash(F.col("record"), rows.schema["record"].dataType).alias("digest"))


@R.query("WITH b AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS observed, count(*) FILTER (event_type = 'error') AS missed FROM events GROUP BY user_id) SELECT c_custkey AS sensor, coalesce(observed, 0) AS observed, coalesce(missed, 0) AS missed, round(CASE WHEN coalesce(observed + missed, 0) = 0 THEN 1 ELSE observed / (observed + missed) END, 6) AS availability FROM customer LEFT JOIN b ON c_custkey = user_id")
def duty(spark, sf_dir):
    beats = _t(spark, sf_dir, "events").select(F.col("user_id").alias("sensor"), (F.col("event_type") != "error").alias("on_time"))
    rows = reports.duty(_t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sensor")), beats)
    return rows.withColumn("availability", F.round("availability", 6))


_NOW, _INTERVAL_MS, _GRACE_MS = "(SELECT max(epoch_ms(ts)) FROM events)", 3_600_000, 600_000


@R.query(f"WITH b AS (SELECT user_id, max(epoch_ms(ts)) AS last FROM events GROUP BY user_id) SELECT c_custkey AS sensor, CASE WHEN last IS NULL THEN 'never_seen' WHEN {_NOW} <= last + {_INTERVAL_MS + _GRACE_MS} THEN 'alive' ELSE 'stale' END AS state FROM customer LEFT JOIN b ON c_custkey = user_id")
def heartbeat_liveness(spark, sf_dir):
    beats = _t(spark, sf_dir, "events").groupBy(F.col("user_id").alias("sensor")).agg(F.max(F.unix_millis(F.col("ts").cast("timestamp"))).alias("last_ms"))
    rows = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sensor")).join(beats, "sensor", "left")
    rows = rows.crossJoin(F.broadcast(beats.agg(F.max("last_ms").alias("now"))))  # one row
    return rows.select("sensor", reports.liveness(F.col("now"), F.col("last_ms"), _INTERVAL_MS, _GRACE_MS).alias("state"))


@R.query("WITH g AS (SELECT p_partkey AS gap, p_size / 50.0 AS severity FROM part), c AS (SELECT s_suppkey * 3 AS gap, s_suppkey AS control, least(1, greatest(0, s_acctbal / 10000)) AS coverage FROM supplier UNION ALL SELECT s_suppkey * 3, s_suppkey + 1000000, 0.25 FROM supplier), b AS (SELECT *, row_number() OVER (PARTITION BY gap ORDER BY coverage DESC, control) AS rn FROM c) SELECT g.gap, control, round(severity * (1 - coalesce(coverage, 0)), 6) AS residual FROM g LEFT JOIN (SELECT * FROM b WHERE rn = 1) b ON g.gap = b.gap")
def residual_risk(spark, sf_dir):
    gaps = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("gap"), (F.col("p_size") / 50.0).alias("severity"))
    s = _t(spark, sf_dir, "supplier")
    own = s.select((F.col("s_suppkey") * 3).alias("gap"), F.col("s_suppkey").alias("control"), (F.col("s_acctbal") / 10000).cast("double").alias("coverage"))
    other = s.select((F.col("s_suppkey") * 3).alias("gap"), (F.col("s_suppkey") + 1_000_000).alias("control"), F.lit(0.25).alias("coverage"))
    rows = al.residual_risk(gaps, own.unionAll(other))
    return rows.select("gap", "control", F.round("residual", 6).alias("residual"))


@R.query("WITH c AS (SELECT user_id, event_type, max(event_id % 1000) AS n FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS clock FROM c GROUP BY user_id")
def clock_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("user_id", F.create_map("event_type", F.col("event_id") % 1000).alias("clock"))
    shown = F.transform(F.map_entries("clock"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return al.clock_merge(rows, "user_id", "clock").select("user_id", F.array_join(shown, ",").alias("clock"))


@R.query()
def wire_volume(spark, sf_dir):
    """Mean serialised size and bytes a day, by kind; the serialisation is Spark's own."""
    return reports.wire_volume(telemetry(spark, sf_dir).where("id < 2000000000"))
