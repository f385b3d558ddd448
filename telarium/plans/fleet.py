"""Queries of reports, raw translation and fleet tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telarium.checkpoint import cut, folder
from telarium.functions import scalars as sc
from telarium.operators import evidence as ev
from telarium.operators import entities, facts, prefixes, reports, rules, sketches, translate
from telarium.plans import detection as d
from telarium.plans.register import TEL, Registry
from telarium.functions import privacy
from telarium.sources import telemetry as src
from telarium.sources.log_table import LogTable
from telarium.sources.shapes import CHAINS, SHAPES
from telarium.sources.telemetry import telemetry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: (rule, technique) of native and SIGMA rules.
_TECHNIQUES = [*rules.TECHNIQUES.items(), ("shell-from-document", "T1204.002"), ("user-unpacked", "T1204.002"), ("port-or-range", "T1571"), ("wildcard-name", "TA0000"), ("no-value-name", "T1547.001")]
_FIRST = ", fr AS (SELECT rule, count(*) AS firings, arg_min(hit, (us, id)) AS hit, arg_min(miss, (us, id)) AS miss FROM find GROUP BY rule)"
_H2 = "CASE WHEN {p} > 0 AND {p} < 1 THEN -({p}) * log2({p}) - (1 - ({p})) * log2(1 - ({p})) ELSE 0 END"
_CAP = f"greatest(0, {_H2.format(p='((1 + miss - (1 - hit)) / 2)')} - ({_H2.format(p='(miss)')}) / 2 - ({_H2.format(p='(1 - hit)')}) / 2)"


@R.query(d.FINDINGS + _FIRST + " SELECT * FROM fr")
def rule_firings(spark, sf_dir):
    return reports.rule_firings(d.all_findings(spark, sf_dir))


@R.query(d.FINDINGS + _FIRST + f" SELECT rule, round({_CAP}, 6) AS capacity, round({_H2.format(p='(1 - hit)')}, 6) AS fano FROM fr")
def rule_capacity(spark, sf_dir):
    rows = reports.rule_capacity(reports.rule_firings(d.all_findings(spark, sf_dir)))
    return rows.select("rule", F.round("capacity", 6).alias("capacity"), F.round("fano", 6).alias("fano"))


@R.query(d.FINDINGS + _FIRST + f" SELECT round(avg({_CAP}), 6) AS capacity, count(*) AS rules FROM fr")
def stack_capacity(spark, sf_dir):
    return reports.stack_capacity(reports.rule_firings(d.all_findings(spark, sf_dir))).select(F.round("capacity", 6).alias("capacity"), "rules")


@R.query(d.FINDINGS + _FIRST + f" SELECT rule, round({_CAP}, 6) AS capacity FROM fr ORDER BY {_CAP} DESC, rule LIMIT 12")
def rules_top12(spark, sf_dir):
    rows = reports.rule_capacity(reports.rule_firings(d.all_findings(spark, sf_dir)))
    return rows.orderBy(F.desc("capacity"), "rule").limit(12).select("rule", F.round("capacity", 6).alias("capacity"))


@R.query(d.FATES + """, h AS (SELECT host, count(*) AS events, count(*) FILTER (kind = 'process_start') AS process_starts FROM tel GROUP BY host),
  m AS (SELECT h.*, (SELECT count(*) FROM find WHERE find.host = h.host) AS findings, (SELECT count(*) FROM de WHERE de.host = h.host AND NOT acts) AS abstained, 0 AS withheld,
    (SELECT count(*) FROM fo WHERE fo.host = h.host AND fate = 'emit') AS alerts, (SELECT count(*) FROM fo WHERE fo.host = h.host AND fate = 'fold') AS suppressed, (SELECT count(*) FROM fo WHERE fo.host = h.host AND fate = 'below_floor') AS below_floor FROM h)
  SELECT host, """ + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("events", "process_starts", "findings", "abstained", "withheld", "alerts", "suppressed", "below_floor")) + " FROM m GROUP BY ROLLUP (host)")
def run_metrics(spark, sf_dir):
    decided = cut(d.decided(spark, sf_dir))
    return reports.run_metrics(telemetry(spark, sf_dir), None, decided, ev.coalesced(decided, d.WINDOW_US))


@R.query(f"WITH {TEL}, s AS (SELECT host, count(*) AS entities, count(DISTINCT pid) AS observed FROM tel WHERE kind = 'process_start' GROUP BY host) SELECT *, round(least(1, observed / entities), 6) AS coverage, round(1 - least(1, observed / entities), 6) AS blind_spot, greatest(entities - observed, 0) AS gap FROM s")
def coverage(spark, sf_dir):
    return reports.coverage(telemetry(spark, sf_dir)).withColumn("coverage", F.round("coverage", 6)).withColumn("blind_spot", F.round("blind_spot", 6))


@R.query(f"WITH {TEL}, c AS (SELECT host, lower(image) AS k, count(*) AS n, min(us) AS first FROM tel WHERE kind = 'process_start' GROUP BY ALL) SELECT host, count(*) AS distinct_n, CAST(sum(n) AS BIGINT) AS total, round(count(*) / sum(n), 6) AS novelty_rate, count(*) FILTER (first >= (SELECT max(us) FROM tel) - 2160000000000) AS novel, round(count(*) / (count(*) + count(*) FILTER (first >= (SELECT max(us) FROM tel) - 2160000000000)), 6) AS coverage_estimate FROM c GROUP BY host")
def novelty_summary(spark, sf_dir):
    """Novel are the images of the last 25 days."""
    events = telemetry(spark, sf_dir)
    since = events.agg(F.max("us")).first()[0] - 2_160_000_000_000
    rows = reports.novelty_summary(events.where("kind = 'process_start'"), F.lower("image"), since)
    return rows.select("host", F.col("distinct").alias("distinct_n"), "total", "novel", F.round("novelty_rate", 6).alias("novelty_rate"), F.round("coverage_estimate", 6).alias("coverage_estimate"))


_ENTITIES = """p AS (SELECT *, us % 3 AS part FROM tel WHERE kind = 'process_start'),
att AS (SELECT host, pid, 'parent_pid' AS key, cast(parent_pid AS varchar) AS value, us, id FROM p WHERE parent_pid IS NOT NULL UNION ALL SELECT host, pid, 'user', user_name, us, id FROM p WHERE user_name IS NOT NULL),
la AS (SELECT host, pid, key, arg_max(value, (us, id)) AS value FROM att GROUP BY host, pid, key),
mm AS (SELECT host, pid, string_agg(key || '=' || value, ',' ORDER BY key) AS attrs FROM la GROUP BY host, pid)"""


@R.query(f"WITH {TEL}, {_ENTITIES} SELECT host, pid, min(us) AS first_seen, max(us) AS last_seen, arg_max(image, (us, id)) AS label, count(*) AS n, coalesce(any_value(attrs), '') AS attrs FROM p LEFT JOIN mm USING (host, pid) GROUP BY host, pid")
def entity_state(spark, sf_dir):
    """The state after three batches, out of order, with one of them sent twice."""
    seen = entities.processes(telemetry(spark, sf_dir))
    table = entities.state_table(spark, f"{folder(spark)}/entities-{uuid.uuid4().hex}", fanout=2)
    for epoch, part in enumerate((2, 0, 1)):
        batch = entities.changes(seen.where(F.col("us") % 3 == part))
        table.append(batch, "fleet", epoch)
    table.append(batch, "fleet", 2)
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return entities.entities(table.read()).select("host", F.col("entity").alias("pid"), F.col("first_us").alias("first_seen"), F.col("last_us").alias("last_seen"), "label", "n", attrs.alias("attrs"))


@R.query(f"WITH {TEL} SELECT DISTINCT host, 'process' AS kind, image AS label, pid FROM tel WHERE kind = 'process_start'")
def entity_fiber(spark, sf_dir):
    return entities.fiber(entities.processes(telemetry(spark, sf_dir))).select("host", "kind", "label", F.col("entity").alias("pid"))


@R.query(f"WITH {TEL} SELECT host, count(DISTINCT pid) AS distinct_n, count(*) AS total, true AS within FROM tel GROUP BY host UNION ALL SELECT NULL, count(DISTINCT pid), count(*), true FROM tel")
def fleet_distinct(spark, sf_dir):
    """Distinct processes by host and of the fleet (null), exactly and by merged hourly sketches, which must be within four standard errors."""
    events = telemetry(spark, sf_dir)
    hours = cut(sketches.rolled_up(events, F.col("pid")))
    told = sketches.estimated(sketches.merged(hours, "host")).unionByName(sketches.estimated(sketches.merged(hours).withColumn("host", F.lit(None).cast("string"))))
    exact = events.rollup("host").agg(F.count_distinct("pid").alias("distinct_n"), F.count("*").alias("total"))
    both = exact.join(told.select(F.col("host").alias("of"), F.col("distinct").alias("told"), F.col("n").alias("told_n")), F.col("host").eqNullSafe(F.col("of")))
    within = (F.abs(F.col("told") - F.col("distinct_n")) <= F.greatest(F.lit(1.0), 4 * sketches.standard_error() * F.col("distinct_n"))) & (F.col("told_n") == F.col("total"))
    return both.select("host", "distinct_n", "total", within.alias("within"))


@R.query(f"WITH {TEL} SELECT host, pid, max(id) FILTER (us = m) AS id FROM (SELECT *, max(us) OVER (PARTITION BY host, pid) AS m FROM tel) GROUP BY host, pid")
def latest_obs(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("host", "pid").agg(F.max(F.struct("us", "id")).alias("x")).select("host", "pid", "x.id")


@R.query(d.FINDINGS + """, r AS (SELECT * FROM (VALUES """ + ", ".join(f"('{t}')" for _, t in _TECHNIQUES) + """) AS t(technique)),
  tq AS (SELECT * FROM (VALUES """ + ", ".join(f"('{n}', '{t}')" for n, t in _TECHNIQUES) + """) AS t(rule, technique)),
  s AS (SELECT tq.technique, count(*) AS findings, count(DISTINCT host) AS hosts FROM find JOIN tq USING (rule) GROUP BY tq.technique)
  SELECT technique, count(*) AS rules, coalesce(any_value(findings), 0) AS findings, coalesce(any_value(hosts), 0) AS hosts FROM r LEFT JOIN s USING (technique) GROUP BY technique""")
def technique_coverage(spark, sf_dir):
    table = spark.createDataFrame(_TECHNIQUES, "rule string, technique string")
    return reports.technique_coverage(table, d.all_findings(spark, sf_dir))


# Raw events ---------------------------------------------------------------

def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw rows of all 15 shapes with a property bag: alternate spellings, blanks, lost
    fields, times that are none and unknown ids."""
    c = F.col
    lost, other = c("id") % 17 == 0, c("id") % 11 == 0
    entry = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    plain = lambda chain, value: [entry(CHAINS[chain][0], value)]

    def must(chain, value):
        """The first spelling is blank now and then, and the second one (if there is one) has the value."""
        names = CHAINS[chain]
        return [entry(names[0], F.when(lost, None).when(other, "").otherwise(value.cast("string"))), *(entry(n, F.when(other & ~lost, value)) for n in names[1:2])]

    parts = lambda address: F.split(address, r"\.")
    number = lambda address: reduce(lambda acc, i: acc + F.get(parts(address), F.lit(i)).cast("bigint") * 256**i, range(4), F.lit(0).cast("bigint"))
    device = F.concat(F.when(c("k") % 2 == 0, "\\Device\\HarddiskVolume1").otherwise("\\Device\\HarddiskVolume12"), F.expr("substring(path, 3)"))
    ids = plain("process_id", c("pid")) + plain("parent_process_id", c("parent_pid"))
    network = plain("net_pid", c("pid")) + must("saddr", number(c("source_ip"))) + must("daddr", number(c("destination_ip"))) + plain("sport", c("source_port")) + plain("dport", c("destination_port")) + plain("size", c("bytes_sent"))
    bags = {
        "process_start": ids + must("image_name", c("image")),
        "process_start_audit": ids + must("new_process_name", c("image")) + plain("command_line", c("command_line")) + plain("subject_user_name", c("user_name")) + plain("parent_process_name", c("reported_parent")) + plain("mandatory_label", F.lit("S-1-16-12288")),
        "process_exit": plain("process_id", c("pid")) + plain("exit_code", c("exit_code").cast("bigint").bitwiseAND(0xFFFFFFFF)),
        "image_load": plain("process_id", c("pid")) + must("image_name", c("path")),
        "registry_set": must("key_name", F.regexp_replace(F.regexp_replace("key_path", "^HKLM", r"\\REGISTRY\\MACHINE"), "^HKCU", r"\\REGISTRY\\USER")) + plain("value_name", c("value_name")) + plain("captured_data", c("value_data")),
        "dns_query": must("query_name", c("query_name")) + plain("query_type", c("k") % 30),
        "script_block": must("script_text", c("script_text")) + plain("script_block_id", c("script_block_id")) + plain("script_path", c("script_path")),
        "file_create": must("file_name", device), "file_delete": must("file_name", device),
        "file_rename": must("file_new_name", c("new_path")) + plain("file_old_name", F.when(~lost, c("old_path"))),
        "network_connect": network, "network_disconnect": network,
        "wmi_process": must("wmi_command_line", c("command_line")) + plain("wmi_created_pid", c("pid")) + plain("wmi_client_machine", c("client_machine")) + plain("wmi_user", c("user_name")) + plain("wmi_is_local", c("is_local").cast("int")),
        "wmi_subscription": must("wmi_namespace", F.lit("root")) + must("wmi_event_filter", F.lit("filter")) + plain("wmi_consumer", c("consumer")),
        "task_registered": must("task_name", c("task_name")) + plain("user_context", c("user_name")),
    }
    ticks = F.when(c("id") % 97 == 0, F.lit(5)).otherwise(c("us") * 10 + F.lit(116_444_736_000_000_000))
    mounts = F.array(*(F.struct(F.lit(d).alias("device"), F.lit(r).alias("root")) for d, r in _MOUNTS))
    out = None
    for provider, event_id, shape, _ in SHAPES:
        bag = F.map_from_entries(F.filter(F.array(*bags[shape]), lambda e: e["value"].isNotNull()))
        audited = {"process_start": c("id") % 3 != 0, "process_start_audit": c("id") % 3 == 0}.get(shape, F.lit(True))
        mine = telemetry(spark, sf_dir, shape.removesuffix("_audit")).where(audited)
        part = mine.select(
            "id", "host", c("us").alias("seen_us"), ticks.alias("ticks"), F.lit(provider).alias("provider"), F.when(c("id") % 13 == 0, 9999).otherwise(event_id).alias("event_id"),
            F.lit(900).cast("bigint").alias("pid"), bag.alias("fields"), F.pmod("k", F.lit(6)).alias("level"), (100 + c("k")).alias("payload_bytes"), mounts.alias("mounts"),
        )
        out = part if out is None else out.unionAll(part)
    return out


#: (device, root) of each host here.
_MOUNTS = (("\\Device\\HarddiskVolume1", "C:"), ("\\Device\\HarddiskVolume12", "D:"), ("\\Device\\Mup", "\\"))
_DIM = "dim AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', {e}, '{s}', {str(k).lower()})" for p, e, s, k in SHAPES) + ") AS t(provider, ev, shape, kernel))"
_OF = "CASE WHEN id % 17 = 0 THEN NULL ELSE {} END"  # a field with two spellings
_ONE = "CASE WHEN id % 17 = 0 OR id % 11 = 0 THEN NULL ELSE {} END"  # a field with one
_RAW = TEL + ", " + _DIM + f""",
raw AS (SELECT tel.* EXCLUDE (provider, event_id), dim.provider, CASE WHEN id % 13 = 0 THEN 9999 ELSE ev END AS event_id, CASE WHEN id % 13 = 0 THEN NULL ELSE dim.shape END AS shape, kernel, k % 6 AS level, 100 + k AS payload_bytes
  FROM tel JOIN dim ON dim.shape = CASE WHEN kind = 'process_start' AND id % 3 = 0 THEN 'process_start_audit' ELSE kind END),
sh AS (SELECT *, CASE WHEN shape IS NULL THEN NULL WHEN id % 97 = 0 THEN 'not a valid time' WHEN shape = 'process_exit' THEN NULL
  WHEN id % 17 = 0 THEN 'no ' || CASE shape WHEN 'process_start' THEN 'ImageName' WHEN 'process_start_audit' THEN 'NewProcessName' WHEN 'image_load' THEN 'ImageName' WHEN 'registry_set' THEN 'KeyName' WHEN 'dns_query' THEN 'QueryName'
    WHEN 'script_block' THEN 'ScriptBlockText' WHEN 'file_create' THEN 'FileName' WHEN 'file_delete' THEN 'FileName' WHEN 'file_rename' THEN 'NewFileName' WHEN 'network_connect' THEN 'saddr' WHEN 'network_disconnect' THEN 'saddr'
    WHEN 'wmi_process' THEN 'Commandline' WHEN 'wmi_subscription' THEN 'Namespace' ELSE 'TaskName' END
  WHEN id % 11 = 0 THEN CASE shape WHEN 'dns_query' THEN 'no QueryName' WHEN 'script_block' THEN 'no ScriptBlockText' WHEN 'wmi_subscription' THEN 'no Namespace' WHEN 'task_registered' THEN 'no TaskName' END END AS failure FROM raw)"""


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All raw rows, translated; ``us`` is when the row was seen. Raw rows are written once a session, by what
    the sensor said of them; the typed ones are not, so that a query makes only the columns that it asks for."""
    raw = src.stored(spark, "raw", sf_dir, lambda: raw_events(spark, sf_dir), "provider", "event_id")
    rows = translate.translated(raw)
    return rows.withColumn("decoded_us", F.col("us")).withColumn("us", F.col("seen_us"))


@R.query(f"WITH {_RAW} SELECT id, shape FROM sh")
def shape_map(spark, sf_dir):
    return shaped(spark, sf_dir).select("id", "shape")


@R.query(f"WITH {_RAW} SELECT id, {_OF.format('image')} AS image FROM sh WHERE shape IN ('process_start', 'process_start_audit')")
def field_chain(spark, sf_dir):
    return shaped(spark, sf_dir).where("shape IN ('process_start', 'process_start_audit')").select("id", "image")


@R.query(rf"""WITH {_RAW} SELECT id, kind, us, CASE WHEN kind IN ('registry_set', 'dns_query', 'script_block', 'file_create', 'file_delete', 'file_rename', 'wmi_subscription', 'task_registered') THEN 900 ELSE pid END AS pid, parent_pid, image,
  CASE WHEN shape <> 'process_start' THEN command_line END AS command_line, CASE WHEN shape <> 'process_start' THEN user_name END AS user_name,
  CASE WHEN shape = 'process_start_audit' THEN coalesce(reported_parent, CASE WHEN id % 11 = 0 THEN image END) END AS reported_parent, CASE WHEN shape = 'process_start_audit' THEN 'high' END AS integrity,
  cast(exit_code AS bigint) & 4294967295 AS exit_code, CASE WHEN shape IN ('file_create', 'file_delete') THEN CASE WHEN k % 2 = 0 THEN 'C:' ELSE 'D:' END || substr(path, 3) ELSE path END AS path,
  new_path, CASE WHEN shape = 'file_rename' THEN coalesce(old_path, new_path) END AS old_path, replace(key_path, 'HKCU', 'HKU') AS key_path, value_name, value_data, query_name, script_text, script_block_id, script_path,
  source_ip, source_port, destination_ip, destination_port, bytes_sent, nullif(client_machine, '') AS client_machine, is_local, consumer, task_name
  FROM sh WHERE shape IS NOT NULL AND failure IS NULL""")
def translate_ok(spark, sf_dir):
    """Raw events as typed telemetry."""
    names = "id kind us pid parent_pid image command_line user_name reported_parent integrity exit_code path new_path old_path key_path value_name value_data query_name script_text script_block_id script_path source_ip source_port destination_ip destination_port bytes_sent client_machine is_local consumer task_name".split()
    return shaped(spark, sf_dir).where("shape IS NOT NULL AND failure IS NULL").withColumn("us", F.col("decoded_us")).select(*names)


@R.query(f"WITH {_RAW} SELECT id, shape, failure FROM sh WHERE failure IS NOT NULL")
def translate_failures(spark, sf_dir):
    return shaped(spark, sf_dir).where("failure IS NOT NULL").select("id", "shape", "failure")


@R.query(f"WITH {_RAW} SELECT provider, count(*) AS starts, count(command_line) FILTER (shape = 'process_start_audit') AS with_command_line FROM sh WHERE shape IN ('process_start', 'process_start_audit') AND failure IS NULL GROUP BY provider")
def process_starts(spark, sf_dir):
    """Starts of both providers, side by side; neither replaces the other."""
    starts = shaped(spark, sf_dir).where("kind = 'process_start' AND failure IS NULL")
    return starts.groupBy("provider").agg(F.count("*").alias("starts"), F.count("command_line").alias("with_command_line"))


@R.query(f"""WITH {TEL}, l AS (SELECT id, us, lower(path) AS p FROM tel WHERE kind = 'image_load'),
m AS (SELECT us, lower(path) AS p, 'hash-' || id AS h, id FROM tel WHERE kind = 'file_create'),
c AS (SELECT l.id, m.h, row_number() OVER (PARTITION BY l.id ORDER BY m.us DESC, m.h DESC) AS rn FROM l JOIN (SELECT p, us, max(h) AS h FROM m GROUP BY p, us) m ON l.p = m.p AND m.us <= l.us)
SELECT l.id, h AS image_hash, CASE WHEN h IS NOT NULL THEN true END AS signed FROM l LEFT JOIN (SELECT * FROM c WHERE rn = 1) c USING (id)""")
def image_enrich(spark, sf_dir):
    """Image loads with what was last known of the file; the files written play the scanner here."""
    rows = telemetry(spark, sf_dir)
    files = rows.where("kind = 'file_create'").groupBy("path", "us").agg(F.max(F.concat(F.lit("hash-"), F.col("id").cast("string"))).alias("image_hash"))
    images = files.select("path", "us", "image_hash", F.lit(True).alias("signed"), F.lit("Example Signing").alias("signer"))
    return translate.with_image_metadata(rows.where("kind = 'image_load'"), images).select("id", "image_hash", "signed")


@R.query(f"WITH {_RAW} SELECT id, level FROM sh WHERE level <= 4")
def level_filter(spark, sf_dir):
    return shaped(spark, sf_dir).where("level <= 4").select("id", F.col("level").cast("int").alias("level"))


@R.query(f"WITH {_RAW} SELECT dim.shape, count(sh.shape) AS attempted, count(*) FILTER (sh.shape IS NOT NULL AND failure IS NULL) AS mapped, count(failure) AS undecodable FROM dim LEFT JOIN sh ON dim.shape = sh.shape GROUP BY dim.shape")
def shape_counts(spark, sf_dir):
    return reports.shape_counts(shaped(spark, sf_dir), translate.shape_table(spark))


@R.query(f"WITH {_RAW} SELECT host, coalesce(shape, 'unrecognised') AS shape, count(*) AS attempted, count(*) FILTER (shape IS NOT NULL AND failure IS NULL) AS mapped, count(failure) AS undecodable FROM sh GROUP BY ROLLUP (coalesce(shape, 'unrecognised'), host)")
def shape_counts_by_host(spark, sf_dir):
    """With rows for the fleet (host null) and for everything (shape null)."""
    rows = shaped(spark, sf_dir).withColumn("name", F.coalesce("shape", F.lit("unrecognised")))
    out = rows.rollup("name", "host").agg(F.count("*").alias("attempted"), F.count_if(F.col("shape").isNotNull() & F.col("failure").isNull()).alias("mapped"), F.count("failure").alias("undecodable"))
    return out.select("host", F.col("name").alias("shape"), "attempted", "mapped", "undecodable")


@R.query(f"WITH {_RAW}, f AS (SELECT provider, row_number() OVER (ORDER BY min((us, id)), provider) <= 5 AS named FROM sh WHERE shape IS NULL GROUP BY provider) SELECT CASE WHEN named THEN provider END AS provider, CASE WHEN named THEN event_id END AS event_id, count(*) AS n FROM sh JOIN f USING (provider) WHERE shape IS NULL GROUP BY ALL ORDER BY n DESC, provider, event_id LIMIT 10")
def unrecognised_top(spark, sf_dir):
    """Five providers are named here, so that some are folded."""
    return reports.unrecognised(shaped(spark, sf_dir), named=5).orderBy(F.desc("n"), "provider", "event_id").limit(10)


@R.query(f"WITH {_RAW} SELECT host, id, failure FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY us, id) AS rn FROM sh WHERE failure IS NOT NULL) WHERE rn <= 8")
def failure_samples(spark, sf_dir):
    w = Window.partitionBy("host").orderBy("us", "id")
    return shaped(spark, sf_dir).where("failure IS NOT NULL").withColumn("rn", F.row_number().over(w)).where("rn <= 8").select("host", "id", "failure")


@R.query(f"""WITH {_RAW}, c AS (SELECT host, us // 600000000 AS win, shape, count(*) AS attempted, count(*) FILTER (failure IS NULL) AS mapped FROM sh WHERE shape IS NOT NULL GROUP BY ALL),
g AS (SELECT w.host, w.win, dim.shape, kernel, coalesce(attempted, 0) AS attempted, coalesce(mapped, 0) AS mapped FROM (SELECT DISTINCT host, win FROM c) w CROSS JOIN dim LEFT JOIN c ON c.host = w.host AND c.win = w.win AND c.shape = dim.shape),
r AS (SELECT *, coalesce(max(attempted) OVER (PARTITION BY host, shape ORDER BY win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS fired,
  CASE WHEN kernel THEN max(CASE WHEN kernel THEN 0 ELSE attempted END) OVER (PARTITION BY host, win) ELSE max(CASE WHEN kernel THEN attempted ELSE 0 END) OVER (PARTITION BY host, win) END AS other FROM g)
SELECT host, CAST(win AS BIGINT) AS win, shape, CASE WHEN attempted = 0 AND fired AND other > 0 THEN 'silent' ELSE 'decode_failure' END AS state, CAST(CASE WHEN attempted = 0 AND fired AND other > 0 THEN 2 ELSE 1 END AS INTEGER) AS severity, attempted, mapped FROM r WHERE (attempted = 0 AND fired AND other > 0) OR attempted > mapped""")
def telemetry_gaps(spark, sf_dir):
    return reports.in_gap_order(reports.telemetry_gaps(shaped(spark, sf_dir), translate.shape_table(spark)))


_FORM = "CASE WHEN id % 31 = 0 THEN 'classic' WHEN id % 37 = 0 THEN 'string_only' WHEN id % 41 = 0 THEN 'trace_message' WHEN host = 'host-3' AND id % 101 = 0 THEN NULL ELSE 'manifest' END"
_KEPT = "form = 'manifest' AND level <= 4 AND shape IS NOT NULL AND failure IS NULL"


@R.query(f"""WITH {_RAW}, fo AS (SELECT *, {_FORM} AS form FROM sh), a AS (SELECT host, count(*) AS received, count(*) FILTER (form = 'classic') AS classic, count(*) FILTER (form = 'string_only') AS string_only, count(*) FILTER (form = 'trace_message') AS trace_message,
  count(*) FILTER (form = 'manifest' AND level > 4) AS filtered, count(*) FILTER ({_KEPT}) AS delivered, count(*) FILTER (form = 'manifest' AND level <= 4 AND (shape IS NULL OR failure IS NOT NULL)) AS dropped, sum(payload_bytes) FILTER ({_KEPT}) AS b, count(*) FILTER (form IS NULL) AS uncounted FROM fo GROUP BY host)
  SELECT host, received, classic, string_only, trace_message, filtered, delivered, dropped, uncounted = 0 AS closes, received - delivered AS lost, round(delivered / received, 6) AS coverage, round(b / delivered, 6) AS mean_payload_bytes FROM a""")
def sensor_accounting(spark, sf_dir):
    """One host has events of a form that no counter counts."""
    rows = reports.sensor_accounting(shaped(spark, sf_dir).withColumn("form", F.expr(_FORM)))
    return rows.withColumn("coverage", F.round("coverage", 6)).withColumn("mean_payload_bytes", F.round("mean_payload_bytes", 6))


@R.query(f"WITH {TEL} SELECT id, us * 10 + 116444736000000000 AS ticks, us FROM tel")
def filetime(spark, sf_dir):
    rows = telemetry(spark, sf_dir).select("id", (F.col("us") * 10 + F.lit(116_444_736_000_000_000)).alias("ticks"))
    return rows.select("id", "ticks", sc.filetime(F.col("ticks")).alias("us"))


@R.query(rf"""WITH {TEL}, p AS (SELECT id, host, CASE k % 3 WHEN 0 THEN '\Device\HarddiskVolume1' WHEN 1 THEN '\Device\HarddiskVolume12' ELSE '\Device\Other' END || substr(path, 3) AS path FROM tel WHERE path IS NOT NULL)
SELECT id, CASE WHEN starts_with(path, '\Device\HarddiskVolume12') THEN CASE WHEN host = 'host-3' THEN 'C:2' ELSE 'D:' END || substr(path, 25) WHEN starts_with(path, '\Device\HarddiskVolume1') THEN 'C:' || substr(path, 24) ELSE path END AS path FROM p""")
def device_path(spark, sf_dir):
    """The longest device prefix among the host's mounts; host-3 has fewer."""
    rows = telemetry(spark, sf_dir).where("path IS NOT NULL")
    raw = F.concat(F.when(F.col("k") % 3 == 0, "\\Device\\HarddiskVolume1").when(F.col("k") % 3 == 1, "\\Device\\HarddiskVolume12").otherwise("\\Device\\Other"), F.expr("substring(path, 3)"))
    table = spark.createDataFrame([*_MOUNTS], "device string, root string")
    mounts = rows.select("host").distinct().crossJoin(F.broadcast(table)).where("NOT (host = 'host-3' AND device LIKE '%12')")
    return prefixes.dos_paths(rows.select("id", "host", raw.alias("path")), "path", mounts).select("id", "path")


@R.query(rf"WITH {TEL} SELECT id, CASE WHEN starts_with(key_path, 'HKLM') THEN 'HKLM' ELSE 'HKU' END || substr(key_path, 5) AS key_path FROM tel WHERE kind = 'registry_set'")
def registry_path(spark, sf_dir):
    rows = telemetry(spark, sf_dir).where("kind = 'registry_set'")
    raw = F.regexp_replace(F.regexp_replace("key_path", "^HKLM", r"\\REGISTRY\\MACHINE"), "^HKCU", r"\\REGISTRY\\USER")
    return rows.select("id", translate.registry_path(raw).alias("key_path"))


@R.query("SELECT doc_id, text[1:0] || (CASE WHEN strlen(text) <= 8192 THEN text ELSE (SELECT max(substr(text, 1, n)) FROM (SELECT max(n) AS n FROM unnest(range(0, 8193)) AS t(n) WHERE strlen(substr(text, 1, n)) <= 8192)) END) AS text FROM documents")
def cap_text(spark, sf_dir):
    """At most 8 KiB, cut at a character's border."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", translate.capped_text(F.col("text")).alias("text"))


# Joins --------------------------------------------------------------------

@R.query("""WITH e AS (SELECT event_id AS id, epoch_us(ts) AS us, concat('host-', user_id % 4) AS host, user_id AS key_object, event_type, cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k FROM events),
l AS (SELECT *, 'p' || k AS path FROM e WHERE event_type = 'click' AND k % 5 <> 0 AND key_object <> 0), w AS (SELECT *, CASE WHEN k % 2 = 0 THEN '' ELSE 'own' || k END AS path FROM e WHERE event_type = 'purchase'),
c AS (SELECT w.id, l.path AS found, row_number() OVER (PARTITION BY w.id ORDER BY l.us DESC, l.id DESC) AS rn FROM w JOIN l ON l.host = w.host AND l.key_object = w.key_object AND (l.us < w.us OR l.us = w.us AND l.id < w.id))
SELECT w.id, coalesce(nullif(w.path, ''), CASE WHEN w.key_object <> 0 THEN found END) AS path FROM w LEFT JOIN (SELECT * FROM c WHERE rn = 1) c ON w.id = c.id""")
def kcb_asof(spark, sf_dir):
    return _handles(spark, sf_dir).select("id", F.col("final_path").alias("path"))


def _handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("event_id AS id", "unix_micros(cast(ts AS timestamp)) AS us", "concat('host-', user_id % 4) AS host", "user_id AS key_object", "event_type", "cast(regexp_extract(props, '([0-9]+)', 1) AS int) AS k")
    learned = e.where("event_type = 'click'").selectExpr("id", "us", "host", "key_object", "CASE WHEN k % 5 = 0 THEN '' ELSE concat('p', k) END AS path")
    writes = e.where("event_type = 'purchase'").selectExpr("id", "us", "host", "key_object", "CASE WHEN k % 2 = 0 THEN '' ELSE concat('own', k) END AS path")
    return facts.path_of_handle(learned, writes)


@R.query(ORACLE["kcb_asof"].replace("SELECT w.id, coalesce(nullif(w.path, ''), CASE WHEN w.key_object <> 0 THEN found END) AS path FROM w", "SELECT count(found) AS hits, count(*) AS lookups, round(count(found) / count(*), 6) AS rate FROM w").replace("ON w.id = c.id", "ON w.id = c.id WHERE w.path = ''"))
def kcb_hit_rate(spark, sf_dir):
    rows = _handles(spark, sf_dir).where("path = ''").agg(F.count("looked_up").alias("hits"), F.count("*").alias("lookups"))
    return rows.select("hits", "lookups", F.round(reports.ratio(F.col("hits"), F.col("lookups")), 6).alias("rate"))


# Fleet --------------------------------------------------------------------

@R.query(f"WITH {TEL} SELECT host, max(us) AS last_seen, max(us) < (SELECT max(us) FROM tel) - 3600000000 AS silent FROM tel GROUP BY host")
def host_liveness(spark, sf_dir):
    rows = telemetry(spark, sf_dir).groupBy("host").agg(F.max("us").alias("last_seen"))
    now = rows.agg(F.max("last_seen").alias("now"))
    return rows.crossJoin(F.broadcast(now)).select("host", "last_seen", (F.col("last_seen") < F.col("now") - 3_600_000_000).alias("silent"))


@R.query(f"WITH {TEL} SELECT host, id FROM (SELECT host, id, us, id % 500 AS seq, lag(id % 500) OVER (PARTITION BY host ORDER BY us, id) AS prev FROM tel) WHERE prev > seq")
def restarts(spark, sf_dir):
    w = Window.partitionBy("host").orderBy("us", "id")
    rows = telemetry(spark, sf_dir).withColumn("seq", F.col("id") % 500)
    return rows.withColumn("prev", F.lag("seq").over(w)).where("prev > seq").select("host", "id")


@R.query(f"WITH {TEL}, b AS (SELECT concat(host, '-', id // 50) AS batch_id, id FROM tel), r AS (SELECT *, 0 AS copy FROM b UNION ALL SELECT *, 1 FROM b WHERE (id // 50) % 7 = 0) SELECT batch_id, count(*) FILTER (copy = 0) AS accepted, count(*) FILTER (copy = 1) AS duplicate FROM r GROUP BY batch_id")
def batch_dedupe(spark, sf_dir):
    """A batch sent again is accepted but not counted again."""
    rows = telemetry(spark, sf_dir).select(F.concat_ws("-", "host", F.expr("cast(id div 50 AS string)")).alias("batch_id"), F.expr("id div 50").alias("n"), "id")
    sent = rows.withColumn("copy", F.lit(0)).unionAll(rows.where("n % 7 = 0").withColumn("copy", F.lit(1)))
    deliveries = sent.groupBy("batch_id", "copy").agg(F.count("*").alias("events"))
    first = F.col("copy") == F.min("copy").over(Window.partitionBy("batch_id"))
    return deliveries.withColumn("first", first).groupBy("batch_id").agg(F.sum(F.when(F.col("first"), F.col("events")).otherwise(0)).alias("accepted"), F.sum(F.when(F.col("first"), 0).otherwise(F.col("events"))).alias("duplicate"))


@R.query(d.FATES + ", a AS (SELECT alert AS id, rule, host, n AS c FROM fo WHERE fate = 'emit' UNION ALL SELECT alert, rule, host, n + 1 FROM fo WHERE fate = 'emit' AND alert % 3 = 0) SELECT id, any_value(rule) AS rule, max(c) AS count FROM a GROUP BY id")
def alert_merge(spark, sf_dir):
    """Restatements share the id; the larger count replaces, it is never added. Through the table that takes each epoch once."""
    rows = cut(d.fates(spark, sf_dir).where("fate = 'emit'").select(F.col("alert").alias("id"), "rule", F.col("n").cast("int").alias("count")))
    again = rows.where("id % 3 = 0").withColumn("count", F.col("count") + 1)
    table = LogTable(spark, f"{folder(spark)}/alerts-{uuid.uuid4().hex}", "id long, rule string, count int", ["id"], {"rule": lambda c: F.max_by(c, F.col("count")), "count": F.max}, fanout=2)
    for epoch, batch in ((0, rows), (1, again), (1, again), (2, rows.where("id % 5 = 0"))):
        table.append(batch, "queue", epoch)
    return table.read()


@R.query("SELECT doc_id, CASE WHEN strlen(text) > 65536 THEN 'payload too large' WHEN doc_id % 5 = 0 THEN 'schema version' WHEN trim(source) = '' THEN 'empty host' END AS reason FROM documents")
def validate_quarantine(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("source").alias("host"), F.col("text").alias("payload"), F.when(F.col("doc_id") % 5 == 0, 1).otherwise(2).alias("schema_version"))
    return src.with_reject_reason(docs).select("doc_id", F.col("reject_reason").alias("reason"))


@R.query(f"WITH {TEL}, n AS (SELECT max(us) AS now FROM tel), a AS (SELECT *, (now - us) / 86400000000.0 AS days FROM tel, n) SELECT id, CASE WHEN days <= 30 THEN 'hot' WHEN days <= 90 THEN 'warm' ELSE 'cold' END AS tier, CASE WHEN days <= 90 THEN command_line END AS command_line, CASE WHEN days <= 90 THEN query_name END AS query_name, destination_port FROM a WHERE days <= 365")
def retention_tier(spark, sf_dir):
    rows = telemetry(spark, sf_dir)
    rows = rows.crossJoin(F.broadcast(rows.agg(F.max("us").alias("now"))))  # one row
    return privacy.retained(rows, (F.col("now") - F.col("us")) / 86_400_000_000).select("id", "tier", "command_line", "query_name", "destination_port")


@R.query(f"WITH {TEL} SELECT id, CASE WHEN pid <= 4 THEN 'system process' WHEN pid = 17 THEN 'own process' WHEN lower(image) = 'c:' || chr(92) || 'windows' || chr(92) || 'system32' || chr(92) || 'certutil.exe' THEN 'own image' WHEN starts_with(lower(image), 'c:' || chr(92) || 'windows' || chr(92)) AND regexp_matches(lower(image), '(svchost|lsass|csrss|winlogon|services|smss|wininit|explorer|dwm|fontdrvhost)\\.exe$') THEN 'critical image' END AS refused FROM tel WHERE kind = 'process_start'")
def response_guard(spark, sf_dir):
    rows = telemetry(spark, sf_dir).where("kind = 'process_start'")
    why = ev.refusal(F.col("pid"), F.col("image"), F.lit(17), F.lit("C:\\Windows\\System32\\CERTUTIL.exe"), F.lit("C:/Windows/"))
    return rows.select("id", why.alias("refused"))


@R.query(f"WITH {TEL}, u AS (SELECT DISTINCT parent_pid AS pid FROM tel WHERE parent_pid IS NOT NULL UNION SELECT c_custkey FROM customer WHERE c_custkey <= 200) SELECT pid FROM u WHERE pid NOT IN (SELECT pid FROM tel WHERE kind = 'process_start')")
def unobserved(spark, sf_dir):
    """Processes that are expected (named as parents, or in the inventory) and were never seen to start."""
    rows = telemetry(spark, sf_dir)
    inventory = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey <= 200").select(F.col("c_custkey").cast("bigint").alias("pid"))
    universe = rows.where("parent_pid IS NOT NULL").select(F.col("parent_pid").cast("bigint").alias("pid")).union(inventory)
    return reports.unobserved(universe, rows.where("kind = 'process_start'"), "pid")


@R.query(f"WITH {_RAW} SELECT host, CAST(count(*) AS BIGINT) AS raw, count(*) FILTER (shape IS NOT NULL AND failure IS NULL) AS scored, round(count(*) FILTER (shape IS NOT NULL AND failure IS NULL) / ((max(us) - min(us)) / 1e6), 6) AS per_second, round(count(*) FILTER (shape IS NOT NULL AND failure IS NULL) / count(*), 6) AS coverage FROM sh GROUP BY host")
def throughput(spark, sf_dir):
    rows = reports.throughput(shaped(spark, sf_dir))
    return rows.withColumn("per_second", F.round("per_second", 6)).withColumn("coverage", F.round("coverage", 6))


@R.query(f"WITH {TEL}, d AS (SELECT concat(host, '-', id // 50) AS batch_id, 0 AS delivery, count(*) AS events FROM tel GROUP BY ALL), a AS (SELECT DISTINCT concat(host, '-', id // 50) AS batch_id, id % 1000 AS alert_id FROM tel WHERE kind = 'process_start'), n AS (SELECT alert_id, min(batch_id) AS batch_id FROM a WHERE alert_id % 10 <> 3 GROUP BY alert_id), c AS (SELECT batch_id, count(*) AS n FROM n GROUP BY batch_id) SELECT batch_id, delivery, events AS accepted_events, CAST(coalesce(n, 0) AS BIGINT) AS accepted_alerts, false AS duplicate FROM d LEFT JOIN c USING (batch_id) UNION ALL SELECT batch_id, 1, 0, 0, true FROM d WHERE events % 2 = 0")
def ingest_receipt(spark, sf_dir):
    """Receipts of batches, some of which are sent twice, with alerts of which some are known."""
    rows = telemetry(spark, sf_dir).withColumn("batch_id", F.concat_ws("-", "host", F.expr("cast(id div 50 AS string)")))
    first = rows.groupBy("batch_id").agg(F.count("*").alias("events")).withColumn("delivery", F.lit(0))
    sent = first.unionByName(first.where("events % 2 = 0").withColumn("delivery", F.lit(1)))
    alerts = rows.where("kind = 'process_start'").select("batch_id", (F.col("id") % 1000).alias("alert_id"))
    return src.receipts(sent, alerts, alerts.where("alert_id % 10 = 3").select("alert_id"))


@R.query("SELECT n.n_nationkey AS site, a.name AS action, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY a.rank, a.severity) AS step FROM nation n JOIN (VALUES ('isolate host', 5, 5, false), ('freeze process', 4, 4, true), ('apply compensating control', 3, 3, true), ('raise alert', 2, 2, true)) a(name, rank, severity, reversible) ON a.severity <= n.n_regionkey + 2 AND a.reversible")
def admissible(spark, sf_dir):
    """Each site's ladder of actions under its own cap of severity."""
    table = spark.createDataFrame([(name, kind, severity, reversible) for _, name, kind, severity, reversible, _ in ev.LADDER], "action string, kind string, severity int, reversible boolean")
    sites = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").alias("site"), (F.col("n_regionkey") + 2).alias("cap"))
    rows = ev.admissible(sites.crossJoin(F.broadcast(table)), F.col("cap"))  # four actions
    return rows.select("site", "action", F.row_number().over(Window.partitionBy("site").orderBy("rank", "severity")).alias("step"))


@R.query(f"WITH {TEL} SELECT id, array_to_string(list_transform(string_split(script_text, ' '), lambda t: CASE WHEN contains(t, '/') OR contains(t, chr(92)) THEN CASE WHEN regexp_extract(lower(regexp_extract(t, '([^\\\\/]*)$', 1)), '(\\.[A-Za-z0-9]{{1,8}})$', 1) = '' THEN 'unknown' ELSE regexp_extract(lower(regexp_extract(t, '([^\\\\/]*)$', 1)), '(\\.[A-Za-z0-9]{{1,8}})$', 1) END ELSE t END), ' ') AS text FROM tel WHERE kind = 'script_block'")
def minimise(spark, sf_dir):
    return telemetry(spark, sf_dir).where("kind = 'script_block'").select("id", sc.minimise(F.col("script_text")).alias("text"))
