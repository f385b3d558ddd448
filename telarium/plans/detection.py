"""Queries of the detection chain: rules, SIGMA, facts, evidence, decisions, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telarium.checkpoint import cut
from telarium.functions import scalars
from telarium.operators import evidence as ev
from telarium.operators import facts, rule_index, rules, sigma
from telarium.plans.register import TEL, Registry
from telarium.sources.telemetry import stored, telemetry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: The gaps between events of one user are hours here.
HALF_LIFE_S, WINDOW_US = 86_400.0, 86_400_000_000


def _like(column: str, needles, end: bool = False) -> str:
    test = "ends_with(lower({c}), '{n}')" if end else "contains(lower({c}), '{n}')"
    return "(" + " OR ".join(test.format(c=column, n=n) for n in needles) + ")"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


_BASE = r"lower(regexp_extract({c}, '([^\\/]*)$', 1))"
_STEM = r"regexp_replace(" + _BASE + r", '\.[^.]*$', '')"
base, stem = (lambda c: _BASE.format(c=c)), (lambda c: _STEM.format(c=c))
_N = " + ".join(f"cast(split_part(destination_ip, '.', {i + 1}) AS bigint) * {256 ** (3 - i)}" for i in range(4))
_ROUTABLE = "NOT (" + " OR ".join(f"({_N}) BETWEEN {scalars._number(a) // 2 ** (32 - b) * 2 ** (32 - b)} AND {scalars._number(a) // 2 ** (32 - b) * 2 ** (32 - b) + 2 ** (32 - b) - 1}" for a, b in scalars.UNROUTABLE) + ")"
_PORT = f"destination_port IN {_in(rules.PORTS)} AND {_ROUTABLE}"
_BLOB = "(" + " OR ".join(rf"(instr(lower(script_text), '{m}') > 0 AND regexp_matches(regexp_extract(ltrim(substr(lower(script_text), instr(lower(script_text), '{m}') + {len(m)})), '^[^\s''" + '"' + r"]*'), '^[a-z0-9+/=]{20,}$'))" for m in rules.BLOB_MARKERS) + ")"
_SPAWNS = f"({_like('command_line', rules.INTERPRETERS)} OR {_like('command_line', rules.LOLBINS)})"
_REMOTE = "(coalesce(is_local = false, false) OR coalesce(client_machine NOT IN ('', '.'), false))"
_CODE = _like("coalesce(consumer, '')", rules.CODE_CONSUMERS)
_TASK = "(contains(lower(task_name), 'microsoft') OR contains(lower(task_name), 'windows') OR contains(lower(task_name), 'defender'))"
_HIDDEN = _like("command_line", rules.HIDDEN)

#: rule -> (kind, predicate, hit, miss) in SQL.
RULE_SQL = {
    "encoded_powershell": ("process_start", f"{base('image')} IN ('powershell.exe', 'pwsh.exe') AND {_like('command_line', rules.ENCODED)}", f"CASE WHEN {_HIDDEN} THEN 0.92 ELSE 0.72 END", f"CASE WHEN {_HIDDEN} THEN 0.01 ELSE 0.02 END"),
    "interpreter_from_host_app": ("process_start", f"{base('image')} IN {_in(rules.INTERPRETERS)} AND {base('parent_image')} IN {_in(rules.HOST_APPS)}", "0.55", "0.04"),
    "masquerading_outside_system32": ("process_start", f"{stem('image')} IN {_in(rules.SYSTEM_NAMES)} AND {_like('image', rules.WRITABLE)}", "0.88", "0.015"),
    "lolbin_remote_fetch": ("process_start", f"{stem('image')} IN {_in(rules.LOLBINS)} AND {_like('command_line', rules.FETCH)}", "0.68", "0.025"),
    "run_key_persistence": ("registry_set", _like("key_path", rules.RUN_KEYS), "0.62", "0.008"),
    "high_abuse_tld": ("dns_query", _like("query_name", rules.TLDS, True), "0.3", "0.07"),
    "novel_binary_in_writable_location": ("process_start", f"sighting = 1 AND {_like('image', rules.WRITABLE)}", "0.45", "0.03"),
    "process_fanout_burst": ("process_start", "siblings >= 8", "CASE WHEN siblings >= 32 THEN 0.5 ELSE 0.25 END", "CASE WHEN siblings >= 32 THEN 0.02 ELSE 0.06 END"),
    "script_block_encoded_command": ("script_block", f"({_like('script_text', rules.SCRIPT_ENCODED)} OR {_BLOB})", "0.8", "0.015"),
    "script_block_obfuscated": ("script_block", _like("script_text", rules.OBFUSCATION), "0.55", "0.03"),
    "script_block_remote_fetch": ("script_block", _like("script_text", rules.REMOTE), "0.45", "0.05"),
    "script_block_defence_evasion": ("script_block", _like("script_text", rules.EVASION), "0.65", "0.005"),
    "wmi_process_creation": ("wmi_process", "true", f"CASE WHEN {_SPAWNS} AND {_REMOTE} THEN 0.9 WHEN {_SPAWNS} THEN 0.7 WHEN {_REMOTE} THEN 0.55 ELSE 0.35 END", f"CASE WHEN {_SPAWNS} AND {_REMOTE} THEN 0.01 WHEN {_SPAWNS} THEN 0.02 WHEN {_REMOTE} THEN 0.015 ELSE 0.04 END"),
    "wmi_permanent_subscription": ("wmi_subscription", "true", f"CASE WHEN {_CODE} THEN 0.85 ELSE 0.45 END", f"CASE WHEN {_CODE} THEN 0.008 ELSE 0.03 END"),
    "scheduled_task_registered": ("task_registered", "NOT starts_with(lower(task_name), chr(92) || 'microsoft' || chr(92))", f"CASE WHEN {_TASK} THEN 0.6 ELSE 0.4 END", f"CASE WHEN {_TASK} THEN 0.02 ELSE 0.035 END"),
    "unsigned_image_from_writable_location": ("image_load", f"signed = false AND {_like('path', rules.WRITABLE)}", "0.42", "0.03"),
    "executable_dropped_in_writable_location": ("file_create", f"{_like('path', rules.EXECUTABLE, True)} AND {_like('path', rules.WRITABLE)}", "0.35", "0.04"),
    "executable_deleted_from_staging_location": ("file_delete", f"{_like('path', rules.EXECUTABLE, True)} AND {_like('path', rules.STAGING)}", "0.3", "0.08"),
    "ransomware_extension_on_rename": ("file_rename", _like("new_path", rules.RANSOM, True), "0.35", "0.02"),
    "connect_to_implant_default_port": ("network_connect", _PORT, "0.4", "0.03"),
    "large_transfer_to_implant_port": ("network_disconnect", f"{_PORT} AND coalesce(bytes_sent, 0) >= 8388608", "0.3", "0.015"),
    "exploitation_crash_exit_code": ("process_exit", f"(cast(exit_code AS bigint) & 4294967295) IN {_in(rules.CRASHES)}", "0.15", "0.02"),
}

#: Process starts with the tracked parent, sighting and siblings; other events with nulls.
FACTS = f"""WITH RECURSIVE {TEL},
ps AS (SELECT * FROM tel WHERE kind = 'process_start'),
rec AS (SELECT host, pid AS key, us, id, id AS parent_id, image AS parent_image FROM ps
  UNION ALL SELECT host, pid, us, id, NULL, NULL FROM tel WHERE kind = 'process_exit'),
cand AS (SELECT ps.id, rec.parent_id, rec.parent_image, row_number() OVER (PARTITION BY ps.id ORDER BY rec.us DESC, rec.id DESC) AS rn
  FROM ps JOIN rec ON rec.host = ps.host AND rec.key = ps.parent_pid AND (rec.us < ps.us OR rec.us = ps.us AND rec.id < ps.id)),
par AS (SELECT id, parent_id, parent_image FROM cand WHERE rn = 1),
fs AS (SELECT ps.*, par.parent_id, par.parent_image,
  row_number() OVER (PARTITION BY host, lower(image) ORDER BY us, ps.id) AS sighting,
  CASE WHEN par.parent_id IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY host, par.parent_id ORDER BY us, ps.id) - 1 END AS siblings
  FROM ps LEFT JOIN par ON ps.id = par.id),
f AS (SELECT * FROM fs UNION ALL BY NAME SELECT *, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS VARCHAR) AS parent_image, CAST(NULL AS BIGINT) AS sighting, CAST(NULL AS BIGINT) AS siblings FROM tel WHERE kind <> 'process_start')"""


def _detail(name: str) -> str:
    """A rule's text in DuckDB, with the program of a command line."""
    program = r"""left(regexp_replace(string_split_regex(trim(command_line), '\s+')[1], '^"+|"+$', '', 'g'), 80)"""
    return rules.DETAILS[name].replace("{command}", program).replace("AS string", "AS varchar")


def _rule_sql(name: str, order: int) -> str:
    kind, test, hit, miss = RULE_SQL[name]
    return f"SELECT id, host, us, pid, {order} AS ord, '{name}' AS rule, cast({hit} AS double) AS hit, cast({miss} AS double) AS miss, '{rules.TECHNIQUES[name]}' AS technique, {_detail(name)} AS detail FROM f WHERE kind = '{kind}' AND {test}"


def minimised_sql(column: str) -> str:
    """Path-like words become their kind of file."""
    last = r"regexp_extract(lower(regexp_extract(t, '([^\\/]*)$', 1)), '(\.[A-Za-z0-9]{1,8})$', 1)"
    return f"array_to_string(list_transform(string_split({column}, ' '), lambda t: CASE WHEN contains(t, '/') OR contains(t, chr(92)) THEN CASE WHEN {last} = '' THEN 'unknown' ELSE {last} END ELSE t END), ' ')"


_SIGMA_HITS = r"""SELECT id, host, us, pid, 1000 AS ord, 'shell-from-document' AS rule, 0.75 AS hit, 0.01 AS miss, 'T1204.002' AS technique, 'Shell started by a document' AS detail FROM tel WHERE kind = 'process_start' AND (ends_with(lower(reported_parent), chr(92) || 'winword.exe') OR ends_with(lower(reported_parent), chr(92) || 'excel.exe')) AND (ends_with(lower(image), chr(92) || 'cmd.exe') OR ends_with(lower(image), chr(92) || 'powershell.exe'))
  UNION ALL SELECT id, host, us, pid, 1001, 'user-unpacked', 0.5, 0.02, 'T1204.002', 'Program unpacked by a user' FROM tel WHERE kind = 'file_create' AND starts_with(lower(path), 'c:' || chr(92) || 'users' || chr(92)) AND (ends_with(lower(path), '.exe') OR ends_with(lower(path), '.scr'))
  UNION ALL SELECT id, host, us, pid, 1002, 'port-or-range', 0.75, 0.01, 'T1571', 'Port or range' FROM tel WHERE kind = 'network_connect' AND (starts_with(destination_ip, '93.184.') OR starts_with(destination_ip, '8.8.8.')) AND destination_port >= 4444
  UNION ALL SELECT id, host, us, pid, 1003, 'wildcard-name', 0.15, 0.1, 'TA0000', 'Wildcard name' FROM tel WHERE kind = 'dns_query' AND (((regexp_matches(query_name, '^[hH].\..*$') OR ends_with(query_name, '.TOP') OR (contains(lower(query_name), 'h') AND contains(lower(query_name), '.o'))) AND NOT regexp_matches(query_name, '^[hH].\..*$')) OR ends_with(query_name, '.TOP'))
  UNION ALL SELECT id, host, us, pid, 1004, 'no-value-name', 0.9, 0.005, 'T1547.001', 'No value name' FROM tel WHERE kind = 'registry_set' AND contains(lower(key_path), chr(92) || 'run')""".replace("\\\\", "\\")
FINDINGS = FACTS + ",\nfind AS (" + " UNION ALL ".join(_rule_sql(n, i) for i, n in enumerate(RULE_SQL)) + " UNION ALL " + _SIGMA_HITS + ")"
EVIDENCE = FINDINGS + f""",
ev AS (SELECT id, host, us, pid AS key, sum(greatest(-20, least(20, ln(hit / miss)))) AS gain, max(struct_pack(r := ln(hit / miss), o := ord, n := rule, t := technique)) AS best, count(*) AS n_findings,
  string_agg(technique || ': ' || coalesce({minimised_sql("detail")}, ''), '; ' ORDER BY ord) AS body FROM find GROUP BY id, host, us, pid),
od AS (SELECT a.id, a.host, a.us, a.key, any_value(a.n_findings) AS n_findings, any_value(a.best).n AS rule, any_value(a.best).t AS technique, any_value(a.body) AS body, sum(b.gain * power(2.0, -(a.us - b.us) / {HALF_LIFE_S * 1e6})) AS log_odds
  FROM ev a JOIN ev b ON a.host = b.host AND a.key = b.key AND (b.us < a.us OR b.us = a.us AND b.id <= a.id) GROUP BY a.id, a.host, a.us, a.key),
sc AS (SELECT *, 1 / (1 + exp(-(ln(0.01 / 0.99) + log_odds))) AS p FROM od),
de AS (SELECT *, 1 - p < 20 * p AS acts,
  CASE WHEN p >= 0.9 THEN 'critical' WHEN p >= 0.6 THEN 'high' WHEN p >= 0.3 THEN 'medium' WHEN p >= 0.1 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN p >= 0.9 THEN 4 WHEN p >= 0.6 THEN 3 WHEN p >= 0.3 THEN 2 WHEN p >= 0.1 THEN 1 ELSE 0 END AS rank,
  CASE WHEN p >= 0.995 THEN 'isolate host' WHEN p >= 0.98 THEN 'freeze process' WHEN p >= 0.9 THEN 'apply compensating control' ELSE 'raise alert' END AS action,
  CASE WHEN p >= 0.9 THEN 'approval' ELSE 'auto' END AS verdict FROM sc)"""
FATES = EVIDENCE + f""",
fi AS (SELECT host, rule, us, id, max(rank) OVER w AS rank, row_number() OVER w AS rn FROM de WHERE acts WINDOW w AS (PARTITION BY host, rule ORDER BY us, id)),
fo AS (
  SELECT host, rule, us, id, rank, rn, CASE WHEN rank < 2 THEN 'below_floor' ELSE 'emit' END AS fate,
    CASE WHEN rank < 2 THEN 1 ELSE 0 END AS folded, CASE WHEN rank < 2 THEN 0 ELSE 1 END AS n, CASE WHEN rank < 2 THEN NULL ELSE us END AS last, CASE WHEN rank < 2 THEN NULL ELSE id END AS alert FROM fi WHERE rn = 1
  UNION ALL
  SELECT b.host, b.rule, b.us, b.id, b.rank, b.rn,
    CASE WHEN b.rank < 2 THEN 'below_floor' WHEN a.last IS NULL OR b.us - a.last >= {WINDOW_US} THEN 'emit' ELSE 'fold' END,
    CASE WHEN b.rank >= 2 AND (a.last IS NULL OR b.us - a.last >= {WINDOW_US}) THEN 0 ELSE a.folded + 1 END,
    CASE WHEN b.rank >= 2 AND (a.last IS NULL OR b.us - a.last >= {WINDOW_US}) THEN a.folded + 1 ELSE 0 END,
    CASE WHEN b.rank >= 2 AND (a.last IS NULL OR b.us - a.last >= {WINDOW_US}) THEN b.us ELSE a.last END,
    CASE WHEN b.rank >= 2 AND (a.last IS NULL OR b.us - a.last >= {WINDOW_US}) THEN b.id ELSE a.alert END
  FROM fo a JOIN fi b ON a.host = b.host AND a.rule = b.rule AND b.rn = a.rn + 1)"""


def _one_rule(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rule = next(r for r in rules.rules() if r.name == name)
        events = telemetry(spark, sf_dir)
        events = facts.enriched(events) if rule.needs_facts else events
        return rules.findings(events.where(F.col("kind") == rule.kind), [rule]).select("id", "host", "us", "pid", "rule", "hit", "miss")

    return run


for _i, _name in enumerate(RULE_SQL):
    R.add(f"rule_{_name}", _one_rule(_name), FACTS + f" SELECT * EXCLUDE (ord, technique, detail) FROM ({_rule_sql(_name, _i)})")


def all_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the native rules and of the SIGMA rules, which count alike from here on."""
    events = stored(spark, "telemetry", sf_dir, lambda: telemetry(spark, sf_dir))
    good, _ = sigma.load(SIGMA_RULES)
    return rules.findings(facts.enriched(events)).unionByName(sigma.hits(events, good))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.evidence(all_findings(spark, sf_dir), HALF_LIFE_S)


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.decisions(scored(spark, sf_dir))


def fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.coalesced(decided(spark, sf_dir), WINDOW_US)


@R.query(FINDINGS + " SELECT id, host, us, pid, cast(ord AS INTEGER) AS ord, rule, hit, miss FROM find")
def rule_findings_all(spark, sf_dir):
    return all_findings(spark, sf_dir).select("id", "host", "us", "pid", "ord", "rule", "hit", "miss")


@R.query(f"WITH {TEL} SELECT id, host, us, kind, pid FROM tel")
def src_telemetry(spark, sf_dir):
    return telemetry(spark, sf_dir).select("id", "host", "us", "kind", "pid")


@R.query(FACTS + " SELECT id, parent_id, parent_image FROM fs")
def parent_asof(spark, sf_dir):
    return facts.parents(telemetry(spark, sf_dir)).select("id", "parent_id", "parent_image")


@R.query(FACTS + " SELECT id, CAST(sighting AS INTEGER) AS sighting, sighting = 1 AS novel, round(1.0 / sighting, 6) AS score FROM fs")
def first_sighting(spark, sf_dir):
    return facts.with_facts(telemetry(spark, sf_dir)).select("id", "sighting", F.col("image_is_novel").alias("novel"), F.round(1 / F.col("sighting"), 6).alias("score"))


@R.query(FACTS + " SELECT id, CAST(siblings AS INTEGER) AS siblings FROM fs")
def siblings(spark, sf_dir):
    return facts.with_facts(telemetry(spark, sf_dir)).select("id", "siblings")


@R.query(FACTS + " SELECT DISTINCT parent_image AS src, image AS dst FROM fs WHERE parent_id IS NOT NULL")
def process_edges(spark, sf_dir):
    return facts.parents(telemetry(spark, sf_dir)).where("parent_id IS NOT NULL").select(F.col("parent_image").alias("src"), F.col("image").alias("dst")).distinct()


@R.query(FACTS + """, e AS (SELECT id, us, host || ':' || coalesce(parent_image, '<unobserved>') AS src, host || ':' || image AS dst FROM fs),
n AS (SELECT node, min((us, id)) AS first FROM (SELECT src AS node, us, id FROM e UNION ALL SELECT dst, us, id FROM e) GROUP BY node), k AS (SELECT e.*, min((us, id)) OVER (PARTITION BY src, dst) AS fe FROM e)
SELECT k.id, CAST(CASE WHEN fe < (k.us, k.id) THEN 0 WHEN a.first < (k.us, k.id) AND b.first < (k.us, k.id) THEN 0.5 ELSE 1 END AS DOUBLE) AS score FROM k JOIN n a ON a.node = src JOIN n b ON b.node = dst""")
def process_edge_novelty(spark, sf_dir):
    return facts.edge_novelty(facts.process_edges(telemetry(spark, sf_dir))).select("id", "score")


@R.query(EVIDENCE + " SELECT id, host, key, us, CAST(n_findings AS BIGINT) AS n_findings, round(log_odds, 6) AS log_odds FROM sc")
def evidence_decay(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "host", "key", "us", "n_findings", F.round("log_odds", 6).alias("log_odds"))


@R.query(EVIDENCE + " SELECT id, round(p, 6) AS p FROM sc")
def posterior(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round("p", 6).alias("p"))


@R.query(EVIDENCE + " SELECT id, rule FROM sc")
def primary_finding(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "rule")


@R.query(EVIDENCE + " SELECT id, acts, severity, action, verdict FROM de")
def decide(spark, sf_dir):
    return decided(spark, sf_dir).select("id", "acts", "severity", "action", "verdict")


@R.query(EVIDENCE + " SELECT severity, count(*) AS n FROM de GROUP BY severity")
def severity(spark, sf_dir):
    return decided(spark, sf_dir).groupBy("severity").agg(F.count("*").alias("n"))


@R.query(EVIDENCE + " SELECT action, verdict, count(*) AS n FROM de WHERE acts GROUP BY ALL")
def action_choice(spark, sf_dir):
    return decided(spark, sf_dir).where("acts").groupBy("action", "verdict").agg(F.count("*").alias("n"))


@R.query(EVIDENCE + """ SELECT host, us, id, action, CASE WHEN action = 'raise alert' THEN 'auto' WHEN action = 'isolate host' THEN 'approval' WHEN action = 'freeze process' THEN 'approval' ELSE 'approval' END AS verdict,
  CASE WHEN action = 'raise alert' THEN 'not disruptive' WHEN action IN ('isolate host', 'freeze process', 'apply compensating control') THEN 'exceeds max_auto severity' END AS reason FROM de WHERE acts""")
def govern_auto(spark, sf_dir):
    return ev.audit(ev.decisions(scored(spark, sf_dir), autonomy="auto"))


@R.query(EVIDENCE + " SELECT host, us, id, action, verdict, CASE verdict WHEN 'auto' THEN 'not disruptive' ELSE 'approval autonomy level' END AS reason FROM de WHERE acts")
def audit(spark, sf_dir):
    return ev.audit(decided(spark, sf_dir))


@R.query(FATES + " SELECT host, rule, us, id, fate, CAST(n AS BIGINT) AS n, CAST(rank AS INTEGER) AS rank, alert FROM fo")
def alert_coalesce(spark, sf_dir):
    return fates(spark, sf_dir)


@R.query(FATES + """, la AS (SELECT host, rule, max(alert) FILTER (fate = 'emit' AND us = m) AS alert FROM (SELECT *, max(us) FILTER (fate = 'emit') OVER (PARTITION BY host, rule) AS m FROM fo) GROUP BY host, rule)
  SELECT host, rule, alert, CAST(sum(n) + count(*) FILTER (fate = 'fold') AS BIGINT) AS n, CAST(max(rank) AS INTEGER) AS rank FROM fo JOIN la USING (host, rule, alert) GROUP BY host, rule, alert HAVING count(*) FILTER (fate = 'fold') > 0""")
def alert_restate(spark, sf_dir):
    return ev.restated(fates(spark, sf_dir))


@R.query(FATES + " SELECT host, rule, count(*) AS firings, count(*) FILTER (fate = 'emit') AS alerts, CAST(max(rank) AS INTEGER) AS severity_rank, max(us) AS last_seen_us FROM fo GROUP BY host, rule HAVING count(*) FILTER (fate = 'emit') > 0")
def alert_queue(spark, sf_dir):
    return ev.alert_queue(fates(spark, sf_dir))


@R.query(FATES + ", q AS (SELECT host, rule, max(rank) AS r FROM fo GROUP BY host, rule HAVING count(*) FILTER (fate = 'emit') > 0) SELECT s.severity, count(q.r) AS detections FROM (VALUES (0, 'info'), (1, 'low'), (2, 'medium'), (3, 'high'), (4, 'critical')) s(r, severity) LEFT JOIN q ON q.r = s.r GROUP BY s.severity")
def queue_by_severity(spark, sf_dir):
    return ev.by_severity(ev.alert_queue(fates(spark, sf_dir)))


def _alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = cut(decided(spark, sf_dir))
    return ev.alert_rows(d, ev.coalesced(d, WINDOW_US), {r["id"]: r["title"] for r in SIGMA_RULES})


@R.query(FATES + """ SELECT concat_ws('-', fo.host, fo.id) AS alert_id, fo.rule, n AS count, technique,
  CASE WHEN fo.rank = 4 THEN 'critical' WHEN fo.rank = 3 THEN 'high' WHEN fo.rank = 2 THEN 'medium' WHEN fo.rank = 1 THEN 'low' ELSE 'info' END AS severity,
  printf('%s (p=%.4f, n=%d) via %s; %s', action, p, n, fo.rule, body) AS description, CASE WHEN fo.rule = 'shell-from-document' THEN 'Shell started by a document' || CASE WHEN verdict = 'approval' THEN ' \u2014 awaiting approval' ELSE '' END END AS sigma_title
  FROM fo JOIN de USING (id) WHERE fate = 'emit'""")
def alert_rows(spark, sf_dir):
    rows = _alerts(spark, sf_dir)
    return rows.select("alert_id", "rule", F.col("count").cast("int").alias("count"), "technique", "severity", "description", F.when(F.col("rule") == "shell-from-document", F.col("title")).alias("sigma_title"))


@R.query(FATES + " SELECT fo.rule, count(*) AS alerts FROM fo WHERE fate = 'emit' AND fo.rule IN ('shell-from-document', 'user-unpacked', 'port-or-range', 'wildcard-name', 'no-value-name') GROUP BY fo.rule")
def sigma_in_alerts(spark, sf_dir):
    """Alerts whose primary finding is a SIGMA rule's."""
    emitted = fates(spark, sf_dir).where("fate = 'emit'")
    return emitted.where(F.col("rule").isin([r["id"] for r in SIGMA_RULES])).groupBy("rule").agg(F.count("*").alias("alerts"))


@R.query(FATES + " SELECT concat_ws('-', fo.host, fo.id) AS alert_id, tel.pid, 'suspend' AS response, false AS automatic FROM fo JOIN de USING (id) JOIN tel USING (id) WHERE fate = 'emit' AND action = 'freeze process'")
def response_plan(spark, sf_dir):
    return ev.response_plan(_alerts(spark, sf_dir))


@R.query(FATES + " SELECT host, rule, alert, id, fate, row_number() OVER (PARTITION BY host, rule, alert ORDER BY us, id) AS place FROM fo WHERE alert IS NOT NULL")
def alert_drilldown(spark, sf_dir):
    """The firings behind each alert, one row each, in order."""
    place = F.row_number().over(Window.partitionBy("host", "rule", "alert").orderBy("us", "id"))
    return fates(spark, sf_dir).where("alert IS NOT NULL").select("host", "rule", "alert", "id", "fate", place.alias("place"))


# SIGMA --------------------------------------------------------------------

#: Rules of the production set.
SIGMA_RULES = [
    {"title": "Shell started by a document", "id": "shell-from-document", "level": "high", "tags": ["attack.execution", "attack.t1204.002"], "logsource": {"category": "process_creation", "product": "windows"}, "detection": {"opener": {"ParentImage|endswith": ["\\winword.exe", "\\excel.exe"]}, "shell": [{"Image|endswith": "\\cmd.exe"}, {"Image|endswith": "\\powershell.exe"}], "condition": "opener and shell"}},
    {"title": "Program unpacked by a user", "id": "user-unpacked", "level": "medium", "tags": ["attack.t1204.002"], "logsource": {"category": "file_event"}, "detection": {"home": {"TargetFilename|startswith": "C:\\Users\\"}, "program": {"TargetFilename|endswith": [".exe", ".scr"]}, "condition": "all of them"}},
    {"title": "Port or range", "id": "port-or-range", "level": "high", "tags": ["attack.t1571"], "logsource": {"category": "network_connection"}, "detection": {"range": {"DestinationIp|cidr": ["93.184.0.0/16", "8.8.8.0/24"]}, "port": {"DestinationPort|gte": 4444}, "condition": "range and port"}},
    {"title": "Wildcard name", "id": "wildcard-name", "level": "informational", "tags": [], "logsource": {"category": "dns_query"}, "detection": {"a": {"QueryName": "h?.*"}, "b": {"QueryName|endswith|cased": ".TOP"}, "c": {"QueryName|contains|all": ["h", ".o"]}, "condition": "1 of them and not a or b"}},
    {"title": "No value name", "id": "no-value-name", "level": "critical", "tags": ["attack.t1547.001"], "logsource": {"category": "registry_set"}, "detection": {"run": {"TargetObject|contains": "\\run"}, "gone": {"CommandLine": None}, "condition": "run and gone"}},
    {"title": "Refused", "id": "refused", "level": "low", "logsource": {"category": "process_creation"}, "detection": {"a": {"CommandLine|re": "x.*"}, "condition": "a"}},
    {"title": "Wrong source", "id": "wrong-source", "logsource": {"service": "security"}, "detection": {"a": {"Image": "x"}, "condition": "a"}},
]
@R.query(f"WITH {TEL}, hit AS ({_SIGMA_HITS}) SELECT id, rule, technique, cast(hit AS double) AS hit, cast(miss AS double) AS miss FROM hit")
def sigma_hits(spark, sf_dir):
    """By the index of rules, whose plan doesn't grow with them."""
    table, _ = rule_index.load(spark, SIGMA_RULES)
    return rule_index.hits(stored(spark, "telemetry", sf_dir, lambda: telemetry(spark, sf_dir)), table).select("id", "rule", "technique", "hit", "miss")


@R.query(f"""WITH {TEL}, hit AS ({_SIGMA_HITS}), c AS (SELECT rule, count(*) AS fired FROM hit GROUP BY rule)
  SELECT t.*, coalesce(fired, 0) AS fired FROM (VALUES ('shell-from-document', 'high', 'T1204.002', true), ('user-unpacked', 'medium', 'T1204.002', true), ('port-or-range', 'high', 'T1571', true), ('wildcard-name', 'informational', 'TA0000', true), ('no-value-name', 'critical', 'T1547.001', true)) t(rule, level, technique, can_fire) LEFT JOIN c USING (rule)""")
def sigma_rule_catalog(spark, sf_dir):
    """The rules table beside how often each fired."""
    good, bad = sigma.load(SIGMA_RULES)
    table, _ = sigma.catalog(spark, good, bad)
    fired = sigma.hits(telemetry(spark, sf_dir), good).groupBy("rule").agg(F.count("*").alias("fired"))
    return table.join(F.broadcast(fired), "rule", "left").select("rule", "level", "technique", "can_fire", F.coalesce("fired", F.lit(0)).alias("fired"))


def _sigma_test(name: str, category: str, selection: dict, condition: str, where: str, kind: str) -> None:
    def run(spark, sf_dir):
        rule = sigma.compile_rule({"title": name, "logsource": {"category": category}, "detection": {**selection, "condition": condition}})
        return sigma.hits(telemetry(spark, sf_dir), [rule]).select("id")

    R.add(name, run, f"WITH {TEL} SELECT id FROM tel WHERE kind = '{kind}' AND {where}")


_sigma_test("sigma_equals", "dns_query", {"a": {"QueryName": ["h2.org", "H3.top"]}}, "a", "lower(query_name) IN ('h2.org', 'h3.top')", "dns_query")
_sigma_test("sigma_wildcard", "dns_query", {"a": {"QueryName|contains": "?1.*o"}}, "a", r"regexp_matches(lower(query_name), '.1\..*o')", "dns_query")
_sigma_test("sigma_affix", "file_event", {"a": {"TargetFilename|startswith": "c:\\users"}, "b": {"TargetFilename|endswith": ".EXE"}}, "a and b", "starts_with(lower(path), 'c:' || chr(92) || 'users') AND ends_with(lower(path), '.exe')", "file_create")
_sigma_test("sigma_cased", "dns_query", {"a": {"QueryName|endswith|cased": ".ORG"}}, "a", "ends_with(query_name, '.ORG')", "dns_query")
_sigma_test("sigma_all", "process_creation", {"a": {"CommandLine|contains|all": ["-enc", "hidden"]}}, "a", "contains(lower(command_line), '-enc') AND contains(lower(command_line), 'hidden')", "process_start")
_sigma_test("sigma_cidr", "network_connection", {"a": {"DestinationIp|cidr": ["10.0.0.0/8", "100.64.0.0/10", "bad/99"]}}, "a", "(starts_with(destination_ip, '10.') OR starts_with(destination_ip, '100.64.'))", "network_connect")
_sigma_test("sigma_numeric", "network_connection", {"a": {"DestinationPort|gt": 443}, "b": {"DestinationPort|lte": 4444}}, "a and b", "destination_port > 443 AND destination_port <= 4444", "network_connect")
_sigma_test("sigma_fieldref", "process_creation", {"a": {"ProcessId|fieldref": "ParentProcessId"}}, "a", "pid = parent_pid", "process_start")
_sigma_test("sigma_absent", "process_creation", {"a": {"CommandLine": None}}, "a", "command_line IS NULL", "process_start")
_sigma_test("sigma_groups", "process_creation", {"a": [{"Image|endswith": "cmd.exe"}, {"Image|endswith": "certutil.exe", "CommandLine|contains": "http"}]}, "a", "(ends_with(lower(image), 'cmd.exe') OR (ends_with(lower(image), 'certutil.exe') AND contains(lower(command_line), 'http')))", "process_start")
_sigma_test("sigma_quantifier", "dns_query", {"x1": {"QueryName|contains": "1"}, "x2": {"QueryName|contains": "2"}, "x3": {"QueryName|endswith": ".org"}}, "2 of x*", "cast(contains(query_name, '1') AS int) + cast(contains(query_name, '2') AS int) + cast(ends_with(lower(query_name), '.org') AS int) >= 2", "dns_query")
_sigma_test("sigma_more_fields", "process_creation", {"a": {"ParentImage|contains": "office", "User|startswith": "user"}, "b": {"EventID": 1, "Provider_Name|endswith": "process"}}, "a and b", "contains(lower(reported_parent), 'office') AND starts_with(lower(user_name), 'user')", "process_start")
_sigma_test("sigma_not_absent", "process_creation", {"a": {"CommandLine|contains": "http"}}, "not a", "NOT coalesce(contains(lower(command_line), 'http'), false)", "process_start")


@R.query(f"""WITH {TEL} SELECT id, CASE kind WHEN 'process_start' THEN 'process_creation' WHEN 'process_exit' THEN 'process_termination' WHEN 'file_create' THEN 'file_event' WHEN 'network_connect' THEN 'network_connection' WHEN 'script_block' THEN 'ps_script' ELSE kind END AS category,
  CASE WHEN kind = 'registry_set' THEN concat_ws(chr(92), key_path, value_name) END AS target_object, CASE WHEN kind = 'process_exit' THEN cast(exit_code AS bigint) & 4294967295 END AS exit_code
  FROM tel WHERE kind IN ('process_start', 'process_exit', 'image_load', 'registry_set', 'file_create', 'file_delete', 'file_rename', 'dns_query', 'network_connect', 'script_block')""")
def sigma_view(spark, sf_dir):
    return sigma.view(telemetry(spark, sf_dir)).select("id", "category", F.col("TargetObject").alias("target_object"), F.col("ExitCode").alias("exit_code"))


@R.query(f"WITH {TEL}, hit AS ({_SIGMA_HITS}) SELECT level, count(*) AS hits, min(l.hit) AS hit, min(l.miss) AS miss FROM hit JOIN (VALUES ('shell-from-document', 'high', 0.75::DOUBLE, 0.01::DOUBLE), ('user-unpacked', 'medium', 0.5, 0.02), ('port-or-range', 'high', 0.75, 0.01), ('wildcard-name', 'informational', 0.15, 0.1), ('no-value-name', 'critical', 0.9, 0.005)) l(rule, level, hit, miss) ON hit.rule = l.rule GROUP BY level")
def sigma_level(spark, sf_dir):
    """Hits by level, with the pair that the level stands for."""
    good, bad = sigma.load(SIGMA_RULES)
    table, _ = sigma.catalog(spark, good, bad)
    found = sigma.hits(telemetry(spark, sf_dir), good).join(F.broadcast(table.select("rule", "level")), "rule")
    return found.groupBy("level").agg(F.count("*").alias("hits"), F.min("hit").alias("hit"), F.min("miss").alias("miss"))
