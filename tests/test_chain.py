"""Literal cases of the chain: satisfiability, flush marks, patterns, translation, guards, receipts."""

import random
import re

from pyspark.sql import functions as F

from telarium.operators import algebra as al
from telarium.operators import evidence as ev
from telarium.operators import sigma, translate
from telarium.sources import telemetry as src


def rule(condition, **selections):
    return sigma.compile_rule({"title": "t", "logsource": {"category": "process_creation"}, "detection": {**selections, "condition": condition}})


def test_can_fire_follows_the_condition(spark):
    image, hash_ = {"Image|endswith": "x"}, {"Hashes|contains": "y"}
    assert rule("a", a=image).can_fire and not rule("a and b", a=image, b=hash_).can_fire and rule("a or b", a=image, b=hash_).can_fire
    assert not rule("2 of *", a=image, b=hash_).can_fire and rule("1 of *", a=image, b=hash_).can_fire
    assert rule("a and not b", a=image, b=hash_).can_fire and not rule("b", b=hash_).can_fire and rule("b", b={"Hashes": None}).can_fire
    assert rule("a and b", a=image, b=hash_).unmapped == ["Hashes"] and not rule("a", a={"QueryName": "x"}).can_fire


def brute_fates(firings, window, least, flush=None):
    """Alerts (id: count) after all flushes, firing by firing."""
    folded, worst, last, alert, totals, mark = 0, -1, None, None, {}, None
    for us, row, rank in sorted(firings):
        if flush and mark is not None and us // flush > mark and alert is not None:
            totals[alert] += folded
            folded = 0
        mark = us // flush if flush else None
        folded, worst = folded + 1, max(worst, rank)
        if worst >= least and (last is None or us - last >= window):
            alert, last = row, us
            totals[row], folded = folded, 0
    if alert is not None:
        totals[alert] += folded
    return totals


def test_coalescing_with_and_without_flushes(spark):
    rng = random.Random(4)
    groups = {(f"h{i}", "r"): [(rng.randrange(4000), i * 1000 + j, rng.choice((0, 1, 1, 2, 3))) for j in range(rng.randrange(1, 120))] for i in range(25)}
    names = ("info", "low", "medium", "high", "critical")
    rows = [(h, r, us, i, True, "auto", names[k]) for (h, r), found in groups.items() for us, i, k in found]
    table = spark.createDataFrame(rows, "host string, rule string, us long, id long, acts boolean, verdict string, severity string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for flush in (None, 300, 1000):
            fates = ev.coalesced(table, window_us=500, flush_us=flush)
            fates = spark.createDataFrame(fates.collect(), fates.schema)
            got = {(r.host, r.alert): r.n for r in fates.where("fate = 'emit'").collect()}
            got |= {(r.host, r.alert): r.n for r in ev.restated(fates, flush).collect()}
            want = {(h, a): n for (h, _), found in groups.items() for a, n in brute_fates(found, 500, 2, flush).items()}
            assert got == want, flush
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_trace_patterns_against_regular_expressions(spark):
    rng = random.Random(9)
    words = {i: [rng.choice("abc") for _ in range(rng.randrange(1, 9))] for i in range(300)}
    trace = spark.createDataFrame([(i, j, j, a) for i, w in words.items() for j, a in enumerate(w)], "actor long, us long, id long, action string")
    atom = lambda x: ("atom", x)
    cases = {"a(b|c)*a": ("seq", atom("a"), ("star", ("alt", atom("b"), atom("c"))), atom("a")), ".*b": ("seq", ("star", ("any",)), atom("b")), "(a*b)*": ("star", ("seq", ("star", atom("a")), atom("b"))), "(|a)(b|c)*": ("seq", ("alt", ("seq",), atom("a")), ("star", ("alt", atom("b"), atom("c"))))}
    for text, pattern in cases.items():
        got = {r.actor: r.matches for r in al.matching_traces(trace, pattern).collect()}
        assert got == {i: re.fullmatch(text, "".join(w)) is not None for i, w in words.items()}, text
    assert al.matching_traces(trace.where("false"), cases[".*b"]).count() == 0


def test_translation(spark):
    start = 116_444_736_000_000_000
    net, net_id = "Microsoft-Windows-Kernel-Network", 10
    rows = [
        (1, start + 70, net, net_id, 5, {"saddr": "16885952", "daddr": "bad", "DestinationAddress": "0x" + "20010db8" + "0" * 23 + "1", "PID": "7"}),
        (2, start, net, net_id, 5, {"saddr": "16885952"}),
        (3, -1, net, net_id, 5, {}),
        (4, start, "Microsoft-Windows-Kernel-Registry", 5, 5, {"KeyName": "", "ValueName": "v"}),
        (5, start, "Microsoft-Windows-Kernel-Process", 3, 5, {}),
        (6, start, "Microsoft-Windows-Kernel-File", 20, 5, {"FileName": "\\Device\\HarddiskVolume12\\a", "NewName": ""}),
        (7, start, "Microsoft-Windows-WMI-Activity", 23, 5, {"Commandline": "x", "IsLocal": "0"}),
    ]
    raw = spark.createDataFrame(rows, "id long, ticks long, provider string, event_id int, pid long, fields map<string,string>")
    mounts = F.array(*(F.struct(F.lit(d).alias("device"), F.lit(r).alias("root")) for d, r in (("\\Device\\HarddiskVolume1", "C:"), ("\\Device\\HarddiskVolume12", "D:"))))
    raw = raw.withColumn("mounts", mounts).withColumn("learned_key", F.lit("\\REGISTRY\\MACHINE\\Run"))
    got = {r.id: r for r in translate.translated(raw).collect()}
    assert (got[1].failure, got[1].us, got[1].pid, got[1].source_ip, got[1].destination_ip) == (None, 7, 7, "192.168.1.1", "2001:db8::1")
    assert got[2].failure == "no daddr" and got[3].failure == "not a valid time" and got[4].key_path == "HKLM\\Run"
    assert got[5].shape is None and got[5].failure is None and len(got) == 7
    assert (got[6].new_path, got[6].old_path, got[6].kind) == ("D:\\a", "D:\\a", "file_rename") and got[7].is_local is False and got[7].pid == 5


def test_guards(spark):
    cases = [(4, "x", "system process"), (9, "x", "own process"), (10, " ", "unknown image"), (10, "C:\\Agent\\A.exe", "own image"), (10, "c:/windows/System32/LSASS.exe", "critical image"), (10, "C:\\WindowsApps\\lsass.exe", None), (10, "C:\\Windows\\notepad.exe", None)]
    rows = spark.createDataFrame([(p, i) for p, i, _ in cases], "pid long, image string")
    got = rows.select(ev.refusal(F.col("pid"), F.col("image"), F.lit(9), F.lit("c:\\agent\\a.EXE"), F.lit("C:\\Windows\\")).alias("x")).collect()
    assert [r.x for r in got] == [w for _, _, w in cases]


def test_receipts_and_batch_reasons(spark, tmp_path):
    sent = spark.createDataFrame([("b1", 0, 3), ("b1", 1, 3), ("b2", 0, 2)], "batch_id string, delivery int, events long")
    alerts = spark.createDataFrame([("b1", 1), ("b1", 2), ("b2", 2), ("b2", 3)], "batch_id string, alert_id long")
    got = {(r.batch_id, r.delivery): (r.accepted_events, r.accepted_alerts, r.duplicate) for r in src.receipts(sent, alerts, spark.createDataFrame([(3,)], "alert_id long")).collect()}
    assert got == {("b1", 0): (3, 2, False), ("b1", 1): (0, 0, True), ("b2", 0): (2, 0, False)}
    (tmp_path / "b.json").write_text('{"batch_id":"b1","events":[{"id":1}],"alerts":[{"id":" "}]}\n{"batch_id":" "}\n{"batch_id":"ok"}\n')
    assert [r.reject_reason for r in src.with_batch_reject_reason(src.read_batches(spark, str(tmp_path))).collect()] == ["empty alert id", "empty batch id", None]
