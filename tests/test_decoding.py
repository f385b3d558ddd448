"""Raw decoding and field classes: literal and brute-force cases."""

import hashlib
import ipaddress
import json
import random
import struct

from pyspark.sql import functions as F

from telarium.functions import decoding as dec
from telarium.functions import privacy
from telarium.operators import algebra as al
from telarium.operators import reports


def test_addresses_against_the_standard_library(spark):
    rng = random.Random(5)
    raws = [bytes(rng.choice((0, 0, 0, 1, 16, 255)) for _ in range(16)) for _ in range(300)]
    raws = [r for r in raws if r[:2] not in (b"\x02\x00", b"\x17\x00") and not r.startswith(bytes(10) + b"\xff\xff")]
    want = {r: ipaddress.IPv6Address(r).compressed for r in raws}
    inner = ipaddress.IPv6Address("2001:db8::1").packed
    want |= {
        bytes([192, 168, 1, 1]): "192.168.1.1", bytes(16): "::", bytes(10) + b"\xff\xff\x0a\x00\x00\x05": "::ffff:10.0.0.5",
        struct.pack("<HH", 2, 80) + bytes([8, 8, 4, 4]) + bytes(8): "8.8.4.4", struct.pack("<HH", 23, 80) + bytes(12): None,
        struct.pack("<HHI", 23, 80, 0) + inner + bytes(4): "2001:db8::1", struct.pack("<HH", 2, 80) + bytes([8, 8, 4, 4]) + bytes(20): "8.8.4.4", struct.pack("<H", 9) + bytes(26): None,
        b"": None, b"\x01\x02\x03": None,
    }
    rows = spark.createDataFrame([(bytearray(r),) for r in want], "raw binary")
    got = {bytes(r.raw): r.ip for r in rows.select("raw", dec.ip_of_bytes(F.col("raw")).alias("ip")).collect()}
    assert got == want
    assert spark.range(1).select(dec.ip4_of_number(F.lit(0x0101A8C0)).alias("x")).first().x == "192.168.1.1"
    assert spark.range(1).select(dec.ip4_of_number(F.lit(0xFF01A8C0)).alias("x")).first().x == "192.168.1.255"


def test_codes(spark):
    rows = spark.createDataFrame([(28, "S-1-16-12288 "), (4000, "S-1-5-18"), (None, None)], "n int, sid string")
    assert [tuple(r) for r in rows.select(dec.query_type(F.col("n")), dec.integrity_level(F.col("sid"))).collect()] == [("AAAA", "high"), ("4000", None), (None, None)]


def test_registry_values(spark):
    cases = [
        (1, "hi\0x".encode("utf-16le"), "hi"), (2, "é€😀".encode("utf-16le"), "é€😀"), (7, b"", ""), (1, b"\0\0", "0000"), (1, b"abc", "616263"), (1, b"\x00\xd8a\x00", "00d86100"),
        (4, b"\x01\x02\x00\x00\xff", "513"), (5, b"\xff\xff\xff\xff", "4294967295"), (4, b"\x01", "01"), (11, b"\xff" * 8, str(2**64 - 1)), (11, b"\x01\0", "0100"), (3, b"\xab\xcd", "abcd"), (99, b"\x0f", "0f"),
    ]
    rows = spark.createDataFrame([(i, k, bytearray(raw)) for i, (k, raw, _) in enumerate(cases)], "i int, kind int, raw binary")
    got = rows.select("i", dec.registry_value(F.col("kind"), F.col("raw")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [want for _, _, want in cases]


def test_redaction_of_nested_columns(spark):
    schema = "r struct<pid:int, command_line:string, extra:struct<hostname:string, mine:string>, items:array<struct<path:string, size:int>>, tags:map<string,int>, labels:array<string>>"
    full = (1, "cmd", ("h", "m"), [("p", 3)], {"pid": 4, "mine": 5}, ["a"])
    rows = spark.createDataFrame([(full,), (None,)], schema)
    kind = rows.schema["r"].dataType
    redacted = [r.x and r.x.asDict(True) for r in rows.select(privacy.redact(F.col("r"), kind).alias("x")).collect()]
    hidden = privacy.REDACTED
    assert redacted == [{"pid": 1, "command_line": hidden, "extra": {"hostname": "h", "mine": hidden}, "items": [{"path": hidden, "size": 3}], "tags": {"pid": "4", "mine": hidden}, "labels": ["a"]}, None]
    assert [r.x and r.x.asDict(True) for r in rows.select(privacy.strip(F.col("r"), kind).alias("x")).collect()] == [{"pid": 1, "labels": ["a"]}, None]


def test_redaction_of_json(spark):
    rows = spark.createDataFrame([('{"pid":1,"path":{"a":1},"box":[{"zip":2,"size":3}]}',), ("[1]",), ("no json",), (None,)], "p string")
    got = [r.x for r in rows.select(privacy.redact_json(F.col("p")).alias("x")).collect()]
    assert [g and g[0] in "{[" and json.loads(g) or g for g in got[:2]] == [{"pid": 1, "path": "[REDACTED]", "box": [{"zip": "[REDACTED]", "size": 3}]}, [1]]
    assert got[2:] == [privacy.REDACTED, None]


def test_canonical_hash_ignores_field_order(spark):
    row = spark.sql("SELECT named_struct('b', 1, 'a', array(named_struct('z', 'x\"', 'y', CAST(NULL AS INT)))) AS one, named_struct('a', array(named_struct('y', CAST(NULL AS INT), 'z', 'x\"')), 'b', 1) AS two, map('q', 1, 'c', 2) AS m")
    digest = lambda c: privacy.canonical_hash(F.col(c), row.schema[c].dataType)
    one, two, m = row.select(digest("one"), digest("two"), digest("m")).first()
    assert one == two == hashlib.sha256(b'{"a":[{"y":null,"z":"x\\""}],"b":1}').hexdigest()
    assert m == hashlib.sha256(b'{"c":2,"q":1}').hexdigest()


def test_liveness_duty_and_residual(spark):
    rows = spark.createDataFrame([(1100, 1000), (1101, 1000), (900, 1000), (5, None)], "now long, last long")
    assert [r.x for r in rows.select(reports.liveness(F.col("now"), F.col("last"), 60, 40).alias("x")).collect()] == ["alive", "stale", "alive", "never_seen"]
    sensors, beats = spark.createDataFrame([(1,), (2,)], "sensor long"), spark.createDataFrame([(1, True), (1, True), (1, False), (1, True)], "sensor long, on_time boolean")
    assert {r.sensor: r.availability for r in reports.duty(sensors, beats).collect()} == {1: 0.75, 2: 1.0}
    gaps = spark.createDataFrame([(1, 0.8), (2, 0.5), (3, -1.0)], "gap long, severity double")
    controls = spark.createDataFrame([(1, 7, 0.5), (1, 6, 0.5), (1, 5, 0.2), (3, 9, 7.0)], "gap long, control long, coverage double")
    assert {r.gap: (r.control, r.residual) for r in al.residual_risk(gaps, controls).collect()} == {1: (6, 0.4), 2: (None, 0.5), 3: (9, 0.0)}


def test_wire_volume_of_one_event_has_no_rate(spark):
    rows = spark.createDataFrame([("a", 0), ("b", 0), ("b", 86_400_000_000)], "kind string, us long")
    got = {r.kind: (r.events, r.bytes_per_day) for r in reports.wire_volume(rows).collect()}
    assert got["a"] == (1, None) and got["b"][0] == 2 and got["b"][1] == sum(len(json.dumps({"kind": "b", "us": us}, separators=(",", ":"))) for us in (0, 86_400_000_000))
