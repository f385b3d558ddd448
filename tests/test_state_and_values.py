"""Ranks without sorting, entity state batch by batch, dynamic values, sketches, image files, sensor sums."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from telarium.functions import dynamic as dy
from telarium.operators import algebra, entities, reports, sketches
from telarium.sources import images

EVENT = "host string, us long, id long, pid long, kind string, image string, parent_pid long, user_name string"


@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.999, 1.0])
def test_nearest_rank(spark, q, monkeypatch):
    rng = random.Random(3)
    groups = {"a": [rng.gauss(0, 1e6) for _ in range(3000)], "tie": [1.0] * 500 + [2.0] * 500, "one": [7.5], "odd": [-1e300, 1e300, 0.0, 5e-324, float("inf")], None: [3.0, 1.0, 2.0], "two": [rng.choice((1.0, 1e9)) for _ in range(999)]}
    rows = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], "g string, v double").repartition(7)
    want = {g: sorted(xs)[math.floor((len(xs) - 1) * q + 0.5)] for g, xs in groups.items()}
    assert {r.g: r.value for r in reports.nearest_rank(rows, "g", "v", q).collect()} == want
    monkeypatch.setattr(reports, "RANK_ACCURACY", 40)  # bounds that are often wrong
    monkeypatch.setattr(reports, "GROUPS_SENT", 0)
    assert {r.g: r.value for r in reports.nearest_rank(rows, "g", "v", q).collect()} == want


def test_nearest_rank_of_nulls_and_of_one_hot_group(spark):
    rows = spark.createDataFrame([("n", None), ("n", None), ("n", 5), ("m", None)], "g string, v long")
    assert {(r.g, r.value) for r in reports.nearest_rank(rows, "g", "v", 0.5).collect()} == {("n", None), ("m", None)}
    assert reports.nearest_rank(rows.where("false"), "g", "v", 0.5).count() == 0
    hot = spark.range(0, 400_000, 1, 16).select(F.lit("g").alias("g"), (F.col("id") * 7919 % 400_009).alias("v"))
    want = sorted(i * 7919 % 400_009 for i in range(400_000))[math.floor(399_999 * 0.9 + 0.5)]
    assert [r.value for r in reports.nearest_rank(hot, "g", "v", 0.9).collect()] == [want]


def observed(n=300, seed=4):
    rng = random.Random(seed)
    return [(f"h{rng.randrange(2)}", rng.randrange(10**6), i, rng.randrange(20), "process_start", rng.choice("abc"), rng.choice((None, 1, 2, 3)), rng.choice((None, "u1", "u2"))) for i in range(n)]


def test_entities_batch_by_batch(spark, tmp_path):
    rows = observed()
    seen = entities.processes(spark.createDataFrame(rows, EVENT))
    at_once = {tuple(r[:3]): (r.first_us, r.last_us, r.label, r.n, r.attrs) for r in entities.entities(entities.changes(seen)).collect()}
    table = entities.state_table(spark, str(tmp_path / "t"), fanout=3)
    parts = rows[:]
    random.Random(1).shuffle(parts)
    for epoch in range(6):
        batch = entities.processes(spark.createDataFrame(parts[epoch * 50 : epoch * 50 + 50], EVENT))
        assert table.append(entities.changes(batch), "w", epoch) and not table.append(entities.changes(batch), "w", epoch)
    assert {tuple(r[:3]): (r.first_us, r.last_us, r.label, r.n, r.attrs) for r in entities.entities(table.read()).collect()} == at_once
    want = {}
    for host, us, i, pid, _, image, parent, user in sorted(rows, key=lambda r: (r[1], r[2])):
        first, _, _, n, attrs = want.get((host, pid, "process"), (us, 0, "", 0, {}))
        new = {k: str(v) for k, v in (("parent_pid", parent), ("user", user)) if v is not None}
        want[host, pid, "process"] = (first, us, image, n + 1, attrs | new)
    assert at_once == want
    assert {tuple(r) for r in entities.by_kind(table.read(), "process").collect()} == {k[:2] for k in want} and entities.by_kind(table.read(), "file").count() == 0
    assert {tuple(r) for r in entities.fiber(seen).collect()} == {(r[0], "process", r[5], r[3]) for r in rows}


def test_dynamic_values(spark):
    texts = ["null", "true", "5", "-7", "2.5", '"x"', '""', "[1, [2, null], {}]", "[]", '{"a": {"b.c": "d", "it\'s": 1}}', "{}", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", F.parse_json("t"))
    v = F.col("v")
    got = {r.i: r for r in rows.select("i", dy.type_name(v).alias("t"), dy.is_empty(v).alias("e"), dy.as_bool(v).alias("b"), dy.as_int(v).alias("n"), dy.as_float(v).alias("f"), dy.as_string(v).alias("s"), dy.size(v).alias("z"), dy.as_int(dy.at(v, 1, 0)).alias("deep"), dy.as_string(dy.at(v, "a", "b.c")).alias("named"), dy.as_int(dy.at(v, "a", "it's")).alias("quoted")).collect()}
    assert [got[i].t for i in range(12)] == ["null", "bool", "int", "int", "float", "string", "string", "array", "array", "object", "object", "null"]
    assert [i for i in range(12) if got[i].e] == [0, 6, 8, 10, 11]
    assert [(i, got[i].b) for i in range(12) if got[i].b is not None] == [(1, True)] and [(i, got[i].n) for i in range(12) if got[i].n is not None] == [(2, 5), (3, -7)]
    assert [(i, got[i].f) for i in range(12) if got[i].f is not None] == [(2, 5.0), (3, -7.0), (4, 2.5)] and [(i, got[i].s) for i in range(12) if got[i].s is not None] == [(5, "x"), (6, "")]
    assert [got[i].z for i in (5, 6, 7, 8, 9, 10)] == [1, 0, 3, 0, 1, 0] and got[7].deep == 2 and got[9].named == "d" and got[9].quoted == 1


def test_shredded_fields_are_pruned(spark, tmp_path):
    rows = spark.range(40).select("id", F.parse_json(F.expr("""concat('{"k": ', id, ', "mixed": ', if(id % 2 = 0, '1', '"x"'), if(id % 4 = 0, ', "rare": 1', ''), ', "name": "n', id, '"}')""")).alias("v"))
    out = dy.shredded(rows, "v", 0.5)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema["shred"].dataType] == [("k", "bigint"), ("mixed", "variant"), ("name", "string")]
    out.write.parquet(str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    scan = back.select("shred.k")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<shred:struct<k:bigint>>" in scan
    assert sorted(r.k for r in back.select("shred.k").collect()) == list(range(40))
    assert sorted(r["name"] for r in dy.frequent_paths(rows, "v", 0.2).collect()) == ["k", "mixed", "name", "rare"]


def test_sketches_add_up(spark):
    events = spark.range(60_000).select(F.concat(F.lit("h"), F.col("id") % 3).alias("host"), (F.col("id") * 1_000_000).alias("us"), (F.col("id") * 31 % 9000).alias("key"))
    hours = sketches.rolled_up(events, F.col("key"))
    for by, exact in ((("host",), 3000), ((), 9000)):
        for r in sketches.estimated(sketches.merged(hours, *by)).collect():
            assert abs(r.distinct - exact) < 4 * sketches.standard_error() * exact
    assert sum(r.n for r in sketches.merged(hours, "host").collect()) == 60_000
    assert sketches.estimated(sketches.rolled_up(events.where("false"), F.col("key"))).count() == 0


def test_images_are_read_again_only_if_changed(spark, tmp_path):
    import hashlib

    for name in ("a.exe", "b.exe", "sub/c d.exe"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() * 50)
    digest = lambda b: hashlib.sha256(b).hexdigest()
    known, fresh = (df.cache() for df in images.refreshed(images.listed(spark, str(tmp_path), "*.exe")))
    assert known.count() == fresh.count() == 3
    (tmp_path / "b.exe").write_bytes(b"new")
    os.remove(tmp_path / "a.exe")
    (tmp_path / "d.exe").write_bytes(b"dd")
    table, fresh = images.refreshed(images.listed(spark, str(tmp_path), "*.exe"), known)
    got = {r.path.rsplit("/", 1)[1].replace("%20", " "): (r.length, r.image_hash) for r in table.collect()}
    assert got == {"b.exe": (3, digest(b"new")), "d.exe": (2, digest(b"dd")), "c d.exe": (550, digest(b"sub/c d.exe" * 50))}
    assert sorted(r.path.rsplit("/", 1)[1] for r in fresh.collect()) == ["b.exe", "d.exe"]


def test_sensor_sums(spark):
    rows = [("h", 1, "s", None, 10, "manifest"), ("h", 5, "s", None, 10, "manifest"), ("h", 1, None, None, 10, "manifest"), ("h", 1, "s", None, 10, "classic"), ("h", 1, None, None, 10, "trace_message"), ("k", 1, "s", None, 30, None)]
    got = {r.host: r for r in reports.sensor_accounting(spark.createDataFrame(rows, "host string, level int, shape string, failure string, payload_bytes int, form string")).collect()}
    assert (got["h"].received, got["h"].classic, got["h"].string_only, got["h"].trace_message, got["h"].filtered, got["h"].delivered, got["h"].dropped, got["h"].closes, got["h"].lost) == (5, 1, 0, 1, 1, 1, 1, True, 4)
    assert not got["k"].closes and got["k"].coverage == 0.0


def test_similarity_cuts_trust(spark):
    rows = spark.createDataFrame([("a", 2.0, 0.5), ("b", 2.0, 7.0), ("b", 2.0, -1.0), ("c", 2.0, 1.0)], "source string, ratio double, similarity double")
    known = spark.createDataFrame([("a", 0.8), ("b", 0.5)], "source string, trust double")
    assert sorted(round(r.weighted, 6) for r in algebra.trust_weighted(rows, known).collect()) == [0.0, 0.8, 1.0, 1.0]
