"""Longest prefixes and networks against brute force and against the expressions for small tables; causal links split by time."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from telarium.operators import algebra, prefixes, sigma, translate
from telarium.streaming import jobs
from test_streams import drained, feed


def addresses(rng, n):
    out = []
    for _ in range(n):
        if rng.random() < 0.5:
            out.append(f"10.{rng.randrange(4)}.{rng.randrange(256)}.{rng.randrange(256)}")
        else:
            a = ipaddress.IPv6Address((0x20010DB8 << 96) | rng.randrange(16) << 80 | rng.randrange(2**20))
            out.append(rng.choice((str(a), a.exploded, str(a).upper())))
    return [*out, None, "", "10.1.2", "300.1.1.1", "text", "::", "::1", "10.0.0.0"]


def networks(rng, n):
    out = ["0.0.0.0/0", "bad/99", "10.0.0.0/33", None, "10.1.2.3", "::1"]
    for _ in range(n):
        a = rng.choice([x for x in addresses(rng, 3) if x and (x.count(".") == 3 or x.count(":") > 2) and x != "300.1.1.1"])
        out.append(f"{a}/{rng.randrange(4, 33) if '.' in a else rng.randrange(20, 129)}")
    return out


@pytest.mark.parametrize("sent", [200_000, 40])
def test_networks(spark, monkeypatch, sent):
    monkeypatch.setattr(prefixes, "SENT", sent)
    rng = random.Random(6)
    probes, nets = addresses(rng, 400), networks(rng, 300)
    parsed = []
    for n in nets:
        try:
            parsed.append((ipaddress.ip_network(n, strict=False), n))
        except ValueError:
            pass

    def want(a):
        try:
            address = ipaddress.ip_address(a)
        except ValueError:
            return None
        return max((net.prefixlen for net, _ in parsed if net.version == address.version and address in net), default=None)

    rows = spark.createDataFrame([(i, a) for i, a in enumerate(probes)] + [(0, probes[0])], "i int, text string")
    table = spark.createDataFrame([(n, i) for i, n in enumerate(nets)], "network string, n int")
    got = prefixes.networks_of(rows, F.col("text"), table).collect()
    assert len(got) == len(probes) + 1
    for r in got:
        found = r.found and ipaddress.ip_network(r.found.network, strict=False)
        assert (found.prefixlen if found else None) == want(r.text), r
        assert not found or (ipaddress.ip_address(r.text) in found and nets[r.found.n] == r.found.network)
    # as the test of a rule
    for _, said in parsed[:: len(parsed) // 2] if sent else ():
        one = spark.createDataFrame([(said,)], "network string")
        a = {r.i for r in prefixes.networks_of(rows, F.col("text"), one).where("found IS NOT NULL").collect()}
        assert a == {r.i for r in rows.where(sigma.cidr_test(F.col("text"), said)).collect()}, said


def test_hundred_thousand_networks(spark):
    nets = spark.range(100_000).select(F.concat_ws(".", (F.col("id") / 65_536).cast("int") + 20, (F.col("id") / 256).cast("int") % 256, F.col("id") % 256, F.lit("0/24")).alias("network"))
    rows = spark.range(50_000).select("id", F.concat_ws(".", (F.col("id") * 7 / 65_536).cast("int") % 6 + 20, (F.col("id") * 7 / 256).cast("int") % 256, F.col("id") * 7 % 256, F.lit("9")).alias("a"))
    got = prefixes.networks_of(rows, F.col("a"), nets)
    right = F.concat(F.substring_index("a", ".", 3), F.lit(".0/24"))
    inside = ((F.split("a", "\\.")[0].cast("int") - 20) * 65_536 + F.split("a", "\\.")[1].cast("int") * 256 + F.split("a", "\\.")[2].cast("int")) < 100_000
    assert got.where(~F.col("found.network").eqNullSafe(F.when(inside, right))).count() == 0 and got.where("found IS NOT NULL").count() > 10_000


def test_paths_of_mounts(spark):
    mounts = [("h", "\\Device\\Vol1", "C:"), ("h", "\\Device\\Vol12", "D:"), ("k", "\\Device\\Vol1", "E:"), ("h", "\\Device\\Mup", "\\"), (None, "\\Device", "N:")]
    paths = ["\\Device\\Vol1\\a", "\\Device\\Vol12\\b", "\\Device\\Vol3\\c", "\\Device\\Mup\\s\\x", None, "", "C:\\x"]
    rows = spark.createDataFrame([(i, h, p) for i, p in enumerate(paths) for h in ("h", "k", None)], "i int, host string, path string")
    table = spark.createDataFrame(mounts, "host string, device string, root string")
    got = {(r.i, r.host): r.path for r in prefixes.dos_paths(rows, "path", table).collect()}
    small = translate.with_mounts(rows, table).select("i", "host", translate.dos_path(F.col("path"), F.col("mounts")).alias("p"))
    assert {k: v for k, v in got.items() if k[1]} == {(r.i, r.host): r.p for r in small.where("host IS NOT NULL").collect()}
    assert got[0, "h"] == "C:\\a" and got[1, "h"] == "D:\\b" and got[0, None] == "N:\\Vol1\\a" and got[2, "k"] == paths[2]
    assert prefixes.dos_paths(rows, "path", table.where("false")).where("path LIKE '%:%'").count() == 3


def trace(n, seed=2):
    rng = random.Random(seed)
    return [(i, rng.randrange(10**9), rng.choice((1, 1, 1, 2, 3, None)), rng.choice((1, 2, 3, 4, None))) for i in range(n)]


def links(rows, horizon):
    return {(a[0], b[0]) for a in rows for b in rows if (a[1], a[0]) < (b[1], b[0]) and b[1] - a[1] <= horizon and b[2] is not None and b[2] in (a[2], a[3])}


def test_causal_links(spark):
    rows = trace(300)
    table = spark.createDataFrame(rows, "id long, us long, actor long, target long")
    for horizon in (0, 10**7, 10**8, 2 * 10**9):
        got = [tuple(r) for r in algebra.causal_links(table, horizon).collect()]
        assert set(got) == links(rows, horizon) and len(got) == len(set(got))
    # one actor with all rows: they meet in many keys
    hot = spark.range(5000).selectExpr("id", "id * 1000 AS us", "1L AS actor", "2L AS target")
    assert algebra.causal_links(hot, 10_000).count() == 10 * 5000 - 55


def test_causal_links_on_a_stream(spark, tmp_path):
    rows = sorted(trace(200, 5), key=lambda r: r[1])
    rows = [(i, us + 10**9, a, t) for i, us, a, t in rows]
    _, stream = feed(spark, rows, "id long, us long, actor long, target long", str(tmp_path / "in"), parts=4)
    got = [tuple(r) for r in drained(jobs.causal_links(stream, "60 seconds"), tmp_path)]
    assert set(got) == links(rows, 60_000_000) and len(got) == len(set(got))
