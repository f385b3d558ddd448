"""Generated methods stay small enough for the JVM to compile, with the same results."""

import contextlib
import io
import ipaddress
import re

from pyspark.sql import functions as F

from telarium.functions import scalars
from telarium.operators import facts, rules
from telarium.sources import telemetry as src

LIMIT = "spark.sql.codegen.hugeMethodLimit"


def test_passes_of_the_rules_are_compiled(spark):
    at, told = "/root/testdata/sf0.001", io.StringIO()
    events = src.stored(spark, "telemetry", at, lambda: src.telemetry(spark, at))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with contextlib.redirect_stdout(told):
            rules.findings(facts.enriched(events)).explain("codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", told.getvalue())]
    assert len(sizes) > 6 and max(sizes) <= 8_000


def test_tables_are_written_by_compiled_methods(spark, tmp_path):
    for name in ("events", "documents"):
        spark.range(3).write.parquet(f"{tmp_path}/{name}.parquet")
    before = spark.conf.get(LIMIT)

    @F.udf("string")
    def limit(_):
        from pyspark import TaskContext

        return TaskContext.get().getLocalProperty(LIMIT)

    rows = src.stored(spark, "t", str(tmp_path), lambda: spark.range(3).select("id", F.lit("k").alias("kind"), limit("id").alias("limit")))
    assert {r.limit for r in rows.collect()} == {"8000"}
    assert spark.conf.get(LIMIT) == before


def test_many_needles_as_one_pattern(spark):
    texts = [None, "", "\n", "A.XYZ", "a.xyz\n", "axyz", "x -ENC y", "x-enc", "[CHAR[]]", "a|iex", "C:\\Temp\\x", "C:/Temp/x", "\\temp\\", "a\n-enc b", "É -e ", "..xyz"]
    needles = ("-enc ", "[char[]]", "|iex", "\\temp\\", ".xyz", "-e ")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.contains_any(F.col("t"), needles).alias("c"), scalars.ends_with_any(F.col("t"), needles).alias("e"), scalars.base_name(F.col("t")).alias("b"))
    for r in rows.collect():
        low = None if r.t is None else r.t.lower()
        want = (None, None, None) if low is None else (any(n in low for n in needles), low.endswith(needles), re.split(r"[\\/]", low)[-1])
        assert (r.c, r.e, r.b) == want, r.t


def test_routable_at_the_edges_of_networks(spark):
    nets = [ipaddress.ip_network(f"{a}/{b}") for a, b in scalars.UNROUTABLE]
    edges = {int(x) + i for n in nets for x in (n.network_address, n.broadcast_address) for i in (-1, 0, 1)}
    texts = [str(ipaddress.ip_address(n)) for n in sorted(edges) if 0 <= n < 1 << 32]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", scalars.is_routable(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == {t: not any(ipaddress.ip_address(t) in n for n in nets) for t in texts}
    odd = {None: False, "": False, "h": False, "1.2.3": False, "256.1.1.1": False, "08.8.8.8": True, "::1": False, "fe80::1": False, "2001:db8::1": True}
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select("t", scalars.is_routable(F.col("t")).alias("r")).collect()
    assert {r.t: r.r for r in rows} == odd
