"""Distinct counts that add up: sketches rolled up by hour and host, merged over any hosts and hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
#: Buckets are 2 ** LG_K; the standard error is about 1.04 / sqrt(2 ** LG_K).
LG_K = 12


def rolled_up(events: DataFrame, key: Column, lg_k: int = LG_K) -> DataFrame:
    """(host, hour, sketch, n) for each host and hour; some KB a row at most, whatever the events."""
    rows = events.select("host", F.floor(F.col("us") / HOUR_US).alias("hour"), key.alias("key"))
    return rows.groupBy("host", "hour").agg(F.hll_sketch_agg("key", F.lit(lg_k)).alias("sketch"), F.count("key").alias("n"))


def merged(rollup: DataFrame, *by: str) -> DataFrame:
    """The roll-up with fewer of its keys (none: the fleet)."""
    return rollup.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"), F.sum("n").alias("n"))


def estimated(rollup: DataFrame) -> DataFrame:
    """``rollup`` with the estimate of its distinct keys in place of the sketch."""
    return rollup.withColumn("distinct", F.hll_sketch_estimate("sketch")).drop("sketch")


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / (1 << lg_k) ** 0.5
