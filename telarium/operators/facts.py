"""What is known of a process when it starts: as-of parent, novelty, siblings.

One shuffle by (host, pid) carries starts, exits and look-ups; an exit leaves a
tombstone, so a look-up after it finds no parent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_last(records: DataFrame, probes: DataFrame, keys: list[str], value: str = "value", tie: str = "id") -> DataFrame:
    """``probes`` with the ``value`` of the last record before it by (us, tie); null if none.

    ``records``: keys, us, tie, value. A record of the same (us, tie) is later.
    """
    kind = records.schema[value].dataType
    r = records.select(*keys, "us", tie, F.struct(F.col(value).alias("v")).alias("r"), F.lit(1).alias("turn"), F.lit(None).cast(probes.select(F.struct("*")).schema[0].dataType).alias("probe"))
    p = probes.select(*keys, "us", tie, F.lit(None).cast(f"struct<v:{kind.simpleString()}>").alias("r"), F.lit(0).alias("turn"), F.struct("*").alias("probe"))
    w = Window.partitionBy(*keys).orderBy("us", tie, "turn").rowsBetween(Window.unboundedPreceding, -1)
    found = r.unionAll(p).withColumn("last", F.last("r", ignorenulls=True).over(w))
    return found.where("turn = 0").select("probe.*", F.col("last.v").alias(value))


def parents(events: DataFrame) -> DataFrame:
    """Process starts with parent_id and parent_image of the tracked parent (null if none is)."""
    starts = events.where("kind = 'process_start'")
    records = starts.select("host", F.col("pid").alias("key"), "us", "id", F.struct(F.col("id").alias("parent_id"), F.col("image").alias("parent_image")).alias("parent"))
    ends = events.where("kind = 'process_exit'").select("host", F.col("pid").alias("key"), "us", "id", F.lit(None).cast(records.schema["parent"].dataType).alias("parent"))
    probes = starts.withColumn("key", F.col("parent_pid"))
    return asof_last(records.unionAll(ends), probes, ["host", "key"], "parent").drop("key").select("*", "parent.parent_id", "parent.parent_image").drop("parent")


def with_facts(events: DataFrame) -> DataFrame:
    """Process starts with parent_id, parent_image, sighting, image_is_novel, siblings."""
    order = ["us", "id"]
    seen = F.row_number().over(Window.partitionBy("host", F.lower("image")).orderBy(*order))
    child = F.row_number().over(Window.partitionBy("host", "parent_id").orderBy(*order)) - 1
    rows = parents(events).withColumn("sighting", seen).withColumn("image_is_novel", F.col("sighting") == 1)
    return rows.withColumn("siblings", F.when(F.col("parent_id").isNull(), 0).otherwise(child))


#: Fixed value: stands for a parent that was not seen to start.
UNKNOWN_PARENT = "<unobserved>"


def process_edges(events: DataFrame, unknown: str = UNKNOWN_PARENT) -> DataFrame:
    """Edges (src, dst, label, seq) from the image of the tracked parent, by host, of each start that names a parent, for ``edge_novelty``."""
    at = lambda image: F.concat_ws(":", "host", image)
    return parents(events).where("parent_pid IS NOT NULL").select(at(F.coalesce("parent_image", F.lit(unknown))).alias("src"), at(F.col("image")).alias("dst"), F.lit("starts").alias("label"), F.struct("us", "id").alias("seq"), "id")


def enriched(events: DataFrame) -> DataFrame:
    """All events; facts are null for those that are no process start."""
    made = with_facts(events)
    other = events.where("kind <> 'process_start'")
    for name in ("parent_id", "parent_image", "sighting", "image_is_novel", "siblings"):
        other = other.withColumn(name, F.lit(None).cast(made.schema[name].dataType))
    return made.unionByName(other)


def path_of_handle(learned: DataFrame, writes: DataFrame) -> DataFrame:
    """``writes`` with its own path, else the latest non-empty path learned for the handle."""
    records = learned.where("path IS NOT NULL AND path <> '' AND key_object <> 0").select("host", "key_object", "us", "id", F.col("path").alias("looked_up"))
    found = asof_last(records, writes, ["host", "key_object"], "looked_up")
    own = F.when(F.coalesce(F.col("path"), F.lit("")) == "", None).otherwise(F.col("path"))
    return found.withColumn("final_path", F.coalesce(own, F.when(F.col("key_object") != 0, F.col("looked_up"))))


def edge_novelty(edges: DataFrame) -> DataFrame:
    """``edges`` (src, dst, label, seq) with 0 for a known edge, 0.5 for two known nodes, else 1."""
    first_edge = F.min("seq").over(Window.partitionBy("src", "dst", "label"))
    nodes = edges.select(F.col("src").alias("node"), "seq").unionAll(edges.select(F.col("dst").alias("node"), "seq")).groupBy("node").agg(F.min("seq").alias("first"))
    rows = edges.withColumn("first_edge", first_edge).join(nodes.select(F.col("node").alias("src"), F.col("first").alias("first_src")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("first").alias("first_dst")), "dst")
    score = F.when(F.col("first_edge") < F.col("seq"), 0.0).when((F.col("first_src") < F.col("seq")) & (F.col("first_dst") < F.col("seq")), 0.5).otherwise(1.0)
    return rows.withColumn("score", score).drop("first_edge", "first_src", "first_dst")
