"""State of entities: first and last sighting, label, and attributes of which the latest value stands.

An observation is a row (host, entity, kind, label, us, id, attrs), ``attrs`` a
map of strings. The state is kept as one row for each (entity, key): a value
and the version (us, id) of the observation that set it. Such rows merge by
version whatever their order, so a new batch is added to a stored state without
reading what it doesn't touch, and batch by batch gives what all at once gives.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.sources.log_table import LogTable

#: The row that carries a sighting itself.
SEEN = ""
STATE = "host string, entity long, kind string, key string, value string, us long, id long, first_us long, n long"


def changes(observations: DataFrame) -> DataFrame:
    """State rows of a batch of observations, the latest of each (entity, key)."""
    entries = F.concat(F.array(F.struct(F.lit(SEEN).alias("key"), F.col("label").alias("value"))), F.map_entries(F.coalesce("attrs", F.create_map().cast("map<string,string>"))))
    rows = observations.select("host", "entity", "kind", "us", "id", F.explode(entries).alias("e")).select("host", "entity", "kind", "us", "id", "e.key", "e.value")
    latest = F.max(F.struct("us", "id", "value"))
    out = rows.groupBy("host", "entity", "kind", "key").agg(latest.alias("x"), F.min("us").alias("first_us"), F.count("*").alias("n"))
    return out.select("host", "entity", "kind", "key", "x.value", "x.us", "x.id", "first_us", "n")


def state_table(spark: SparkSession, path: str, **more) -> LogTable:
    version = F.struct("us", "id")
    merge = {"value": lambda c: F.max_by(c, version), "us": lambda c: F.max(version)["us"], "id": lambda c: F.max(version)["id"], "first_us": F.min, "n": F.sum}
    return LogTable(spark, path, STATE, ["host", "entity", "kind", "key"], merge, **more)


def entities(state: DataFrame) -> DataFrame:
    """(host, entity, kind, first_us, last_us, label, n, attrs): one row an entity; attributes by key."""
    seen = F.col("key") == SEEN
    pick = lambda c: F.max(F.when(seen, F.col(c)))
    attrs = F.map_from_entries(F.sort_array(F.collect_list(F.when(~seen & F.col("value").isNotNull(), F.struct("key", "value")))))  # as many as an entity has keys
    return state.groupBy("host", "entity", "kind").agg(pick("first_us").alias("first_us"), pick("us").alias("last_us"), pick("value").alias("label"), pick("n").alias("n"), attrs.alias("attrs"))


def by_kind(state: DataFrame, kind: str) -> DataFrame:
    """(host, entity) of the entities of a kind."""
    return state.where((F.col("key") == SEEN) & (F.col("kind") == kind)).select("host", "entity")


def fiber(observations: DataFrame) -> DataFrame:
    """(host, kind, label, entity): the entities that ever had a label, a row each, as a set has no bound."""
    return observations.select("host", "kind", "label", "entity").distinct()


def processes(events: DataFrame) -> DataFrame:
    """Observations of process starts."""
    attrs = F.map_filter(F.create_map(F.lit("parent_pid"), F.col("parent_pid").cast("string"), F.lit("user"), F.col("user_name")), lambda _, v: v.isNotNull())
    return events.where("kind = 'process_start'").select("host", F.col("pid").alias("entity"), F.lit("process").alias("kind"), F.col("image").alias("label"), "us", "id", attrs.alias("attrs"))
