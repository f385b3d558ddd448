"""Dynamic values (VARIANT): steps into them, typed reads, type names, emptiness, and columns for frequent paths.

Reads are strict: a value of another type is null, not converted; whole numbers
may be read as floats. Absent and null are both null, as is a step into a value
that has no such field or place. A field whose name holds both kinds of quotes
can't be stepped into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of the kinds of values.
NAMES = ("null", "bool", "int", "float", "string", "array", "object")


def at(value: Column, *steps: str | int) -> Column:
    """The value behind fields (strings) and places of arrays (numbers)."""
    named = lambda s: f'["{s}"]' if "'" in s else f"['{s}']"
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else named(s) for s in steps)
    return F.try_variant_get(value, path, "variant")


def type_name(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False)), "null")
        .when(kind == "BOOLEAN", "bool")
        .when(kind == "BIGINT", "int")
        .when(kind.isin("DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), "float")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def _read(value: Column, names: tuple[str, ...], kind: str) -> Column:
    return F.when(type_name(value).isin(*names), F.try_variant_get(value, "$", kind))


def as_bool(value: Column) -> Column:
    return _read(value, ("bool",), "boolean")


def as_string(value: Column) -> Column:
    return _read(value, ("string",), "string")


def as_int(value: Column) -> Column:
    return _read(value, ("int",), "bigint")


def as_float(value: Column) -> Column:
    return _read(value, ("int", "float"), "double")


def size(value: Column) -> Column:
    """Entries of an array or fields of an object, characters of a string; null for others."""
    kind = type_name(value)
    fields = F.size(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")))
    return F.when(kind == "array", F.size(F.try_variant_get(value, "$", "array<variant>"))).when(kind == "object", fields).when(kind == "string", F.length(F.try_variant_get(value, "$", "string")))


def is_empty(value: Column) -> Column:
    """No entries, no fields, no characters, or null."""
    return (type_name(value) == "null") | F.coalesce(size(value) == 0, F.lit(False))


def frequent_paths(rows: DataFrame, value: str, least: float = 0.5) -> DataFrame:
    """(name, n, share): fields of the outermost object that at least so many of the rows have."""
    total = rows.count()
    names = rows.select(F.explode(F.map_keys(F.try_variant_get(F.col(value), "$", "map<string,variant>"))).alias("name"))
    counts = names.groupBy("name").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least * total).withColumn("share", F.col("n") / F.lit(max(total, 1)))


def shredded(rows: DataFrame, value: str, least: float = 0.5, most: int = 64) -> DataFrame:
    """``rows`` with a struct ``shred`` of the frequent fields, each in the type that all its values agree on
    (else as VARIANT), so that a scan of the written table reads only the fields it asks for.

    At most ``most`` fields, the most frequent first; all others stay in ``value``, which is unchanged.
    """
    names = [r["name"] for r in frequent_paths(rows, value, least).orderBy(F.desc("n"), "name").limit(most).collect()]
    if not names:
        return rows.withColumn("shred", F.lit(None).cast("struct<>"))
    merged = rows.agg(*(F.schema_of_variant_agg(at(F.col(value), n)).alias(f"c{i}") for i, n in enumerate(names))).first()
    kinds = {"BIGINT": "bigint", "DOUBLE": "double", "BOOLEAN": "boolean", "STRING": "string"}
    typed = [F.try_variant_get(at(F.col(value), n), "$", kinds[merged[i]]) if merged[i] in kinds else at(F.col(value), n) for i, n in enumerate(names)]
    return rows.withColumn("shred", F.struct(*(c.alias(n) for c, n in zip(typed, names, strict=True))))
