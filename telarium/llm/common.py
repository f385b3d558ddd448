"""Helpers that the training-data operators share.

``cut`` ends a lineage in the shared checkpoint folder, so a lost executor
costs a re-read, never a re-run of the whole chain.
``blocks`` walks Arrow batches in pieces of bounded size, so a task's memory
does not depend on the batch size or on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telarium.checkpoint import cut, folder

__all__ = ["blocks", "cut", "folder", "row_of", "same", "table", "text_hash", "texts_of", "unpacked", "with_fields"]

#: Bytes of text that one numpy step works on; a longer text is a step alone.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_hash(text: Column) -> Column:
    """Second half of a document's key, so that null or repeated ids stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_of(df: DataFrame, *without: str) -> Column:
    """The caller's row as one struct, so that no name of ours can clash with one of its columns."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in without))


def unpacked(df: DataFrame, row: str = "row", **new: Column) -> DataFrame:
    """The columns of the struct ``row``; those named in ``new`` are replaced, others of ``new`` are added."""
    names = df.schema[row].dataType.names
    return df.select(*(new.get(c, F.col(row).getField(c)).alias(c) for c in names), *(v.alias(c) for c, v in new.items() if c not in names))


def same(*pairs: tuple[Column, Column]) -> Column:
    """Null-safe equality of several columns."""
    out = None
    for a, b in pairs:
        out = a.eqNullSafe(b) if out is None else out & a.eqNullSafe(b)
    return out


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets from 0) in pieces of about BLOCK_BYTES of text."""
    for batch in batches:
        raw, offsets = texts_of(batch.column(text))
        at = 0
        while at < len(batch):
            end = int(np.searchsorted(offsets, offsets[at] + BLOCK_BYTES, side="right")) - 1
            end = min(max(end, at + 1), len(batch))
            first = int(offsets[at])
            yield batch.slice(at, end - at), raw[first : int(offsets[end])], offsets[at : end + 1] - first
            at = end


def with_fields(schema: T.StructType, fields: str) -> T.StructType:
    """A new schema with the fields of a DDL string behind those of ``schema``."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(fields).fields])
