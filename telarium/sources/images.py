"""Metadata of image files, hashed again only when a file's path, time or size has changed."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METADATA = "path string, modified timestamp, length long, image_hash string"
#: Bytes of a file that are read at once.
CHUNK = 1 << 22


def listed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """path, modified, length of the files below a folder; no file is opened. Files without content are left out, as by Spark's reader."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    return reader.load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def hashed(files: DataFrame) -> DataFrame:
    """``files`` with image_hash (SHA-256), read in pieces of bounded size by the tasks; null if a file is gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [_digest(p) for p in batch.column("path").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "image_hash"])

    return files.select("path", "modified", "length").mapInArrow(run, METADATA)


def _digest(path: str) -> str | None:
    system, place = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path).replace(" ", "%20")) if re.match("[a-z][a-z0-9+.-]*:", path) else (fs.LocalFileSystem(), path)
    digest = hashlib.sha256()
    try:
        with system.open_input_stream(place) as stream:
            while piece := stream.read(CHUNK):
                digest.update(piece)
    except FileNotFoundError:
        return None
    return digest.hexdigest()


def refreshed(files: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(metadata of all ``files``, the part of it that was read now).

    ``known``: metadata of an earlier time. A file whose (path, modified,
    length) it has keeps its hash; one that is no longer listed goes.
    """
    if known is None:
        fresh = hashed(files)
        return fresh, fresh
    same = ["path", "modified", "length"]
    fresh = hashed(files.join(known.select(*same), same, "left_anti").hint("rebalance"))
    return files.join(known, same).select("path", "modified", "length", "image_hash").unionByName(fresh), fresh
