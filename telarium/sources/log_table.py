"""Tables that take every batch once, whatever is replayed, and stay small in files.

A table is a folder of parquet *runs* and a log of numbered versions. A version
is a small file that lists the live runs and, for each writer, the last epoch
that it has committed; it appears by one rename that fails if the number is
taken, so of two writers one wins and the other tries again on top of it. What
a failed task, a failed commit or a killed driver leaves behind is listed
nowhere and never read.

- ``append`` writes a run of level 0. An epoch that its writer has committed
  already is skipped, so a stream that replays a micro-batch adds nothing.
- A table with ``keys`` holds one row a key: rows of one key are merged by
  ``merge`` (column to aggregate) when they are read and when runs are merged.
- When a level has ``fanout`` runs they are merged into one of the next level,
  so a table of n epochs has at most ``fanout * log(n)`` runs, and a row is
  rewritten ``log(n)`` times. Files have at most ``rows_per_file`` rows.
- Runs may be laid out by ``partition_by``, so a reader's filter on it opens
  those folders only.
- Readers take the newest version and are not disturbed by later ones.
  ``vacuum`` removes what no recent version lists.

Defined cases: an empty batch commits its epoch and no run. Null keys are keys.
A table that was never written has no rows. The rename must be atomic and must
not overwrite, as that of HDFS; a store without it needs a put-if-absent here.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

_DIGITS = 12


@dataclass
class Version:
    number: int = 0
    #: (folder, level, rows)
    runs: list[tuple[str, int, int]] = field(default_factory=list)
    #: last committed epoch of each writer
    epochs: dict[str, int] = field(default_factory=dict)


class LogTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, keys: list[str] | None = None, merge: dict[str, Callable[[Column], Column]] | None = None, fanout: int = 8, rows_per_file: int = 5_000_000, partition_by: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.merge, self.partition_by = spark, path, keys, merge or {}, partition_by
        self.schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        self.fanout, self.rows_per_file = fanout, rows_per_file
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("_log"))

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self._root, name)

    # the log

    def _numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:_DIGITS]) for s in self._fs.listStatus(self._at("_log")) if s.getPath().getName().endswith(".json"))

    def _load(self, number: int) -> Version:
        stream = self._fs.open(self._at(f"_log/{number:0{_DIGITS}}.json"))
        try:
            data = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Version(number, [tuple(r) for r in data["runs"]], data["epochs"])

    def version(self, number: int | None = None) -> Version:
        """The newest version, or the one of that number."""
        if number is None:
            numbers = self._numbers()
            if not numbers:
                return Version()
            number = numbers[-1]
        return self._load(number)

    def _publish(self, version: Version) -> bool:
        """Whether the version could be put under its number."""
        final, temporary = self._at(f"_log/{version.number:0{_DIGITS}}.json"), self._at(f"_log/_{uuid.uuid4().hex}")
        if self._fs.exists(final):
            return False
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(json.dumps({"runs": version.runs, "epochs": version.epochs}).encode()))
        finally:
            stream.close()
        try:
            return self._put(temporary, final)
        finally:
            self._fs.delete(temporary, False)

    def _put(self, temporary, final) -> bool:
        """A rename that doesn't overwrite. A local disk's would, so a link is made there instead."""
        if self._fs.getUri().getScheme() != "file":
            return self._fs.rename(temporary, final)
        files, to = self.spark._jvm.java.nio.file.Files, lambda p: self.spark._jvm.java.nio.file.Path.of(p.toUri())
        try:
            files.createLink(to(self._fs.makeQualified(final)), to(self._fs.makeQualified(temporary)))
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _commit(self, change: Callable[[Version], Version | None]) -> Version | None:
        """Applies ``change`` to the newest version until it is published; None if ``change`` gives none."""
        while True:
            now = self.version()
            then = change(now)
            if then is None:
                return None
            then.number = now.number + 1
            if self._publish(then):
                return then

    # rows

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        name = f"run={uuid.uuid4().hex}"
        rows.write.option("maxRecordsPerFile", self.rows_per_file).partitionBy(*self.partition_by).parquet(f"{self.path}/{name}")
        return name, self._parquet(name).count()

    def _parquet(self, *names: str) -> DataFrame:
        # a run is a partition of the table's folder
        return self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*(f"{self.path}/{name}" for name in names)).select(*self.schema.names)

    def _merged(self, rows: DataFrame) -> DataFrame:
        if self.keys is None:
            return rows
        made = [self.merge[c](rows[c]).alias(c) for c in self.schema.names if c not in self.keys]
        return rows.groupBy(*self.keys).agg(*made).select(*self.schema.names)

    def _rows(self, runs: list[tuple[str, int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self._parquet(*(name for name, _, _ in runs))

    def read(self, number: int | None = None) -> DataFrame:
        """The table's rows as of its newest version, or of that number."""
        return self._merged(self._rows(self.version(number).runs))

    def append(self, batch: DataFrame, writer: str, epoch: int) -> bool:
        """Adds a batch, unless ``writer`` has committed this epoch or a later one; then merges levels that are full."""

        def seen(v: Version) -> bool:
            return v.epochs.get(writer, -1) >= epoch

        if seen(self.version()):
            return False
        name, n = self._write(self._merged(batch.select(*self.schema.names)))

        def add(v: Version) -> Version | None:
            return None if seen(v) else Version(0, [*v.runs, *([(name, 0, n)] if n else [])], v.epochs | {writer: epoch})

        done = self._commit(add) is not None
        while done and self.compact():
            pass
        return done

    def compact(self) -> bool:
        """Merges one full level; False if none is, or if someone else has done it."""
        now = self.version()
        for level in sorted({r[1] for r in now.runs}):
            mine = [r for r in now.runs if r[1] == level]
            if len(mine) < self.fanout:
                continue
            rows = self._merged(self._rows(mine))
            files = max(1, -(-sum(r[2] for r in mine) // self.rows_per_file))
            name, n = self._write(rows.coalesce(files))

            def swap(v: Version, mine=mine, new=(name, level + 1, n)) -> Version | None:
                return Version(0, [*(r for r in v.runs if r not in mine), new], v.epochs) if all(r in v.runs for r in mine) else None

            return self._commit(swap) is not None
        return False

    def vacuum(self, keep: int = 10) -> int:
        """Removes runs that none of the last ``keep`` versions lists, and older versions. Not beside a writer."""
        numbers = self._numbers()
        kept = numbers[-keep:]
        live = {r[0] for n in kept for r in self._load(n).runs}
        gone = [s.getPath() for s in self._fs.listStatus(self._root) if s.getPath().getName().startswith("run=") and s.getPath().getName() not in live]
        for path in [*gone, *(self._at(f"_log/{n:0{_DIGITS}}.json") for n in numbers[:-keep])]:
            self._fs.delete(path, True)
        return len(gone)

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """A ``foreachBatch`` function: each micro-batch counts once, also after a restart."""

        def write(batch: DataFrame, epoch: int) -> None:
            batch.persist()
            try:
                self.append(batch, writer, epoch)
            finally:
                batch.unpersist()

        return write
