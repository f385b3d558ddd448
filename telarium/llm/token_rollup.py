"""Token counts kept up to date by signed changes.

A change row is (source, lang, tokenizer, documents, tokens) with signs: an
insert adds, a delete subtracts, a revised count subtracts the old one and
adds the new one. A batch of changes is summed by key and committed under its
id. Totals are a snapshot that each commit carries forward by its own sums.

A folder appears under its final name only when it is complete: it is written
under a hidden name and renamed. So a batch that was lost half way is not
there, a batch that is sent again is skipped, and of two writers of one id one
is counted (the other's folder lands inside it under its hidden name, which no
reader looks at, and is deleted). Snapshots name the batches they hold; totals
are the last snapshot with the batches behind it, so a commit that is lost
before its snapshot is counted as well.

Additive state only: a batch costs its own size and that of the totals,
whatever the corpus, and partial sums mean that a source with a third of the
rows is no hot key.

Tokens are those of vocabulary files, counted in one pass over the texts for
all versions (``token_counts``). A text is cut once; each version encodes a
worker's distinct words once, and a text's count is the sum of its words'.

Defined cases: null source or lang is a key of its own. Null text has 0 tokens.
Empty batches commit an empty sum. Keys whose documents and tokens are both 0
after deletes are left out of the totals. Repeated rows count each time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.llm import unit_codec
from telarium.llm.common import blocks, folder, with_fields

KEYS = ("source", "lang", "tokenizer")


def token_counts(docs: DataFrame, vocabularies: dict[str, str | Path], text: str = "text") -> DataFrame:
    """``docs`` with ``tokens`` (a map from tokenizer version to count) in place of the text."""
    names = list(vocabularies)
    sent = docs.sparkSession.sparkContext.broadcast(tuple(unit_codec.tokenizers_file(Path(file).read_text()) for file in vocabularies.values()))
    docs = docs.drop("tokens")
    keep = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unit_codec.counter(sent.value)
        for part, _, _ in blocks(batches, text):
            n, k = len(part), len(names)
            counts = np.stack(counter.counts(part.column(text).to_pylist()), axis=1).ravel()
            tokens = pa.MapArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), pa.array(names * n, pa.string()), pa.array(counts, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), tokens], names=[*keep, "tokens"])

    return docs.mapInArrow(run, with_fields(docs.select(*keep).schema, "tokens map<string,bigint>"))


def _change(docs: DataFrame, tokenizer: str, tokens: Column | None, sign: int) -> DataFrame:
    tokens = F.try_element_at("tokens", F.lit(tokenizer)) if tokens is None else tokens
    return docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.lit(tokenizer).alias("tokenizer"), F.lit(sign).cast("long").alias("documents"), (sign * F.coalesce(tokens, F.lit(0))).cast("long").alias("tokens"))


def inserts(docs: DataFrame, tokenizer: str, tokens: Column | None = None) -> DataFrame:
    """One change for each counted document. ``tokens``: its count, if not in the map."""
    return _change(docs, tokenizer, tokens, 1)


def deletes(docs: DataFrame, tokenizer: str, tokens: Column | None = None) -> DataFrame:
    return _change(docs, tokenizer, tokens, -1)


def revisions(docs: DataFrame, old: str, new: str) -> DataFrame:
    """Takes the counts of one tokenizer version out and puts the other's in."""
    return deletes(docs, old).unionAll(inserts(docs, new))


class Rollup:
    """Totals in a folder that driver and executors share."""

    SCHEMA = "source string, lang string, tokenizer string, documents long, tokens long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def fresh(cls, spark: SparkSession) -> Rollup:
        """A new one beside the checkpoints."""
        return cls(spark, f"{folder(spark)}/rollup-{uuid.uuid4().hex}")

    def _files(self):
        context = self.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path
        return path(self.path).getFileSystem(context._jsc.hadoopConfiguration()), path

    def _names(self, prefix: str) -> list[str]:
        files, path = self._files()
        if not files.exists(path(self.path)):
            return []
        return [name[len(prefix) :] for name in (s.getPath().getName() for s in files.listStatus(path(self.path))) if name.startswith(prefix)]

    def _publish(self, hidden: str, name: str) -> bool:
        """Renames a complete folder; False if another one has the name."""
        files, path = self._files()
        if not files.exists(path(f"{self.path}/{name}")):
            files.rename(path(f"{self.path}/{hidden}"), path(f"{self.path}/{name}"))
            if not files.exists(path(f"{self.path}/{name}/{hidden}")):
                return True
            files.delete(path(f"{self.path}/{name}/{hidden}"), True)
        files.delete(path(f"{self.path}/{hidden}"), True)
        return False

    def _sum(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch; False if its id was committed before."""
        name = quote(batch, safe="")
        if name in self._names("batch-"):
            return False
        hidden = f"_{uuid.uuid4().hex}"
        self._sum(changes).write.parquet(f"{self.path}/{hidden}")
        done = self._publish(hidden, f"batch-{name}")
        self._carry()
        return done

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of the last snapshot (0: none), the batches in it, and those behind it."""
        last = max(map(int, self._names("snapshot-")), default=0)
        held = [r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/snapshot-{last}/batches").collect()] if last else []
        return last, held, sorted(set(self._names("batch-")) - set(held))

    def _rows(self, last: int, new: list[str]) -> DataFrame:
        at = [f"{self.path}/snapshot-{last}/totals"] * (last > 0) + [f"{self.path}/batch-{name}" for name in new]
        return self.spark.read.schema(self.SCHEMA).parquet(*at) if at else self.spark.createDataFrame([], self.SCHEMA)

    def _carry(self) -> None:
        """A new snapshot with the batches behind the last one."""
        while True:
            last, held, new = self._state()
            if not new:
                return
            hidden = f"_{uuid.uuid4().hex}"
            self._sum(self._rows(last, new)).write.parquet(f"{self.path}/{hidden}/totals")
            self.spark.createDataFrame([(name,) for name in held + new], "batch string").coalesce(1).write.parquet(f"{self.path}/{hidden}/batches")
            self._publish(hidden, f"snapshot-{last + 1}")

    def totals(self) -> DataFrame:
        last, _, new = self._state()
        return self._sum(self._rows(last, new)).where("documents <> 0 OR tokens <> 0")
