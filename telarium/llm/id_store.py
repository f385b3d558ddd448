r"""Token ids of documents in binary shards, with keyed access by a minimal perfect hash.

Format, in a folder that all executors share:

- ``shard-N.ids``: raw ids of a range of documents in ascending key order,
  little-endian, 16 bits each if the vocabulary allows, else 32; no header.
- ``shard-N.len``: the number of ids of each of its documents, 32 bits each.
- ``index-B.mph``: a minimal perfect hash of the keys whose hash falls in
  bucket B. Levels of bits: a key's bit is set on the first level where no
  other remaining key takes it; the number of set bits before it is the key's
  slot. A slot holds a 32-bit fingerprint of the key and where its ids are:
  shard, row in the shard, ids before it in the shard, its number of ids, and
  how many documents have the key. A key is found by as many probes as there
  are levels (a constant), and one read.
- ``manifest.json``: sizes of the shards, written last; a store without it is
  not complete.

A bucket holds some 2^15 keys whatever the corpus, so it is built in one task.
Shards are the partitions of a range shuffle by key, then text, then place, so
even one key with a third of all rows is dealt to many shards. Files appear by
rename under their final name, and a task that runs again writes the same
bytes. On an object store that has no rename, files appear when they are
closed, as they are small enough for one put.

Defined cases: null text has no ids besides the end id. A null key is a key.
Documents with one key stand one behind the other, ordered by a hash of their
text, and a look-up gives all of them. A key that is not stored is missing
from the result (a fingerprint of 32 bits lets a foreign key through with
probability 2^-32). An empty table makes a store without shards. Two keys with
one 64-bit hash, or left over by the last level, are listed by their strings.
Columns of the caller beside key and text are not stored.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from telarium.llm import unit_codec
from telarium.llm.common import blocks

#: Keys of a bucket, bits a key and level, levels.
BUCKET_KEYS, GAMMA, LEVELS = 1 << 15, 2, 24
#: Documents of one key that one look-up row reads.
TOGETHER = 1024
SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("row", "<u4"), ("at", "<u8"), ("n", "<u4"), ("rows", "<u4")])
_POSITION = "shard int, row int, at long, n int, rows int"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if re.match("[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


class _Writer:
    """A file that has its name only when it is complete."""

    def __init__(self, path: str, name: str):
        self.system, folder = _place(path)
        self.final = f"{folder}/{name}"
        self.temporary = f"{self.final}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.temporary)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.temporary, self.final)


def _read(path: str, name: str) -> bytes:
    system, folder = _place(path)
    with system.open_input_stream(f"{folder}/{name}") as stream:
        return stream.read()


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    """Bits of a 64-bit hash stirred anew for each level (the finisher of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _fingerprints(h: np.ndarray) -> np.ndarray:
    return (_mixed(h, 77) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of 64-bit hashes; ``others`` are the keys that it can't tell apart."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def of(cls, hashes: np.ndarray) -> tuple[PerfectHash, np.ndarray]:
        """The hash, and a mark for each of ``hashes`` that got no slot."""
        left = np.ones(len(hashes), bool)
        order = np.argsort(hashes)
        same = hashes[order[1:]] == hashes[order[:-1]]
        left[order[1:][same]] = left[order[:-1][same]] = False
        twins, sizes, words = ~left, [], []
        for level in range(LEVELS):
            some = hashes[left]
            if not len(some):
                break
            size = -(-GAMMA * len(some) // 64) * 64
            place = (_mixed(some, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left[left] = ~alone[place]
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, "<u8")), twins | left

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; -1 where no level has its bit."""
        out, first = np.full(len(hashes), -1), 0
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            place = (_mixed(hashes[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = first + place // 64, (place % 64).astype(np.uint64)
            value = self.words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            below = value & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[word] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            first += size // 64
        return out


def build_index(hashes: np.ndarray, keys: list[str], positions: np.ndarray) -> bytes:
    """An index file of keys, their hashes and their slots' contents."""
    mph, without = PerfectHash.of(hashes)
    slots = np.zeros(int((~without).sum()), SLOT)
    kept = positions[~without].copy()
    kept["fingerprint"] = _fingerprints(hashes[~without])
    slots[mph.slots(hashes[~without])] = kept
    others = {keys[k]: [int(x) for x in positions[k]] for k in np.flatnonzero(without)}
    head = json.dumps({"sizes": mph.sizes, "keys": len(slots), "others": others}).encode()
    return b"".join([len(head).to_bytes(8, "little"), head, mph.words.tobytes(), slots.tobytes()])


class Index:
    def __init__(self, data: bytes):
        end = 8 + int.from_bytes(data[:8], "little")
        head = json.loads(data[8:end])
        words = sum(head["sizes"]) // 64
        self.hash = PerfectHash(head["sizes"], np.frombuffer(data, "<u8", words, end))
        self.entries = np.frombuffer(data, SLOT, head["keys"], end + 8 * words)
        self.others = {k: np.array(tuple(v), SLOT) for k, v in head["others"].items()}

    def find(self, hashes: np.ndarray, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Contents of the slots, and which keys are stored."""
        slot = self.hash.slots(hashes)
        met = slot >= 0
        out = np.zeros(len(hashes), SLOT)
        out[met] = self.entries[slot[met]]
        met &= out["fingerprint"] == _fingerprints(hashes)
        if self.others:
            for k, key in enumerate(keys):
                if key in self.others:
                    out[k], met[k] = self.others[key], True
        return out, met


def _key(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def _bucket(buckets: int) -> Column:
    return F.pmod(F.col("h__"), F.lit(buckets)).cast("int")


def write(docs: DataFrame, vocabulary: str | Path, path: str, end: int | None = 2, key: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` with a tokenizers file and write the store; ``end`` is put behind each document."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_text())
    system, place = _place(path)
    system.create_dir(place)
    rows = docs.select(F.col(key).alias("key__"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumns({"h__": F.xxhash64("text"), "at__": F.monotonically_increasing_id()})
    order = ["key__", "h__", "at__"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key__", "text")

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, units = unit_codec.byte_level(sent.value, True), unit_codec.byte_level_units(sent.value, True)
        kind = "<u2" if len(codec.width) <= 1 << 16 else "<u4"
        number, ids_file, lengths_file = TaskContext.get().partitionId(), None, None
        row = at = 0
        for part, _, _ in blocks(batches):
            ((ids, counts),) = units.gather([codec.cut(t) if t else [] for t in part.column("text").to_pylist()])
            if end is not None:
                ids, counts = np.insert(ids, np.cumsum(counts), end), counts + 1
            if ids_file is None:
                ids_file, lengths_file = _Writer(path, f"shard-{number}.ids"), _Writer(path, f"shard-{number}.len")
            ids_file.stream.write(ids.astype(kind).tobytes())
            lengths_file.stream.write(counts.astype("<u4").tobytes())
            n = len(counts)
            before = at + np.cumsum(counts) - counts
            columns = [np.full(n, number, np.int32), np.arange(row, row + n, dtype=np.int32), before, counts.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([part.column("key__"), *map(pa.array, columns)], names=["key", "shard", "row", "at", "n"])
            row, at = row + n, at + int(counts.sum())
        for file in (ids_file, lengths_file):
            if file is not None:
                file.close()

    kind = rows.schema["key__"].dataType.simpleString()
    rows.mapInArrow(shard, f"key {kind}, shard int, row int, at long, n int").write.parquet(f"{path}/entries")
    entries = spark.read.parquet(f"{path}/entries")
    shards = entries.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n").alias("ids")).orderBy("shard").collect()  # a row a file
    keys = entries.groupBy("key").agg(F.min(F.struct("shard", "row", "at", "n")).alias("first"), F.count("*").cast("int").alias("rows"))
    buckets = max(1, -(-sum(r.docs for r in shards) // BUCKET_KEYS))
    keys = keys.select(_key("key").alias("k__"), "first.*", "rows").withColumn("h__", F.xxhash64("k__")).withColumn("bucket", _bucket(buckets))

    def index(bucket: tuple, group: pa.Table) -> pa.Table:
        positions = np.zeros(len(group), SLOT)
        for c in ("shard", "row", "at", "n", "rows"):
            positions[c] = group.column(c).to_numpy()
        file = _Writer(path, f"index-{bucket[0].as_py()}.mph")
        file.stream.write(build_index(group.column("h__").to_numpy().view(np.uint64), group.column("k__").to_pylist(), positions))
        file.close()
        return pa.table({"bucket": pa.array([bucket[0].as_py()], pa.int32()), "keys": pa.array([len(group)], pa.int64())})

    keys.groupBy("bucket").applyInArrow(index, "bucket int, keys long").agg(F.sum("keys")).collect()
    size = 2 if len(unit_codec.byte_level(sent.value, True).width) <= 1 << 16 else 4
    manifest = {"bytes": size, "buckets": buckets, "shards": [[r.shard, r.docs, r.ids] for r in shards], "key": kind}
    file = _Writer(path, "manifest.json")
    file.stream.write(json.dumps(manifest).encode())
    file.close()


class _Store:
    """What a task needs of a store: the manifest, with ids and documents before each shard."""

    def __init__(self, path: str):
        self.path = path
        self.manifest = json.loads(_read(path, "manifest.json"))
        self.type = np.dtype(f"<u{self.manifest['bytes']}")
        shards = self.manifest["shards"]
        self.docs, self.ids, docs, ids = {}, {}, 0, 0
        self.numbers, self.rows = [s for s, _, _ in shards], []
        for s, d, n in shards:
            self.docs[s], self.ids[s] = docs, ids
            docs, ids = docs + d, ids + n
            self.rows.append(docs)
        self.open: tuple[int, object] | None = None

    def read(self, shard: int, at: int, n: int) -> np.ndarray:
        """``n`` ids of a shard behind the first ``at``."""
        if self.open is None or self.open[0] != shard:
            if self.open is not None:
                self.open[1].close()
            system, place = _place(self.path)
            self.open = shard, system.open_input_file(f"{place}/shard-{shard}.ids")
        size = self.type.itemsize
        return np.frombuffer(self.open[1].read_at(n * size, at * size), self.type).astype("<u4")

    @lru_cache(maxsize=4)  # noqa: B019
    def lengths(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        n = np.frombuffer(_read(self.path, f"shard-{shard}.len"), "<u4").astype(np.int64)
        return n, np.cumsum(n) - n

    def documents(self, row: int, rows: int) -> Iterator[tuple[int, int, int]]:
        """(shard, ids before, n) of ``rows`` documents from a document of the store on."""
        for r in range(row, row + rows):
            k = int(np.searchsorted(self.rows, r, side="right"))
            shard = self.numbers[k]
            n, before = self.lengths(shard)
            i = r - self.docs[shard]
            yield shard, int(before[i]), int(n[i])


def look_up(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Position of each distinct key that is stored: key, shard, row, at, n, rows."""
    buckets = json.loads(_read(path, "manifest.json"))["buckets"]
    asked = keys.select(F.col(key).alias("key")).distinct().withColumn("k__", _key("key")).withColumn("h__", F.xxhash64("k__")).withColumn("bucket", _bucket(buckets))
    asked = asked.repartition("bucket").sortWithinPartitions("bucket")
    names = ["shard", "row", "at", "n", "rows"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            bucket = batch.column("bucket").to_numpy()
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True):
                if bucket[a] != at:
                    at = bucket[a]
                    index = _index(path, int(at))
                if index is None:
                    continue
                part = batch.slice(a, b - a)
                found, met = index.find(part.column("h__").to_numpy().view(np.uint64), part.column("k__").to_pylist() if index.others else [])
                kept = part.column("key").filter(pa.array(met))
                yield pa.RecordBatch.from_arrays([kept, *(pa.array(found[c][met].astype(np.int64 if c == "at" else np.int32)) for c in names)], names=["key", *names])

    return asked.select("key", "k__", "h__", "bucket").mapInArrow(find, f"key {asked.schema['key'].dataType.simpleString()}, {_POSITION}")


def _index(path: str, bucket: int) -> Index | None:
    try:
        return Index(_read(path, f"index-{bucket}.mph"))
    except FileNotFoundError:  # no key fell in this bucket
        return None


def get(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id", ids: bool = True) -> DataFrame:
    """Documents of the given keys, read from the shards: key, start, n_tokens, ids_crc32 and, if asked for, ids."""
    found = look_up(spark, path, keys, key)
    found = found.withColumn("skip", F.explode(F.expr(f"sequence(0, rows - 1, {TOGETHER})")))
    found = found.repartitionByRange("shard", "row", "skip").sortWithinPartitions("shard", "row", "skip")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = _Store(path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0
            for name, shard, row, at, n, rows, skip in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "row", "at", "n", "rows", "skip")), strict=True):
                places = [(shard, at, n)] if rows == 1 else store.documents(store.docs[shard] + row + skip, min(TOGETHER, rows - skip))
                for s, a, count in places:
                    got = store.read(s, a, count)
                    for column, value in zip(out, (name, store.ids[s] + a, count, zlib.crc32(got.tobytes()), got if ids else None), strict=True):
                        column.append(value)
                    held += count
                if held >= 1 << 20:
                    yield made(out)
                    out, held = ([], [], [], [], []), 0
            if out[0]:
                yield made(out)

    kind = found.schema["key"].dataType.simpleString()
    arrow = to_arrow_type(found.schema["key"].dataType)
    names = [key, "start", "n_tokens", "ids_crc32", *["ids"] * ids]

    def made(out: tuple[list, ...]) -> pa.RecordBatch:
        columns = [pa.array(out[0], arrow), *(pa.array(c, pa.int64()) for c in out[1:4])]
        if ids:
            offsets = np.concatenate([[0], np.cumsum(out[2])])
            columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(out[4]).astype(np.int64))))
        return pa.RecordBatch.from_arrays(columns, names=names)

    return found.mapInArrow(read, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids)
