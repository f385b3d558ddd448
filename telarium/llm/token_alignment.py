r"""Alignment of two tokenizers' ids of the same texts, and corpus counts of linked ids.

Both vocabularies cut the bytes of a text; where both cut, a group ends. Tokens
of the two sides are linked if their byte ranges overlap.

Method: the sorted ends of both sides are merged along a merge path. The path
is cut at equidistant diagonals, each cut found by binary search on its own
diagonal, so all pieces have the same number of steps whatever the texts are;
each piece walks its steps alone (here: one lane of an array a piece, all
lanes step together) and gives the places of both sides, hence the overlaps
and the groups that close in it. Pieces are stitched: a piece's groups are
numbered on from those closed before it, so a group that spans pieces is one.

Counts of id pairs are summed in Spark (partial sums first). Up to ``SENT``
most frequent pairs are sent to tasks; the others, which no document has
often, are joined by a shuffle. Both ways give the same numbers.

Defined cases: a text that is null or empty, or whose bytes one of the two
sides does not give back, has no tokens: zeros, and '' for its groups. Rows
are told apart by their place, so repeated rows and ids count each, and equal
counts are all best. An empty table gives an empty table. A text is worked on
alone if it is longer than a block; memory follows the text. Only ``doc_id``
and ``text`` of the caller are read or returned.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.llm import unit_codec
from telarium.llm.common import blocks, folder

#: Steps of a piece of the merge path.
PIECE = 128
#: Most id pairs that tasks are sent (25 MB).
SENT = 1 << 20
#: Bits of an id in a pair.
_BITS = 20


def cuts(a: np.ndarray, b: np.ndarray, piece: int) -> np.ndarray:
    """How many ends of ``a`` lie before each cut of the path; equal ends: the one of ``a`` first."""
    d = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) >> 1
        first = open_.copy()
        first[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]
        low = np.where(first, mid + 1, low)
        high = np.where(open_ & ~first, mid, high)
    return low


def merge_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(places in a, places in b) of overlapping tokens in order, and the group of each token of a and of b.

    ``a`` and ``b``: ends of tokens, increasing, with the same last one.
    """
    total = len(a) + len(b)
    if not total:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    i = cuts(a, b, piece)
    lanes = len(i)
    last = np.iinfo(np.int64).max
    starts_a, ends_a, ends_b = np.append(0, a), np.append(a, last), np.append(b, np.full(piece + 1, last))
    walked = np.empty((piece, lanes), np.int64)
    d = np.arange(lanes) * piece
    for step in range(piece):
        walked[step] = i
        i = i + (ends_a[i] <= ends_b[d - i])
        d += 1
        np.minimum(i, len(a), out=i)
    # the steps of each piece: an overlap, or the close of a group
    i = walked.T.ravel()[:total]
    j = np.arange(total) - i
    b_here = b[j]
    closes = starts_a[i] == b_here
    linked = ~closes
    takes_b = ends_a[i] > b_here
    # stitched: groups closed in the pieces before, and before in the piece
    inner = np.zeros((lanes, piece), np.int32)
    inner.ravel()[:total] = closes
    inner = np.cumsum(inner, axis=1, dtype=np.int32)
    before = np.concatenate([[0], np.cumsum(inner[:, -1], dtype=np.int64)[:-1]])
    group = (inner + before[:, None]).ravel()[:total] - closes
    return i[linked], j[linked], group[~takes_b], group[takes_b]


class Aligner:
    def __init__(self, a_text: str, b_model: bytes):
        self.a, self.b = unit_codec.byte_level(a_text, False), unit_codec.pieces(b_model)
        self.size = max(len(self.a.bytes_of), len(self.b.bytes_of))
        listed = [f"{i}{end}".encode() for end in (",", "|", ";", "") for i in range(self.size)]
        #: each id with what may stand behind it, in bytes that zeros fill up
        self.listed = np.array(listed).view(np.uint8).reshape(len(listed), -1)
        self.lengths = np.array(list(map(len, listed)))
        self.units = unit_codec.Units(self.a.encode, self.b.encode, self._differs)

    def _differs(self, units: list[unit_codec.Unit]) -> tuple[np.ndarray, np.ndarray]:
        """A mark for each text encoded whole whose bytes the pieces don't give back; units of texts without a U+2581 have theirs."""
        bytes_of = self.b.bytes_of.__getitem__
        differs = lambda text: b"".join(map(bytes_of, self.b.library.encode(text[1:]))) != text.encode()
        counts = np.array([type(u) is tuple and differs(u[0]) for u in units], np.int64)
        return np.ones(int(counts.sum()), np.int32), counts

    def block(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links), groups as text, and of the distinct pairs: row, pair, times."""
        n = len(texts)
        (a, sizes_a), (b, sizes_b), (_, marks) = self.units.gather([self.b.cut(f" {t}") if t else [] for t in texts])
        if marks.any():
            a, b = a[np.repeat(marks == 0, sizes_a)], b[np.repeat(marks == 0, sizes_b)]
            sizes_a, sizes_b = np.where(marks, 0, sizes_a), np.where(marks, 0, sizes_b)
        a, b = a.astype(np.int64), b.astype(np.int64)
        i, j, of_a, of_b = merge_path(np.cumsum(self.a.width[a]), np.cumsum(self.b.width[b]))
        row_a = np.repeat(np.arange(n), sizes_a)
        row = row_a[i]
        n_links = np.bincount(row, minlength=n)
        # where each token stands in the list of groups, and what follows it
        last_a, last_b = np.diff(of_a, append=-1) != 0, np.diff(of_b, append=-1) != 0
        n_groups = np.bincount(row_a[last_a], minlength=n)
        in_a, in_b = np.bincount(of_a), np.bincount(of_b)
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]] = a + self.size * last_a
        end = 2 * last_b
        end[np.cumsum(sizes_b)[sizes_b > 0] - 1] = 3
        codes[np.arange(len(b)) + np.cumsum(in_a)[of_b]] = b + self.size * end
        upto = np.concatenate([[0], np.cumsum(self.lengths[codes])])
        flat = self.listed[codes].ravel()
        flat = flat[flat != 0].tobytes()
        stops = upto[np.cumsum(sizes_a + sizes_b)].tolist()
        listed = [flat[x:y] for x, y in zip([0, *stops], stops, strict=False)]
        keys, times = np.unique(row << 2 * _BITS | a[i] << _BITS | b[j], return_counts=True)
        return [sizes_a, sizes_b, n_groups, n_links], listed, keys >> 2 * _BITS, keys & ((1 << 2 * _BITS) - 1), times


@lru_cache(maxsize=1)
def _aligner(a_text: str, b_model: bytes) -> Aligner:
    """A worker keeps its units from task to task."""
    return Aligner(a_text, b_model)


def _links(docs: DataFrame, a_path: str | Path, b_path: str | Path, groups: bool) -> DataFrame:
    """A row a document: numbers, groups, and its distinct id pairs with how often it links them."""
    sent = docs.sparkSession.sparkContext.broadcast((Path(a_path).read_text(), Path(b_path).read_bytes()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sent.value)
        for rows, _, _ in blocks(batches):
            numbers, listed, row, pairs, times = aligner.block(rows.column("text").to_pylist())
            offsets = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), pa.int32())
            digests = [hashlib.sha256(x).hexdigest() if x else "" for x in listed]
            columns = [rows.column("doc_id"), rows.column("row__"), *(pa.array(x, pa.int64()) for x in numbers), pa.array(digests, pa.string())]
            columns += [pa.ListArray.from_arrays(offsets, pa.array(pairs, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))]
            if groups:
                columns.append(pa.array([x.decode() for x in listed], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row__", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *["groups"] * groups])

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {kind}, row__ long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>" + ", groups string" * groups
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row__"))
    return rows.mapInArrow(run, fields)


def pair_counts(links: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (n is the highest of its A id)."""
    counts = links.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    side = F.shiftright("pair", _BITS)
    highest = counts.groupBy(side.alias("a")).agg(F.max("n").alias("most"))  # a row an id of A at most
    return counts.join(F.broadcast(highest), side == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _stored(df: DataFrame, at: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)


def align(docs: DataFrame, a_path: str | Path, b_path: str | Path, groups: bool = True, most: int = SENT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 and, if asked for, groups."""
    spark: SparkSession = docs.sparkSession
    at = f"{folder(spark)}/alignment-{uuid.uuid4().hex}"
    links = _stored(_links(docs, a_path, b_path, groups), f"{at}/links")
    counts = _stored(pair_counts(links), f"{at}/counts")
    n = counts.count()
    frequent, rare = counts, None
    if n > most:
        limit = counts.agg(F.percentile_approx("n", 1 - most / (2 * n), 10_000)).first()[0]
        frequent, rare = counts.where(F.col("n") > limit), counts.where(F.col("n") <= limit)
        if frequent.count() > most:  # too many equals for the percentile: all by the shuffle
            frequent, rare = counts.where("false"), counts
    table = frequent.toArrow()
    order = np.argsort(known := table.column("pair").to_numpy())
    sent = spark.sparkContext.broadcast((known[order], table.column("n").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]))
    columns = ["doc_id", "row__", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *["groups"] * groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counted, is_best = sent.value
        for batch in batches:
            pairs, times = batch.column("pairs").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), np.diff(batch.column("pairs").offsets.to_numpy()))
            place = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            met = known[place] == pairs if len(known) else np.zeros(len(pairs), bool)
            at, seen = place[met], times[met]
            best, total = _sums(row[met], seen * is_best[at], len(batch)), _sums(row[met], seen * counted[at], len(batch))
            left = np.concatenate([[0], np.cumsum(np.bincount(row[~met], minlength=len(batch)))])
            rest = [pa.ListArray.from_arrays(pa.array(left, pa.int32()), pa.array(x[~met], pa.int64())) for x in (pairs, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), best, total, *rest], names=[*columns, "n_best", "count_sum", "rest", "rest_times"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in links.select(*columns).schema.fields)
    found = links.select(*columns, "pairs", "times").mapInArrow(run, f"{fields}, n_best long, count_sum long, rest array<long>, rest_times array<long>")
    result = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups]
    if rare is None:
        return found.select(*result)
    found = _stored(found, f"{at}/found")
    left = found.select("row__", F.explode(F.arrays_zip("rest", "rest_times")).alias("x")).select("row__", F.col("x.rest").alias("pair"), F.col("x.rest_times").alias("times"))
    more = left.join(rare, "pair").groupBy("row__").agg(F.sum(F.col("times") * F.col("best").cast("long")).alias("best_more"), F.sum(F.col("times") * F.col("n")).alias("sum_more"))
    found = found.join(more, "row__", "left")
    return found.withColumns({"n_best": F.col("n_best") + F.coalesce("best_more", F.lit(0)), "count_sum": F.col("count_sum") + F.coalesce("sum_more", F.lit(0))}).select(*result)


def _sums(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Sums of whole numbers by row; rows are in order."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.searchsorted(row, np.arange(n + 1))
    return pa.array(upto[ends[1:]] - upto[ends[:-1]], pa.int64())
