"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item's windows are its runs of 10 words (a shorter item is one window). The
tokens of a window are its shingles of up to 3 words, ordered by rarity in the
whole corpus. Exact containment needs every token of the window, so the prefix
of one token, the rarest, is necessary: only its occurrences are joined. A
window whose rarest token never occurs is dropped before the join. The token's
offset fixes where the window would start, which gives the length and the
positional bound; what is left is verified word by word.

Two passes over the texts: one counts the items' tokens (one row for each
token and task), one emits occurrences of prefix tokens with the words around.
What tasks are sent is a bit for each token of the benchmark, in a map of at
most ``2 ** MAX_BITS`` bits (32 MB) whatever its size; a crowded map only lets
more words through to the joins, which compare tokens themselves. The windows
are broadcast while they take at most ``BYTES_SENT``, and joined by a shuffle
on their token beyond.

Defined cases: null or empty text has no words and is not contaminated. Rows
that agree in ``doc_id`` and text are one document. An item without words has
no window. Item ids are compared as strings. A text of any length is read
whole, as one step of its task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.llm.common import blocks, cut, row_of, same, text_hash, unpacked
from telarium.llm.words import ALNUM, shingle_hashes, word_hashes, word_spans

WINDOW, TOKEN = 10, 3
MAX_BITS = 28
BYTES_SENT = 32 << 20


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(window_id, item_id, words, tokens) for every window of every item."""

    def cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in blocks(batches):
            starts, ends, first = word_spans(raw, offsets, ALNUM)
            hashes = word_hashes(raw, starts, ends)
            out = []
            for i, item in enumerate(rows.column("item_id").to_pylist()):
                a, b = int(first[i]), int(first[i + 1])
                texts = [raw[s:e].tobytes().decode().translate(_LOWER) for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                size = min(window, b - a)
                token = min(TOKEN, size)
                for at in range(b - a - size + 1 if size else 0):
                    out.append({"item_id": item, "words": texts[at : at + size], "token_words": token, "tokens": shingle_hashes(hashes[a + at : a + at + size], token).view(np.int64).tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOWS)

    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(cutter, "item_id string, words array<string>, token_words int, tokens array<long>")


_LOWER = {c: c + 32 for c in range(65, 91)}
_WINDOWS = pa.schema([("item_id", pa.string()), ("words", pa.list_(pa.string())), ("token_words", pa.int32()), ("tokens", pa.list_(pa.int64()))])
_SPOT = "struct<token:bigint,token_words:int,at:int,before:int,around:array<string>>"
_SPOTS = pa.list_(pa.struct([("token", pa.int64()), ("token_words", pa.int32()), ("at", pa.int32()), ("before", pa.int32()), ("around", pa.list_(pa.string()))]))


class _Members:
    """A bit for the leading bits of each hash of a set; tells what can be in it."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def places(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return np.flatnonzero((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1))


def _members(tokens: DataFrame) -> dict[int, _Members]:
    """The map of each token length; Spark sets the bits, 64 to a row."""
    out = {}
    for size, count in tokens.groupBy("token_words").agg(F.count("*")).collect():
        bits = min(MAX_BITS, max(12, (256 * count).bit_length()))  # at most one word in 256 is let through in vain
        at = F.shiftrightunsigned("token", 64 - bits)
        rows = tokens.where(F.col("token_words") == size).groupBy(F.shiftright(at, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(token, {64 - bits}) & 63 AS int))")).alias("set")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
        out[size] = _Members(bits, words)
    return out


def _occurrences(raw, offsets, wanted: dict[int, _Members]):
    """Words of the texts, and for each token length the hashes and places that may be looked for."""
    starts, ends, first = word_spans(raw, offsets, ALNUM)
    hashes = word_hashes(raw, starts, ends)
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    hits = []
    for size, members in wanted.items():
        runs = shingle_hashes(hashes, size)
        at = members.places(runs)
        at = at[of[at] == of[at + size - 1]] if len(at) else at
        hits.append((size, at, runs[at]))
    return starts, ends, first, of, hits


def _counts(docs: DataFrame, tokens: dict[int, _Members]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        keep: list[np.ndarray] = []
        held = 0

        def out():
            token, n = np.unique(np.concatenate(keep), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "n"])

        for _, raw, offsets in blocks(batches):
            for _, _, found in _occurrences(raw, offsets, wanted)[4]:
                keep.append(found)
                held += len(found)
            if held > 1_000_000:
                yield out()
                keep, held = [], 0
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("seen"))


def _spots(docs: DataFrame, tokens: dict[int, _Members], window: int) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(tokens)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for rows, raw, offsets in blocks(batches):
            starts, ends, first, of, hits = _occurrences(raw, offsets, wanted)
            spots: list[list[dict]] = [[] for _ in range(len(rows))]
            for size, places, found in hits:
                for at, token in zip(places.tolist(), found.view(np.int64).tolist(), strict=True):
                    doc = int(of[at])
                    a, b = int(first[doc]), int(first[doc + 1])
                    low, high = max(a, at - window + size), min(b, at + window)
                    around = [raw[s:e].tobytes().decode().translate(_LOWER) for s, e in zip(starts[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                    spots[doc].append({"token": token, "token_words": size, "at": at - a, "before": at - low, "around": around})
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("part"), pa.array(np.diff(first), pa.int64()), pa.array(spots, _SPOTS)], names=["doc_id", "part", "n_words", "spots"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_hash(F.col("text")).alias("part"), "text").mapInArrow(find, f"doc_id {kind}, part long, n_words long, spots array<{_SPOT}>")


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, part, n_words, n_hit, item_ids, contaminated for each document."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    windows = cut(item_windows(items, window))
    tokens = cut(windows.select("token_words", F.explode("tokens").alias("token")).distinct())
    counted = cut(_counts(docs, _members(tokens)).join(tokens.select("token").distinct(), "token", "left_semi"))
    each = windows.select(F.xxhash64("item_id", "words").alias("window_id"), "item_id", "words", "token_words", F.posexplode("tokens").alias("place", "token"))
    prefix = cut(
        each.join(counted, "token", "left")
        .groupBy("window_id", "item_id", "words", "token_words")
        .agg(F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "token", "place")).alias("p"), F.count("seen").alias("met"), F.count("*").alias("of"))
        .where("met = of")  # a token that no text has rules the window out
        .select("item_id", "words", "token_words", "p.token", "p.place")
    )
    spots = _spots(docs, _members(prefix.select("token_words", "token").distinct()), window).select("doc_id", "part", "n_words", F.explode_outer("spots").alias("s"))
    spots = spots.withColumn("token", F.coalesce("s.token", F.xxhash64("doc_id", "part")))  # texts without a spot are spread
    start = F.col("s.at") - F.col("w.place")
    fits = (F.col("s.token") == F.col("w.token")) & (F.col("s.token_words") == F.col("w.token_words")) & (start >= 0) & (start + F.size("w.words") <= F.col("n_words"))
    equal = F.slice("s.around", F.col("s.before") - F.col("w.place") + 1, F.size("w.words")) == F.col("w.words")
    near = (F.col("s.before") >= F.col("w.place")) & equal
    size = prefix.agg(F.sum(F.octet_length(F.concat_ws(" ", "item_id", F.array_join("words", "  "))) + 64)).first()[0] or 0
    prefix = F.broadcast(prefix) if size <= BYTES_SENT else prefix
    hits = spots.alias("d").join(prefix.alias("w"), (F.col("d.token") == F.col("w.token")) & fits & near, "left")
    runs = hits.groupBy("doc_id", "part").agg(
        F.max("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("w.item_id").isNotNull(), F.struct(start.alias("a"), (start + F.size("w.words")).alias("b")))).alias("runs"),
        F.sort_array(F.collect_set("w.item_id")).alias("item_ids"),
    )
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, r: F.struct(F.greatest(acc["end"], r["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(acc["end"], r["a"]))).alias("n"))
    hit = F.aggregate(F.sort_array("runs"), zero, step, lambda acc: acc["n"])
    return runs.select("doc_id", "part", "n_words", hit.alias("n_hit"), "item_ids", (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents in which a window of an item occurs."""
    bad = decontaminate(docs, items).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("part").alias("bad_part"))
    rows = docs.select(row_of(docs).alias("row"), "doc_id", text_hash(F.col("text").cast("string")).alias("part"))
    return unpacked(rows.join(bad, same((F.col("doc_id"), F.col("bad_id")), (F.col("part"), F.col("bad_part"))), "left_anti"))
