r"""Runs of repeated words: maximal periodic stretches, and texts without them.

A run is a stretch of consecutive words with smallest period q and a length of
at least ``max(SHORTEST, 3 * q)`` that no neighbouring word extends keeping q.

Method: Ukkonen's suffix trees of the words and of their reversal; an Euler
tour of each with a sparse table of minima answers the longest common
extension of two places (the string depth of their lowest common ancestor) in
constant time. The longest Lyndon words that start at each place, under one
order of the words and under its opposite (the next smaller and the next
greater suffix), are the only candidates for a run's root; each is extended to
both sides.

Trees are built over those parts of a text only that can hold a run: of a run,
every ``GRAM`` consecutive words occur in it twice (there are at least
``max(16, 3q - 8) >= 2q`` of them), so a place whose nine words are met once
in the text lies in no run. That is a test of hashes which can err towards
keeping a part, never towards losing one, and a run lies whole in one part.

Defined cases: null or empty text has no words and no runs, its collapsed text
is empty. Rows are independent, so ties, repeated rows and an empty table need
no rule; among runs of equal exponent the smallest start, then the smallest
period is the greatest. A text is worked on alone, in memory of some hundred
bytes a word of its periodic parts. Columns of the caller named like the
results are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.llm.common import with_fields

#: Fewest words of a run, and fewest periods.
SHORTEST, PERIODS = 24, 3
#: Words that occur twice in any run (see above).
GRAM = 9
_WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Words whose hashes are sorted at once.
_BLOCK_WORDS = 1 << 17

Rewrite = Callable[[int | None, list[str]], list[str]]


def suffix_tree(s: list[int], sigma: int) -> tuple[list[int], dict[int, int], list[int]]:
    """Ukkonen: string depth of each node, children by ``node * sigma + symbol``, leaves by suffix.

    ``s`` ends with a symbol that occurs nowhere else in it.
    """
    m = len(s)
    start, end, link, depth, edge, leaves = [0], [0], [0], [0], {}, []
    node = at = length = waiting = 0
    for i, c in enumerate(s):
        waiting += 1
        last = 0
        while waiting:
            if not length:
                at = i
            key = node * sigma + s[at]
            child = edge.get(key)
            if child is None:
                edge[key] = len(start)
                leaves.append(len(start))
                start.append(i)
                end.append(m)
                link.append(0)
                depth.append(m - i + waiting - 1)
                if last:
                    link[last] = node
                    last = 0
            else:
                first = start[child]
                size = end[child] - first
                if length >= size:
                    node, length, at = child, length - size, at + size
                    continue
                if s[first + length] == c:
                    length += 1
                    if last:
                        link[last] = node
                    break
                mid, cut = len(start), first + length
                edge[key] = mid
                start += (first, i)
                end += (cut, m)
                link += (0, 0)
                depth += (waiting - 1, m - i + waiting - 1)
                leaves.append(mid + 1)
                start[child] = cut
                edge[mid * sigma + c] = mid + 1
                edge[mid * sigma + s[cut]] = child
                if last:
                    link[last] = mid
                last = mid
            waiting -= 1
            if node:
                node = link[node]
            elif length:
                length -= 1
                at = i - waiting + 1
    return depth, edge, leaves


class Extensions:
    """Longest common extension of any two suffixes in constant time."""

    def __init__(self, s: list[int], sigma: int):
        depth, edge, leaves = suffix_tree(s, sigma)
        n = len(depth)
        keys = np.fromiter(edge.keys(), np.int64, len(edge))
        order = np.argsort(keys)
        child = np.fromiter(edge.values(), np.int64, len(edge))[order].tolist()
        bounds = np.searchsorted(keys[order], np.arange(n + 1) * sigma).tolist()
        #: string depths along the Euler tour, and where each leaf stands in it
        tour, place = [0], [0] * n
        path, here, children = [], 0, iter(child[: bounds[1]])
        while True:
            for c in children:
                d = depth[c]
                if bounds[c] == bounds[c + 1]:
                    place[c] = len(tour)
                    tour += (d, here)
                else:
                    path.append((here, children))
                    tour.append(d)
                    here, children = d, iter(child[bounds[c] : bounds[c + 1]])
                    break
            else:
                if not path:
                    break
                here, children = path.pop()
                tour.append(here)
        self.place = np.array(place, np.int64)[np.array(leaves, np.int64)]
        self.minima = [np.array(tour, np.int32)]
        width = 1
        while 2 * width <= len(tour):
            self.minima.append(np.minimum(self.minima[-1][:-width], self.minima[-1][width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Lengths of what the suffixes at ``a`` and ``b`` (different places) have in common."""
        x, y = self.place[a], self.place[b]
        x, y = np.minimum(x, y), np.maximum(x, y) + 1
        level = np.frexp((y - x).astype(np.float64))[1] - 1
        out = np.zeros(len(x), np.int64)
        for k in np.unique(level):
            at = level == k
            row = self.minima[k]
            out[at] = np.minimum(row[x[at]], row[y[at] - (1 << int(k))])
        return out


def _lyndon_ends(rank: list[int]) -> tuple[list[int], list[int]]:
    """For each suffix, the next one that is smaller and the next one that is greater; 0 where there is none."""
    m = len(rank)
    smaller, greater = [0] * m, [0] * m
    low: list[int] = []
    high: list[int] = []
    for i, r in enumerate(rank):
        while low and rank[low[-1]] > r:
            smaller[low.pop()] = i
        while high and rank[high[-1]] < r:
            greater[high.pop()] = i
        low.append(i)
        high.append(i)
    return smaller, greater


def runs_of(symbols: list[int], shortest: int = SHORTEST, periods: int = PERIODS) -> np.ndarray:
    """Rows (start, length, period) of all runs of a sequence, by start, then period."""
    n = len(symbols)
    number: dict[int, int] = {}
    s = [number.setdefault(x, len(number) + 1) for x in symbols]
    sigma = len(number) + 1
    ahead = Extensions([*s, 0], sigma)
    rank = np.empty(n + 1, np.int64)
    rank[np.argsort(ahead.place)] = np.arange(n + 1)
    starts, ends = [], []
    for found in _lyndon_ends(rank.tolist()):
        to = np.array(found[:n], np.int64)
        period = to - np.arange(n)
        at = np.flatnonzero((to > 0) & (to < n) & (period * periods <= n))
        starts.append(at)
        ends.append(to[at])
    i, j = np.concatenate(starts), np.concatenate(ends)
    right = ahead(i, j)
    fits = (j - i) + right >= 2 * (j - i)  # a run of three periods holds a root with a period behind it
    i, j, right = i[fits], j[fits], right[fits]
    if not len(i):
        return np.zeros((0, 3), np.int64)
    back = Extensions([*s[::-1], 0], sigma)
    left = back(n - i, n - j)
    left[i == 0] = 0
    start, length, period = i - left, j - i + left + right, j - i
    keep = length >= np.maximum(shortest, periods * period)
    return np.unique(np.stack([start, length, period], 1)[keep], axis=0)


def _parts(texts: list[list[str]]) -> list[list[tuple[int, int]]]:
    """Of each text, the (start, end) of the parts that can hold a run."""
    sizes = np.array([len(w) for w in texts])
    total = int(sizes.sum())
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if total < SHORTEST:
        return out
    h = np.fromiter((hash(x) for w in texts for x in w), np.int64, total).view(np.uint64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), sizes)
    before = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    gram = np.zeros(total - GRAM + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            gram = gram * _MIX + h[k : total - GRAM + 1 + k]
        gram ^= gram >> np.uint64(29)
        gram = (gram ^ doc[: len(gram)].view(np.uint64)) * _MIX
    whole = doc[: len(gram)] == doc[GRAM - 1 :]
    order = np.argsort(gram)
    equal = gram[order[1:]] == gram[order[:-1]]
    twice = np.zeros(len(gram) + 2, np.int8)
    twice[order[1:][equal] + 1] = twice[order[:-1][equal] + 1] = 1
    twice[1:-1] &= whole
    step = np.diff(twice)
    for a, b in zip(np.flatnonzero(step == 1).tolist(), np.flatnonzero(step == -1).tolist(), strict=True):
        if b - a >= SHORTEST - GRAM + 1:
            first = int(doc[a])
            out[first].append((a - before[first], b - before[first] + GRAM - 1))
    return out


def _find(texts: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, by start, then period."""
    out = []
    for words, parts in zip(texts, _parts(texts), strict=True):
        found = []
        for a, b in parts:
            number: dict[str, int] = {}
            rows = runs_of([number.setdefault(x, len(number)) for x in words[a:b]])
            rows[:, 0] += a
            found += map(tuple, rows.tolist())
        out.append(sorted(found, key=lambda r: (r[0], r[2])))
    return out


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> str:
    """The words without those that lie in a run behind its first period."""
    if not runs:
        return " ".join(words)
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist())


def find(docs: DataFrame, rewrite: Rewrite | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with runs (array of start, length, period) and collapsed (text without repetition).

    ``rewrite`` takes a row's key and its words and gives the words to look at.
    """
    docs = docs.drop("runs", "collapsed")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(key).to_pylist() if rewrite else None
            texts, at, words = [], 0, 0
            for k, value in enumerate(batch.column(text)):
                w = _WORDS(value.as_py() or "")
                texts.append(rewrite(keys[k], w) if rewrite else w)
                words += len(w)
                if words >= _BLOCK_WORDS or k + 1 == len(batch):
                    found = _find(texts)
                    columns = [
                        pa.array([[{"start": a, "length": b, "period": c} for a, b, c in r] for r in found], kind),
                        pa.array([collapsed(w, r) for w, r in zip(texts, found, strict=True)], pa.string()),
                    ]
                    part = batch.slice(at, k + 1 - at)
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, "runs", "collapsed"])
                    texts, at, words = [], k + 1, 0

    return docs.mapInArrow(run, with_fields(docs.schema, "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"))


def planted(key: int | None, words: list[str]) -> list[str]:
    """The words that the production query looks at: one document in ten repeats itself from some word on."""
    n = len(words)
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def digests(docs: DataFrame, rewrite: Rewrite | None = planted) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent, and digests of the runs and of the collapsed text."""
    found = find(docs.select("doc_id", F.col("text").cast("string").alias("text")), rewrite).drop("text")

    def greater(a, b):  # lengths and periods are below 2^31, so the products are exact
        return (a["start"].isNull()) | (b["length"] * a["period"] > a["length"] * b["period"])

    none = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    best = F.aggregate("runs", none, lambda a, b: F.when(greater(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listing = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listing, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
