"""Byte-level BPE: encode and decode whole texts with a contiguous rank array.

A text is split by the vocabulary's own pattern. White space with the word
behind it is a unit that no piece crosses, so its ids are kept in a dictionary
of bounded size and merged once. Merging holds the part
boundaries of a piece and, beside them, the rank of each adjacent pair in one
array: find the least rank, delete the boundary between the two parts, refresh
the ranks of the two neighbours, until no pair has a rank. A scan of the array
costs its length, so pieces beyond ``LONG`` bytes (text without a break) take
their least rank from a heap instead and keep their parts in a linked list;
the merges are the same ones.

Defined cases: null text counts as empty: no ids, empty decoded text. Every
row gives one row; no shuffle, so ties and repeats need no rule. A very long
text costs n log n at worst and memory of its own size.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.llm.common import with_fields

#: Fixed value: the pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker keeps with their ids; it starts anew beyond.
CACHE_UNITS = 600_000
#: Bytes beyond which a piece is merged with a heap.
LONG = 160
_NONE = 1 << 60
#: Fixed value: the characters with the Unicode property White_Space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_UNITS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Counts(dict):
    """Number of ids of a unit, worked out when it is first asked for."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, unit: str) -> int:
        n = sum(len(self.codec.merge(piece.encode())) for piece in self.codec.pieces.findall(unit))
        if len(unit) <= 64:
            self[unit] = n
        return n


class Codec:
    """A vocabulary read from a tokenizer file's text, or from a file of ranks."""

    def __init__(self, text: str):
        self.known: dict[str, tuple[int, ...]] = {}
        #: one object for each id, which all units share
        self.shared: list[int] = []
        self.counts = _Counts(self)
        self.pieces = regex.compile(PATTERN)
        self.rank: dict[int, int] = {}
        if text.startswith("{"):
            self._from_merges(json.loads(text))
        else:
            self._from_ranks(text)

    def _from_ranks(self, text: str) -> None:
        """Lines of a token (base 64) and its rank; a token is what two earlier ones were merged to."""
        self.id_of = {base64.b64decode(token): int(n) for token, n in map(str.split, text.splitlines())}
        self.first = [self.id_of[bytes([b])] for b in range(256)]
        self.bytes_of = {i: s for s, i in self.id_of.items()}
        for token, i in sorted(self.id_of.items(), key=lambda x: x[1]):
            if len(token) > 1 and len(parts := self.merge(token)) == 2:
                self.rank[parts[0] << 20 | parts[1]] = i << 20 | i
        self.special, self.split_special = {}, None

    def _from_merges(self, data: dict) -> None:
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.id_of = {raw(s): i for s, i in data["model"]["vocab"].items()}
        #: (left id << 20 | right id) -> (merge number << 20 | merged id)
        for n, pair in enumerate(data["model"]["merges"]):
            a, b = map(raw, pair.split(" ") if isinstance(pair, str) else pair)
            self.rank.setdefault(self.id_of[a] << 20 | self.id_of[b], n << 20 | self.id_of[a + b])
        self.first = [self.id_of[bytes([b])] for b in range(256)]
        self.bytes_of = {i: s for s, i in self.id_of.items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        if len(piece) > LONG:
            return self.merge_long(piece)
        rank, first = self.rank, self.first
        parts = [first[b] for b in piece]
        ranks = [rank.get(a << 20 | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) != _NONE:
            i = ranks.index(best)
            parts[i] = merged = best & 0xFFFFF
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] << 20 | merged, _NONE)
            if i < len(ranks):
                ranks[i] = rank.get(merged << 20 | parts[i + 1], _NONE)
        return parts

    def merge_long(self, piece: bytes) -> list[int]:
        """``merge`` with a heap of (rank, place): the least rank, the leftmost of equals."""
        rank, n = self.rank, len(piece)
        parts = [self.first[b] for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            best, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= n or rank.get(parts[i] << 20 | parts[j]) != best:
                continue  # one of the two was merged since
            parts[i], parts[j] = best & 0xFFFFF, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(parts[i] << 20 | parts[k])) is not None:
                    heapq.heappush(heap, (r, i))
            h = before[i]
            if h >= 0 and (r := rank.get(parts[h] << 20 | parts[i])) is not None:
                heapq.heappush(heap, (r, h))
        return [p for p in parts if p >= 0]

    def _unit(self, unit: str) -> tuple[int, ...]:
        """Ids of white space with the word behind it; no piece crosses its ends."""
        out: list[int] = []
        for piece in self.pieces.findall(unit):
            out += self.merge(piece.encode())
        if len(self.known) >= CACHE_UNITS:
            self.known.clear()
        if not self.shared:
            self.shared = list(range(1 + max(self.bytes_of)))
        ids = tuple(map(self.shared.__getitem__, out))
        if len(unit) <= 64:
            self.known[unit] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        known = self.known
        for unit in _UNITS(text):
            out += known.get(unit) or self._unit(unit)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        if self.split_special is None or not any(s in text for s in self.special):
            self._plain(text, out)
            return out
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:
                out.append(self.special[part])
            else:
                self._plain(part, out)
        return out

    def count(self, text: str) -> int:
        """Number of ids of a text; only numbers are kept for known units."""
        counts = self.counts
        if len(counts) >= CACHE_UNITS:
            counts.clear()
        if self.split_special is None or not any(s in text for s in self.special):
            return sum(map(counts.__getitem__, _UNITS(text)))
        return sum(1 if i % 2 else sum(map(counts.__getitem__, _UNITS(part))) for i, part in enumerate(self.split_special.split(text)))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def _codec(text: str) -> Codec:
    return Codec(text)


def encode(docs: DataFrame, vocabulary: str | Path, ids: bool = True, text: str = "text") -> DataFrame:
    """``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Extra columns are carried unless they have one of these names. The
    vocabulary is sent once to each executor (a few MB, whatever the input).
    """
    sent = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    made = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * ids]
    docs = docs.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                n, digests, decoded, all_ids = [], [], [], []
                for value in part.column(text).to_pylist():
                    found = codec.encode(value or "")
                    n.append(len(found))
                    digests.append(hashlib.sha256(",".join(map(str, found)).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(found).encode()).hexdigest())
                    if ids:
                        all_ids.append(pa.array(found, pa.int32()))
                columns = [pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                if ids:
                    columns.append(pa.array([x.to_pylist() for x in all_ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *made])

    fields = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.mapInArrow(run, with_fields(docs.schema, fields))


def decode(tokens: DataFrame, vocabulary: str | Path, ids: str = "ids") -> DataFrame:
    """``tokens`` with ``decoded``, the text of its ids (null ids: empty text)."""
    sent = tokens.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text())
    tokens = tokens.drop("decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(sent.value)
        for batch in batches:
            texts = [codec.decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(run, with_fields(tokens.schema, "decoded string"))


def digests(docs: DataFrame, vocabulary: str | Path) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return encode(docs.select("doc_id", F.col("text").cast("string").alias("text")), vocabulary, ids=False).drop("text")
