r"""Token ids by the tokenizers and sentencepiece libraries, each distinct word encoded once.

No piece of a byte-level vocabulary's pattern crosses the end of a *unit*:
white space with the word behind it. Nor does a piece of a sentencepiece model
whose pieces hold U+2581 at their beginning only. So a text's ids are those of
its units one behind another. Units are numbered when first met and given to
the libraries many at a time; the ids of a block of texts are then gathered by
the units' numbers. The store is bounded: when it is full, units that few
blocks had go.

A unit is written without the space that it begins with. A tuple of one string
is a text that has to be encoded as it stands: a text's first word, white
space other than a space, or a whole text (one with the string of a special
token, or with a U+2581 of its own). Where a text's white space is single
spaces and line ends, units are what lies between its spaces; other texts are
cut by a pattern.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import chain

import numpy as np

from telarium.llm.bpe import WHITE, Codec, byte_letters

#: Units and ids a worker keeps.
KEPT, KEPT_IDS = 1_200_000, 8_000_000
#: Units that go to a library as one text.
_AT_ONCE = 4096
_OTHER = WHITE.replace(" ", "", 1)
#: White space and a word.
WORDS = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+").findall
#: Of a text that begins with a space: cut before each space behind a character that is not white space.
SPACED = re.compile(f" [{WHITE}]*[^{WHITE}]*(?:[{_OTHER}][{WHITE}]*[^{WHITE}]*)*").findall

_RARE = re.compile(f"[{_OTHER.replace(chr(92) + 't-' + chr(92) + 'r', '')}]").search

Unit = str | tuple[str]
#: Units to their ids in one array and the number of ids of each.
Encode = Callable[[list[Unit]], tuple[np.ndarray, np.ndarray]]


def _simple(text: str) -> bool:
    """Whether each space of a text has a word on one side that it can be told from, so that no piece crosses it."""
    odd = "  " in text or "\n \n" in text or text.endswith("\n ") or "\t" in text or "\r" in text or "\x0b" in text or "\x0c" in text
    return not odd and (text.isascii() or not _RARE(text))


class _Numbers(dict):
    """Number of a unit; a new one gets the next."""

    def __init__(self):
        self.new: list[Unit] = []

    def __missing__(self, unit: Unit) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class Units:
    """Ids of units by one or more encoders; with ``only_counts``, how many each unit has and no ids."""

    def __init__(self, *encoders: Encode, only_counts: bool = False):
        self.encoders, self.only_counts = encoders, only_counts
        self.numbers = _Numbers()
        self.blocks = np.zeros(0, np.int32)  # blocks that had the unit
        self.ids = [np.zeros(0, np.int32) for _ in encoders]
        self.starts = [np.zeros(1, np.int64) for _ in encoders]

    def _trim(self) -> None:
        """Keeps the half, or fewer, that most blocks had."""
        least = 2
        while (keep := self.blocks >= least).sum() > len(keep) // 2:
            least *= 2
        kept = np.flatnonzero(keep)
        names = list(self.numbers)
        self.numbers = _Numbers()
        self.numbers.update(zip([names[k] for k in kept], range(len(kept)), strict=True))
        self.blocks = self.blocks[kept] // 2
        for k, (ids, starts) in enumerate(zip(self.ids, self.starts, strict=True)):
            if not self.only_counts:
                self.ids[k] = ids[np.repeat(keep, np.diff(starts))]
            self.starts[k] = np.concatenate([[0], np.cumsum(np.diff(starts)[kept])])

    def _numbered(self, texts: list[list[Unit]]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the units of all texts, and where each text ends; new units go to the encoders."""
        if len(self.numbers) > KEPT or max(starts[-1] for starts in self.starts) > KEPT_IDS:
            self._trim()
        sizes = np.array(list(map(len, texts)), np.int64)
        units = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
        if new := self.numbers.new:
            for k, encode in enumerate(self.encoders):
                ids, counts = encode(new)
                if not self.only_counts:
                    self.ids[k] = np.concatenate([self.ids[k], ids.astype(np.int32)])
                self.starts[k] = np.concatenate([self.starts[k], self.starts[k][-1] + np.cumsum(counts)])
            self.numbers.new = []
            self.blocks = np.concatenate([self.blocks, np.zeros(len(new), np.int32)])
        self.blocks[units] += 1
        return units, np.cumsum(sizes)

    def counts(self, texts: list[list[Unit]]) -> list[np.ndarray]:
        """For each encoder, how many ids each text has."""
        units, ends = self._numbered(texts)
        each = (np.concatenate([[0], np.cumsum(np.diff(starts)[units])]) for starts in self.starts)
        return [np.diff(upto[ends], prepend=0) for upto in each]

    def gather(self, texts: list[list[Unit]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each encoder, the ids of all texts and how many each text has."""
        units, ends = self._numbered(texts)
        out = []
        for ids, starts in zip(self.ids, self.starts, strict=True):
            first = starts[units]
            count = starts[units + 1] - first
            upto = np.concatenate([[0], np.cumsum(count)])
            at = np.repeat(first - upto[:-1], count)
            at += np.arange(len(at))
            out.append((ids[at], np.diff(upto[ends], prepend=0)))
        return out


class ByteLevel:
    """A byte-level BPE of a tokenizers file; ``special``: strings of special tokens become their ids."""

    def __init__(self, text: str, special: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        data = json.loads(text)
        if data.get("normalizer") is not None or data["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("the vocabulary changes texts before it splits them")
        letter = byte_letters()
        vocabulary = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = 1 + max([*vocabulary.values(), *added.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocabulary.items():
            if token not in added:
                self.bytes_of[i] = bytes(letter[c] for c in token)
        self.width = np.array(list(map(len, self.bytes_of)))
        self.special = tuple(added) if special else ()
        self.whole, self.plain = Tokenizer.from_str(text), Tokenizer.from_str(text)
        for library in (self.whole, self.plain):
            library.no_truncation()
            library.no_padding()
        self.whole.encode_special_tokens = not special
        self.plain.encode_special_tokens = True

    def cut(self, text: str) -> list[Unit]:
        if any(s in text for s in self.special):
            return [(text,)]
        if not _simple(text):
            return [u[1:] if u[0] == " " else (u,) for u in WORDS(text)]
        first, *units = text.split(" ")
        return [(first,), *units] if first else units

    def _ids(self, text: str) -> list[int]:
        return self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode(self, units: list[Unit]) -> tuple[np.ndarray, np.ndarray]:
        """Where a space stands behind a word, units don't meet, so they can go to the library together."""
        together = [type(u) is str and u != "" and not u[-1].isspace() for u in units]
        alone = lambda u: self._ids(f" {u}") if type(u) is str else self.whole.encode_batch_fast([u[0]], add_special_tokens=False)[0].ids
        return _encoded(units, together, lambda some: self._ids(" " + " ".join(some)), alone, self.width)


def tokenizers_file(text: str) -> str:
    """A tokenizers file's text as it is; of a file of ranks, the tokenizers file with its tokens and merges."""
    if text.startswith("{"):
        return text
    codec, letter = Codec(text), {b: c for c, b in byte_letters().items()}
    names = {i: "".join(map(letter.__getitem__, token)) for token, i in codec.id_of.items()}
    merges = [[names[pair >> 20], names[pair & 0xFFFFF]] for pair, _ in sorted(codec.rank.items(), key=lambda x: x[1])]
    split = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    return json.dumps({"version": "1.0", "added_tokens": [], "pre_tokenizer": split, "decoder": split, "model": {"type": "BPE", "vocab": {name: i for i, name in names.items()}, "merges": merges}})


def _encoded(units: list[Unit], together: list[bool], joined: Callable[[list[str]], list[int]], alone: Callable[[Unit], list[int]], width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units: of those marked ``together`` many at a time, each taking the ids that make up its bytes."""
    some = [u for u, x in zip(units, together, strict=True) if x]
    mark = np.array(together, bool)
    counts, found = np.zeros(len(units), np.int64), [np.zeros(0, np.int32)]
    for at in range(0, len(some), _AT_ONCE):
        found.append(np.array(joined(some[at : at + _AT_ONCE]), np.int32))
    ids = np.concatenate(found)
    ends = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in some), np.int64, len(some)))
    bytes_upto = np.cumsum(width[ids])
    if len(some) and bytes_upto[-1] != ends[-1]:
        raise ValueError("the vocabulary doesn't give back the bytes of a unit")
    counts[mark] = np.diff(np.searchsorted(bytes_upto, ends) + 1, prepend=0)
    if len(some) == len(units):
        return ids, counts
    others = [alone(u) for u, x in zip(units, together, strict=True) if not x]
    counts[~mark] = list(map(len, others))
    own = np.repeat(mark, counts)
    out = np.empty(len(own), np.int32)
    out[own] = ids
    out[~own] = list(chain.from_iterable(others))
    return out, counts


class Pieces:
    """A sentencepiece model with byte fallback; texts are given with the space that it puts in front."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        one_byte = re.compile("<0x([0-9A-F]{2})>")
        self.bytes_of = [bytes([int(m[1], 16)]) if self.library.is_byte(i) and (m := one_byte.fullmatch(s)) else s.replace("▁", " ").encode() for i, s in enumerate(names)]
        self.width = np.array(list(map(len, self.bytes_of)))
        self.space = self.library.encode("a ")[len(self.library.encode("a")) :]
        sample = "  A\n ﬁá "
        plain = b"".join(self.bytes_of[i] for i in self.library.encode(sample)) == f" {sample}".encode()
        #: whether ids of units make up those of texts
        self.by_units = plain and not any(re.search("[^▁]▁", s) for s in names)

    def cut(self, spaced: str) -> list[Unit]:
        """A U+2581 of the text's own is a space to the model, so its units would meet."""
        if not self.by_units or "▁" in spaced:
            return [(spaced,)]
        return spaced[1:].split(" ") if _simple(spaced) else [u[1:] for u in SPACED(spaced)]

    def _alone(self, unit: Unit) -> list[int]:
        # the library gives nothing for the empty text, but a piece for a space at a text's end
        return self.space if unit == "" else self.library.encode(unit if type(unit) is str else unit[0][1:])

    def encode(self, units: list[Unit]) -> tuple[np.ndarray, np.ndarray]:
        together = [type(u) is str and u != "" and u[-1] != " " for u in units]
        return _encoded(units, together, lambda some: self.library.encode(" ".join(some)), self._alone, self.width)


@lru_cache(maxsize=4)
def byte_level(text: str, special: bool) -> ByteLevel:
    return ByteLevel(text, special)


@lru_cache(maxsize=2)
def byte_level_units(text: str, special: bool) -> Units:
    """The units that a worker keeps from task to task."""
    return Units(byte_level(text, special).encode)


class Counter:
    """Numbers of ids of texts by several byte-level vocabularies, which share the units."""

    def __init__(self, texts: tuple[str, ...]):
        self.codecs = [byte_level(text, True) for text in texts]
        self.special = {s for codec in self.codecs for s in codec.special}
        self.units = Units(*(codec.encode for codec in self.codecs), only_counts=True)

    def _cut(self, text: str) -> list[Unit]:
        return [(text,)] if any(s in text for s in self.special) else self.codecs[0].cut(text)

    def counts(self, texts: list[str | None]) -> list[np.ndarray]:
        return self.units.counts([self._cut(t) if t else [] for t in texts])


@lru_cache(maxsize=2)
def counter(texts: tuple[str, ...]) -> Counter:
    """The counter that a worker keeps from task to task."""
    return Counter(texts)


@lru_cache(maxsize=2)
def pieces(model: bytes) -> Pieces:
    return Pieces(model)
