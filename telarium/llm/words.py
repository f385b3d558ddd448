"""Words and shingles as 64-bit hashes, computed with numpy over UTF-8 bytes.

The two word classes of the contracts are sets of bytes: every byte of a
character beyond ASCII belongs to a word, so no decoding is needed.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_RNG = np.random.default_rng(20_240_611)
#: One random odd-ish 64-bit value for each byte.
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_STEP = _U(0xD1B54A32D192ED03)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: `[^\x20\x09-\x0D]+`
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (the splitmix64 step)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _STEP, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_spans(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each text the index of its first word."""
    inside = kind[raw]
    n = len(raw)
    edges = offsets[(offsets > 0) & (offsets < n)]
    before = np.empty(n, bool)
    before[1:] = inside[:-1]
    before[:1] = False
    before[edges] = False
    after = np.empty(n, bool)
    after[:-1] = inside[1:]
    after[n - 1 :] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, step: int = 1 << 17) -> np.ndarray:
    """A 64-bit hash of each word, in steps of so many words."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        lengths = e - s
        heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        place = np.arange(int(lengths.sum())) - np.repeat(heads, lengths)
        chars = raw[place + np.repeat(s, lengths)]
        values = _BYTE[_LOWER[chars] if lower else chars] * _powers(int(lengths.max()))[place]
        out[a : a + step] = mix(np.add.reduceat(values, heads) + lengths.astype(np.uint64))
    return out


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, ignoring text borders."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _BASE + words[j : j + n]
    return mix(out + _U(size))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct shingle hashes; a shorter text is one shingle."""
    starts, ends, first = word_spans(raw, offsets, SPACED)
    words = word_hashes(raw, starts, ends)
    runs = shingle_hashes(words, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(shingle_hashes(words[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
