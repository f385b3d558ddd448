r"""Personal data: fixed patterns, and a character BiLSTM-CRF that adds to them.

Base spans are the leftmost non-overlapping matches of a kind's pattern that
pass its check. The tagger then reads overlapping windows of the text wherever
a window holds a digit, an `@` or a spelled-out at or dot (no span of any kind
can lie elsewhere), and its spans are reconciled over the whole text: one that
touches a window's border and that no other window holds whole is read again
in windows around it, each twice as long as the last, until one holds it whole
(no limit but the text); one that overlaps a base span, or a longer one, goes. What is added must pass
the kind's own check (Luhn for cards, parts of at most 255 for addresses).

The model is trained on the driver from a fixed number of labelled windows and
sent to tasks (some 30 kB). Texts are read one by one: no shuffle, no state.

Defined cases: null text is empty and has no spans; every row gives one row.
A very long text is read window by window, in batches of bounded size.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telarium.llm.char_tagger import KINDS, Tagger, classes, trained
from telarium.llm.common import with_fields

LENGTH, STEP, WINDOWS_AT_ONCE = 112, 64, 512

#: The base patterns. Those of ``email`` are applied at each ``@`` (``_emails``).
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    # a match starts with the first digit of a run and takes whole runs, so no run is tried twice
    "ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_EVIDENCE = re.compile(r"[0-9@]|\[at\]|\(at\)| at (?=[A-Za-z0-9-]+(?:\.| dot | ?\[dot\]|\(dot\)))| dot(?= )|\[dot\]|\(dot\)", re.I)
_DIGITS = re.compile("[0-9]")
_NUMBER = re.compile("[0-9]+")
_SPELLED = re.compile(r"\S+(?: ?@ ?| at | ?\[at\] ?|\(at\))[A-Za-z0-9-]+(?:(?:\.| dot | ?\[dot\] ?|\(dot\))[A-Za-z0-9-]+)+", re.I)
_PHONE = re.compile(r"(?:00[1-9]|0|\(|\+)[0-9][0-9 ()./-]*[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += sum(divmod(2 * d, 10)) if i % 2 else d
    return total % 10 == 0


def _passes(kind: str, value: str) -> bool:
    if kind == "ip":
        return all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in value.split(".")))
    if kind == "card":
        digits = "".join(_DIGITS.findall(value))
        return 16 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 8 <= len(_DIGITS.findall(value)) <= 15
    return True


_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from each ``@`` so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = end + len(text[end:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        end = m.end() if m else at + 1
        at = text.find("@", end)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = []
    for kind, pattern in PATTERNS.items():
        if kind == "email":
            out += [(kind, a, b) for a, b in _emails(text)]
            continue
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _passes(kind, m[0])]
    return out


def _accepted(kind: str, value: str) -> bool:
    """What the tagger may add."""
    if kind == "email":
        return _SPELLED.fullmatch(value) is not None
    if kind == "ip":
        parts = _NUMBER.findall(value)
        return len(parts) == 4 and value[0].isdigit() and value[-1].isdigit() and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return value[0].isdigit() and value[-1].isdigit() and _passes("card", value)
    digits = len(_DIGITS.findall(value))
    return 9 <= digits <= 15 and _PHONE.fullmatch(value) is not None and re.search(r"[ ()/-]", value) is not None


def _windows(text: str) -> list[int]:
    """Starts of the windows that hold evidence; they are STEP apart over the whole text."""
    starts: set[int] = set()
    for m in _EVIDENCE.finditer(text):
        last = m.start() // STEP
        starts.update(s for s in range(max(0, last - (LENGTH - 1) // STEP), last + 1) if s * STEP + LENGTH > m.start())
    return [s * STEP for s in sorted(starts)]


def _tagged(row: np.ndarray, size: int) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the spans in the first ``size`` places of a window."""
    edges = np.flatnonzero(row[:size])
    at = 0
    while at < len(edges):
        a = int(edges[at])
        kind = (int(row[a]) - 1) // 2
        b = a + 1
        while b < size and row[b] == 2 + 2 * kind:
            b += 1
        while at < len(edges) and edges[at] < b:
            at += 1
        yield KINDS[kind], a, b


def added_spans(texts: list[str], tagger: Tagger) -> list[list[tuple[str, int, int]]]:
    """Spans of the tagger for each text, reconciled over its windows."""
    found: list[set[tuple[str, int, int]]] = [set() for _ in texts]
    torn: list[tuple[int, int, int]] = []
    pad = int(classes(" ")[0])

    def read(windows: Iterable[tuple[int, int]], length: int, wanted: dict[tuple[int, int], list[tuple[int, int]]] | None = None) -> None:
        """Adds to ``found`` and ``torn``; of a window in ``wanted``, only what overlaps its places."""
        pending: list[tuple[int, int, np.ndarray]] = []

        def flush() -> None:
            tags = tagger.decode(np.stack([c for _, _, c in pending]).T).T
            for (doc, start, _), row in zip(pending, tags, strict=True):
                if not row.any():
                    continue
                n = len(texts[doc])
                for kind, a, b in _tagged(row, min(length, n - start)):
                    a, b = start + a, start + b
                    if wanted is not None and all(b <= x or a >= y for x, y in wanted[doc, start]):
                        continue
                    if (a > start or start == 0) and (b < start + length or b == n):
                        found[doc].add((kind, a, b))
                    else:
                        torn.append((doc, a, b))
            pending.clear()

        last, codes = -1, np.zeros(0, np.int64)
        for doc, start in windows:
            if doc != last:
                last, codes = doc, classes(texts[doc])
            window = np.full(length, pad)
            part = codes[start : start + length]
            window[: len(part)] = part
            pending.append((doc, start, window))
            if len(pending) * length >= WINDOWS_AT_ONCE * LENGTH:
                flush()
        if pending:
            flush()

    read(((doc, start) for doc, text in enumerate(texts) for start in _windows(text)), LENGTH)
    length = LENGTH
    while torn:
        # windows of one length start at multiples of half of it, so spans share them
        length *= 2
        wanted: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, a, b in torn:
            if not any(x <= a and b <= y for _, x, y in found[doc]):
                step, n = length // 2, len(texts[doc])
                start = 0 if n <= length else max(0, round(((a + b) / 2 - step) / step)) * step
                wanted.setdefault((doc, start), []).append((a, b))
        torn.clear()
        read(sorted(wanted), length, wanted)
    out = []
    for doc, spans in enumerate(found):
        kept: list[tuple[str, int, int]] = []
        for kind, a, b in sorted(spans, key=lambda s: (s[1] - s[2], s[1], s[0])):
            if _accepted(kind, texts[doc][a:b]) and all(b <= x or a >= y for _, x, y in kept):
                kept.append((kind, a, b))
        out.append(kept)
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1])))


def find(docs: DataFrame, tagger: Tagger | None = None, text: str = "text") -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, n_added of the tagger's, and all spans."""
    sent = docs.sparkSession.sparkContext.broadcast((tagger or trained()))
    made = [*(f"n_{k}" for k in KINDS), "base_sha256", "n_added", "spans"]
    docs = docs.drop(*made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                texts = [x or "" for x in part.column(text).to_pylist()]
                with_evidence = [i for i, x in enumerate(texts) if _EVIDENCE.search(x)]
                base: list[list] = [[] for _ in texts]
                spans: list[list] = [[] for _ in texts]
                more = added_spans([texts[i] for i in with_evidence], sent.value)
                for i, extra in zip(with_evidence, more, strict=True):
                    base[i] = base_spans(texts[i])
                    spans[i] = base[i] + [s for s in extra if all(s[2] <= a or s[1] >= b for _, a, b in base[i])]
                columns = [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in KINDS]
                columns += [pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]), pa.array([len(x) - len(b) for x, b in zip(spans, base, strict=True)], pa.int64()), pa.array([_joined(x) for x in spans], pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*part.schema.names, *made])

    fields = ", ".join(f"{name} {'string' if name in ('base_sha256', 'spans') else 'bigint'}" for name in made)
    return docs.mapInArrow(run, with_fields(docs.schema, fields))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and what ``find`` adds."""
    return find(docs.select("doc_id", F.col("text").cast("string").alias("text"))).drop("text")
