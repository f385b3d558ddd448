"""Operators 11 to 13 against brute force: whole texts, nulls, empties, repeats, ties, clashing columns, empty tables."""

import hashlib
import random
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telarium.llm import id_store, period_runs, token_alignment, unit_codec
from telarium.llm.common import folder
from telarium.llm.queries import PIECES, VOCABULARY

RNG = random.Random(11)
ALPHABET = [*" \n\t  \x1c\x85　 ab'sé1２,.-_<|>▁日本é̈🙂\x00\r", "<|endoftext|>", "<s>", "hello", "  ", "   "]
NOISE = ["".join(RNG.choice(ALPHABET) for _ in range(RNG.randint(0, 40))) for _ in range(400)]
PROSE = [" ".join(RNG.choice(["the", "of", "Zebra,", "don't", "naïve.\nNew", "x" * 30, "12345", "日本語"]) for _ in range(RNG.randint(1, 300))) for _ in range(60)]
TEXTS = [*NOISE, *PROSE, PROSE[0], None, "", " ", "\n", "▁", "a<|endoftext|>b", " ".join(PROSE) * 3, "no" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"own{i}", 1) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, PROSE[1], "x", 1)], "doc_id long, text string, runs string, row__ int").repartition(5).cache()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(VOCABULARY), sentencepiece.SentencePieceProcessor(model_file=PIECES)


# operator 11


def test_units_equal_the_libraries(library):
    tokens, pieces = library
    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    texts = [t or "" for t in TEXTS]
    special, own = unit_codec.ByteLevel(open(VOCABULARY).read(), True), unit_codec.ByteLevel(open(VOCABULARY).read(), False)
    b = unit_codec.Pieces(open(PIECES, "rb").read())
    assert b.by_units
    both = unit_codec.Units(own.encode, b.encode)

    def split(found):
        ends = np.cumsum(found[1])
        return [found[0][e - n : e].tolist() for n, e in zip(found[1], ends, strict=True)]

    assert split(unit_codec.Units(special.encode).gather([special.cut(t) for t in texts])[0]) == [tokens.encode(t, add_special_tokens=False).ids for t in texts]
    a, c = both.gather([b.cut(f" {t}") if t else [] for t in texts])
    assert split(a) == [plain.encode(f" {t}", add_special_tokens=False).ids if t else [] for t in texts]
    assert split(c) == [pieces.encode(t) for t in texts]


def test_store(spark, docs, library):
    at = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    id_store.write(docs, VOCABULARY, at)
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    want, start = [], 0
    for key, text in rows:
        ids = [*library[0].encode(text or "", add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    got = [tuple(r) for r in id_store.get(spark, at, docs).collect()]
    assert sorted(got, key=lambda r: r[1]) == want
    some = spark.createDataFrame([(5,), (10**9,), (None,), (-3,), (5,)], "doc_id long")
    assert sorted(r.doc_id or -1 for r in id_store.get(spark, at, some, ids=False).collect()) == [-1, 5]
    with pytest.raises(Exception, match="(?i)no such file|not found|does not exist|FileNotFound"):
        id_store.get(spark, f"{at}-none", some).collect()


def test_store_of_nothing_of_one_key_and_of_strings(spark, library):
    at = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    none = spark.createDataFrame([], "doc_id long, text string")
    id_store.write(none, VOCABULARY, at)
    assert id_store.get(spark, at, spark.range(5).withColumnRenamed("id", "doc_id")).count() == 0
    # one key holds all rows: they are dealt to several shards and all of them are read
    at = f"{folder(spark)}/store-{uuid.uuid4().hex}"
    texts = [f"text {i}" for i in range(2500)] + ["same"] * 700
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        id_store.write(spark.createDataFrame([("k", t) for t in texts] + [("z", "last")], "doc_id string, text string"), VOCABULARY, at, end=None)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{at}/entries").where("key = 'k'").select("shard").distinct().count() > 4
    got = id_store.get(spark, at, spark.createDataFrame([("k",), ("z",), ("y",)], "doc_id string")).collect()
    want = Counter(tuple(library[0].encode(t, add_special_tokens=False).ids) for t in texts)
    assert Counter(tuple(r.ids) for r in got if r.doc_id == "k") == want
    spans = sorted((r.start, r.n_tokens) for r in got)
    assert [s for s, _ in spans] == np.cumsum([0, *(n for _, n in spans)])[:-1].tolist()


def test_perfect_hash():
    rng = np.random.default_rng(4)
    hashes = np.unique(rng.integers(0, 2**63, 20_000).astype(np.uint64))
    mph, without = id_store.PerfectHash.of(hashes)
    assert not without.any() and sorted(mph.slots(hashes).tolist()) == list(range(len(hashes)))
    # keys of one hash, and foreign keys
    twice = np.concatenate([hashes[:50], hashes[:3]])
    keys = [f"k{i}" for i in range(53)]
    positions = np.zeros(53, id_store.SLOT)
    positions["at"] = np.arange(53)
    index = id_store.Index(id_store.build_index(twice, keys, positions))
    found, met = index.find(twice, keys)
    assert met.all() and found["at"].tolist() == list(range(53))
    assert not index.find(hashes[100:15_000], ["foreign"] * 14_900)[1].any()
    empty = id_store.Index(id_store.build_index(hashes[:0], [], positions[:0]))
    assert not empty.find(hashes, ["x"] * len(hashes))[1].any()


# operator 12


def brute_runs(w, shortest=24, periods=3):
    out = set()
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            size = j - i + p
            if j > i and size >= max(shortest, periods * p):
                part = w[i : i + size]
                if not any(part[d:] == part[:-d] for d in range(1, p)):
                    out.add((i, size, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(k):
    w = [RNG.randrange(k) for _ in range(RNG.randint(0, 60))]
    for _ in range(RNG.randint(0, 3)):
        base, at = [RNG.randrange(k) for _ in range(RNG.randint(1, 12))], RNG.randint(0, len(w))
        w[at:at] = [base[i % len(base)] for i in range(RNG.randint(20, 70))]
    return [f"w{x}" for x in w]


def test_extensions_and_runs():
    for _ in range(150):
        s = [RNG.randrange(1, RNG.choice([2, 3, 9])) for _ in range(RNG.randint(2, 60))]
        a, b = np.array(RNG.choices(range(len(s)), k=40)), np.array(RNG.choices(range(len(s)), k=40))
        a, b = a[a != b], b[a != b]
        common = [next((k for k in range(len(s)) if max(x, y) + k >= len(s) or s[x + k] != s[y + k]), 0) for x, y in zip(a, b, strict=True)]
        assert period_runs.Extensions([*s, 0], max(s) + 1)(a, b).tolist() == common
        assert sorted(map(tuple, period_runs.runs_of(s, 2).tolist()), key=lambda r: (r[0], r[2])) == brute_runs(s, 2)


def test_period_runs(spark, docs):
    texts = [" ".join(periodic(RNG.choice([1, 2, 3, 5, 40]))) for _ in range(250)]
    texts += [None, "", " \n", "one", " ".join(["a"] * 24), " ".join(["a"] * 23), " ".join(["b", "a"] * 15_000), " ".join(["q"] * 40)]
    table = spark.createDataFrame([*((i, t, "clash") for i, t in enumerate(texts)), (None, texts[0], "clash"), (7, texts[7], "clash")], "doc_id long, text string, collapsed string")

    def want(key, text, plant):
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
        n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
        if plant and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n < 5000 else [(0, n, 2)]
        drop = {i for s, size, p in runs for i in range(s + p, s + size)}
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
        listed = "".join(f"{s},{size},{p}\n" for s, size, p in runs)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return (key, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha(listed), sha(" ".join(x for i, x in enumerate(w) if i not in drop)))

    rows = [(r.doc_id, r.text) for r in table.collect()]
    for plant in (True, False):
        got = Counter(tuple(r) for r in period_runs.digests(table, period_runs.planted if plant else None).collect())
        assert got == Counter(want(k, t, plant) for k, t in rows)
    out = period_runs.find(docs)
    assert out.columns == ["doc_id", "text", "row__", "runs", "collapsed"] and out.count() == docs.count()
    assert period_runs.digests(docs.where("false")).count() == 0


# operator 13


def brute_alignment(rows, library):
    tokens = Tokenizer.from_file(VOCABULARY)
    tokens.encode_special_tokens = True
    a_of, b_of = token_alignment.Aligner(open(VOCABULARY).read(), open(PIECES, "rb").read()).a.bytes_of, {}
    for i in range(library[1].get_piece_size()):
        s = library[1].id_to_piece(i)
        b_of[i] = bytes([int(s[3:5], 16)]) if library[1].is_byte(i) else s.replace("▁", " ").encode()
    out, docs_of = [], defaultdict(int)
    for key, text in rows:
        a, b = (tokens.encode(f" {text}", add_special_tokens=False).ids, library[1].encode(text)) if text else ([], [])
        x, y = [a_of[i] for i in a], [b_of[i] for i in b]
        if not text or b"".join(x) != f" {text}".encode() or b"".join(y) != f" {text}".encode():
            out.append((key, None))
            continue
        ea, eb = np.cumsum(list(map(len, x))), np.cumsum(list(map(len, y)))
        ends = np.intersect1d(ea, eb)
        ga, gb = np.searchsorted(ends, ea), np.searchsorted(ends, eb)
        in_a, in_b = defaultdict(list), defaultdict(list)
        links = []
        for i, g in zip(range(len(a)), ga.tolist(), strict=True):
            in_a[g].append(i)
        for j, g in zip(range(len(b)), gb.tolist(), strict=True):
            in_b[g].append(j)
        for g in range(len(ends)):
            links += [(a[i], b[j]) for i in in_a[g] for j in in_b[g] if max(ea[i] - len(x[i]), eb[j] - len(y[j])) < min(ea[i], eb[j])]
        groups = ";".join(",".join(str(a[i]) for i in in_a[g]) + "|" + ",".join(str(b[j]) for j in in_b[g]) for g in range(len(ends)))
        out.append((key, (len(a), len(b), len(ends), links, groups)))
        for pair in set(links):
            docs_of[pair] += 1
    highest = defaultdict(int)
    for (a, _), n in docs_of.items():
        highest[a] = max(highest[a], n)
    for key, found in out:
        if found is None:
            yield key, 0, 0, 0, 0, 0, 0, "", ""
        else:
            n_a, n_b, n_groups, links, groups = found
            best = sum(docs_of[p] == highest[p[0]] for p in links)
            yield key, n_a, n_b, n_groups, len(links), best, sum(docs_of[p] for p in links), hashlib.sha256(groups.encode()).hexdigest(), groups


def test_merge_path():
    rng = np.random.default_rng(3)
    for _ in range(150):
        n = int(rng.integers(1, 200))
        a, b = (np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(1, n + 1))), n)) for _ in "ab")
        for piece in (1, 3, 8, 1000):
            i, j, of_a, of_b = token_alignment.merge_path(a, b, piece)
            before_a, before_b = np.append(0, a[:-1]), np.append(0, b[:-1])
            assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(x, y) for x in range(len(a)) for y in range(len(b)) if max(before_a[x], before_b[y]) < min(a[x], b[y])]
            both = np.intersect1d(a, b)
            assert of_a.tolist() == np.searchsorted(both, a).tolist() and of_b.tolist() == np.searchsorted(both, b).tolist()


@pytest.mark.parametrize("most", [token_alignment.SENT, 300, 1])
def test_alignment(docs, library, most):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(tuple(r) for r in token_alignment.align(docs, VOCABULARY, PIECES, most=most).collect())
    assert got == Counter(brute_alignment(rows, library))


def test_alignment_of_nothing(docs):
    none = token_alignment.align(docs.where("false"), VOCABULARY, PIECES, groups=False)
    assert none.count() == 0 and none.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    empty = token_alignment.align(docs.select("doc_id", F.lit(None).cast("string").alias("text")), VOCABULARY, PIECES, groups=False)
    assert empty.where("n_a + n_b + n_groups + n_links + n_best + count_sum > 0 OR groups_sha256 <> ''").count() == 0 and empty.count() == docs.count()


def test_units_that_few_blocks_had_go(library, monkeypatch):
    monkeypatch.setattr(unit_codec, "KEPT", 60)
    codec = unit_codec.ByteLevel(open(VOCABULARY).read(), True)
    units = unit_codec.Units(codec.encode)
    for k in range(40):
        texts = ["the old words stay " + " ".join(f"new{k}x{i}" for i in range(9)), NOISE[k]]
        ((ids, counts),) = units.gather([codec.cut(t) for t in texts])
        assert ids.tolist() == [x for t in texts for x in library[0].encode(t, add_special_tokens=False).ids] and counts.sum() == len(ids)
    assert len(units.numbers) < 120 and {"old", "words", "stay"} <= set(units.numbers)
