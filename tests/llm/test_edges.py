"""Cases that operators of the training data got wrong once, nulls, empty tables, clashing columns and what is beyond each bound."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telarium.llm import bpe, decontaminate, html_text, near_dup, personal_data, quality_lm, quality_rules, secret_scan, token_rollup, url_filter
from telarium.llm.queries import VOCABULARY, public_tokenizers

RNG = np.random.default_rng(8)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(n):
    return " ".join(f"w{i}" for i in RNG.integers(0, 5000, n))


def rows(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


# near duplicates ------------------------------------------------------------

def test_one_id_with_two_texts(spark):
    a, b = made(60), made(60)
    docs = spark.createDataFrame([(1, a), (1, b), (3, a + " more"), (0, b + " more"), (5, a)], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(docs).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 1, True), (3, 1, False), (5, 1, False)]
    kept = {(r.doc_id, r.text) for r in near_dup.drop_near_duplicates(docs).collect()}
    assert kept == {(0, b + " more"), (1, a)}
    twins = spark.createDataFrame([(1, a), (1, a + " more"), (1, a), (2, None), (2, None), (None, a)], "doc_id long, text string")
    assert Counter(r.doc_id for r in near_dup.drop_near_duplicates(twins).collect()) == {1: 1, 2: 2, None: 1}


def brute_components(texts):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in range(len(texts))}


def at_the_threshold(groups, size, edits):
    out = []
    for _ in range(groups):
        base = made(160).split()
        for _ in range(size):
            words = list(base)
            for i in RNG.choice(len(words), edits, replace=False):
                words[i] = f"x{RNG.integers(1 << 40)}"
            out.append(" ".join(words))
    return out


@pytest.mark.parametrize("sent,block", [(1_000_000, 2000), (0, 3)])
def test_pairs_around_the_threshold(spark, monkeypatch, sent, block):
    monkeypatch.setattr(near_dup, "SENT", sent)
    monkeypatch.setattr(near_dup, "BUCKET_BLOCK", block)
    texts = at_the_threshold(12, 12, 2) + at_the_threshold(8, 10, 3) + at_the_threshold(8, 12, 4)
    got = {r.doc_id: r.component_id for r in near_dup.near_duplicates(rows(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_hub_of_links(spark, monkeypatch):
    links = [(0, i) for i in range(1, 1500)] + [(i, i + 5000) for i in range(1, 50)] + [(9000 + i, 9001 + i) for i in range(40)] + [(7, 7)]
    got = {r.id: r.component for r in near_dup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 1500)} | {i + 5000: 0 for i in range(1, 50)} | {9000 + i: 9000 for i in range(1, 41)}


# BPE --------------------------------------------------------------------------

def test_long_pieces():
    codec = bpe.Codec(open(VOCABULARY).read())
    library = Tokenizer.from_file(VOCABULARY)
    letters = "".join(chr(97 + i) for i in RNG.integers(0, 26, 30_000))
    for text in (letters, "ab" * 5000, "é" * 3000, " " * 4000 + "x", "a" * 161, "the" * 2000, "=" * 9000):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids
        assert codec.count(text) == len(codec.encode(text))
    for _ in range(200):
        piece = bytes(RNG.integers(97, 103, int(RNG.integers(1, 150))).astype(np.uint8))
        assert codec.merge(piece) == codec.merge_long(piece)


def test_codec_of_ranks():
    text = open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read()
    codec = bpe.Codec(text)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.id_of, special_tokens={})
    for t in (made(200), "Ein Haus, été 2024\n\n  das «ist» 漢字 𝔘 x", "", "z" * 3000):
        assert codec.encode(t) == library.encode_ordinary(t) and codec.count(t) == len(codec.encode(t)) and codec.decode(codec.encode(t)) == t


# personal data ----------------------------------------------------------------

def test_base_patterns_are_linear_and_the_same():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    for _ in range(3000):
        text = "".join("ab1.2@ -%3"[i] for i in RNG.integers(0, 10, 40))
        want = [(k, m.start(), m.end()) for k, p in plain.items() for m in re.finditer(p, text) if personal_data._passes(k, m[0])]
        assert [x for x in personal_data.base_spans(text) if x[0] in plain] == want, text
    assert personal_data.base_spans("0" * 6000 + "1.2.3.4") == [("ip", 0, 6007)]
    assert personal_data.base_spans("9" * 6000 + ".2.3.4") == []
    for text in ("a" * 400_000, "a" * 400_000 + " x@y", "1" * 400_000, "a@" * 100_000, "1." * 200_000, "+" + "(" * 300_000):
        personal_data.base_spans(text)


# secrets ------------------------------------------------------------------------

def test_secrets_at_their_places(spark):
    a, b = "Kaa11bb22cc33dd44", "Kaa11bb22"
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = [f'password = "{a}" and token = "{b}"', f'token = "{b}" then {a[:12]} stays, password = "{a}"', f'commit {key} here\ntoken = "{key}"', f'token = "{key}"\ncommit {key} here', None, ""]
    table = spark.createDataFrame([(i, t, "s", "mine", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, findings string, n_candidates long")
    clean = {r.doc_id: r.text for r in secret_scan.redact(table).collect()}
    assert clean[0] == 'password = "[SECRET]" and token = "[SECRET]"'
    assert clean[1] == f'token = "[SECRET]" then {a[:12]} stays, password = "[SECRET]"'
    assert clean[2] == f'commit {key} here\ntoken = "[SECRET]"' and clean[3] == f'token = "[SECRET]"\ncommit {key} here'
    assert clean[4] is None and clean[5] == ""
    out = secret_scan.redact(table)
    assert out.columns == table.columns and {r.findings for r in out.collect()} == {"mine"}
    assert secret_scan.scan(table.where("false")).count() == 0
    assert secret_scan.scan(rows(spark, [made(60_000) + f' token = "{key}" '])).first().findings[0].value == key


def test_forest_on_new_findings(spark):
    forest = secret_scan.production_forest(rows(spark, []))
    new = spark.createDataFrame(secret_scan.labelled_findings(1500, seed=77), "value string, before string, after string, path string, secret int")
    made_ = secret_scan.features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    out = new.select("secret", *(c.alias(k) for k, c in made_.items())).select("secret", (secret_scan.score(forest, F.col) >= secret_scan.THRESHOLD).cast("int").alias("said"))
    right = Counter((r.secret, r.said) for r in out.collect())
    assert (right[1, 1] + right[0, 0]) / sum(right.values()) > 0.93, right


# URL filter -----------------------------------------------------------------------

def test_cascade_in_shares(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BITS_SENT", 640)
    pages = spark.createDataFrame([(i, f"http://h{i}.example.edu/p") for i in range(500)], "page_id long, url string")
    listed = spark.createDataFrame([(f"h{i}.example.edu",) for i in range(0, 700, 3)], "key string")
    assert len(url_filter.cascades(listed, url_filter.with_host_and_path(pages).select(F.col("host").alias("key")))) == 4
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, listed).collect()}
    assert got == {i: "block" if i % 3 == 0 else "allow" for i in range(500)}
    assert url_filter.judge(pages.where("false"), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.where("false")).collect()} == {"allow"}


# HTML -------------------------------------------------------------------------------

@pytest.mark.parametrize("sent,share", [(2_000_000, 5000), (0, 7)])
def test_large_templates(spark, monkeypatch, sent, share):
    monkeypatch.setattr(html_text, "HASHES_SENT", sent)
    monkeypatch.setattr(html_text, "PAGES_A_SHARE", share)
    menu = "".join(f"<div>item {k}</div>" for k in range(60))
    table = [(i, "http://a.org/", menu + "".join(f"<div>own {i} {k}</div>" for k in range(5)), "own") for i in range(200)] + [(500 + i, "http://b.org/", f"<div>item {i}</div>", "own") for i in range(3)] + [(900, None, None, "own")]
    pages = spark.createDataFrame(table, "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract(pages).collect()}
    want = {i: " ".join(f"own {i} {k}" for k in range(5)) for i in range(200)} | {500 + i: f"item {i}" for i in range(3)} | {900: ""}
    assert got == {i: (t, len(t)) for i, t in want.items()}
    assert html_text.extract(pages.where("false")).count() == 0


# quality rules ------------------------------------------------------------------------

def test_lines_of_a_host_against_brute_force(spark):
    shared = [made(9) for _ in range(20)]
    texts = ["\n".join([*shared, made(12), made(12)]) for _ in range(200)] + ["\n".join([*shared[:3], made(30)]) for _ in range(20)] + [shared[0]] * 60 + [None, ""]
    table = rows(spark, texts)
    lines = [[" ".join(x.lower().split()) for x in (t or "").split("\n") if x.split()] for t in texts]
    having = defaultdict(set)
    for x in lines:
        for line in x:
            having[line].add(frozenset(x))
    gone = {i: sum(len(line.split()) for line in x if len(having[line]) > quality_rules.MAX_DOCUMENTS) for i, x in enumerate(lines)}
    assert {r.doc_id: r.n_removed_words for r in quality_rules.verdicts(table).collect()} == gone
    assert gone[0] == 180


# decontamination ------------------------------------------------------------------------

@pytest.mark.parametrize("bits,sent", [(28, 32 << 20), (7, 0)])
def test_windows_beyond_what_is_sent(spark, monkeypatch, bits, sent):
    monkeypatch.setattr(decontaminate, "MAX_BITS", bits)
    monkeypatch.setattr(decontaminate, "BYTES_SENT", sent)
    items = [made(14) for _ in range(40)]
    texts = [made(80) for _ in range(60)] + [made(20) + " " + items[i].upper() + " " + made(20) for i in range(20)]
    bench = spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.decontaminate(rows(spark, texts), bench).collect()}
    assert got == {i: (0, []) for i in range(60)} | {60 + i: (14, [str(i)]) for i in range(20)}


# token counts ---------------------------------------------------------------------------

def test_rollup_of_vocabularies(spark):
    files = {"one": public_tokenizers.path("byte_bpe_50k.json"), "two": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}
    texts = [made(30), None, "", "a<|endoftext|>b", made(2000), "ünï 漢字"]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, "s", "own") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, tokens string")
    counted = token_rollup.token_counts(docs, files).cache()
    library = Tokenizer.from_file(files["one"])
    n = [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert {r.doc_id: r.tokens["one"] for r in counted.collect()} == dict(enumerate(n))
    rollup = token_rollup.Rollup.fresh(spark)
    rollup.commit("a/1", token_rollup.inserts(counted, "one"))
    assert {(r.lang, r.documents, r.tokens) for r in rollup.totals().collect()} == {(None, 3, n[0] + n[2] + n[4]), ("en", 3, n[1] + n[3] + n[5])}
    # a batch that was lost half way, and one that another writer has just committed
    counted.select("doc_id").write.parquet(f"{rollup.path}/_lost")
    before = rollup.totals().collect()
    again = token_rollup.inserts(counted, "one")
    again.groupBy(*token_rollup.KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens")).write.parquet(f"{rollup.path}/_late")
    assert not rollup._publish("_late", "batch-a%2F1") and not rollup.commit("a/1", again)
    assert sorted(map(str, rollup.totals().collect())) == sorted(map(str, before))
    # a commit whose snapshot was lost is counted from its batch
    hidden = spark.createDataFrame([("s", "en", "one", 1, 5)], rollup.SCHEMA)
    hidden.write.parquet(f"{rollup.path}/_x")
    assert rollup._publish("_x", "batch-b")
    assert {(r.lang, r.documents, r.tokens) for r in rollup.totals().collect()} == {(None, 3, n[0] + n[2] + n[4]), ("en", 4, n[1] + n[3] + n[5] + 5)}
    rollup.commit("c", token_rollup.revisions(counted, "one", "two"))
    got = {(r.lang, r.tokenizer, r.documents, r.tokens) for r in rollup.totals().collect()}
    assert ("en", "one", 1, 5) in got and not any(t == "one" and lang is None for lang, t, _, _ in got)


# quality model ----------------------------------------------------------------------------

def kneser_ney(texts):
    """Probability of a symbol after three others, straight from the definition."""
    top = Counter()
    for t in texts:
        padded = "   " + t
        top.update(padded[i : i + 4] for i in range(len(t)))
    levels = {4: top}
    for size in (3, 2, 1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    parts = {}
    for size, counts in levels.items():
        n = Counter(min(c, 5) for c in counts.values())
        n1, n2, n3, n4 = (sum(1 for c in counts.values() if c == i) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [0.5 if not (n1 and a) else max(0.05, min(i - 0.05, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, mass = Counter(), Counter()
        for g, c in counts.items():
            total[g[:-1]] += c
            mass[g[:-1]] += d[min(c, 3) - 1]
        parts[size] = (counts, d, total, mass)

    def p(gram):
        size = len(gram)
        if size == 0:
            return 1 / 65536
        counts, d, total, mass = parts[size]
        below = p(gram[1:])
        if not total[gram[:-1]]:
            return below
        c = counts[gram]
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total[gram[:-1]] + mass[gram[:-1]] / total[gram[:-1]] * below

    return lambda t: math.exp(-sum(math.log(p(("   " + t)[i : i + 4])) for i in range(len(t))) / len(t))


@pytest.mark.parametrize("sent,often,small", [(1 << 20, 200_000, 100_000), (40, 20, 0), (0, 1_000_000, 100_000)])
def test_kneser_ney_against_its_definition(spark, monkeypatch, sent, often, small):
    monkeypatch.setattr(quality_lm, "LANGUAGES_SENT", small)
    good = ["the cat sat on the mat and the dog ran in the rain", "a man and a cat ran to the red hat", "Ein Kät sät 𝔘 on the mät"]
    new = ["the dog sat on the hat", "zzz qq 漢字", "", None, "t", "the the the the " * 300]
    table = spark.createDataFrame([(i, "=x", t) for i, t in enumerate(good)], "doc_id long, lang string, text string")
    docs = spark.createDataFrame([(i, "=x" if i != 1 else "=x", t) for i, t in enumerate(new)] + [(9, "=none", "words")], table.schema)
    got = {r.doc_id: (r.n_chars, r.perplexity) for r in quality_lm.perplexities(docs, quality_lm.train(table), sent, often).collect()}
    split = lambda t: "".join(chr(u) for u in np.frombuffer(t.encode("utf-16-le"), np.uint16))
    want = kneser_ney([split(t) for t in good])
    for i, t in enumerate(new):
        assert got[i][0] == len(t or "")
        assert got[i][1] == pytest.approx(want(split(t)), rel=1e-4) if t else got[i][1] is None
    assert got[9] == (5, None)


def test_scripts_beyond_latin(spark):
    words = ["человек", "дорога", "сегодня", "работа", "большой", "город", "время", "книга", "слово", "река"]
    text = lambda: " ".join(words[i] for i in RNG.integers(0, 10, 60))
    junk = " ".join("".join("ъыьэюящчшж"[i] for i in RNG.integers(0, 10, 6)) for _ in range(60))
    docs = spark.createDataFrame([(i, "ru", text()) for i in range(60)] + [(90, "ru", junk), (91, None, None)], "doc_id long, lang string, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_lm.classify(docs, labels).collect()}
    assert not out[90].kept and out[90].perplexity > 5 * out[55].perplexity and sum(out[i].kept for i in range(60)) >= 58 and not out[91].kept
    assert quality_lm.classify(docs.where("false"), labels).count() == 0
    assert all(r.kept == (r.doc_id != 91) for r in quality_lm.classify(docs, labels.where("false")).collect())


# empty tables -------------------------------------------------------------------------------

def test_empty_tables(spark):
    docs = rows(spark, [])
    assert near_dup.near_duplicates(docs).count() == 0 and near_dup.drop_near_duplicates(docs).count() == 0
    assert bpe.digests(docs, VOCABULARY).count() == 0 and personal_data.digests(docs).count() == 0
    assert quality_rules.keep_good(docs).count() == 0 and decontaminate.decontaminate(docs, spark.createDataFrame([], "item_id string, text string")).count() == 0
    assert secret_scan.redact(docs).columns == docs.columns and personal_data.find(docs.withColumn("spans", F.lit(1))).count() == 0
