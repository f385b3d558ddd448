"""Clashing names, hot and very long inputs, wrappers of articles, counted subtrees against brute force, and the pipeline stage by stage."""

import re
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from telarium.llm import bpe, decontaminate, html_text, quality_rules, secret_scan, unit_codec, url_filter

RNG = np.random.default_rng(21)
#: Names that the operators use inside, or did.
INNER = "row part id d p r d__ p__ r__ removed lines gone salt h h__ bad_id bad_part window_id token spots host path host__ hashes__ hash share on on__ rule verdict hits gaps found hits__ gaps__ found__ k__ key bucket page of n".split()


def made(n):
    return " ".join(f"w{i}" for i in RNG.integers(0, 5000, n))


def with_names(df, without=()):
    return df.select("*", *(F.lit(f"mine-{c}").alias(c) for c in INNER if c not in without and c not in df.columns))


def unharmed(out, names):
    assert set(names) <= set(out.columns)
    bad = out.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> 'mine-{c}'" for c in names))
    assert out.count() > 0 and bad.count() == 0


def test_any_name_may_clash(spark):
    footer = "a line of the site footer"
    docs = with_names(spark.createDataFrame([(i, f"{made(40)}\n{footer}\ntoken = \"Kaa11bb22cc33dd{i:02d}\"", "en", "s") for i in range(12)], "doc_id long, text string, lang string, source string"))
    items = with_names(spark.createDataFrame([("x", made(12))], "item_id string, text string"))
    good = quality_rules.keep_good(docs, max_documents=5)
    assert good.columns == docs.columns and good.where(F.col("text").contains(footer)).count() == 0
    clean = decontaminate.drop_contaminated(docs, items)
    hidden = secret_scan.redact(docs)
    assert clean.columns == docs.columns and hidden.columns == docs.columns and hidden.where("text LIKE '%[SECRET]%'").count() == 12
    for out in (good, clean, hidden, secret_scan.scan(docs)):
        unharmed(out, [c for c in INNER if c in docs.columns])
    pages = with_names(spark.createDataFrame([(i, f"http://h{i}.org/p", f"<p>own {i}</p>") for i in range(4)], "page_id long, url string, html string"))
    unharmed(html_text.extract(pages), [c for c in INNER if c in pages.columns])
    unharmed(url_filter.judge(pages, spark.createDataFrame([("h1.org",)], "key string")), [c for c in INNER if c in pages.columns and c not in ("host", "path", "rule", "verdict")])


# quality rules


def test_documents_of_very_many_frequent_lines(spark):
    menu = "\n".join(f"shared line {i}" for i in range(20_000))
    docs = spark.createDataFrame([(i, f"{menu}\n{made(30)} own{i}", "s") for i in range(8)], "doc_id long, text string, source string")
    began = time.time()
    out = quality_rules.verdicts(docs, max_documents=5).collect()
    assert {r.n_removed_words for r in out} == {60_000} and not any(r.kept for r in out)
    own = docs.withColumn("text", F.concat("text", F.lit("\n"), F.lit(" ".join(f"x{i}" for i in range(60_000)))))
    kept = quality_rules.keep_good(own, max_documents=5).collect()
    assert all(r.text.count("\n") == 1 and "shared" not in r.text and f"own{r.doc_id}" in r.text for r in kept) or not kept
    assert time.time() - began < 120


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_lines_beyond_what_is_sent(spark, monkeypatch, sent):
    monkeypatch.setattr(quality_rules, "LINES_SENT", sent)
    shared = [made(4) for _ in range(6)]
    texts = ["\n".join([shared[i % 6], made(25), "", shared[(i + 1) % 6].upper(), made(20)]) for i in range(90)] + [None, "", "\n\n"]
    docs = spark.createDataFrame([(i, t, "h" if i % 9 else None) for i, t in enumerate(texts)], "doc_id long, text string, source string")
    lines = [[" ".join(x.lower().split()) for x in (t or "").split("\n")] for t in texts]
    having = defaultdict(set)
    for i, x in enumerate(lines):
        for line in x:
            if line:
                having["h" if i % 9 else None, line].add(frozenset(v for v in x if v))
    frequent = lambda i, line: len(having.get(("h" if i % 9 else None, line), ())) > 12
    want = {i: "\n".join(raw for raw, line in zip(t.split("\n"), lines[i], strict=True) if not frequent(i, line)) for i, t in enumerate(texts[:90])}
    got = {r.doc_id: r.text for r in quality_rules.keep_good(docs, max_documents=12).collect()}
    assert got == want and any(want[i] != texts[i] for i in want)
    removed = {r.doc_id: r.n_removed_words for r in quality_rules.verdicts(docs, max_documents=12).collect()}
    assert removed == {i: sum(len(line.split()) for line in x if line and frequent(i, line)) for i, x in enumerate(lines)}


# HTML


def test_wrappers_of_articles():
    text = lambda page: html_text.main_text(page, set())
    for name in ("layout has-sidebar", "nav-open page", "no-comments", "social-studies lesson", "header-less", "notice-of-motion", "sidebar", "form"):
        assert text(f'<div class="{name}"><article><p>x</p></article></div>') == "x", name
        if name not in ("sidebar", "form"):
            assert text(f'<div class="{name}"><p>x</p></div>') == "x", name
    assert text('<article><div class="entry-header"><h1>Title</h1></div><div class="header">Part</div><p>x</p></article>') == "Title Part x"
    assert text("<form><main>x<form>no</form></main></form>") == "x"
    assert text('<div class="comments"><article>no</article></div><article>x<div class="ad">no</div></article><aside><article>no</article></aside>') == "x"
    assert text('<div class="site-header">no</div>x<div id="cookie-banner">no</div><ul class="related-posts"><li>no</ul><div class="AD wide">no</div><div role="navigation">no</div><p hidden>no</p>') == "x"
    assert text("<aside><article>no</article></aside><p>x</p>") == "x"
    assert text("<p>" + "<b>deep" * 5000) == " ".join(["deep" * 5000])
    assert len(text("<article>" + "<p>word</p>" * 100_000 + "</article>")) == 5 * 100_000 - 1


@pytest.mark.parametrize("sent", [2_000_000, 0])
def test_counted_subtrees_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(html_text, "HASHES_SENT", sent)
    monkeypatch.setattr(html_text, "PAGES_A_SHARE", 9)
    parts = [f"<div><b>menu</b> of {k}</div>" for k in range(12)]
    rows = []
    for i in range(60):
        pick = [k for k in range(12) if RNG.random() < 0.1 + 0.07 * k]
        own = "".join(f"<div>own {RNG.integers(30)} {k}</div>" for k in range(3))
        rows.append((i, f"http://h{i % 2}.org/{i}", "".join(parts[k] for k in pick) + own + ("<section>" + parts[3] + "</section>" if i % 3 else "")))
    rows += [(100 + i, f"http://h0.org/{i}", rows[0][2]) for i in range(30)] + [(200, None, None), (201, "x", "")]
    # a subtree is its tag and what is in it; pages that are copies count once
    trees = lambda page: set(re.findall(r"<div>.*?</div>", page or "")) | set(re.findall(r"<section>.*?</section>", page or ""))
    seen = defaultdict(set)
    host = lambda url: (re.match(r"\w+://([^/]*)", url or "") or [None, ""])[1]
    for _, url, page in rows:
        for tree in trees(page):
            seen[host(url), tree].add(page)

    def want(url, page):
        page = page or ""
        for tree in sorted(trees(page), key=len, reverse=True):
            if len(seen[host(url), tree]) > 6:
                page = page.replace(tree, " ")
        return " ".join(re.sub(r"<b>|</b>", "", page).replace("<", " <").replace(">", "> ").split()) if "<" not in page else " ".join(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", page)).split())

    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(table, max_pages=6).collect()}
    assert got == {i: want(url, page) for i, url, page in rows}
    assert html_text.extract(table.where("false")).count() == 0


def test_many_templates_in_bounded_memory(spark):
    known = np.sort(RNG.integers(-(2**63), 2**63 - 1, 100_000))
    lists = html_text._sorted_lists(__import__("pyarrow").array(["a"] * 50_000 + ["b"] * 50_000), known)
    assert sum(x.nbytes for x in lists.values()) == 800_000 and all((np.diff(x) > 0).all() for x in lists.values())
    whole, found = html_text.subtree_hashes("<div>gone</div><div>own</div>")
    gone = html_text.subtree_hashes("<div>gone</div>")[1]
    assert html_text.main_text("<div>gone</div><div>own</div>", np.sort(np.concatenate([known, gone]))) == "own"


# the pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against plain Python over what the stage before kept, with nulls, repeats and ties; then an empty table."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    low = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")
    item = " ".join(f"bench{i}" for i in range(14))
    base = [made(80) for _ in range(6)]
    texts = [*base, base[0], base[1] + " tail", None, "", "too short", "x y z w " * 30, f"{made(40)} {item} {made(10)}", f'{made(40)} token = "Kaa11bb22cc33dd44" {made(5)}', "\n".join(["footer of the host", made(60)]), made(3000)]
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows.append(rows[2])
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    at = str(tmp_path)
    spark.createDataFrame(rows, schema).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([("b1", item), ("b2", None)], "item_id string, text string").write.parquet(f"{at}/benchmark.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, at).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        kept[name] = sorted((r.doc_id, getattr(r, "text", None)) for r in docs.collect())
        if name != "encoding":
            assert docs.columns == [f.split()[0] for f in schema.split(", ")]

    def quality(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = defaultdict(list)
        for i in range(len(w) - 7):
            runs[tuple(w[i : i + 8])].append(i)
        covered = {p for places in runs.values() if len(places) > 1 for i in places for p in range(i, i + 8)}
        return len(w) >= 20 and 100 * len(covered) <= 30 * len(w)

    assert kept["quality_rules"] == sorted((r[0], r[1]) for r in rows if quality(r[1]))

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    left = []
    for key, t in kept["quality_rules"]:
        a = shingles(t)
        if not any(100 * len(a & b) >= 75 * len(a | b) for b in (shingles(u) for _, u in left)):
            left.append((key, t))
    assert kept["near_duplicates"] == left
    windows = {tuple(item.split()[i : i + 10]) for i in range(5)}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    clean = [(k, t) for k, t in left if not any(tuple(words(t)[i : i + 10]) in windows for i in range(len(words(t))))]
    assert kept["decontamination"] == clean and len(clean) == len(left) - 1
    assert kept["secrets"] == [(k, t.replace("Kaa11bb22cc33dd44", "[SECRET]")) for k, t in clean] and any("[SECRET]" in t for _, t in kept["secrets"])
    library = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    assert {r.doc_id: r.ids for r in docs.collect()} == {k: library.encode(t, add_special_tokens=False).ids for k, t in kept["secrets"]}
    assert {r.doc_id for r in corpus_pipeline.query(spark, at).collect()} == {k for k, _ in clean}
    none = spark.createDataFrame([], T._parse_datatype_string(schema))
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, at)
    assert none.count() == 0


# token counts: a text is cut once for all vocabularies, and words that many blocks had are not encoded again -----

def test_counts_by_shared_units(monkeypatch):
    ranks = Path(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).read_text()
    files = (Path(public_tokenizers.path("byte_bpe_50k.json")).read_text(), unit_codec.tokenizers_file(ranks))
    plain = bpe.Codec(ranks)
    counter, library = unit_codec.Counter(files), Tokenizer.from_str(files[0])
    texts = ["the cat's  12\n\n 漢字 é", None, "", " ", "a<|endoftext|>b", "\t\u3000x \x85 y", "the the  ", "z" * 300]
    one, two = counter.counts(texts)
    assert one.tolist() == [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert two.tolist() == [plain.count(t or "") for t in texts]
    assert not any(map(len, counter.units.ids))
    monkeypatch.setattr(unit_codec, "KEPT", 50)
    asked = []

    def encode(units):
        asked.extend(units)
        return np.zeros(0, np.int32), np.ones(len(units), np.int64)

    units = unit_codec.Units(encode, only_counts=True)
    for i in range(30):
        assert units.counts([["often", *(f"w{i}-{k}" for k in range(10))], []])[0].tolist() == [11, 0]
    assert asked.count("often") == 1 and len(units.numbers) <= 61
