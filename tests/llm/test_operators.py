"""Training-data operators against brute force, with nulls, empty texts, ties, repeats and clashing columns."""

import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from telarium.llm import bpe, char_tagger, decontaminate, html_text, near_dup, personal_data, quality_lm, quality_rules, secret_scan, token_rollup, url_filter

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
RNG = np.random.default_rng(3)
WORDS = [f"w{i}é" if i % 9 == 0 else f"Word{i}" for i in range(400)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, hits string"


def prose(n):
    return " ".join(WORDS[i] for i in RNG.integers(0, len(WORDS), n))


def varied(text, edits):
    words = text.split(" ")
    for i in RNG.integers(0, len(words), edits):
        words[i] = "x" + str(RNG.integers(1_000_000))
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    base = [prose(120) for _ in range(12)]
    out = base + [base[0], base[0]] + [varied(base[1], e) for e in (1, 2, 3, 4, 5, 6, 8, 10)] + [varied(base[2], 3) for _ in range(12)]
    return out + [None, "", " \n\t ", "one two", "ONE  two", "same words here now five", prose(6000), "Footer line of the site\n" + prose(40), "café\x00null byte"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, None if t is None else len(t), "own") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, texts[0], None, None, 1, "own")], DOCS).cache()


def low(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s or "")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def test_near_duplicates(docs, texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 75 * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    got = near_dup.near_duplicates(docs).collect()
    assert len(got) == len(texts) + 2
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == {(i, len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}
    kept = near_dup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter([*(i for i in range(len(texts)) if find(i) == i), None])


def test_decontamination(spark, docs, texts):
    pick = texts[4].split(" ")
    items = spark.createDataFrame([("b", " ".join(pick[10:30])), ("a", "one two"), ("c", prose(30)), ("d", None), ("e", "--"), ("f", " ".join(pick[12:24]))], "item_id string, text string")
    words = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(s))
    windows = defaultdict(set)
    for r in items.collect():
        w = words(r.text)
        size = min(10, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows[tuple(w[i : i + size])].add(r.item_id)
    want = {}
    for i, t in enumerate(texts):
        w, hit, found = words(t), set(), set()
        for size in set(map(len, windows)):
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    found |= windows[tuple(w[k : k + size])]
        want[i] = (len(w), len(hit), sorted(found), bool(hit))
    got = {r.doc_id: (r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in decontaminate.decontaminate(docs, items).where("doc_id IS NOT NULL").collect()}
    assert got == want
    assert decontaminate.drop_contaminated(docs, items).columns == docs.columns
    none = decontaminate.decontaminate(docs, items.where("false"))
    assert none.where("contaminated").count() == 0 and none.count() > 0


def test_bpe_equals_library(docs, texts):
    library = Tokenizer.from_file(VOCABULARY)
    extra = ["a<|endoftext|>b", "  hi 　 don't 123's", "a\x1cb\x85c e​"]
    codec = bpe.Codec(open(VOCABULARY).read())
    for t in [*texts, *extra]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert codec.encode(t or "") == ids and codec.decode(ids) == library.decode(ids, skip_special_tokens=False)
    out = bpe.encode(docs.withColumn("ids", F.lit("clash")), VOCABULARY)
    assert out.count() == docs.count()
    back = bpe.decode(out, VOCABULARY).where("coalesce(text, '') <> decoded").count()
    assert back == 0
    row = bpe.digests(docs, VOCABULARY).where("doc_id = 0").first()
    assert row.ids_sha256 == hashlib.sha256(",".join(map(str, codec.encode(texts[0]))).encode()).hexdigest()


def test_quality_rules(spark, docs, texts):
    def base(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {p for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)

    more = ["a b c\na b c\n" + "x y z # " * 20, "\n".join(["same line"] * 9)]
    rows = [*((i, t) for i, t in enumerate(texts)), *((900 + i, t) for i, t in enumerate(more))]
    table = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.verdicts(table).collect()}
    assert got == {i: base(t) for i, t in rows}
    # a line of many different documents goes; a group of copies keeps its lines; a depleted document is rejected
    site = [(i, f"MENU  of the site\n{prose(30)}\n{prose(30)}", "h") for i in range(30)] + [(100 + i, "copied text " + " ".join(WORDS[:40]), "h") for i in range(30)] + [(200, "menu of the site\n" + prose(15), "h")]
    table = spark.createDataFrame(site, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in quality_rules.verdicts(table, max_documents=15).collect()}
    assert all(out[i].kept and out[i].n_removed_words == 4 for i in range(30)) and all(out[100 + i].kept and out[100 + i].n_removed_words == 0 for i in range(30))
    assert not out[200].kept and not out[200].n_words == 0
    cleaned = quality_rules.keep_good(table, max_documents=15)
    assert cleaned.where("lower(text) LIKE '%menu%'").count() == 0 and cleaned.count() == 60
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert quality_rules.verdicts(docs.where("false")).count() == 0
    # 70 different documents with 80 % shared lines, and 70 copies of another one, at production limits
    menu = [f"shared line {k} of the host" for k in range(16)]
    site = [(i, "\n".join([*menu, *(prose(8) + f" own{i}.{k}" for k in range(4))]), "h") for i in range(70)] + [(100 + i, "a copied line\n" + " ".join(WORDS[:40]), "h") for i in range(70)]
    out = {r.doc_id: r.n_removed_words for r in quality_rules.verdicts(spark.createDataFrame(site, "doc_id long, text string, source string")).collect()}
    assert out == {i: 16 * 6 for i in range(70)} | {100 + i: 0 for i in range(70)}


def test_url_cascade(spark):
    urls = [f"http://h{i}.example.org/p" for i in range(400)] + [None, "no scheme", "HTTP://A.COM/en/x?y", "https://b.example.com/en/70#z", "x://example.net/de/81", "://", "http://c.net/de/", "http://com/en/"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([(f"h{i}.example.org",) for i in range(0, 400, 3)] + [("unseen.org",), (None,)], "key string")
    got = {r.page_id: r for r in url_filter.judge(pages, listed).collect()}
    assert all(got[i].verdict == ("block" if i % 3 == 0 else "allow") for i in range(400))
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(400, 408)] == [
        ("", "", None, "allow"), ("", "", None, "allow"), ("a.com", "/en/x", "com/en/", "block"), ("b.example.com", "/en/70", "example.com/en/7", "allow"),
        ("example.net", "/de/81", "example.net/de/8", "block"), ("", "", None, "allow"), ("c.net", "/de/", "net/de/", "allow"), ("com", "/en/", "com/en/", "block"),
    ]


def test_html(spark):
    page = lambda i: f"<html><head><title>t</title></head><body><nav>menu</nav><div><p>Site wide words</p></div><article><h1>T{i} &amp;c</h1><p>a{i}<b>b</b><br><p>d  e<li>x<li>y<div class='comments'>c</div><script>var a='</p>'</script></article><aside>z</aside></body>"
    rows = [(100 + i, "http://h.org/z", page(i)) for i in range(60)] + [(i, "http://h.org/x", page(i)) for i in range(9)] + [(9, None, None), (10, "u", "<p>plain <i>te</i>xt<!-- no --></p><footer>f</footer>"), (11, "http://h.org/y", "<div><p>Site wide words</p></div><p>own</p>")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), max_pages=3).collect()}
    assert got[2] == "T2 &c a2b d e x y" and got[9] == "" and got[10] == "plain text" and got[11] == "own"

    # 30 pages with 40 shared and 3 own subtrees, and 30 that differ only outside block elements, at production limits
    menu = "".join(f"<div>shared {k}</div>" for k in range(40))
    rows = [(i, "http://a.org/", menu + "".join(f"<div>own {i} {k}</div>" for k in range(3))) for i in range(30)] + [(100 + i, "http://b.org/", f"<div>menu</div>own {i}") for i in range(30)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"own {i} 0 own {i} 1 own {i} 2" for i in range(30)} | {100 + i: f"own {i}" for i in range(30)}


def test_html_after_drawings():
    for inner in ('<svg width="5"/>', "<math/>", "<svg-icon name='x'></svg-icon>", "<svg><title>t</title><path d='m'></svg>", "<svg><path d='m'/>", "<math><mi>x</mi></math>", "<object data='x'>", "<object data='x'><p>gone</p></object>", "<template><p>gone</p></template>", "<svg><foreignObject><p>gone</p></foreignObject></svg>"):
        assert html_text.main_text(f"<article><p>one</p>{inner}<p>two</p></article><div>no</div>", set()) == "one two", inner
        assert html_text.main_text(f"<div><p>one</p>{inner}<p>two</p></div><p>three</p>", set()) == "one two three", inner
    assert html_text.main_text("<p>one</p><object data='x'><p>two</p>", set()) == "one two"
    assert html_text.main_text("<p>one</p><script>var a = '<p>two</p>'", set()) == "one"


def test_personal_data(docs):
    text = "mail a.b@c.de, 1.2.3.400 10.0.0.255 card 4539 1488 0343 6467 or 4539148803436468 tel +1 (743) 555-3824."
    assert personal_data.base_spans(text) == [("email", 5, 13), ("ip", 25, 35), ("card", 41, 60), ("phone", 85, 102)]
    tagger = char_tagger.trained()
    x, y = char_tagger.labelled_windows(200, 112, seed=99)
    found = tagger.decode(x.T).T
    assert (found == y).mean() > 0.95
    out = personal_data.find(docs, tagger)
    assert out.count() == docs.count() and out.where("n_added > 0").count() == 0
    near = personal_data.added_spans(["filler words " * 9 + "call (743) 555-3824 now"], tagger)[0]
    assert [k for k, _, _ in near] == ["phone"]


def test_personal_data_counts_are_of_base_spans(spark):
    docs = spark.createDataFrame([(1, "filler words " * 9 + "call (743) 555-3824 now, not 10.0.0.255"), (2, None)], "doc_id long, text string")
    first, empty = personal_data.digests(docs).orderBy("doc_id").collect()
    assert first.n_added == 1 and first.spans.startswith("ip:") and ",phone:" in first.spans
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone) == (0, 1, 0, 0)
    assert (empty.n_email, empty.n_ip, empty.n_card, empty.n_phone, empty.n_added, empty.spans) == (0, 0, 0, 0, 0, "")


class _Lines:
    """Tags each line that is not empty as an address."""

    def decode(self, x):
        inside = x != char_tagger.classes("\n")[0]
        before = np.vstack([np.zeros((1, x.shape[1]), bool), inside[:-1]])
        return np.where(inside, np.where(before, 2, 1), 0).astype(np.int8)


def test_personal_data_over_borders():
    # every length at every place relative to the windows, then what the base windows cannot hold at all
    for size in (40, 56, 64, 80, 100, 111, 112, 150, 700):
        value = "n" * (size - 26) + " [at] mail [dot] example.de"[:26]
        texts = ["\n" * at + value + "\n" * 300 for at in range(130, 130 + personal_data.STEP)]
        found = personal_data.added_spans(texts, _Lines())
        assert found == [[("email", at, at + size)] for at in range(130, 130 + personal_data.STEP)]
    for value in ("jane [at] example.com", "jane [AT] mail [DOT] com", "jane(At)mail(dot)com", "jane at mail.com", "jane AT mail DOT com"):
        assert personal_data._windows("words here " * 30 + value) and personal_data._SPELLED.search(value)
    assert not personal_data._windows("the cat looks at the dog. " * 30)


def test_secrets(spark, docs):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    rows = [(1, f'the token = "{key}" in', "src1"), (2, f"commit {key} of the tree", "src1"), (3, 'password = "your-token-here-example"', "src1"), (4, None, None), (5, "plain words only", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: [f.value for f in r.findings] for r in secret_scan.scan(table).collect()}
    assert got == {1: [key], 2: [], 3: [], 4: [], 5: []}
    clean = {r.doc_id: r.text for r in secret_scan.redact(table).collect()}
    assert clean[1] == 'the token = "[SECRET]" in' and clean[2] == rows[1][1] and clean[4] is None
    assert secret_scan.redact(docs).columns == docs.columns
    forms = [("export DB_PASSWORD=hunter2x9Kq now", "hunter2x9Kq"), (f"AWS_SECRET_ACCESS_KEY={key}", key), (f"a/long/path/to/github_token: {key}", key), ('password = "P@ssw0rd!2024" # x', "P@ssw0rd!2024")]
    forms += [("DB_PASSWORD=P@ssw0rd!2024", "P@ssw0rd!2024"), ('"apiToken": "k9 Q\\"z7&Lw2(x)"', 'k9 Q\\"z7&Lw2(x)'), ("db.password='Qx7;Lw2}9z'", "Qx7;Lw2}9z")]
    table = spark.createDataFrame([(i, t, "src1") for i, (t, _) in enumerate(forms)], "doc_id long, text string, source string")
    clean = {r.doc_id: r.text for r in secret_scan.redact(table).collect()}
    assert clean == {i: t.replace(v, "[SECRET]") for i, (t, v) in enumerate(forms)}
    plain = [(0, 'password = "abc" and name = "12345678"', "src1"), (1, "the token: something", "src1"), (2, "password_policy = strict-mode", "src1")]
    assert all(not r.findings for r in secret_scan.scan(spark.createDataFrame(plain, "doc_id long, text string, source string")).collect())


def test_quality_model(spark):
    good = ["the cat sat on the mat and the dog ran in the rain " * 4] * 1
    rows = [(i, "en", f"{good[0]} {WORDS[i]}", "own") for i in range(40)] + [(90, "en", "#$%^ ZZZZ QQQ 999 ||| " * 20, "own"), (91, None, None, "own"), (92, "xx", "unknown language text", "own")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, perplexity string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r for r in quality_lm.classify(docs, labels).collect()}
    assert len(out) == len(rows) and not out[90].kept and not out[91].kept and out[92].kept
    assert sum(out[i].kept for i in range(40)) >= 38


def test_rollup(spark, docs):
    counted = token_rollup.token_counts(docs, {"one": VOCABULARY, "two": VOCABULARY}).cache()
    rollup = token_rollup.Rollup.fresh(spark)
    assert rollup.totals().count() == 0
    assert rollup.commit("a", token_rollup.inserts(counted, "one")) and not rollup.commit("a", token_rollup.inserts(counted, "one"))
    rollup.commit("b", token_rollup.revisions(counted, "one", "two"))
    rollup.commit("c", token_rollup.inserts(counted.where("false"), "one"))
    got = {(r.source, r.lang, r.tokenizer): (r.documents, r.tokens) for r in rollup.totals().collect()}
    assert {k[2] for k in got} == {"two"} and sum(v[0] for v in got.values()) == docs.count()
    rollup.commit("d", token_rollup.deletes(counted, "two"))
    assert rollup.totals().count() == 0
