"""Secret scans, with DataFrame functions only: candidates by pattern, then a
random forest that removes false positives.

A candidate is a value after a naming word or an identifier that ends in one
(`token = "..."`, `DB_PASSWORD=...`), a value of a known form, or a long run of
letters and digits. A quoted value is read up to its closing quote. A text is
cut at its candidates, so each is seen at its own place. Its features are its
length, its character transitions, how much of it dictionary words cover, the
path (``source``) and the neighbouring words on both sides; all are SQL
expressions. The forest is fitted on the driver on at most ``TRAINING_ROWS``
labelled findings and is then a sum of nested CASE expressions over the features.

Each row is handled alone: no shuffle, so no key can be hot.

Defined cases: null text has no findings. A null path is an ordinary path.
Repeated findings in a text count each time, each with its own neighbours; a
value that is also part of another one or of plain text is replaced only where
it was found. Extra columns are carried, and those named like an output are
replaced by it in ``scan`` and kept in ``redact``. A text of any length is
searched whole.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.llm.common import row_of, unpacked

TRAINING_ROWS = 3000
TREES, DEPTH, LEAF = 15, 5, 8
THRESHOLD = 0.5
REDACTED = "[SECRET]"

#: Words that name a secret before its value.
NAMING = "token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?secret|auth|bearer|credential"
#: Words near a value that is no secret.
HARMLESS = "sha1|sha256|md5|checksum|digest|hash|commit|revision|uuid|etag|example|sample|dummy|placeholder|integrity|build|version|page|isbn"
#: Ordinary words inside a value, of code and of four languages.
DICTIONARY = "|".join(
    (
        "example sample change your token secret password test dummy placeholder here this that with from the and for not key value admin user name hello world letter number "
        "abc xyz foo bar xxxx 1234 0000 default config server client local host data file path index page section version build release update status error message report table "
        "field column string integer object class method module package public private static return import export select insert delete where group order count length model train "
        "login account email address phone street company service system network windows linux image video music summer winter spring autumn monday friday january december "
        "about after again before between could every first great house little many more most never other people place right should small sound still their there these thing "
        "think three under water which while without would write before green white black light night right world money paper power point order "
        "dans pour avec sans mais leur nous vous tout plus sous der die das und nicht eine auch wird sein haben los las una con por para como pero muy"
    ).split()
)
#: Values of a known form.
FORMS = "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{10,}\\.[A-Za-z0-9_-]{5,}"
_VALUE = "[A-Za-z0-9+/_=.@!#$%^*~-]{8,}"
#: From after the opening quote up to the closing one, which is not escaped.
_QUOTED = "|".join(rf"{q}(?!.{{0,7}}(?<!\\){q}).{{8,}}?(?<!\\)(?={q})" for q in "\"'")
#: How far back neighbouring words are read.
NEAR = 40
_TAIL = rf"(?:{NAMING})\b[\"']?"
_NAMED = rf"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]*{_TAIL}\s{{0,3}}+(?>:=|=>|[:=])\s{{0,3}}+"
_CANDIDATE = rf"(?i:{_NAMED}(?:{_QUOTED}|[\"']?{_VALUE}))|(?<![A-Za-z0-9+/_-])(?:{FORMS}|[A-Za-z0-9+/_-]{{20,}})"

FEATURES = ("length", "digits", "upper", "changes", "vowels", "distinct", "dictionary", "named", "quoted", "form", "harmless", "harmless_after", "naming_near", "test_path")


def features(value: Column, before: Column, after: Column, path: Column) -> dict[str, Column]:
    """FEATURES of a candidate, each a number; the same expressions train and score."""
    n = F.length(value)
    share = lambda c: c / n
    left = lambda text, pattern: F.length(F.regexp_replace(text, pattern, ""))
    return {
        "length": n.cast("double"),
        "digits": share(n - left(value, "[0-9]")),
        "upper": share(n - left(value, "[A-Z]")),
        "changes": share(F.size(F.split(value, r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])")) - 1),
        "vowels": share(n - left(value, "[aeiouAEIOU]")),
        "distinct": share(F.size(F.array_distinct(F.split(value, "")))),
        "dictionary": share(n - left(F.lower(value), DICTIONARY)),
        "named": before.rlike(rf"(?i){_TAIL}\s*(?:[:=]|:=|=>)\s*[\"']?$").cast("double"),
        "quoted": before.rlike("[\"']$").cast("double"),
        "form": value.rlike(f"^(?:{FORMS})$").cast("double"),
        "harmless": before.rlike(rf"(?i)\b(?:{HARMLESS})\b").cast("double"),
        "harmless_after": after.rlike(rf"(?i)^[\"']?[\s(\[#-]*(?:is |of )?(?:the )?(?:a )?(?:{HARMLESS})\b").cast("double"),
        "naming_near": before.rlike(rf"(?i)\b(?:{NAMING})\b").cast("double"),
        "test_path": F.coalesce(path.cast("string"), F.lit("")).rlike(r"(?i)(?:^|[/_.-])(?:tests?|fixtures?|examples?|docs?|samples?)(?:$|[/_.-])").cast("double"),
    }


def labelled_findings(count: int = TRAINING_ROWS, seed: int = 11) -> list[tuple[str, str, str, str, int]]:
    """(value, text before it, text after it, path, is a secret): reviewed forms, filled by a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda options: options[int(rng.integers(len(options)))]
    run = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    name = lambda: pick(("token", "secret", "password", "api_key", "access-key", "auth", "client_secret", "DB_PASSWORD", "AWS_SECRET_ACCESS_KEY", "github_token", "spring.datasource.password", "apiToken"))
    assign = lambda: pick((" = \"", "=", ": ", " = '", "\": \"", ":"))
    words = lambda: " ".join(pick(("the", "in", "of", "ended", "hat", "une", "que", "der", "los")) for _ in range(3))
    path = lambda: pick(("crawl", "forum", "web/app.py", "config/prod.env", "lib/core.js", "tests/fixtures", "docs/example"))
    code = lambda: pick(("crawl", "forum", "config/prod.env", "web/app.py", "lib/core.js"))
    plain = lambda: "-".join(pick(("thermal", "under", "letter", "example", "value", "number", "report", "table", "your", "change")) for _ in range(4))
    out = []
    for _ in range(count):
        kind = int(rng.integers(14))
        if kind < 3:
            row = (run(hexa, pick((32, 40, 64))), words() + " " + name() + assign(), code(), 1)
        elif kind < 5:
            row = (run(mixed, int(rng.integers(16, 60))), words() + " " + name() + assign(), code(), 1)
        elif kind == 5:
            row = (pick(("AKIA" + run(mixed[:26] + "0123456789", 16), "ghp_" + run(mixed, 36), "sk_live_" + run(mixed, 24))), words() + " ", path(), 1)
        elif kind == 6:
            row = (run(hexa, pick((32, 40, 64))), words() + " " + pick(("commit ", "sha256: ", "md5=", "checksum ", "digest: ", "integrity sha256-", "revision ")), path(), 0)
        elif kind == 7:
            row = (pick((plain(), plain() + run("0123456789", 2), "your_" + pick(("token", "secret")) + "_here", "changeme1234", "xxxxxxxxxxxx", "example-password", "placeholder0000")), words() + " " + pick((name() + assign(), "")), path(), 0)
        elif kind == 8:
            row = (pick((run("0123456789", int(rng.integers(20, 30))), "_".join(("page", run("0123456789", 8), "section", run("0123456789", 4))), run(hexa, 8) + "-" + "-".join(run(hexa, 4) for _ in range(3)) + "-" + run(hexa, 12))), words() + " ", path(), 0)
        elif kind == 10:
            row = (run(mixed, int(rng.integers(8, 20))), words() + " " + name() + assign(), code(), 1)
        elif kind == 11:
            row = (pick(("P@ss", "Winter", "h!nter", "Xy#", "m0nkey$", "root%")) + run(mixed + "@!#$%^", int(rng.integers(6, 14))), words() + " " + name() + assign(), code(), 1)
        elif kind == 12:
            row = (pick(("required", "undefined", "optional", "disabled", "something", "see the manual", "a value of this form", words())), words() + " " + name() + assign(), path(), 0)
        elif kind == 13:
            row = (run(hexa, pick((32, 40, 64))), words() + " ", path(), 0)
        else:
            row = (run(mixed, int(rng.integers(20, 40))), words() + " " + name() + assign(), pick(("tests/fixtures", "docs/example", "examples/demo")), 0)
        value, before, where, secret = row
        harmless = kind == 13 and rng.random() < 0.7
        after = pick((" (sha256)", " is the checksum", " checksum", " commit")) if harmless else pick(("", "\" ", "' ", " ", "\n", ".")) + words()
        out.append((value, before, after, where, secret))
    return out


def _grow(x: np.ndarray, y: np.ndarray, depth: int, rng) -> tuple | float:
    if depth == 0 or len(y) < 2 * LEAF or y.min() == y.max():
        return round(float((y.sum() + 1) / (len(y) + 2)), 6)
    best = (0.0, -1, 0.0)
    base = y.mean() * (1 - y.mean()) * len(y)
    for f in rng.choice(x.shape[1], 4, replace=False):
        order = np.argsort(x[:, f], kind="stable")
        values, ones = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(values[:-1] < values[1:])
        cuts = cuts[(cuts + 1 >= LEAF) & (len(y) - cuts - 1 >= LEAF)]
        if not len(cuts):
            continue
        n = cuts + 1.0
        p, q = ones[cuts] / n, (ones[-1] - ones[cuts]) / (len(y) - n)
        gain = base - (p * (1 - p) * n + q * (1 - q) * (len(y) - n))
        i = int(gain.argmax())
        if gain[i] > best[0] + 1e-9:
            best = (float(gain[i]), int(f), float(round((values[cuts[i]] + values[cuts[i] + 1]) / 2, 6)))
    _, f, at = best
    if f < 0:
        return round(float((y.sum() + 1) / (len(y) + 2)), 6)
    low = x[:, f] <= at
    return f, at, _grow(x[low], y[low], depth - 1, rng), _grow(x[~low], y[~low], depth - 1, rng)


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 12) -> tuple:
    """Trees over bootstrap samples: (feature, cut, low, high) or a share of secrets."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        out.append(_grow(x[pick], y[pick].astype(float), depth, rng))
    return tuple(out)


def train(findings: DataFrame, rows: int = TRAINING_ROWS) -> tuple:
    """A forest from labelled findings (value, before, after, path, secret), at most ``rows`` of them."""
    made = features(F.col("value"), F.col("before"), F.col("after"), F.col("path"))
    data = np.array([tuple(r) for r in findings.limit(rows).select(*(c.alias(k) for k, c in made.items()), F.col("secret").cast("double")).collect()])
    return fit_forest(data[:, :-1], data[:, -1])


_FORESTS: dict[str, tuple] = {}


def production_forest(docs: DataFrame) -> tuple:
    if "own" not in _FORESTS:
        _FORESTS["own"] = train(docs.sparkSession.createDataFrame(labelled_findings(), "value string, before string, after string, path string, secret int").coalesce(1))
    return _FORESTS["own"]


def _tree(tree, feature) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    f, at, low, high = tree
    return F.when(feature(FEATURES[f]) <= at, _tree(low, feature)).otherwise(_tree(high, feature))


def score(forest: tuple, feature) -> Column:
    """Mean over trees; ``feature`` gives the column of a feature's name."""
    total = None
    for tree in forest:
        total = _tree(tree, feature) if total is None else total + _tree(tree, feature)
    return total / len(forest)


def _candidates(docs: DataFrame, forest: tuple, threshold: float) -> DataFrame:
    """row, text, gaps (the text between candidates) and found: (lead, value, before, score, secret) of each.

    A text is its first gap, then each candidate's lead and value with the gap behind.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    path = F.col("source")
    named = rf"(?i)^({_NAMED}[\"']?)"  # no other candidate holds a sign of assignment
    rows = docs.select(row_of(docs).alias("row"), F.col("text"), path.alias("source"), F.regexp_extract_all(text, F.lit(_CANDIDATE), 0).alias("hits"), F.split(text, _CANDIDATE, -1).alias("gaps"))

    def parts(hit: Column, i: Column) -> Column:
        lead = F.regexp_extract(hit, named, 1)
        near = F.right(F.concat(F.when(i > 0, F.get("hits", i - 1)).otherwise(""), F.get("gaps", i)), F.lit(NEAR))
        after = F.regexp_extract(F.left(F.get("gaps", i + 1), F.lit(NEAR)), r"^[^\n]*", 0)
        candidate = hit.rlike("[0-9]") | (lead != "")
        return F.struct(lead.alias("lead"), F.substring(hit, F.length(lead) + 1, F.length(hit)).alias("value"), F.concat(F.regexp_extract(near, r"[^\n]*$", 0), lead).alias("before"), after.alias("after"), candidate.alias("candidate"))

    described = F.transform(F.transform("hits", parts), lambda p: F.struct(p["lead"].alias("lead"), p["value"].alias("value"), p["before"].alias("before"), p["candidate"].alias("candidate"), *(c.alias(k) for k, c in features(p["value"], p["before"], p["after"], path).items())))
    scored = F.transform(described, lambda p: F.struct(p["lead"].alias("lead"), p["value"].alias("value"), p["before"].alias("before"), F.when(p["candidate"], F.round(score(forest, lambda k: p[k]), 6)).alias("score")))
    return rows.withColumn("found", F.transform(scored, lambda p: F.struct(p["lead"].alias("lead"), p["value"].alias("value"), p["before"].alias("before"), p["score"].alias("score"), F.coalesce(p["score"] >= threshold, F.lit(False)).alias("secret")))).drop("hits")


def scan(docs: DataFrame, forest: tuple | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with findings: array of (value, before, score), in text order, and n_candidates."""
    rows = _candidates(docs.drop("findings", "n_candidates"), forest or production_forest(docs), threshold)
    found = F.transform(F.filter("found", lambda p: p["secret"]), lambda p: F.struct(p["value"].alias("value"), p["before"].alias("before"), p["score"].alias("score")))
    return unpacked(rows, findings=found, n_candidates=F.size(F.filter("found", lambda p: p["score"].isNotNull())).cast("long"))


def redact(docs: DataFrame, forest: tuple | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every found secret replaced at its place; columns as in ``docs``."""
    rows = _candidates(docs, forest or production_forest(docs), threshold)
    shown = F.transform("found", lambda p, i: F.concat(p["lead"], F.when(p["secret"], F.lit(REDACTED)).otherwise(p["value"]), F.get("gaps", i + 1)))
    clean = F.when(F.exists("found", lambda p: p["secret"]), F.concat(F.get("gaps", F.lit(0)), F.array_join(shown, ""))).otherwise(F.col("text"))
    rows = rows.select("row", clean.alias("text"))
    return unpacked(rows, text=F.col("text"), **({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}))
