"""Quality classifier: an interpolated modified Kneser-Ney model of characters.

A symbol is a UTF-16 code unit, so a 4-gram is exactly a 64-bit number in any
script. Trusted documents (label quality 1) are counted: Spark sums n-grams,
sharded by language and n-gram, and the tables grow with the text they are
counted on. Lower orders count distinct left contexts, discounts come from the
counts of counts, and the parts of the model are joined by context.

Each document then has a perplexity, exp of the mean negative log probability
over all its symbols:

1. The ``SENT`` most frequent 4-grams of the model, with their log
   probabilities, are sent to tasks, which sum them over each document.
2. All other 4-grams of a document, counted once a document, are joined by
   n-gram to their log probabilities, which are worked out for each distinct
   4-gram of the corpus by joins with the sharded counts. 4-grams that very
   many documents have (at most ``OFTEN`` of them) are joined by broadcast.

The sizes of what is sent are fixed; what is over takes the joins, so scores do
not depend on them. A key of a join has at most 65,536 rows (the symbols that
can stand on one side of an n-gram), or is one of those broadcast.

A language's threshold is a high quantile of the perplexity of its trusted
documents. A fifth of them (by hash of the id) is left out of the counts; the
threshold is the greater of the quantiles of both parts, as documents that the
model has seen look better than new ones; the quantile of n documents left out
is raised by its n ** -0.5.

Defined cases: an empty or null text has perplexity null and is not kept. A
language without trusted text has no threshold and keeps its documents. A null
language is a language of its own. Repeated label rows count once, and a
document with labels of both kinds is not trusted. Repeated rows are scored
alike. A very long text is one step of its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.llm.common import blocks, cut, with_fields
from telarium.llm.words import mix

ORDER, UNIT = 4, 16
SYMBOLS = 1 << UNIT
QUANTILE, HELD_OUT = 0.995, 5
#: 4-grams that tasks are sent (12 bytes each), and n-grams that are joined by broadcast.
SENT, OFTEN = 1 << 20, 200_000
#: Ids of trusted documents and languages that are joined by broadcast; more take a shuffle.
IDS_SENT, LANGUAGES_SENT = 4_000_000, 100_000
#: Rows of a partition of a table of the model.
ROWS = 250_000
_SPACE = 32


def symbols(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code units of the texts, each text's first, and how many characters each has."""
    lead = (raw & 0xC0) != 0x80
    try:
        codes = np.frombuffer(raw.tobytes().decode().encode("utf-16-le"), np.uint16)
        first = np.concatenate(([0], np.cumsum(lead.astype(np.int64) + (raw >= 0xF0))))[offsets]
    except UnicodeDecodeError:  # bytes that are no text
        parts = [np.frombuffer(raw[a:b].tobytes().decode("utf-8", "replace").encode("utf-16-le"), np.uint16) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codes, first = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
    return codes, first, np.diff(np.concatenate(([0], np.cumsum(lead)))[offsets])


def grams(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ORDER-gram that ends at each symbol; white space stands before a text."""
    n = len(codes)
    place = np.arange(n) - np.repeat(first[:-1], np.diff(first))
    out = codes.astype(np.uint64)
    for back in range(1, ORDER):
        before = np.full(n, _SPACE, np.uint64)
        before[back:] = codes[: max(n - back, 0)]
        before[place < back] = _SPACE
        out |= before << np.uint64(UNIT * back)
    return out.view(np.int64)


def _languages(rows: pa.RecordBatch) -> tuple[list, np.ndarray]:
    found = rows.column("lang").dictionary_encode()
    return found.dictionary.to_pylist(), found.indices.to_numpy()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, offsets in blocks(batches):
        codes, first, _ = symbols(raw, offsets)
        all_grams, (names, of) = grams(codes, first), _languages(rows)
        of = np.repeat(of, np.diff(first))
        for i, lang in enumerate(names):
            found, n = np.unique(all_grams[of == i], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(n)], names=["lang", "gram", "n"])


def _low(gram: str, size: int) -> Column:
    """The last ``size`` symbols."""
    return F.col(gram) if size == ORDER else F.col(gram).bitwiseAND((1 << (UNIT * size)) - 1)


def _packed(rows: DataFrame) -> DataFrame:
    """``rows``, written, in partitions of some ROWS: a small table makes few tasks and files."""
    rows = cut(rows)
    return rows.coalesce(max(1, rows.count() // ROWS))


def _by_language(rows: DataFrame) -> DataFrame:
    rows = _packed(rows)
    return F.broadcast(rows) if rows.count() <= LANGUAGES_SENT else rows


@dataclass
class Model:
    """``counts`` (lang, gram, n) of 4-grams; by order, ``shares`` (lang, gram, own), the
    discounted share of a gram, and ``weights`` (lang, context, back), that of the order below."""

    counts: DataFrame
    shares: dict[int, DataFrame]
    weights: dict[int, DataFrame]


def train(trusted: DataFrame) -> Model:
    """The model of texts (lang, text)."""
    level = top = _packed(trusted.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    shares, weights = {}, {}
    for size in range(ORDER, 0, -1):
        freq = level.groupBy("lang").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
        y = F.expr("n1 / (n1 + 2 * n2)")
        discount = lambda i: F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")))).otherwise(F.lit(0.5))  # noqa: B023, E731
        used = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        each = level.join(_by_language(freq.select("lang", *(discount(i).alias(f"d{i}") for i in (1, 2, 3)))), "lang")
        each = each.select("lang", "gram", F.shiftrightunsigned("gram", UNIT).alias("context"), "n", used.alias("d"))
        totals = each.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("d").alias("mass"))
        totals = _by_language(totals) if size == 1 else _packed(totals)  # of order 1, one context a language
        shares[size] = _packed(each.join(totals, ["lang", "context"]).select("lang", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own")))
        weights[size] = totals.select("lang", "context", (F.col("mass") / F.col("total")).alias("back"))
        if size > 1:  # the order below counts distinct symbols to the left
            level = _packed(level.select("lang", _low("gram", size - 1).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n")))
    return Model(top, shares, weights)


def probabilities(wanted: DataFrame, model: Model, size: int = ORDER) -> DataFrame:
    """(lang, gram, p) for distinct grams of ``size`` symbols of the model's languages."""
    rows = wanted.join(model.shares[size], ["lang", "gram"], "left").withColumn("context", F.shiftrightunsigned("gram", UNIT))
    rows = rows.join(model.weights[size], ["lang", "context"], "left")
    below = F.lit(1.0 / SYMBOLS)
    if size > 1:
        rows = rows.withColumn("rest", _low("gram", size - 1))
        lower = probabilities(_packed(wanted.select("lang", _low("gram", size - 1).alias("gram")).distinct()), model, size - 1)
        rows, below = rows.join(lower.select("lang", F.col("gram").alias("rest"), F.col("p").alias("below")), ["lang", "rest"]), F.col("below")
    return _packed(rows.select("lang", "gram", (F.coalesce("own", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * below).alias("p")))


class Table:
    """Numbers by 64-bit key, open addressing; looks up whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        home = self._home(keys)
        order = np.argsort(home, kind="stable")
        place = np.maximum.accumulate(home[order] - np.arange(len(keys))) + np.arange(len(keys))
        size = max(1 << self.bits, int(place[-1]) + 1 if len(keys) else 0) + 1
        self.keys, self.values = np.zeros(size, np.int64), np.full(size, np.nan, np.float32)
        self.keys[place], self.values[place] = keys[order], values[order]

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Values; NaN where a key is absent."""
        at = self._home(keys)
        out = self.values[at]
        todo = np.flatnonzero((self.keys[at] != keys) & ~np.isnan(out))
        out[todo] = np.nan
        while len(todo):
            at[todo] += 1
            value, same = self.values[at[todo]], self.keys[at[todo]] == keys[todo]
            out[todo[same]] = value[same]
            todo = todo[~same & ~np.isnan(value)]
        return out


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """(lang, gram) of at most ``most`` 4-grams: those above the least count that keeps within it."""
    least, total = 0, 0
    for n, how_many in sorted(counts.groupBy("n").agg(F.count("*")).collect(), reverse=True):
        total += how_many
        if total > most:
            least = n
            break
    return counts.where(F.col("n") > least).select("lang", "gram")


def perplexities(docs: DataFrame, model: Model, sent: int = SENT, often: int = OFTEN) -> DataFrame:
    """doc_id, lang, n_chars and perplexity for each row of ``docs`` (doc_id, lang, text)."""
    langs = sorted(r.lang for r in model.counts.select("lang").distinct().collect())
    head = probabilities(frequent(model.counts, sent), model).select("lang", "gram", F.log("p").cast("float").alias("log_p")).toArrow()
    of = head["lang"].combine_chunks().dictionary_encode()
    where, keys, logs = of.indices.to_numpy(), head["gram"].to_numpy(), head["log_p"].to_numpy()
    tables = {lang: Table(np.zeros(0, np.int64), np.zeros(0, np.float32)) for lang in langs} | {lang: Table(keys[where == i], logs[where == i]) for i, lang in enumerate(of.dictionary.to_pylist())}
    shared = docs.sparkSession.sparkContext.broadcast(tables)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets in blocks(batches):
            codes, first, chars = symbols(raw, offsets)
            n, all_grams, (names, of) = np.diff(first), grams(codes, first), _languages(rows)
            text = np.repeat(np.arange(len(rows)), n)
            logs = np.zeros(len(codes), np.float32)
            for i, lang in enumerate(names):
                if lang in shared.value:
                    mine = np.flatnonzero(of[text] == i)
                    logs[mine] = shared.value[lang].look_up(all_grams[mine])
            over = np.flatnonzero(np.isnan(logs))
            logs[over] = 0
            # n-grams that were not sent, counted for each text
            order = np.lexsort((all_grams[over], text[over]))
            gram, doc = all_grams[over][order], text[over][order]
            new = np.flatnonzero(np.concatenate(([True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])))[: len(gram)])
            times = np.diff(np.concatenate((new, [len(gram)])))
            ends = np.concatenate(([0], np.searchsorted(doc[new], np.arange(len(rows)), side="right"))).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(gram[new]), pa.array(times, pa.int64())], names=["gram", "n"])
            total = np.concatenate(([0.0], np.cumsum(logs, dtype=np.float64)))
            known = np.array([lang in shared.value for lang in names], bool)[of]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("lang"), pa.array(chars, pa.int64()), pa.array(n, pa.int64()), pa.array(total[first[1:]] - total[first[:-1]], mask=~known | (n == 0)), pa.ListArray.from_arrays(ends, pairs)], names=["doc_id", "lang", "n_chars", "n", "log_p", "over"])

    schema = with_fields(docs.select("doc_id", "lang").schema, "n_chars bigint, n bigint, log_p double, over array<struct<gram:bigint,n:bigint>>")
    rows = cut(docs.select("doc_id", "lang", "text").mapInArrow(score, schema).withColumn("row", F.monotonically_increasing_id()))
    over = rows.where("log_p IS NOT NULL").select("row", "lang", F.explode("over").alias("x")).select("row", "lang", "x.*")
    seen = _packed(over.groupBy("lang", "gram").agg(F.count("*").alias("texts")))
    many = (seen.agg(F.sum("texts")).first()[0] or 0) // often
    values = _packed(probabilities(seen.select("lang", "gram"), model).join(seen, ["lang", "gram"]).select("lang", "gram", F.log("p").alias("log"), (F.col("texts") > many).alias("often")))
    told = F.broadcast(values.where("often").select("lang", "gram", "log"))
    rest = over.join(told, ["lang", "gram"], "left_anti").join(values.where("NOT often").select("lang", "gram", "log"), ["lang", "gram"])
    sums = over.join(told, ["lang", "gram"]).unionByName(rest).groupBy("row").agg(F.sum(F.col("n") * F.col("log")).alias("more"))
    out = rows.drop("over").join(sums, "row", "left")
    return out.select("doc_id", "lang", "n_chars", F.exp(-(F.col("log_p") + F.coalesce("more", F.lit(0.0))) / F.col("n")).alias("perplexity"))


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, sent: int = SENT, often: int = OFTEN) -> DataFrame:
    """doc_id, lang, n_chars, perplexity, threshold, kept for each row of ``docs``."""
    good = _packed(labels.groupBy(F.col("doc_id").alias("id__")).agg(F.min("quality").alias("q__")).where("q__ = 1").select("id__"))
    good = F.broadcast(good) if good.count() <= IDS_SENT else good
    named = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string")))
    texts = docs.select("doc_id", named.alias("lang"), F.col("text").cast("string").alias("text"))
    held_out = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    model = train(texts.where(~held_out).join(good, F.col("doc_id") == F.col("id__"), "left_semi"))
    scored = cut(perplexities(texts, model, sent, often).join(good, F.col("doc_id") == F.col("id__"), "left").withColumn("trusted", F.col("id__").isNotNull()).drop("id__"))
    high = lambda new: F.percentile_approx(F.when(held_out if new else ~held_out, F.col("perplexity")), quantile, 10_000)
    unsure = 1 + 1 / F.sqrt(F.count_if(held_out))  # few documents say little of a high quantile
    limits = scored.where("trusted AND perplexity IS NOT NULL").groupBy("lang").agg(F.greatest(high(True) * unsure, high(False)).alias("threshold"))
    out = scored.join(_by_language(limits), "lang", "left")
    kept = (F.col("n_chars") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    lang = F.when(F.col("lang") == "", F.lit(None)).otherwise(F.substring("lang", 2, 1 << 30))
    return out.select("doc_id", lang.alias("lang"), "n_chars", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), kept.alias("kept"))
