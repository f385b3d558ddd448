r"""Quality rules, with DataFrame functions only.

Per document: word and symbol counts, repeated lines, and words inside 8-word
windows that occur twice. Across documents: the lines of a document, normalised
(lower case, white space as one space) and hashed with its host (``source``),
are counted once per *distinct* document; a line that more than
``MAX_DOCUMENTS`` documents of a host share is removed, and a document that
removal depletes is rejected. Copies are one document here: a document is the
hash of the whole sorted set of its lines, so copies do not make their own
lines look like a template (groups of copies are left to the near-duplicate
operator), while documents that differ in any line count apart.

One pass over the texts leaves a row of numbers for each document and 16 bytes
for each line; every later step works on those. Line counts are aggregated in
two levels (line and document, then line), and frequent lines are broadcast while
they are few, else joined salted, so a line in a third of all documents is no
hot key. A text of n lines costs n log n. Windows and lines are compared by 64-bit hashes.

Defined cases: null text has no words and fails the base rules. A null host is
a host of its own. Rows that agree in ``doc_id`` and text get the same verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telarium.llm.common import cut, row_of, same, text_hash, unpacked

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
MAX_DOCUMENTS, MAX_REMOVED_PERCENT = 50, 70
#: Frequent lines that are broadcast (8 bytes each); beyond, each goes to so many partitions.
LINES_SENT, SALTS = 1_000_000, 32

_SPACE = r"[\x20\x09-\x0D]+"


def _normal_lines(text: Column) -> Column:
    """Normalised lines, in order; a line without words is empty."""
    flat = F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def _line_key(host: Column, line: Column) -> Column:
    return F.xxhash64(host, line)


def measured(docs: DataFrame) -> DataFrame:
    """id, doc_id, part, the base figures and the hashed lines with their words and places; one row for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    host = F.col("source").cast("string")
    words = F.filter(F.split(text, _SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = docs.select(
        "doc_id", text_hash(F.col("text").cast("string")).alias("part"), words.alias("words"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.filter(
            F.transform(_normal_lines(text), lambda x, i: F.when(x != "", F.struct(_line_key(host, x).alias("h"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("w"), i.alias("at")))),
            lambda x: x.isNotNull(),
        ).alias("lines"),
    )
    n = F.size("words")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    b = a.select("doc_id", "part", "n_symbols", "n_dup_lines", "lines", n.cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"), windows.alias("windows"))
    # (hash, place) in order of hash, beside its neighbours; only for texts with a repeated window
    ranked = F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.zip_with("windows", F.sequence(F.lit(1), F.size("windows")), lambda k, i: F.struct(k.alias("k"), i.alias("i")))))
    c = b.withColumn("ranked", ranked).drop("windows")
    none = F.array(F.lit(None).cast("struct<k:bigint,i:int>"))
    twice = F.filter(
        F.arrays_zip(F.col("ranked").alias("z"), F.concat(none, F.col("ranked")).alias("p"), F.concat(F.slice("ranked", 2, F.greatest(F.size("ranked"), F.lit(1))), none).alias("q")),
        lambda x: x["z"].isNotNull() & (x["z"]["k"].eqNullSafe(x["p"]["k"]) | x["z"]["k"].eqNullSafe(x["q"]["k"])),
    )
    places = F.sort_array(F.transform(twice, lambda x: x["z"]["i"]))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(places, zero, lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + F.least(F.lit(WINDOW), i + WINDOW - acc["end"])).alias("n")), lambda acc: acc["n"])
    return c.withColumn("n_repeat_words", F.when(F.col("ranked").isNull(), 0).otherwise(covered).cast("long")).drop("ranked")


def frequent_lines(rows: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """(h): hashes of lines that more distinct documents of a host have than allowed."""
    each = rows.select(F.sort_array(F.array_distinct("lines.h")).alias("hs")).select(F.xxhash64("hs").alias("document"), F.explode("hs").alias("h"))
    pairs = each.groupBy("h", "document").agg(F.lit(1).alias("one"))
    return pairs.groupBy("h").agg(F.count("*").alias("documents")).where(F.col("documents") > max_documents).select("h")


def _removed(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """(id, gone, removed): words in, and places of, the lines that are frequent."""
    lines = rows.select("id", F.explode("lines").alias("x")).select("id", "x.*")
    if hot.count() <= LINES_SENT:
        found = lines.join(F.broadcast(hot), "h", "left_semi")
    else:
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = lines.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, ["h", "salt"], "left_semi")
    return found.groupBy("id").agg(F.sum("w").cast("long").alias("gone"), F.collect_list("at").alias("removed"))


def verdicts(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """A row for each row of ``docs``: base figures, words and places of frequent lines, kept."""
    rows = cut(measured(docs).withColumn("id", F.monotonically_increasing_id()))
    found = _removed(rows, cut(frequent_lines(rows, max_documents)))
    out = rows.drop("lines").join(found, "id", "left").withColumn("n_removed_words", F.coalesce("gone", F.lit(0).cast("long"))).drop("id", "gone")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = (F.col("n_words") - F.col("n_removed_words") < MIN_WORDS) | (100 * F.col("n_removed_words") > MAX_REMOVED_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted)


def keep_good(docs: DataFrame, max_documents: int = MAX_DOCUMENTS) -> DataFrame:
    """The kept documents, without their frequent lines; columns as in ``docs``."""
    good = verdicts(docs, max_documents).where("kept").groupBy(F.col("doc_id").alias("d"), F.col("part").alias("p")).agg(F.first("removed").alias("removed"))
    text = F.col("text").cast("string")
    rows = docs.select(row_of(docs).alias("row"), "doc_id", text.alias("text"), text_hash(text).alias("part"))
    out = rows.join(good, same((F.col("doc_id"), F.col("d")), (F.col("part"), F.col("p"))))
    # places of the lines that stay, in order; a set operation, as texts may have very many lines
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "removed")
    cleaned = F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    out = out.withColumn("lines", lines).select("row", cleaned.alias("text"))
    return unpacked(out, text=F.col("text"), **({"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}))
