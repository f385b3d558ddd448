"""URL filters: a cascade of Bloom filters over hosts, with DataFrame functions only.

The first filter encodes the listed hosts. The second encodes those hosts of
the corpus that are not listed but pass the first; the third the listed hosts
that pass the second; and so on until a level lets nothing through by mistake.
Every host of the corpus was put to every level when it was built, so the
answer is exact for all of them, without a join at the time of use.

Each level is a bit set of fixed length for its number of keys (10 bits a key),
built by an aggregate over 64-bit words and used as one literal. A list that
needs more than ``BITS_SENT`` bits is dealt by the hash of its keys to several
cascades, each of which answers for the hosts of its own share.

Rules on host and path come first; the rule with the longest text wins.

A host with a third of all pages is one key of the universe and one test a row;
no rows are shuffled but distinct hosts.

Defined cases: a null url, or one without ``://``, has empty host and path and
fits no rule. Repeated rows and urls are judged alike. Empty lists block none.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.llm.common import cut, row_of, unpacked

BITS_PER_KEY, HASHES = 10, 5
#: 8 MB as a literal.
BITS_SENT = 1 << 26
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path start) of the rules of the production list.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The production list: each term under each domain, bare and with the usual first labels.
LISTED = tuple(f"{first}{term}.example.{last}" for term in ("cheap-pills", "casino-win", "free-bets", "ads-track") for first in ("", "www.", "m.", "blog.", "shop.") for last in ("com", "net", "org", "info"))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(cast(url AS string), ''), instr(coalesce(cast(url AS string), ''), '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    return pages.withColumn("host", host).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def _places(key: Column, level: int, bits: int) -> list[Column]:
    """Bits of a key on a level, by double hashing."""
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), F.lit(bits).cast("long")) for i in (0, 1))
    return [F.pmod(a + b * F.lit(j), F.lit(bits).cast("long")) for j in range(HASHES)]


class Level:
    def __init__(self, number: int, bits: int, words: np.ndarray):
        self.number, self.bits, self.words = number, bits, words

    def passes(self, key: Column) -> Column:
        words = F.lit(self.words)
        out = None
        for p in _places(key, self.number, self.bits):
            bit = F.getbit(F.get(words, F.shiftright(p, 6).cast("int")), p.bitwiseAND(63).cast("int")) == 1
            out = bit if out is None else out & bit
        return out


def _level(keys: DataFrame, number: int, count: int) -> Level:
    bits = 64 * math.ceil(max(64, count * BITS_PER_KEY) / 64)
    bit = F.explode(F.array(*_places(F.col("key"), number, bits)))
    rows = keys.select(bit.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 AS int))")).alias("bits")).collect()
    words = np.zeros(bits // 64, np.int64)
    for word, value in rows:
        words[word] = value
    return Level(number, bits, words)


class Cascade:
    """Exact membership of the hosts of one corpus in one list."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    @staticmethod
    def build(listed: DataFrame, other: DataFrame) -> Cascade:
        """Column ``key``: the listed keys, and all others of the corpus; both distinct and written."""
        levels: list[Level] = []
        encode, against, n = listed, other, listed.count()
        while n:
            levels.append(_level(encode, len(levels), n))
            wrong = cut(against.where(levels[-1].passes(F.col("key"))))
            encode, against, n = wrong, encode, wrong.count()
        return Cascade(levels)

    def listed(self, key: Column) -> Column:
        """Inside out: passes level 0, and not level 1 unless level 2, ..."""
        out = F.lit(True)
        for i, level in reversed(list(enumerate(self.levels))):
            # what passes an odd level is decided by the next; what fails it was decided by the one before
            out = F.when(level.passes(key), out if i + 1 < len(self.levels) else F.lit(i % 2 == 0)).otherwise(F.lit(i % 2 == 1))
        return out if self.levels else F.lit(False)


def _share(key: Column, shares: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shares))


def cascades(listed: DataFrame, universe: DataFrame) -> list[Cascade]:
    """A cascade for each share of the keys; one, unless the list is very large."""
    listed = cut(listed.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct())
    other = cut(universe.where("key IS NOT NULL").distinct().join(listed, "key", "left_anti"))
    shares = max(1, math.ceil(listed.count() * BITS_PER_KEY / BITS_SENT))
    mine = lambda rows, i: rows if shares == 1 else rows.where(_share(F.col("key"), shares) == i)
    return [Cascade.build(mine(listed, i), mine(other, i)) for i in range(shares)]


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule and verdict, which replace columns of these names. ``listed``: one column ``key`` of hosts."""
    rows = with_host_and_path(pages.select(row_of(pages, "host", "path", "rule", "verdict").alias("row"), "url"))
    built = cascades(listed, rows.select(F.col("host").alias("key")))
    if len(built) == 1:
        rows = rows.withColumn("on", built[0].listed(F.col("host")))
    else:  # a scan for each share, each with its own literals
        shares = [rows.where(_share(F.col("host"), len(built)) == i).withColumn("on", c.listed(F.col("host"))) for i, c in enumerate(built)]
        rows = reduce(DataFrame.unionAll, shares)
    on = F.col("on")
    rule, verdict = F.lit(None).cast("string"), F.when(on, "block").otherwise("allow")
    for say, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = _fits(host, path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, say).otherwise(verdict)
    return unpacked(rows.select("row", "host", "path", rule.alias("rule"), verdict.alias("verdict")), host=F.col("host"), path=F.col("path"), rule=F.col("rule"), verdict=F.col("verdict"))


def production_list(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(host,) for host in LISTED], "key string").coalesce(1)
