"""Scalar functions over columns; all stay in generated code."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def base_name(path: Column) -> Column:
    """What stands behind the last separator."""
    return F.lower(F.substring_index(F.replace(path, F.lit("/"), F.lit("\\")), "\\", -1))


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


# Tests by many needles or ranges name their text once, as one pattern: generated
# code holds a text as often as it is named, and the JVM compiles no method over 8,000 bytes.


def _either(needles: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(n) for n in needles) + ")"


def contains_any(text: Column, needles: tuple[str, ...]) -> Column:
    return F.lower(text).rlike(_either(needles))


def ends_with_any(text: Column, needles: tuple[str, ...]) -> Column:
    return F.lower(text).rlike(_either(needles) + r"\z")


def ip4(address: Column) -> Column:
    """Number of a dotted address, null for anything else."""
    parts = F.split(address, r"\.")
    number = reduce(lambda acc, i: acc * 256 + F.get(parts, F.lit(i)).cast("bigint"), range(1, 4), F.get(parts, F.lit(0)).cast("bigint"))
    octet = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.when(address.rlike(rf"^{octet}(\.{octet}){{3}}$"), number)


#: Ranges that are not routable (first, last).
UNROUTABLE = (("0.0.0.0", 8), ("127.0.0.0", 8), ("224.0.0.0", 3), ("10.0.0.0", 8), ("172.16.0.0", 12), ("192.168.0.0", 16), ("169.254.0.0", 16), ("192.0.2.0", 24), ("198.51.100.0", 24), ("203.0.113.0", 24), ("100.64.0.0", 10), ("192.0.0.0", 24), ("198.18.0.0", 15))


def _number(address: str) -> int:
    return reduce(lambda acc, part: acc * 256 + int(part), address.split("."), 0)


def in_range4(number: Column, network: str, bits: int) -> Column:
    size = 1 << (32 - bits)
    first = _number(network) // size * size
    return number.between(first, first + size - 1)


#: Their networks' leading bits.
_UNROUTABLE_BITS = "^(?:" + "|".join(f"{_number(a):032b}"[:b] for a, b in UNROUTABLE) + ")"


def is_routable(address: Column) -> Column:
    v4 = ~F.lpad(F.bin(ip4(address)), 32, "0").rlike(_UNROUTABLE_BITS)
    low = F.lower(address)
    v6 = low.contains(":") & ~low.isin("::", "::1") & ~low.rlike("^(ff|f[cd]|fe[89ab])")
    return F.coalesce(v4, v6, F.lit(False))


def log_ratio(hit: Column, miss: Column) -> Column:
    return F.when((hit > 0) & (miss > 0), F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.log(hit / miss)))).otherwise(0.0)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return F.log(p / (1 - p))


def half_life_weight(age_s: Column, half_life_s: float) -> Column:
    return F.when(age_s <= 0, 1.0).otherwise(F.pow(F.lit(2.0), -age_s / max(half_life_s, 1e-9)))


def entropy(p: Column) -> Column:
    """Binary entropy in bits, 0 outside (0, 1)."""
    return F.when((p > 0) & (p < 1), -(p * F.log2(p)) - (1 - p) * F.log2(1 - p)).otherwise(0.0)


def capacity(hit: Column, miss: Column) -> Column:
    """Bits that a rule carries with an even prior."""
    fp, fn = miss, 1 - hit
    return F.greatest(F.lit(0.0), entropy((1 + fp - fn) / 2) - entropy(fp) / 2 - entropy(fn) / 2)


def extension_bucket(token: Column) -> Column:
    ext = F.regexp_extract(base_name(token), r"(\.[A-Za-z0-9]{1,8})$", 1)
    return F.when(ext == "", "unknown").otherwise(ext)


def minimise(detail: Column) -> Column:
    """Path-like tokens become their kind of file."""
    bucket = lambda t: F.when(t.contains("\\") | t.contains("/"), extension_bucket(t)).otherwise(t)
    return F.array_join(F.transform(F.split(detail, " "), bucket), " ")


def command_image(command: Column) -> Column:
    return F.left(F.regexp_replace(F.element_at(F.split(F.trim(command), r"\s+"), 1), r'^"+|"+$', ""), F.lit(80))


def severity_band(p: Column) -> Column:
    return F.when(p >= 0.90, "critical").when(p >= 0.60, "high").when(p >= 0.30, "medium").when(p >= 0.10, "low").otherwise("info")


SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.lit(list(SEVERITIES)), severity).cast("int") - 1


def filetime(ticks: Column) -> Column:
    """Microseconds since 1970 of 100 ns ticks since 1601; null before 1970 or beyond 9999."""
    since = ticks - F.lit(116_444_736_000_000_000)
    value = F.call_function("div", since, F.lit(10))
    return F.when((since >= 0) & (value < 253_402_300_800_000_000), value)


def backoff(n: Column, base_ms: int, ceiling_ms: int) -> Column:
    return F.least(F.lit(ceiling_ms).cast("bigint"), F.lit(base_ms).cast("bigint") * F.pow(F.lit(2), F.least(n, F.lit(30))).cast("bigint"))


def may_restart(attempt: Column, most: int) -> Column:
    """Whether a restart is within budget; the attempt numbered ``most`` is not."""
    return attempt < most
