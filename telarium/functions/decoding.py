"""Raw values to text: addresses, codes, registry values. All in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: DNS query types.
QUERY_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 43: "DS", 65: "HTTPS", 255: "ANY"}

#: Mandatory-label SIDs (last number) and their levels.
INTEGRITY_LEVELS = {0: "untrusted", 4096: "low", 8192: "medium", 8448: "medium_plus", 12288: "high", 16384: "system", 20480: "protected"}

#: Registry value types.
REG_SZ, REG_EXPAND_SZ, REG_BINARY, REG_DWORD, REG_DWORD_BIG_ENDIAN, REG_MULTI_SZ, REG_QWORD = 1, 2, 3, 4, 5, 7, 11


def _lookup(value: Column, names: dict) -> Column:
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), value)


def query_type(number: Column) -> Column:
    """Name of a DNS query type, or its number."""
    return F.coalesce(_lookup(number.cast("int"), QUERY_TYPES), number.cast("string"))


def integrity_level(sid: Column) -> Column:
    """Level of a mandatory-label SID; null for anything else."""
    return _lookup(F.trim(sid), {f"S-1-16-{n}": level for n, level in INTEGRITY_LEVELS.items()})


def ip4_of_number(number: Column) -> Column:
    """Dotted address of a little-endian number; bits beyond 32 don't count."""
    octet = lambda i: F.shiftrightunsigned(number.cast("bigint"), 8 * i).bitwiseAND(255).cast("string")
    return F.concat_ws(".", *(octet(i) for i in range(4)))


def _byte(digits: Column, at: int) -> Column:
    return F.conv(F.substring(digits, 2 * at + 1, 2), 16, 10)


def _ip4(digits: Column, at: int) -> Column:
    return F.concat_ws(".", *(_byte(digits, at + i) for i in range(4)))


#: Zero groups in a row, the longest first; the text before and behind a run are groups of their own.
_ZERO_RUNS = "|".join(f"(.*?)(?:^|:)0(?::0){{{run - 1}}}(?:$|:)(.*)" for run in range(8, 1, -1))
_SHORTENED = "".join(f"${i}" for i in range(1, 15, 2)) + "::" + "".join(f"${i}" for i in range(2, 15, 2))


def _ip6(digits: Column, at: int) -> Column:
    """Shortest form: the first of the longest runs of zero groups becomes ``::``."""
    groups = F.regexp_replace(F.substring(digits, 2 * at + 1, 32), "(.{4})(?!$)", "$1:")
    plain = F.regexp_replace(groups, "(^|:)0{1,3}", "$1")
    out = F.regexp_replace(plain, f"^(?:{_ZERO_RUNS})$", _SHORTENED)
    mapped = F.substring(digits, 2 * at + 1, 24) == "0" * 20 + "ffff"
    return F.when(mapped, F.concat(F.lit("::ffff:"), _ip4(digits, at + 12))).otherwise(out)


def ip_of_bytes(raw: Column) -> Column:
    """Address of 4, 16 or 28 bytes: bare, or a socket address of family 2 or 23.

    Anything else, and a socket address that is cut short, is null.
    """
    digits, size = F.lower(F.hex(raw)), F.octet_length(raw)
    family = F.substring(digits, 1, 4)
    six = F.when((size == 16) & (family != "1700"), digits).when((size == 28) & (family == "1700"), F.substring(digits, 17, 32))
    return F.when(size == 4, _ip4(digits, 0)).when(size.isin(16, 28) & (family == "0200"), _ip4(digits, 4)).when(six.isNotNull(), _ip6(six, 0))


def registry_value(kind: Column, raw: Column) -> Column:
    """Text of a value by its declared type; what does not fit its type is hex."""
    digits, size = F.lower(F.hex(raw)), F.octet_length(raw)
    number = lambda n: F.conv(F.concat(*(F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n)))), 16, 10)
    units = F.regexp_extract(digits, "^((?:(?!0000)[0-9a-f]{4})*)", 1)
    pair_or_single = "^(?:[0-9a-f]{2}(?!d[89a-f])[0-9a-f]{2}|[0-9a-f]{2}d[89ab][0-9a-f]{2}d[c-f])+$"
    text = F.when((size % 2 == 0) & units.rlike(pair_or_single), F.decode(F.unhex(units), "UTF-16LE"))
    return (
        F.when(kind.isin(REG_SZ, REG_EXPAND_SZ, REG_MULTI_SZ), F.coalesce(text, digits))
        .when(kind.isin(REG_DWORD, REG_DWORD_BIG_ENDIAN) & (size >= 4), number(4))
        .when((kind == REG_QWORD) & (size >= 8), number(8))
        .otherwise(digits)
    )
