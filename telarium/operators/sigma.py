"""SIGMA rules compiled to column expressions.

A rule is a mapping as in its YAML file. Every test of an absent field is false
(never null), so that ``not`` of it is true. What can't be compiled is a
problem row, and the other rules still load.
"""

from __future__ import annotations

import ipaddress
import re
from dataclasses import dataclass, field
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.functions.scalars import in_range4, ip4

#: Likelihood pair of each level; an unknown level is informational.
LEVELS = {"critical": (0.90, 0.005), "high": (0.75, 0.010), "medium": (0.50, 0.020), "low": (0.30, 0.050), "informational": (0.15, 0.100)}
REFUSED = ("re", "base64", "base64offset", "windash", "wide", "utf16", "utf16le", "utf16be", "expand")
CATEGORIES = {"process_creation": "process_start", "process_termination": "process_exit", "image_load": "image_load", "registry_set": "registry_set", "file_event": "file_create", "file_delete": "file_delete", "file_rename": "file_rename", "dns_query": "dns_query", "network_connection": "network_connect", "ps_script": "script_block"}
_ALL = tuple(CATEGORIES)
#: SIGMA field -> (expression over a telemetry row, the categories that fill it).
FIELDS = {
    "EventID": ("event_id", _ALL), "Provider_Name": ("provider", _ALL), "Channel": ("provider", _ALL), "ProcessId": ("pid", _ALL),
    "Image": ("image", ("process_creation",)), "CommandLine": ("command_line", ("process_creation",)), "ParentImage": ("reported_parent", ("process_creation",)),
    "ParentProcessId": ("parent_pid", ("process_creation",)), "User": ("user_name", ("process_creation",)), "ExitCode": ("exit_code & 4294967295", ("process_termination",)),
    "ImageLoaded": ("path", ("image_load",)), "Signed": ("signed", ("image_load",)), "Signature": ("signer", ("image_load",)),
    "TargetObject": ("concat_ws(chr(92), key_path, value_name)", ("registry_set",)), "Details": ("value_data", ("registry_set",)),
    "TargetFilename": ("coalesce(new_path, path)", ("file_event", "file_delete", "file_rename")), "SourceFilename": ("coalesce(old_path, new_path)", ("file_rename",)),
    "QueryName": ("query_name", ("dns_query",)), "QueryResults": ("answers", ("dns_query",)),
    "SourceIp": ("source_ip", ("network_connection",)), "SourcePort": ("source_port", ("network_connection",)), "DestinationIp": ("destination_ip", ("network_connection",)),
    "DestinationPort": ("destination_port", ("network_connection",)), "Protocol": ("'tcp'", ("network_connection",)),
    "ScriptBlockText": ("script_text", ("ps_script",)), "ScriptBlockId": ("script_block_id", ("ps_script",)), "Path": ("script_path", ("ps_script",)),
}


class Refused(ValueError):
    """The rule uses something that is not supported."""


def view(events: DataFrame) -> DataFrame:
    """id, host, us, pid, category and one column for each SIGMA field (null: absent)."""
    category = reduce(lambda acc, x: F.when(F.col("kind") == x[1], x[0]).otherwise(acc), CATEGORIES.items(), F.lit(None).cast("string"))
    rows = events.withColumn("category", category)
    made = [F.when(F.col("category").isin(*cats), F.expr(sql)).alias(name) for name, (sql, cats) in FIELDS.items()]
    return rows.where("category IS NOT NULL").select("id", "host", "us", "pid", "kind", "category", *made)


def pattern(needle: str, before: bool, after: bool) -> str:
    out = [".*"] if before else []
    i = 0
    while i < len(needle):
        c = needle[i]
        if c == "\\" and i + 1 < len(needle) and needle[i + 1] in "*?\\":
            i += 1
            out.append(re.escape(needle[i]))
        else:
            out.append(".*" if c == "*" else "." if c == "?" else re.escape(c))
        i += 1
    return "".join(out) + (".*" if after else "")


def text_test(value: Column, needle: str, mode: str = "equals", cased: bool = False) -> Column:
    """equals, contains, startswith or endswith; `*` and `?` are wildcards in all of them."""
    value = value.cast("string")
    before, after = mode in ("contains", "endswith"), mode in ("contains", "startswith")
    if re.search(r"[*?]", needle):
        return value.rlike(("(?s)" if cased else "(?is)") + rf"\A{pattern(needle, before, after)}\z")
    a, b = (value, needle) if cased else (F.lower(value), needle.lower())
    return {"equals": a == F.lit(b), "contains": a.contains(b), "startswith": a.startswith(b), "endswith": a.endswith(b)}[mode]


def cidr_test(value: Column, network: str) -> Column:
    try:
        net = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    if net.version == 4:
        return in_range4(ip4(value), str(net.network_address), net.prefixlen)
    digits, whole = net.network_address.exploded.replace(":", ""), net.prefixlen // 4
    parts = F.split(F.lower(value), "::")
    spread = lambda side: F.transform(F.filter(F.split(side, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0"))
    head, tail = F.array_join(spread(F.get(parts, F.lit(0))), ""), F.array_join(spread(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), "")
    full = F.concat(head, F.repeat(F.lit("0"), 32 - F.length(head) - F.length(tail)), tail)
    rest = net.prefixlen % 4
    same = full.startswith(digits[:whole])
    if rest:
        low = int(digits[whole], 16) >> (4 - rest) << (4 - rest)
        same = same & F.substring(full, whole + 1, 1).isin([f"{low + i:x}" for i in range(1 << (4 - rest))])
    return value.contains(":") & (F.length(full) == 32) & same


def field_test(key: str, needles) -> Column:
    name, *modifiers = key.split("|")
    for m in modifiers:
        if m in REFUSED:
            raise Refused(f"modifier {m}")
        if m not in ("contains", "startswith", "endswith", "all", "cased", "cidr", "gt", "gte", "lt", "lte", "fieldref"):
            raise Refused(f"unknown modifier {m}")
    value = F.col(name) if name in FIELDS else F.lit(None).cast("string")
    mode = next((m for m in modifiers if m in ("contains", "startswith", "endswith")), "equals")

    def one(needle) -> Column:
        if needle is None:
            return value.isNull()
        if "fieldref" in modifiers:
            return value.cast("string") == (F.col(needle).cast("string") if needle in FIELDS else F.lit(None))
        if "cidr" in modifiers:
            return cidr_test(value, str(needle))
        for m, compare in (("gte", lambda a, b: a >= b), ("gt", lambda a, b: a > b), ("lte", lambda a, b: a <= b), ("lt", lambda a, b: a < b)):
            if m in modifiers:
                return compare(F.trim(value.cast("string")).try_cast("double"), float(needle))
        text = str(needle).lower() if isinstance(needle, bool) else str(needle)
        return text_test(value, text, mode, "cased" in modifiers)

    tests = [F.coalesce(one(n), F.lit(False)) for n in (needles if isinstance(needles, list) else [needles])]
    return reduce(lambda a, b: a & b if "all" in modifiers else a | b, tests)


def selection_test(body) -> Column:
    """A mapping is an AND of its fields; a list is an OR of mappings (or of plain keywords, refused)."""
    groups = body if isinstance(body, list) else [body]
    if not all(isinstance(g, dict) for g in groups):
        raise Refused("keyword selection")
    return reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [field_test(k, v) for k, v in g.items()]) for g in groups])


def condition_tree(text: str, selections: list[str]) -> tuple:
    """("is", name), ("not", x), ("and", x, y), ("or", x, y) or ("least", n, names).

    not binds before and, and before or; `N of x*`, `all of`, `any of`, parentheses.
    """
    words = re.findall(r"\(|\)|[^\s()]+", text)
    at = 0

    def peek() -> str:
        return words[at].lower() if at < len(words) else ""

    def take() -> str:
        nonlocal at
        if at >= len(words):
            raise Refused("condition ends early")
        at += 1
        return words[at - 1]

    def names(pattern: str) -> list[str]:
        found = selections if pattern == "them" else [n for n in selections if re.fullmatch(re.escape(pattern).replace(r"\*", ".*"), n)]
        if not found:
            raise Refused(f"nothing named {pattern}")
        return list(found)

    def atom() -> tuple:
        word = take()
        if word == "(":
            out = either()
            if take() != ")":
                raise Refused("no closing parenthesis")
            return out
        if word.lower() == "not":
            return "not", atom()
        if peek() == "of":
            take()
            found = names(take())
            least = len(found) if word.lower() == "all" else 1 if word.lower() == "any" else int(word) if word.isdigit() else None
            if least is None or least > len(found):
                raise Refused(f"quantifier {word}")
            return "least", least, found
        if word == "|":
            raise Refused("aggregation")
        if word not in selections:
            raise Refused(f"unknown selection {word}")
        return "is", word

    def chain(word: str, inner) -> tuple:
        out = inner()
        while peek() == word:
            take()
            out = (word, out, inner())
        return out

    def either() -> tuple:
        return chain("or", lambda: chain("and", atom))

    out = either()
    if at < len(words):
        raise Refused("aggregation" if words[at] == "|" else f"unexpected {words[at]}")
    return out


def condition_test(tree: tuple, selections: dict[str, Column]) -> Column:
    match tree:
        case "is", name:
            return selections[name]
        case "not", x:
            return ~condition_test(x, selections)
        case "and", x, y:
            return condition_test(x, selections) & condition_test(y, selections)
        case "or", x, y:
            return condition_test(x, selections) | condition_test(y, selections)
        case _, least, names:
            return reduce(lambda a, b: a + b, [selections[n].cast("int") for n in names]) >= least


def satisfiable(tree: tuple, selections: dict[str, bool]) -> bool:
    """Whether some event can meet the condition, given which selections can be met; a negation counts as met."""
    match tree:
        case "is", name:
            return selections[name]
        case "not", _:
            return True
        case "and", x, y:
            return satisfiable(x, selections) and satisfiable(y, selections)
        case "or", x, y:
            return satisfiable(x, selections) or satisfiable(y, selections)
        case _, least, names:
            return sum(selections[n] for n in names) >= least


def _can_be_met(body, category: str) -> bool:
    """Whether a group of the selection reads only fields that the category fills."""
    filled = lambda name: name in FIELDS and category in FIELDS[name][1]

    def test(key: str, needles) -> bool:
        name, *modifiers = key.split("|")
        needles = needles if isinstance(needles, list) else [needles]
        return None in needles or filled(name) and ("fieldref" not in modifiers or all(filled(str(n)) for n in needles))

    return any(all(test(k, v) for k, v in group.items()) for group in (body if isinstance(body, list) else [body]))


@dataclass
class Compiled:
    rule_id: str
    title: str
    level: str
    technique: str
    category: str
    test: Column
    unmapped: list[str] = field(default_factory=list)
    can_fire: bool = True


def compile_rule(rule: dict) -> Compiled:
    source = rule.get("logsource") or {}
    if source.get("service") or source.get("product", "windows") != "windows":
        raise Refused("log source")
    if source.get("category") not in CATEGORIES:
        raise Refused(f"category {source.get('category')}")
    detection = dict(rule.get("detection") or {})
    condition = detection.pop("condition", None)
    if "timeframe" in detection or not isinstance(condition, str):
        raise Refused("timeframe" if "timeframe" in detection else "condition")
    used = [k.split("|")[0] for body in detection.values() for g in (body if isinstance(body, list) else [body]) if isinstance(g, dict) for k in g]
    tags = [str(t) for t in rule.get("tags") or []]
    technique = next((t[len("attack.") :].upper() for t in tags if re.fullmatch(r"attack\.t\d.*", t, re.I)), "TA0000")
    slug = re.sub(r"[^a-z0-9]+", "_", str(rule.get("title", "")).lower()).strip("_")
    category, tree = source["category"], condition_tree(condition, list(detection))
    test = condition_test(tree, {k: selection_test(v) for k, v in detection.items()})
    unmapped = sorted({k for k in used if k not in FIELDS or category not in FIELDS[k][1]})
    return Compiled(str(rule.get("id") or slug), str(rule.get("title", "")), str(rule.get("level", "informational")).lower(), technique, category, test, unmapped, satisfiable(tree, {k: _can_be_met(v, category) for k, v in detection.items()}))


def load(rules: list[dict]) -> tuple[list[Compiled], list[tuple[str, str]]]:
    """Compiled rules and (name, reason) of those refused."""
    good, bad = [], []
    for rule in rules:
        try:
            good.append(compile_rule(rule))
        except (Refused, KeyError, TypeError, AttributeError, ValueError) as e:
            bad.append((str(rule.get("title") or rule.get("id") if isinstance(rule, dict) else rule), str(e)))
    return good, bad


def load_directory(path: str) -> tuple[list[Compiled], list[tuple[str, str]]]:
    """Every .yml and .yaml file, sorted; a bad file becomes a problem."""
    import yaml

    good, bad = [], []
    for file in sorted(p for p in Path(path).iterdir() if p.suffix in (".yml", ".yaml")):
        try:
            rules = [r for r in yaml.safe_load_all(file.read_text()) if r]
        except yaml.YAMLError as e:
            bad.append((file.name, str(e).splitlines()[0]))
            continue
        a, b = load(rules)
        good, bad = good + a, bad + [(file.name, reason) for _, reason in b]
    return good, bad


def pair(level: str) -> tuple[float, float]:
    return LEVELS.get(level, LEVELS["informational"])


def hits(events: DataFrame, rules: list[Compiled], chunk: int = 100) -> DataFrame:
    """Findings of the rules, one pass for each category and chunk of rules; ``ord`` follows the native rules'."""
    rows, out = view(events), None
    found = lambda i, r: F.when(r.test, F.struct(F.lit(1000 + i).alias("ord"), F.lit(r.rule_id).alias("rule"), F.lit(r.technique).alias("technique"), F.lit(pair(r.level)[0]).alias("hit"), F.lit(pair(r.level)[1]).alias("miss"), F.lit(r.title).alias("detail")))
    for category in sorted({r.category for r in rules}):
        mine = [(i, r) for i, r in enumerate(rules) if r.category == category]
        for at in range(0, len(mine), chunk):
            part = rows.where(F.col("category") == category).select("id", "host", "us", "pid", "kind", F.explode(F.array(*(found(i, r) for i, r in mine[at : at + chunk]))).alias("x"))
            part = part.where("x IS NOT NULL").select("id", "host", "us", "pid", "kind", "x.*")
            out = part if out is None else out.unionByName(part)
    return out


def catalog(spark: SparkSession, good: list[Compiled], bad: list[tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """rules and problems tables."""
    rules = spark.createDataFrame([(r.rule_id, r.title, r.level, r.technique, r.category, r.unmapped, r.can_fire, True) for r in good], "rule string, title string, level string, technique string, category string, unmapped array<string>, can_fire boolean, enabled boolean")
    return rules, spark.createDataFrame(bad, "name string, reason string")
