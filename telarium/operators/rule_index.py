"""SIGMA rules as data: an index finds the rules that an event can meet, and one expression evaluates them.

``sigma.hits`` makes each rule a column of the plan, which is fine for some
hundred rules. Here a rule is a row: its tests as nested arrays, its condition
as a program for a stack. The plan is the same for one rule and for thousands.

Index: a rule that can only be true where some text of its occurs has *keys*.
From its condition, a set of literals is taken of which at least one must occur
in its field; of each literal the key is its rarest run of three characters (in
lower case), or the whole value where the test is for equality. An event's keys
are the runs and values of its fields; they are joined to the rules' keys.
Rules without such a literal (numeric, negated, address ranges only) are
candidates for every event of their category. Every candidate is then
evaluated in full, so the index never decides anything.

Defined cases are those of ``sigma``: a positive test of an absent field is
false. An empty set of rules gives no findings. Rules are broadcast while their
text takes at most ``RULES_SENT`` bytes, else joined by a shuffle.
"""

from __future__ import annotations

import ipaddress
import re
from collections import Counter
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telarium.checkpoint import cut
from telarium.functions.scalars import ip4
from telarium.operators import sigma
from telarium.operators.prefixes import digits6

GRAM = 3
RULES_SENT = 64 << 20
#: Keys of a field up to which each is looked for in its text; of more, all runs of the text are.
ONE_BY_ONE = 64
#: Fields that may hold text, in the order of an event's values.
NAMES = tuple(sigma.FIELDS)
_AT = {name: i for i, name in enumerate(NAMES)}
#: Kinds of tests.
NULL, EQUALS, CONTAINS, STARTS, ENDS, PATTERN, GREATER, AT_LEAST, LESS, AT_MOST, RANGE4, RANGE6, SAME, NEVER = range(14)
#: What events and the index are joined by.
_KEY = ["category", "field", "whole", "text"]
#: Kinds of steps of a condition.
PUSH, NOT, AND, OR, LEAST = range(5)

_NEEDLE = "struct<kind:int,text:string,cased:boolean,number:double,low:string,high:string,other:int>"
_TEST = f"struct<field:int,every:boolean,needles:array<{_NEEDLE}>>"
RULE = f"ord int, rule string, title string, technique string, category string, hit double, miss double, selections array<array<array<{_TEST}>>>, program array<struct<op:int,a:int,b:int>>, keys array<struct<field:int,whole:boolean,text:string>>"

#: (field, whole value, text in lower case)
Key = tuple[int, bool, str]


def _needle(kind: int, text: str | None = None, cased: bool = False, number: float | None = None, low: str | None = None, high: str | None = None, other: int | None = None) -> tuple:
    return kind, text, cased, number, low, high, other


def _needle_of(modifiers: list[str], needle) -> tuple:
    if needle is None:
        return _needle(NULL)
    if "fieldref" in modifiers:
        return _needle(SAME, other=_AT[needle]) if needle in _AT else _needle(NEVER)
    if "cidr" in modifiers:
        try:
            net = ipaddress.ip_network(str(needle), strict=False)
        except ValueError:
            return _needle(NEVER)
        width = 10 if net.version == 4 else 32
        said = (lambda a: f"{int(a):010d}") if net.version == 4 else (lambda a: f"{int(a):032x}")
        assert len(said(net.network_address)) == width
        return _needle(RANGE4 if net.version == 4 else RANGE6, low=said(net.network_address), high=said(net.broadcast_address))
    for name, kind in (("gte", AT_LEAST), ("gt", GREATER), ("lte", AT_MOST), ("lt", LESS)):
        if name in modifiers:
            return _needle(kind, number=float(needle))
    text, cased = str(needle).lower() if isinstance(needle, bool) else str(needle), "cased" in modifiers
    mode = next((m for m in modifiers if m in ("contains", "startswith", "endswith")), "equals")
    if re.search(r"[*?]", text):
        before, after = mode in ("contains", "endswith"), mode in ("contains", "startswith")
        return _needle(PATTERN, ("(?s)" if cased else "(?is)") + rf"\A{sigma.pattern(text, before, after)}\z")
    return _needle({"equals": EQUALS, "contains": CONTAINS, "startswith": STARTS, "endswith": ENDS}[mode], text if cased else text.lower(), cased)


def _literal(modifiers: list[str], needle) -> tuple[bool, str] | None:
    """(whole value, text) that must occur for the test to be true; None if there is none of use."""
    if needle is None or any(m in modifiers for m in ("fieldref", "cidr", "gte", "gt", "lte", "lt")):
        return None
    text = str(needle).lower()
    if re.search(r"[*?]", text):
        # the longest piece between wildcards; an escape ends a piece
        text = max(re.split(r"[*?\\]", text), key=len)
    elif not any(m in modifiers for m in ("contains", "startswith", "endswith")):
        return True, text
    return (False, text) if len(text) >= GRAM else None


def _test_keys(key: str, needles) -> list[Key] | None:
    name, *modifiers = key.split("|")
    if name not in _AT:
        return None
    found = [_literal(modifiers, n) for n in (needles if isinstance(needles, list) else [needles])]
    if "all" in modifiers:
        some = [f for f in found if f is not None]
        return [(_AT[name], *max(some, key=lambda f: len(f[1])))] if some else None
    return [(_AT[name], *f) for f in found] if found and None not in found else None


def _better(choices: list[list[Key] | None]) -> list[Key] | None:
    """The set of keys that promises the fewest candidates: long literals, few of them."""
    some = [c for c in choices if c]
    return min(some, key=lambda c: (-min(len(t) + GRAM * whole for _, whole, t in c), len(c))) if some else None


def _selection_keys(body) -> list[Key] | None:
    groups = [_better([_test_keys(k, v) for k, v in g.items()]) for g in (body if isinstance(body, list) else [body])]
    return list(dict.fromkeys(chain.from_iterable(groups))) if groups and None not in groups else None


def necessary(tree: tuple, selections: dict[str, list[Key] | None]) -> list[Key] | None:
    """Keys of which an event that meets the condition has at least one; None if there is no such set."""
    union = lambda sets: None if None in sets else list(dict.fromkeys(chain.from_iterable(sets)))
    match tree:
        case "is", name:
            return selections[name]
        case "not", _:
            return None
        case "and", x, y:
            return _better([necessary(x, selections), necessary(y, selections)])
        case "or", x, y:
            return union([necessary(x, selections), necessary(y, selections)])
        case _, least, names:
            if least <= 0:
                return None
            # of any so many, one is met
            sets = sorted((selections[n] for n in names), key=lambda k: (k is None, len(k or ())))
            return union(sets[: len(names) - least + 1])


def program(tree: tuple, names: list[str]) -> list[tuple[int, int, int]]:
    """The condition in postfix order."""
    match tree:
        case "is", name:
            return [(PUSH, names.index(name), 0)]
        case "not", x:
            return [*program(x, names), (NOT, 0, 0)]
        case ("and" | "or") as word, x, y:
            return [*program(x, names), *program(y, names), (AND if word == "and" else OR, 0, 0)]
        case _, least, some:
            return [*((PUSH, names.index(n), 0) for n in some), (LEAST, least, len(some))]


def _row(order: int, rule: dict) -> tuple:
    made = sigma.compile_rule(rule)
    detection = dict(rule["detection"])
    tree = sigma.condition_tree(detection.pop("condition"), list(detection))
    selections = []
    for body in detection.values():
        groups = []
        for g in body if isinstance(body, list) else [body]:
            tests = []
            for key, needles in g.items():
                name, *modifiers = key.split("|")
                tests.append((_AT.get(name, -1), "all" in modifiers, [_needle_of(modifiers, n) for n in (needles if isinstance(needles, list) else [needles])]))
            groups.append(tests)
        selections.append(groups)
    keys = necessary(tree, {name: _selection_keys(body) for name, body in detection.items()})
    hit, miss = sigma.pair(made.level)
    return 1000 + order, made.rule_id, made.title, made.technique, made.category, hit, miss, selections, program(tree, list(detection)), keys


def load(spark: SparkSession, rules: list[dict]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Rules as rows (schema ``RULE``), and (name, reason) of those refused."""
    good, bad = [], []
    for rule in rules:
        try:
            good.append(_row(len(good), rule))
        except (sigma.Refused, KeyError, TypeError, AttributeError, ValueError) as e:
            bad.append((str(rule.get("title") or rule.get("id") if isinstance(rule, dict) else rule), str(e)))
    return spark.createDataFrame(good, RULE), bad


# events ---------------------------------------------------------------------


def values_of(events: DataFrame) -> DataFrame:
    """id, host, us, pid, kind, category and ``v``, the event's fields as text in the order of ``NAMES``."""
    rows = sigma.view(events)
    return rows.select("id", "host", "us", "pid", "kind", "category", F.array(*(F.col(n).cast("string") for n in NAMES)).alias("v"))


def _grams(text: Column) -> Column:
    """Distinct runs of three characters."""
    n = F.length(text)
    return F.array_distinct(F.when(n >= GRAM, F.transform(F.sequence(F.lit(1), n - (GRAM - 1)), lambda i: F.substring(text, i, GRAM))).otherwise(F.array().cast("array<string>")))


def key_fields(keys: DataFrame) -> DataFrame:
    """(category, field, whole, wanted) of keys (category, field, whole, text): a handful of rows each category.

    ``wanted``: the keys, where they are few.
    """
    return keys.groupBy("category", "field", "whole").agg(F.collect_set("text").alias("wanted")).withColumn("wanted", F.when(F.size("wanted") <= ONE_BY_ONE, F.col("wanted")))


def event_keys(rows: DataFrame, fields: DataFrame, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """(``keep``, category, field, whole, text) of the events: each field's value, and its runs or those of them that rules have.

    ``fields``: as ``key_fields`` gives them.
    """
    each = rows.select(*keep, "category", F.posexplode("v").alias("field", "value")).where("value IS NOT NULL")
    each = each.join(F.broadcast(fields), ["category", "field"])
    text = F.lower("value")
    keys = F.when(F.col("whole"), F.array(text)).when(F.col("wanted").isNotNull(), F.filter("wanted", lambda w: text.contains(w))).otherwise(_grams(text))
    return each.select(*keep, "category", "field", "whole", F.explode(keys).alias("text"))


def index(rules: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """(category, field, whole, text, ord): the rules behind each key.

    ``seen``: (category, field, text, n), how often runs occur in events; the
    rarest of a literal's runs is taken, or its last one where nothing is known.
    """
    literals = rules.select("category", "ord", F.explode("keys").alias("k")).select("category", "ord", "k.*")
    whole = literals.where("whole").select("category", "field", "whole", "text", "ord")
    runs = literals.where("NOT whole").select("category", "field", "ord", F.col("text").alias("literal"), F.posexplode(_grams(F.col("text"))).alias("place", "text"))
    n = F.lit(0)
    if seen is not None:
        runs, n = runs.join(seen, ["category", "field", "text"], "left"), F.coalesce("n", F.lit(0))
    best = runs.groupBy("category", "field", "ord", "literal").agg(F.min_by("text", F.struct(n, -F.col("place"))).alias("text"))
    return whole.unionByName(best.select("category", "field", F.lit(False).alias("whole"), "text", "ord")).distinct()


def run_counts(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(category, field, text, n): in how many events each run of the rules' literals occurs."""
    wanted = rules.select("category", F.explode("keys").alias("k")).where("NOT k.whole").select("category", "k.field", F.explode(_grams(F.col("k.text"))).alias("text")).distinct()
    return event_keys(rows, key_fields(wanted.withColumn("whole", F.lit(False)))).join(F.broadcast(wanted), ["category", "field", "text"]).groupBy("category", "field", "text").agg(F.count("*").alias("n"))


# evaluation -------------------------------------------------------------------


def _met(n: Column, value: Column, values: Column) -> Column:
    kind, text = n["kind"], F.when(n["cased"], value).otherwise(F.lower(value))
    number = F.trim(value).try_cast("double")
    four = F.lpad(ip4(value).cast("string"), 10, "0")
    six = digits6(value)
    test = (
        F.when(kind == NULL, value.isNull())
        .when(kind == EQUALS, text == n["text"])
        .when(kind == CONTAINS, text.contains(n["text"]))
        .when(kind == STARTS, text.startswith(n["text"]))
        .when(kind == ENDS, text.endswith(n["text"]))
        .when(kind == PATTERN, F.regexp_like(value, n["text"]))
        .when(kind == GREATER, number > n["number"])
        .when(kind == AT_LEAST, number >= n["number"])
        .when(kind == LESS, number < n["number"])
        .when(kind == AT_MOST, number <= n["number"])
        .when(kind == RANGE4, (four >= n["low"]) & (four <= n["high"]))
        .when(kind == RANGE6, (six >= n["low"]) & (six <= n["high"]))
        .when(kind == SAME, value == F.get(values, n["other"]))
        .otherwise(False)
    )
    return F.coalesce(test, F.lit(False))


def meets(values: Column, selections: Column, steps: Column) -> Column:
    """Whether an event's values meet a rule, both columns."""

    def tested(t: Column) -> Column:
        value = F.get(values, t["field"])
        return F.when(t["every"], F.forall(t["needles"], lambda n: _met(n, value, values))).otherwise(F.exists(t["needles"], lambda n: _met(n, value, values)))

    chosen = F.transform(selections, lambda s: F.exists(s, lambda g: F.forall(g, tested)))

    def step(stack: Column, x: Column) -> Column:
        top, below = F.get(stack, F.lit(0)), F.get(stack, F.lit(1))
        enough = F.size(F.filter(F.slice(stack, F.lit(1), F.greatest(x["b"], F.lit(1))), lambda v: v)) >= x["a"]
        put = lambda value, taken: F.concat(F.array(value), F.slice(stack, taken + 1, F.greatest(F.size(stack), F.lit(1))))
        return (
            F.when(x["op"] == PUSH, put(F.get(chosen_, x["a"]), F.lit(0)))
            .when(x["op"] == NOT, put(~top, F.lit(1)))
            .when(x["op"] == AND, put(top & below, F.lit(2)))
            .when(x["op"] == OR, put(top | below, F.lit(2)))
            .otherwise(put(enough, x["b"]))
        )

    chosen_ = F.col("chosen")
    return chosen, F.aggregate(steps, F.array().cast("array<boolean>"), step, lambda stack: F.get(stack, F.lit(0)))


def _index(rows: DataFrame, keyed: DataFrame, counted: bool) -> DataFrame:
    return cut(index(keyed, cut(run_counts(rows, keyed)) if counted else None))


def candidates(rows: DataFrame, rules: DataFrame, counted: bool = False, table: DataFrame | None = None) -> DataFrame:
    """Distinct (id, ord) of events and the rules that they may meet. ``table``: the index, if it was made."""
    keyed = rules.where("keys IS NOT NULL")
    table = _index(rows, keyed, counted) if table is None else table
    by_key = event_keys(rows, key_fields(table)).join(F.broadcast(table) if _small(table) else table, _KEY).select("id", "ord")
    others = rules.where("keys IS NULL").select("category", "ord")
    return by_key.distinct().unionAll(rows.select("id", "category").join(F.broadcast(others), "category").select("id", "ord"))


def _carried(events: DataFrame, rules: DataFrame, table: DataFrame) -> DataFrame:
    """``candidates`` with the events' values, which stay where they are: an event comes once for each of its keys of a rule."""
    keep = ("row__", "id", "host", "us", "pid", "kind", "v")

    def rows(some: DataFrame) -> DataFrame:
        kinds = {sigma.CATEGORIES[r.category] for r in some.select("category").distinct().collect()}
        return values_of(events.where(F.col("kind").isin(*sorted(kinds)))).withColumn("row__", F.monotonically_increasing_id())

    keyed, others = rules.where("keys IS NOT NULL"), rules.where("keys IS NULL").select("category", "ord")
    by_key = event_keys(rows(keyed), key_fields(table), keep).join(F.broadcast(table), _KEY).select(*keep, "ord")
    return by_key.unionAll(rows(others).join(F.broadcast(others), "category").select(*keep, "ord"))


def _small(df: DataFrame) -> bool:
    """Whether a table of texts is within what is broadcast."""
    return (df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= RULES_SENT


def hits(events: DataFrame, rules: DataFrame, counted: bool = False) -> DataFrame:
    """Findings as ``sigma.hits`` gives them. ``counted``: take the rarest runs of the literals, for one more pass over the events.

    Where the index is broadcast, an event is evaluated where it was read, and only findings are shuffled.
    """
    rows, rules = values_of(events), cut(rules)
    table = _index(rows, rules.where("keys IS NOT NULL"), counted)
    told = rules.select("ord", "rule", "title", "technique", "hit", "miss", "selections", "program")
    told = F.broadcast(told) if _small(told) else told
    sent = _small(table)
    if sent:
        tried = _carried(events, rules, table)
    else:
        tried = rows.drop("category").join(candidates(rows, rules, table=table), "id").withColumn("row__", F.lit(0))
    chosen, met = meets(F.col("v"), F.col("selections"), F.col("program"))
    found = tried.join(told, "ord").withColumn("chosen", chosen).where(met)
    found = found.select("row__", "id", "host", "us", "pid", "kind", "ord", "rule", "technique", "hit", "miss", F.col("title").alias("detail"))
    return (found.distinct() if sent else found).drop("row__")
