"""Rules as data against the compiled rules: every kind of test and condition, thousands of rules, a plan of one size."""

import random

from pyspark.sql import functions as F

from telarium.operators import rule_index, sigma
from test_goldens import events

WORDS = ["powershell", "cmd.exe", "certutil", "-enc", "http://", "Temp", "Users", "Hidden", "download", "xyz", "office", "system32", "\\", "ab", "invoke", "Load"]


def some(rng, n):
    out = []
    for i in range(n):
        text = lambda: "\\".join(rng.choices(WORDS, k=rng.randint(1, 4)))
        kind = rng.choice(("process_start", "process_start", "dns_query", "network_connect", "file_create", "registry_set", "process_exit"))
        row = {"kind": kind, "pid": rng.randrange(50)}
        if kind == "process_start":
            row |= {"image": text() if rng.random() < 0.9 else None, "command_line": rng.choice((text(), text().upper(), None)), "parent_pid": rng.randrange(50), "reported_parent": rng.choice((text(), None))}
        elif kind == "dns_query":
            row |= {"query_name": rng.choice(("a.xyz", "B.Office.com", "download.org", "h1.xy"))}
        elif kind == "network_connect":
            row |= {"destination_ip": rng.choice(("10.1.2.3", "8.8.8.8", "2001:db8::5", "fe80::1", "bad", None)), "destination_port": rng.choice((80, 443, 8080, None))}
        elif kind == "registry_set":
            row |= {"key_path": text(), "value_name": rng.choice(("run", None))}
        elif kind == "process_exit":
            row |= {"exit_code": rng.choice((0, -1, 5))}
        else:
            row |= {"path": text()}
        out.append(row)
    return out


def rule(rng, i):
    category = rng.choice(("process_creation", "process_creation", "dns_query", "network_connection", "file_event", "registry_set", "process_termination"))
    fields = {"process_creation": ["Image", "CommandLine", "ParentImage", "ProcessId"], "dns_query": ["QueryName"], "network_connection": ["DestinationIp", "DestinationPort"], "file_event": ["TargetFilename"], "registry_set": ["TargetObject", "Details"], "process_termination": ["ExitCode"]}[category]

    def test():
        name = rng.choice([*fields, *fields, "Nothing"] if rng.random() < 0.1 else fields)
        if name in ("DestinationPort", "ProcessId", "ExitCode"):
            return {f"{name}|{rng.choice(('gt', 'gte', 'lt', 'lte'))}": rng.choice((5, 80, 443, 4000))} if rng.random() < 0.8 else {name: rng.choice((80, "443", 0))}
        if name == "DestinationIp":
            return {f"{name}|cidr": rng.choice(("10.0.0.0/8", "2001:db8::/33", ["8.8.8.0/24", "fe80::/10"], "bad/99"))}
        kind = rng.random()
        if kind < 0.08:
            return {name: None}
        if kind < 0.12:
            return {f"{name}|fieldref": rng.choice(fields)}
        needles = rng.choices([*WORDS, "*.xyz", "p?wer*", "a.xyz", "te", "INVOKE", "b.office.com", r"\*x"], k=rng.randint(1, 3))
        mode = rng.choice(("", "|contains", "|startswith", "|endswith"))
        return {name + mode + rng.choice(("", "", "|all")) + rng.choice(("", "", "|cased")): needles if len(needles) > 1 or rng.random() < 0.5 else needles[0]}

    def selection():
        group = lambda: {k: v for _ in range(rng.randint(1, 2)) for k, v in test().items()}
        return [group() for _ in range(rng.randint(1, 3))] if rng.random() < 0.4 else group()

    names = ["a1", "a2", "b"]
    condition = rng.choice(("a1", "a1 and b", "a1 or a2", "not b", "a1 and not b", "1 of a*", "2 of them", "all of a* or b", "any of them", "(a1 or a2) and not (b and a1)", "not 1 of a*"))
    return {"title": f"rule {i}", "id": f"r{i}", "level": rng.choice(("low", "high", "odd")), "tags": ["attack.t1059"], "logsource": {"category": category}, "detection": {n: selection() for n in names} | {"condition": condition}}


def test_equal_to_compiled_rules(spark):
    rng = random.Random(9)
    table = events(spark, *some(rng, 300)).cache()
    rules = [rule(rng, i) for i in range(160)] + [{"title": "refused", "logsource": {"category": "process_creation"}, "detection": {"a": {"Image|re": "x"}, "condition": "a"}}]
    good, bad = sigma.load(rules)
    rows, refused = rule_index.load(spark, rules)
    assert refused == bad and rows.count() == len(good) == 160
    want = {tuple(r) for r in sigma.hits(table, good, chunk=40).collect()}
    for counted in (False, True):
        got = rule_index.hits(table, rows, counted)
        assert got.columns == sigma.hits(table, good[:1]).columns
        found = [tuple(r) for r in got.collect()]
        assert set(found) == want and len(found) == len(want)
    assert len(want) > 500 and len({r[6] for r in want}) > 80
    # the index is of use: candidates are fewer than all pairs of rules with keys
    keyed = rows.where("keys IS NOT NULL")
    tried = rule_index.candidates(rule_index.values_of(table), keyed).count()
    pairs = rule_index.values_of(table).join(keyed.select("category"), "category").count()
    assert keyed.count() > 50 and tried < 0.7 * pairs


def test_thousands_of_rules(spark):
    rng = random.Random(4)
    image = lambda n: f"C:\\tools\\{n:05d}\\run.exe"
    table = events(spark, *({"kind": "process_start", "image": image(rng.randrange(4000)), "command_line": None} for _ in range(3000)))
    rules = [{"title": f"tool {n}", "id": f"t{n}", "level": "low", "logsource": {"category": "process_creation"}, "detection": {"a": {"Image|contains": f"\\{n:05d}\\"}, "b": {"CommandLine|contains": "quiet"}, "condition": "a and not b"}} for n in range(2000)]
    rows, bad = rule_index.load(spark, rules)
    assert not bad
    got = rule_index.hits(table, rows, counted=True)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    few = rule_index.hits(table, rule_index.load(spark, rules[:3])[0], counted=True)
    assert abs(size(got) - size(few)) < 0.02 * size(few)
    want = sorted((r.id, f"t{int(r.image.split(chr(92))[2])}") for r in table.collect() if int(r.image.split("\\")[2]) < 2000)
    assert sorted((r.id, r.rule) for r in got.collect()) == want and len(want) > 1000


def test_no_rules_and_no_events(spark):
    table = events(spark, *some(random.Random(1), 20))
    none = rule_index.load(spark, [])[0]
    assert rule_index.hits(table, none).count() == 0
    rows = rule_index.load(spark, [rule(random.Random(2), i) for i in range(5)])[0]
    assert rule_index.hits(table.where("false"), rows).count() == 0


def test_what_is_necessary():
    keys = {"a": [(1, False, "long literal")], "b": [(2, False, "xyz"), (2, False, "uvw")], "c": None}
    tree = lambda text: sigma.condition_tree(text, list(keys))
    assert rule_index.necessary(tree("a and b"), keys) == keys["a"]
    assert set(rule_index.necessary(tree("a or b"), keys)) == {*keys["a"], *keys["b"]}
    assert rule_index.necessary(tree("a or c"), keys) is None and rule_index.necessary(tree("not a"), keys) is None
    assert rule_index.necessary(tree("c and b"), keys) == keys["b"]
    assert set(rule_index.necessary(tree("2 of them"), keys)) == {*keys["a"], *keys["b"]}  # c and one of these at least
    assert rule_index.necessary(tree("1 of them"), keys) is None and rule_index.necessary(tree("all of them"), keys) == keys["a"]


def test_events_are_not_joined_back(spark, monkeypatch):
    """An event that has several keys of a rule is found once, and none is shuffled before it is evaluated."""
    table = events(spark, *some(random.Random(5), 60)).unionAll(events(spark, *some(random.Random(5), 3)))
    rules = [{"title": "two", "id": "two", "level": "low", "logsource": {"category": "process_creation"}, "detection": {"a": {"Image|contains": ["users", "temp", "cmd.exe"]}, "condition": "a"}}]
    rows, _ = rule_index.load(spark, rules)
    want = sorted(map(tuple, sigma.hits(table, sigma.load(rules)[0]).collect()))
    got = rule_index.hits(table, rows)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 10
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == plan.count("rightHint=(strategy=broadcast)") > 0
    monkeypatch.setattr(rule_index, "ONE_BY_ONE", 1)  # by all runs
    assert sorted(map(tuple, rule_index.hits(table, rows).collect())) == want
