"""Conversion: written-out rules with the lines they must give, and what must hold for any rules."""

import random

import pytest
from pyspark.sql import functions as F

from wallflow.functions import fields as fl
from wallflow.operators import dependencies, hosts, joins
from wallflow.plans import conversion

INSERT = "CONFIG FILTER RULE INSERT index=9 type=filter position="
NAT = "CONFIG FILTER RULE INSERT index=9 type=nat action=nat position="
OBJECTS, INTERFACES = {"web", "db", "tcp"}, {"eth0"}


def frame(spark, rows, columns=None):
    columns = columns or list(dict.fromkeys(c for r in rows for c in r))
    data = [(i, *[r.get(c) for c in columns]) for i, r in enumerate(rows, 1)]
    return spark.createDataFrame(data, "_row long, " + ", ".join(f"`{c}` string" for c in columns)).repartition(3)


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


def known(spark):
    return dependencies.known_names(names(spark, OBJECTS), names(spark, INTERFACES))


def converted(spark, rows, columns=None, **options):
    got = conversion.convert_rules(frame(spark, rows, columns), known(spark), **options)
    return {r["_row"]: r for r in got.collect()}


# A rule, its command from position 1 on (None: it cannot be built), and what it lacks.
WRITTEN_OUT = [
    ({"action": "pass", "from_src": "web", "to_dest": "db"}, f"{INSERT}1 rulename=FilterRule-0001 action=pass srctarget=web dsttarget=db", []),
    ({"action": "Allow", "source": "any", "destination": "10.0.0.1", "rule_name": "r 2"}, f'{INSERT}2 rulename="r 2" action=pass srctarget=any dsttarget=10.0.0.1', []),
    ({"action": "deny", "comment": "café crème"}, f'{INSERT}3 rulename="cafe creme" action=drop', []),
    ({"action": "it's"}, None, []),
    ({"action": "LOG", "rule_name": "web", "comment": 'say "hi"'}, f'{INSERT}4 rulename=web comment="say \\"hi\\"" action=log', []),
    ({"action": "pass", "from_src": "web, ghost", "from_if": "eth0,eth9"}, f'{INSERT}5 rulename=FilterRule-0005 action=pass srcif="eth0,eth9" srctarget="web, ghost"', ["INTERFACE:eth9", "OBJECT:ghost"]),
    ({"action": "pass", "from_src": "db,10.0.0.1"}, f'{INSERT}5 rulename=FilterRule-0005 action=pass srctarget="db,10.0.0.1"', ["OBJECT:10.0.0.1"]),
    ({"separator_color": "red", "comment": "a line between rules"}, "skipped", []),
    ({"action": "nat", "from_src": "10.0.0.0/8", "service": "gone"}, f"{NAT}5 rulename=NatRule-0005 srctarget=10.0.0.0/8", ["OBJECT:gone"]),
    ({"type_slot": "local_nat_slot_09", "comment": "x\ny", "nat_to_target": "web"}, f'{NAT}5 rulename="x y" natdsttarget=web', []),
    ({"action": "pass", "ip_proto": "tcp,udp", "policy": "5"}, f"{INSERT}6 rulename=FilterRule-0006 action=pass ipproto=tcp proto=\"tcp,udp\"".replace("index=9", "index=5"), []),
    ({"action": "pass", "policy": "x"}, None, []),
    ({"action": "pass", "rule_name": "n" * 65}, f"{INSERT}7 rulename={'n' * 61}... action=pass", []),
    ({"action": "pass", "from_src": "eth0", "to_if": "web"}, f"{INSERT}8 rulename=FilterRule-0008 action=pass dstif=web srctarget=eth0", ["INTERFACE:web"]),
]


def words(command):
    """A command without the order of its fields."""
    return None if command is None else sorted(command.split(" "))


def test_written_out_rules(spark):
    rules = [r for r, _, _ in WRITTEN_OUT]
    got = converted(spark, rules)
    for i, (rule, command, lacks) in enumerate(WRITTEN_OUT, 1):
        if command == "skipped":
            assert i not in got
            continue
        r = got[i]
        assert words(r["command"]) == words(command), rule
        assert [f"{m['kind']}:{m['name']}" for m in r["missing"]] == lacks, rule
        assert r["status"] == ("SAFE" if command and not lacks else "PENDING"), rule
        assert (r["error"] is None) == (command is not None) == (r["original"] is None)


CELLS = {
    "action": ["pass", "Allow", "bogus", "", "nat"],
    "separator_color": ["", "", "", "", "red"],
    "policy": ["", "", "5", "x"],
    "comment": ["", "café crème", "a\nb", "x" * 70, "y" * 980],
    "rule_name": ["", "", "web", "n" * 65],
    "from_if": ["", "eth0", "eth9", "any"],
}
TARGETS = ["", "any", "web", "web, db", "10.0.0.1", "10.0.0.2", "10.0.0.0/8", "H_10_0_0_1", " , ", "ghost"]


def random_rules(seed, n, columns):
    rng = random.Random(seed)
    return [{c: rng.choice(CELLS.get(c, TARGETS)) for c in columns} for _ in range(n)]


def check_properties(rows, got, start):
    """What must hold whatever the rules are."""
    separators = {i for i, r in enumerate(rows, 1) if (r.get("separator_color") or "").strip()}
    assert set(got) == set(range(1, len(rows) + 1)) - separators
    at = start
    for i in sorted(got):
        r = got[i]
        # A pending rule shows the position that the next safe one takes.
        assert r["position"] == at
        assert (r["command"] is None) != (r["error"] is None)
        assert (r["status"] == "SAFE") == (r["command"] is not None and not r["missing"])
        if r["command"] is not None:
            assert len(r["command"]) <= 1024
            assert f" position={at} " in r["command"]
            assert f" type={r['kind'].lower()} " in r["command"]
        assert [(m["kind"], m["name"]) for m in r["missing"]] == sorted({(m["kind"], m["name"]) for m in r["missing"]})
        for m in r["missing"]:
            cells = {p.strip() for v in rows[i - 1].values() for p in (v or "").split(",")}
            assert m["name"] in cells
            assert m["name"] not in (INTERFACES if m["kind"] == "INTERFACE" else OBJECTS | INTERFACES)
        at += r["status"] == "SAFE"
    assert {r["status"] for r in got.values()} == {"SAFE", "PENDING"}


@pytest.mark.parametrize("create_hosts", [False, True])
def test_any_rules(spark, create_hosts):
    columns = ["from_src", "to_dest", "action", "comment", "separator_color", "from_if", "source_ip", "source", "rule_name", "policy"]
    rows = random_rules(2, 250, columns)
    got = converted(spark, rows, columns, create_hosts=create_hosts, start=95, prefix="P-")
    check_properties(rows, got, 95)
    shown = " ".join(r["command"] or "" for r in got.values())
    assert ("srctarget=H_10_0_0_2" in shown) == create_hosts == ("srctarget=10.0.0.2" not in shown)


def test_every_field_has_its_token(spark):
    rows = [{f: "web"} for f in fl.FIELD_TOKENS if f not in ("rule_name", "comment", "action", *fl.NAT_ONLY_FIELDS)]
    got = converted(spark, [{"action": "pass", **r} for r in rows])
    for i, r in enumerate(rows, 1):
        (field,) = r
        assert f" {fl.FIELD_TOKENS[field]}=web" in got[i]["command"]


def same_result(spark, monkeypatch, rows, columns, change, **options):
    """A setting of the engine changes no row."""
    before = converted(spark, rows, columns, **options)
    change(monkeypatch)
    assert converted(spark, rows, columns, **options) == before
    check_properties(rows, before, options.get("start", 1))


def test_blocks_smaller_than_the_set(spark, monkeypatch):
    def change(patch):
        patch.setattr(conversion.ordering, "block_of", lambda c, bits=3: F.shiftright(c.cast("long"), 3))

    same_result(spark, monkeypatch, random_rules(3, 200, ["from_src", "action"]), ["from_src", "action"], change, start=7)


def test_large_universe_is_not_broadcast(spark, monkeypatch):
    def change(patch):
        for module in (joins, conversion):
            patch.setattr(module, "fits_broadcast", lambda df, **_: False)

    columns = ["from_src", "to_dest", "action", "source"]
    same_result(spark, monkeypatch, random_rules(4, 60, columns), columns, change, create_hosts=True)


@pytest.mark.parametrize("start", [1, 8, 97])
def test_length_that_depends_on_the_position(spark, start):
    rng = random.Random(start)
    fixed = len(f"{INSERT}1 rulename=FilterRule-0001 state=")
    sizes = [1024 - fixed + rng.choice([-3, -2, -1, 0, 1, -400]) for _ in range(60)]
    rows = [{"state": "s" * n} for n in sizes]
    got = converted(spark, rows, start=start)
    at = start
    for i, n in enumerate(sizes, 1):
        line = f"{INSERT}{at} rulename=FilterRule-{at:04d} state={'s' * n}"
        assert got[i]["command"] == (line if len(line) <= 1024 else None)
        at += len(line) <= 1024
    assert {r["status"] for r in got.values()} == {"SAFE", "PENDING"}


def test_golden_pending_rules(spark):
    columns = ["source", "destination", "service", "action", "comment"]
    rows = [dict(zip(columns, r)) for r in [
        ("workstation1", "server1", "https", "pass", "Allow web access"),
        ("workstation2", "web-server", "http", "block", "Block web access"),
        ("workstation1", "ssh-server", "ssh", "pass", "Allow SSH access"),
        ("workstation1", "server1", "https", "pass", "Duplicate Rule for testing"),
    ]]
    rules = frame(spark, rows, columns)
    nothing = dependencies.known_names(names(spark, []), None)
    got = conversion.convert_rules(rules, nothing)
    assert [tuple(r) for r in conversion.conversion_counts(rules, got).collect()] == [(4, 0, 4, 8)]
    lacks = dependencies.missing_names(rules, nothing).orderBy("kind", "name")
    assert [r["name"] for r in lacks.collect()] == [
        "http", "https", "server1", "ssh", "ssh-server", "web-server", "workstation1", "workstation2"]


def test_host_objects(spark):
    columns = ["from_src", "source_ip", "to_dest", "to", "separator_color"]
    rows = [{"from_src": "", "source_ip": "10.0.0.9", "to_dest": "any", "to": "10.0.0.10"},
            {"from_src": "10.0.0.9", "source_ip": "1.1.1.1", "separator_color": "red"}]
    got = hosts.host_objects(frame(spark, rows, columns)).orderBy("rank").collect()
    assert [r["command"] for r in got] == [
        'CONFIG OBJECT HOST NEW name=H_10_0_0_10 ip=10.0.0.10 comment=""',
        'CONFIG OBJECT HOST NEW name=H_10_0_0_9 ip=10.0.0.9 comment=""',
    ]


def test_plan_moves_the_rules_once(spark, tmp_path):
    columns = ["from_src", "to_dest", "action", "comment"]
    path = str(tmp_path / "rules")
    frame(spark, random_rules(5, 50, columns), columns).write.parquet(path)
    plan = conversion.checked_rules(spark.read.parquet(path), known(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1 and "BroadcastHashJoin" in text
    assert sum("hashpartitioning(_block" in line for line in text.splitlines()) == 1
    assert not any("cmd_rest" in line for line in text.splitlines() if "SinglePartition" in line)


def test_numbering_moves_no_rule_again(spark):
    columns = ["from_src", "to_dest", "action", "comment"]
    got = conversion.convert_rules(frame(spark, random_rules(5, 50, columns), columns), known(spark))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_block" not in plan and "SinglePartition" not in plan.split("BroadcastExchange")[0]


def test_a_large_universe_is_asked_for_names_alone(spark, tmp_path, monkeypatch):
    columns = ["from_src", "to_dest", "action", "comment"]
    path = str(tmp_path / "rules")
    rows = random_rules(6, 80, columns)
    frame(spark, [*rows, *rows[:5]], columns).write.parquet(path)
    rules = spark.read.parquet(path)
    # Rules that share a number count as one rule, by either way.
    rules = rules.union(rules.filter("_row < 9"))
    want = sorted(map(str, conversion.convert_rules(rules, known(spark)).collect()))
    asked, lookup = [], conversion.lookup_join
    monkeypatch.setattr(conversion, "lookup_join", lambda left, *rest: asked.append(left.columns) or lookup(left, *rest))
    for module in (joins, conversion):
        monkeypatch.setattr(module, "fits_broadcast", lambda df, **_: False)
    plan = conversion.checked_rules(rules, known(spark))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert asked == [["_block", "_row", "need_kind", "need_name"]]
    assert sum("hashpartitioning(_block" in line for line in text.splitlines()) == 2
    assert sorted(map(str, conversion.convert_rules(rules, known(spark)).collect())) == want
