"""Comparison, duplicates and suggestions: written-out cases, and what must hold for any rules."""

import random
from collections import defaultdict

import pytest

from tests.test_conversion import frame, known, names
from wallflow.operators import dependencies, flows, joins
from wallflow.plans import comparison, duplicates, suggestions

IDENTITY = ["from_src", "to_dest", "service", "action"]


def test_written_out_comparison(spark):
    columns = [*IDENTITY, "rule_name", "source", "type_slot", "note"]
    row = lambda **cells: cells
    source = [
        row(from_src="a", to_dest="x", service="http", action="pass", rule_name="r1", note="n1"),
        row(from_src="a", to_dest="x", service="http", action="pass", rule_name="again"),
        row(from_src="b", action="pass", note="in the final set"),
        row(source="c", action="Allow", note="by another header"),
        row(from_src="c", action="pass", note="the action differs in spelling"),
        row(from_src="d", action="nonsense"),
        row(action="nat", type_slot="local_nat_slot_09", to_dest="y"),
    ]
    final = [row(from_src="b", action="pass"), row(from_src="z", action="pass")]
    got = comparison.missing_rule_commands(frame(spark, source, columns), frame(spark, final, columns), slot=4, start=5)
    begin = "CONFIG FILTER RULE INSERT index=4 type=filter position="
    want = [
        (1, 5, "FILTER", "a", "x", "http", "pass", begin + "5 rulename=MissingRule-r1 action=pass service=http srctarget=a dsttarget=x"),
        (4, 6, "FILTER", "c", "", "", "Allow", begin + "6 rulename=MissingRule-FilterRule-0006 action=pass srctarget=c"),
        (5, 7, "FILTER", "c", "", "", "pass", begin + "7 rulename=MissingRule-FilterRule-0007 action=pass srctarget=c"),
        (6, 8, "FILTER", "d", "", "", "nonsense", None),
        (7, 9, "NAT", "", "y", "", "nat", begin + "9 rulename=MissingRule-FilterRule-0009 action=nat dsttarget=y"),
    ]
    assert [tuple(r)[:-1] for r in got.orderBy("_row").collect()] == want
    rows = comparison.missing_rules(frame(spark, source, columns), frame(spark, final, columns)).orderBy("_row")
    assert [r["note"] for r in rows.collect()] == [source[w[0] - 1].get("note") for w in want]


def random_comparison():
    rng = random.Random(1)
    cells = {"from_src": ["a", "b", "c", ""], "to_dest": ["x", ""], "service": ["http", "", "ssh"], "action": ["pass", "Allow", ""]}
    made = lambda n: [{c: rng.choice(v) for c, v in cells.items()} for _ in range(n)]
    return made(90), made(12)


def test_any_comparison(spark):
    source, final = random_comparison()
    got = comparison.missing_rule_commands(frame(spark, source), frame(spark, final), start=5).orderBy("position").collect()
    ids = [(r["id_source"], r["id_destination"], r["id_service"], r["id_action"]) for r in got]
    key = lambda r: tuple(r[c] for c in IDENTITY)
    assert set(ids) == {key(r) for r in source} - {key(r) for r in final} and len(ids) == len(set(ids))
    assert [r["position"] for r in got] == list(range(5, 5 + len(got)))
    assert [r["_row"] for r in got] == sorted(r["_row"] for r in got)
    for r, i in zip(got, ids):
        assert key(source[r["_row"] - 1]) == i
        assert all(key(x) != i for x in source[: r["_row"] - 1])


FILTER_SLOT, NAT_SLOT = "local_filter_slot_09", "local_nat_slot_09"

# File, slot, name, source, destination, service, protocol, action; what its group is called here, and how it is removed.
WRITTEN_OUT = [
    ("b.csv", FILTER_SLOT, "web", "a, b", "x", "http", "", "pass", "list", None),
    ("b.csv", FILTER_SLOT, "web", "b;a", "x", "http", "", "pass", "list", "position=2"),
    ("b.csv", FILTER_SLOT, "db", "b,a", "x", "http", "", "pass", "list", 'name="db"'),
    ("b.csv", FILTER_SLOT, "", "a,b", "x", "http", "", "pass", "list", "position=4"),
    ("b.csv", FILTER_SLOT, "web", "a,b", "x", "http", "tcp", "pass", None, None),
    ("b.csv", FILTER_SLOT, "web", "a,b", "x", "http", "", "Pass", None, None),
    ("b.csv", FILTER_SLOT, "t", "", "x,", "", "", "pass", None, None),
    ("b.csv", FILTER_SLOT, "u", "", "x", "", "", "pass", None, None),
    ("b.csv", FILTER_SLOT, "blank", "", "", "http", "", "", None, None),
    ("b.csv", FILTER_SLOT, "blank", "", "", "http", "", "", None, None),
    ("b.csv", "Local_filter_slot_09", "v", "a,b", "x", "http", "", "pass", None, None),
    ("a.csv", NAT_SLOT, "n1", "", "", "", "", "nat", "nat", 'name="n1"'),
    ("a.csv", NAT_SLOT, "", "", "", "", "", "nat", "nat", None),
    ("c.csv", NAT_SLOT, "n1", "", "", "", "", "nat", "nat", 'name="n1"'),
    ("0.csv", NAT_SLOT, "first", "", "", "", "", "nat", "nat", None),
    ("a.csv", NAT_SLOT, "n1", "a", "", "", "", "nat", None, None),
]
COLUMNS = ["type_slot", "rule_name", "from_src", "to_dest", "service", "proto", "action"]


def placed(spark, rows):
    """Rules with the file of each and its line there."""
    lines, data = defaultdict(int), []
    for i, (file, *cells) in enumerate(rows, 1):
        lines[file] += 1
        data.append((i, file, lines[file], *cells))
    return spark.createDataFrame(data, "_row long, _file string, _line long, " + ", ".join(f"`{c}` string" for c in COLUMNS)).repartition(3)


def test_written_out_duplicates(spark):
    rules = placed(spark, [r[:-2] for r in WRITTEN_OUT])
    members = duplicates.duplicate_members(rules, with_nat_lines=True).collect()
    groups = {r["_row"]: tuple(r[c] for c in duplicates.SIGNATURE) for r in members}
    assert groups == {
        i: ("a,b", "x", "http", "any", "pass") if g == "list" else ("any", "any", "any", "any", "nat")
        for i, (*_, g, _) in enumerate(WRITTEN_OUT, 1) if g
    }
    # Where several files are read the file's name comes first, then the line.
    assert [r["_row"] for r in members if r["is_kept"]] and sorted(r["_row"] for r in members if r["is_kept"]) == [1, 15]
    assert {r["_row"]: r["nat_line"] for r in members if r["kind"] == "nat"} == {12: 1, 13: 2, 14: 3, 15: 4}
    got = {r["_row"]: r["command"] for r in duplicates.duplicate_removals(rules, slot=2, is_global=True).collect()}
    assert got == {
        i: f"CONFIG FILTER RULE REMOVE index=2 type={'nat' if g == 'nat' else 'filter'} {how} global=1"
        for i, (*_, g, how) in enumerate(WRITTEN_OUT, 1) if how
    }


def random_rules(seed, n):
    rng = random.Random(seed)
    cells = (["b.csv", "a.csv"], [FILTER_SLOT, FILTER_SLOT, NAT_SLOT, ""], ["", "", "web", "db"], ["a", "a, b", "b;a", ""], ["x", "x,", ""],
             ["", "http", "http,ssh", "ssh;http"], ["", "tcp"], ["pass", "Allow", ""])
    return [tuple(rng.choice(c) for c in cells) for _ in range(n)]


def test_any_duplicates(spark, monkeypatch):
    rules = placed(spark, random_rules(3, 300))
    groups = duplicates.duplicate_groups(rules).collect()
    members = duplicates.duplicate_members(rules, with_nat_lines=True).collect()
    removals = duplicates.duplicate_removals(rules, slot=2).collect()
    signature = lambda r: (r["kind"], *[r[c] for c in duplicates.SIGNATURE])
    by_group = defaultdict(list)
    for r in members:
        by_group[signature(r)].append(r)
    # A rule is in one group; a group has one survivor, its first by file and line.
    assert len({(r["kind"], r["_row"]) for r in members}) == len(members)
    assert {signature(g): g["n"] for g in groups} == {s: len(m) for s, m in by_group.items()} and min(map(len, by_group.values())) > 1
    gone = {(r["kind"], r["_row"]): r["command"] for r in removals}
    assert len(gone) == len(removals)
    for s, group in by_group.items():
        order = sorted(group, key=lambda r: (r["file"], r["nat_line"] if s[0] == "nat" else r["line"]))
        assert [r["is_kept"] for r in order] == [True] + [False] * (len(order) - 1)
        for r in order[1:]:
            command = gone.pop((r["kind"], r["_row"]), None)
            alone = r["name"] != "Sans nom" and sum(x["name"] == r["name"] for x in group) == 1
            if s[0] == "nat":
                # A rule without a name cannot be removed by name.
                assert (command is None) == (r["name"] == "Sans nom")
            else:
                # Each command hits one member: by its name if no other has it, else by its line.
                assert command.endswith(f'name="{r["name"]}"' if alone else f"position={r['line']}")
    assert not gone
    monkeypatch.setattr(duplicates, "hot_keys", lambda s, k, n: joins.hot_keys(s, k, n, rows_per_task=2))
    assert sorted(map(tuple, duplicates.duplicate_members(rules, with_nat_lines=True).collect()), key=repr) == sorted(map(tuple, members), key=repr)


def test_original_line_wins_and_no_slot_means_none(spark):
    columns = ["action", "type_slot", "original_line"]
    rows = [{"action": "pass", "type_slot": "local_filter_slot_1", "original_line": n} for n in ("40", "7", "x")]
    got = duplicates.duplicate_removals(frame(spark, rows, columns)).orderBy("remove_order").collect()
    assert [(r["line"], r["remove_order"]) for r in got] == [(40, -40), (7, -7)]
    assert duplicates.duplicate_groups(frame(spark, rows, ["action"])).count() == 0


def test_nat_lines_follow_the_original_line(spark):
    columns = ["action", "type_slot", "original_line"]
    rows = [{"action": "pass", "type_slot": "local_nat_slot_1", "original_line": n} for n in ("20", "10", "20", "-3")]
    got = duplicates.nat_lines(frame(spark, rows, columns)).orderBy("nat_line").collect()
    assert [(r["_row"], r["nat_line"]) for r in got] == [(4, 1), (2, 2), (1, 3), (3, 4)]


LOGS = "srcname string, dstname string, dstportname string, time string, rcvd string, sent string"


def test_suggestions(spark):
    logs = spark.createDataFrame(
        [("web", s, "tcp", f"2024-01-01 00:00:0{i}", "1", "2") for i, s in enumerate(["db", "db", "a b", "ghost", "db", "a b"])], LOGS)
    table = flows.flow_rollup(logs)
    got = suggestions.suggest_rules(table, known(spark), k=3).orderBy("rank").collect()
    begin = "CONFIG FILTER RULE INSERT index=9 type=filter position=1 rulename="
    assert [(r["dstname"], r["count"], len(r["missing"]), r["command"]) for r in got] == [
        ("db", 3, 0, begin + '"Rule for web to db" action=pass service=tcp srctarget=web dsttarget=db'),
        ("a b", 2, 1, begin + '"Rule for web to a b" action=pass service=tcp srctarget=web dsttarget="a b"'),
        ("ghost", 1, 1, begin + '"Rule for web to ghost" action=pass service=tcp srctarget=web dsttarget=ghost')]
    chosen = suggestions.suggest_rules(table, known(spark), k=3, ranks=[3, 1, 9], names={1: "mine"}, comments={1: "since", 3: "because"}, action="deny")
    assert [(r["rank"], r["command"]) for r in chosen.orderBy("rank").collect()] == [
        (1, begin + "mine comment=since action=drop service=tcp srctarget=web dsttarget=db"),
        (3, begin + "because action=drop service=tcp srctarget=web dsttarget=ghost")]
    assert suggestions.suggest_rules(table, known(spark), ranks=[]).count() == 0


def test_missing_references_by_row(spark):
    rows = [{"from_src": "a,b, web", "from_if": "eth0,web"}, {"from_src": "web", "from_if": ""}]
    rules = frame(spark, rows, ["from_src", "from_if"])
    universe = dependencies.known_names(names(spark, ["web"]), names(spark, ["eth0"]))
    got = dependencies.missing_references(rules, universe).collect()
    assert sorted(tuple(r) for r in got) == sorted([("OBJECT", "a", 1), ("OBJECT", "b", 1), ("INTERFACE", "web", 1)]) or (
        sorted((r["_row"], r["kind"], r["name"]) for r in got) == [(1, "INTERFACE", "web"), (1, "OBJECT", "a"), (1, "OBJECT", "b")])


def test_a_large_comparison_moves_only_blocks_with_missing_rules(spark, monkeypatch):
    source, final = random_comparison()
    want = sorted(tuple(r) for r in comparison.missing_rules(frame(spark, source), frame(spark, final)).collect())
    for fits in (lambda df: False, lambda df: "_block" in df.columns):
        monkeypatch.setattr(comparison, "fits_broadcast", fits)
        assert sorted(tuple(r) for r in comparison.missing_rules(frame(spark, source), frame(spark, final)).collect()) == want
