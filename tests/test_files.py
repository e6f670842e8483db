"""Readers, writers and file-to-file jobs on temporary files."""

import os
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wallflow.operators.flows import flow_rollup
from wallflow.plans import jobs
from wallflow.sources import listing, logs, names, rules

HEAD = "srcname,dstname,dstportname,time,rcvd,sent,action"


def text_of(path):
    """The part files of a written folder, one after the other."""
    return "".join(p.read_text() for p in sorted(Path(path).glob("part-*")))


def write(folder, name, content, encoding="utf-8"):
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode(encoding))
    return str(path)


def test_bad_lines_quotes_and_bytes(spark, tmp_path):
    path = write(tmp_path, "a.log", (HEAD + "\n"
        "ok,d,p,2024-01-01,1,2,x\n"
        "short,d,p,2024-01-01\n"
        "long,d,p,2024-01-01,1,2,x,extra\n"
        "blank,d,p,2024-01-01,1,2,x,\n"
        '"a,b",d,p,2024-01-01,1,2,"say ""hi"", you"\n'
        "NA,d,p,2024-01-01,1,2,x\n").encode() + b"b\xffyte,d,p,2024-01-01,1,2,n/a\n")
    got = logs.read_logs(spark, path)
    assert got.columns == HEAD.split(",")
    assert sorted((r["srcname"] or "-", r["rcvd"], r["action"]) for r in got.collect()) == [
        ("-", "1", "x"), ("a,b", "1", 'say "hi", you'), ("byte", "1", None), ("ok", "1", "x"), ("short", None, None)]
    # Pruned scans must drop the same rows.
    assert sorted(r[0] or "-" for r in got.select("srcname").collect()) == ["-", "a,b", "byte", "ok", "short"]
    assert got.count() == 5


def test_folder_union_by_name(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + "\na,d,p,2024-01-01 00:00:01,1,2,late\n")
    write(tmp_path, "b.csv", "action,user,srcname,dstname,dstportname,time,rcvd,sent\nearly,u,a,d,p,2024-01-01 00:00:00,3,4\n")
    write(tmp_path, "c.CSV", HEAD + "\nz,z,z,2024-01-01,1,2,x\n")
    write(tmp_path, "d.txt", HEAD + "\nz,z,z,2024-01-01,1,2,x\n")
    write(tmp_path, "empty.csv", "")
    (tmp_path / "deeper").mkdir()
    write(tmp_path / "deeper", "e.csv", HEAD + "\nz,z,z,2024-01-01,1,2,x\n")
    table = flow_rollup(logs.read_logs(spark, str(tmp_path), with_order=True), tie_break=logs.ORDER)
    assert [tuple(r) for r in table.collect()] == [
        ("a", "d", "p", 2, datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 1), 4.0, 6.0, "early", "u")]
    with pytest.raises(FileNotFoundError):
        logs.read_logs(spark, str(tmp_path / "none"))


def test_same_header_is_checked(spark, tmp_path):
    write(tmp_path, "a.csv", HEAD + "\na,d,p,2024-01-01,1,2,x\n")
    write(tmp_path, "b.csv", HEAD + "\nb,d,p,2024-01-01,1,2,x\n")
    assert logs.read_logs(spark, str(tmp_path), same_header=True).count() == 2
    write(tmp_path, "c.csv", "other," + HEAD + "\nq,c,d,p,2024-01-01,1,2,x\n")
    with pytest.raises(Exception, match="(?i)header"):
        logs.read_logs(spark, str(tmp_path), same_header=True).collect()


def test_repeated_log_headers():
    assert logs.header_names("a,b,a,a") == ["a", "b", "a.1", "a.2"]


def test_rule_header():
    assert rules.rule_header('#type_slot;"Action"; # Action ;') == (";", ("type_slot", "action", " action", ""))
    assert rules.rule_header("a,A,\"a\"") == (",", ("a", "a_1", "a_2"))


def test_rule_files(spark, tmp_path):
    a = write(tmp_path, "a.csv", '﻿\n  \n#type_slot;Action;action;"Comment"\r\n'
              'x; pass ;"y";"two\nlines ""q"""\r\n\n;;;\nshort\nlong;a;b;c;d;e\n', "utf-8")
    b = write(tmp_path, "b.csv", "action,source\ndrop,s1\nblock,s2\n")
    with pytest.warns(UserWarning, match="not found"):
        got = rules.read_rules(spark, [b, str(tmp_path / "gone.csv"), a, b]).orderBy("_row").collect()
    assert [(r["_row"], r["_file"], r["_line"], r["action"], r["action_1"], r["comment"], r["source"]) for r in got] == [
        (1, "b.csv", 1, "drop", "", "", "s1"), (2, "b.csv", 2, "block", "", "", "s2"),
        (3, "a.csv", 1, "pass", "y", 'two\nlines ""q'.replace('""', '"'), ""),
        (4, "a.csv", 2, "", "", "", ""), (5, "a.csv", 3, "a", "b", "c", ""),
        (6, "b.csv", 1, "drop", "", "", "s1"), (7, "b.csv", 2, "block", "", "", "s2")]


def test_rule_rows_over_many_splits(spark, tmp_path):
    big = "action;note\n" + "".join(f"pass;{i}\n\n" for i in range(4000))
    paths = [write(tmp_path, n, big) for n in ("z.csv", "y.csv")]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = rules.read_rules(spark, paths, multi_line=False)
        splits = spark.read.text(paths).rdd.getNumPartitions()
        rows = [(r["_row"], r["_file"], r["_line"], int(r["note"])) for r in got.collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert splits > 3
    assert sorted(rows) == [(f * 4000 + i + 1, n, i + 1, i) for f, n in enumerate(("z.csv", "y.csv")) for i in range(4000)]


def test_name_lists(spark, tmp_path):
    objects = write(tmp_path, "o.txt", 'type=host name="web-server" ip=1.1.1.1 name="no"\r\n  server1  \n# note\n\n#name="hash"\nserver1\n')
    assert sorted(r[0] for r in names.read_objects(spark, objects).collect()) == ["hash", "server1", "web-server"]
    interfaces = write(tmp_path, "i.txt", 'ifname="eth 0" Name="x"\nifname=eth1 y\nName="dmz"\n[section]\nkey=value\n#c\n bare if \nname="low"\n')
    assert sorted(r[0] for r in names.read_interfaces(spark, interfaces).collect()) == ["bare if", "dmz", "eth 0", "eth1"]
    assert names.read_objects(spark, str(tmp_path / "none")).count() == 0
    assert names.read_objects(spark, "").count() == 0


def test_newest_file(spark, tmp_path):
    for i, name in enumerate(["export_objects_2.txt", "export_objects_1.txt", "export_interfaces_9.txt"]):
        os.utime(write(tmp_path, name, "x"), (1000 + 10 * i, 1000 + 10 * i))
    newest = names.newest_lists(spark, str(tmp_path))
    assert [Path(p).name for p in newest] == ["export_objects_1.txt", "export_interfaces_9.txt"]
    assert listing.newest_file(spark, str(tmp_path), "routes") == ""
    assert listing.newest_file(spark, str(tmp_path / "none"), "x") == ""
    plan = listing.list_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_analyse_logs_golden(spark, tmp_path):
    source = write(tmp_path, "in.csv", HEAD + "\n"
        "workstation1,server1,https,2023-10-27 10:01:00,3000,1500,other\n"
        "workstation1,server1,https,2023-10-27 10:00:00,1500,1000,pass\n"
        "workstation1,ssh-server,ssh,2023-10-27 10:03:00,3000,2000,pass\n"
        "workstation2,web-server,http,2023-10-27 10:02:00,100,500,block\n")
    out = str(tmp_path / "out")
    flows = jobs.analyse_logs(spark, source, out)
    assert text_of(f"{out}/analyzed_logs") == (
        "srcname,dstname,dstportname,count,min_time,max_time,total_rcvd,total_sent,action_first\n"
        "workstation1,server1,https,2,2023-10-27 10:00:00,2023-10-27 10:01:00,4500,2500,pass\n"
        "workstation1,ssh-server,ssh,1,2023-10-27 10:03:00,2023-10-27 10:03:00,3000,2000,pass\n"
        "workstation2,web-server,http,1,2023-10-27 10:02:00,2023-10-27 10:02:00,100,500,block\n")
    assert text_of(f"{out}/analysis_summary") == """\
Firewall Log Analysis Summary
==============================
Total rows processed: 4
Total unique flows identified: 3

Top 10 Flows by Count:
-------------------------
     srcname    dstname dstportname  count
workstation1    server1       https      2
workstation1 ssh-server         ssh      1
workstation2 web-server        http      1

Top 10 Flows by Total Traffic (Received + Sent):
--------------------------------------------------
     srcname    dstname dstportname  total_traffic  total_rcvd  total_sent
workstation1    server1       https           7000        4500        2500
workstation1 ssh-server         ssh           5000        3000        2000
workstation2 web-server        http            600         100         500
"""
    objects = write(tmp_path, "objects.txt", "workstation1\nserver1\nhttps\n")
    for _ in range(2):
        jobs.append_suggestions(flows, out, objects=objects, generated_at="T", k=2)
    assert text_of(f"{out}/generated_rules_from_logs") == 2 * (
        "# Rule generated from log analysis on T\n"
        'CONFIG FILTER RULE INSERT index=9 type=filter position=1 rulename="Rule for workstation1 to server1" '
        "action=pass service=https srctarget=workstation1 dsttarget=server1\n\n")


def test_convert_files(spark, tmp_path):
    body = "".join(f"web,10.0.0.{i % 3},pass,r{i}\n" for i in range(12))
    source = write(tmp_path, "in.csv", "source,destination,action,rule_name\n" + body + "ghost,web,pass,g\nweb,web,bogus,b\n")
    out = str(tmp_path / "out")
    objects = write(tmp_path, "objects.txt", "web\n")
    counts = jobs.convert_files(spark, [source], out, objects=objects, create_hosts=True, generated_at="T", slot=4)
    assert counts == {"rows_read": 14, "safe_commands": 15, "pending": 2, "missing": 1}
    line = "CONFIG FILTER RULE INSERT index=4 type=filter position={} rulename=r{} action=pass srctarget=web dsttarget=H_10_0_0_{}\n"
    commands = [line.format(i + 1, i, i % 3) for i in range(12)]
    assert text_of(f"{out}/rules_safe") == (
        "# Commands generated on T\n# Source CSVs: in.csv\n# Number of commands: 15\nSYSTEM SESSION language=fr\n"
        "MODIFY ON FORCE\nCONFIG SLOT ACTIVATE type=filter slot=4\n\n# --- Objets Hôtes ---\n"
        + "".join(f'CONFIG OBJECT HOST NEW name=H_10_0_0_{i} ip=10.0.0.{i} comment=""\n' for i in range(3))
        + "\n" + "".join(commands[:7]) + "\n" + "".join(commands[7:]) + "\nCONFIG FILTER ACTIVATE\n")
    pending = text_of(f"{out}/rules_pending").splitlines()
    assert pending[8:] == ["", "# Generated on: T",
        "# PENDING: Missing dependencies: OBJECT:ghost",
        "CONFIG FILTER RULE INSERT index=4 type=filter position=13 rulename=g action=pass srctarget=ghost dsttarget=web", "",
        "# PENDING: Rule from row 14 could not be processed.", "#  Build error: action de filtre inconnue: 'bogus'",
        '# Original data: {"source":"web","destination":"web","action":"bogus","rule_name":"b"}', ""]
    assert text_of(f"{out}/dependencies_missing") == "# Missing dependencies found on T\n\nOBJECT: ghost\n"


def test_compare_files(spark, tmp_path):
    source = write(tmp_path, "s.csv", "rule_name;from_src;action;x\n" + "".join(f"n{i};a{i % 11};pass;1\n" for i in range(20)))
    final = write(tmp_path, "f.csv", "from_src,action\nzz,pass\n")
    out = str(tmp_path / "out")
    assert jobs.compare_files(spark, [source], final, out, generated_at="T", start=3) == 11
    commands = [f"CONFIG FILTER RULE INSERT index=9 type=filter position={i + 3} rulename=MissingRule-n{i} action=pass srctarget=a{i}\n"
                for i in range(11)]
    assert text_of(f"{out}/missing_rules_commands") == (
        "# Generated on T\n# 11 commands to add rules that are missing from the final configuration.\n\n"
        + "".join(commands[:10]) + "\n" + commands[10])
    assert text_of(f"{out}/missing_rules_summary").splitlines() == ["rule_name;from_src;action"] + [f"n{i};a{i};pass" for i in range(11)]
    assert jobs.compare_files(spark, [source], source, str(tmp_path / "none"), generated_at="T") == 0


def test_find_duplicates_in_files(spark, tmp_path):
    slots = {"f": "local_filter_slot_09", "n": "local_nat_slot_09"}
    rows = [("f", "web", "a,b"), ("n", "nat1", "x"), ("f", "", "c"), ("f", "", "b;a"), ("f", "", "c"), ("n", "nat2", "x"), ("f", "solo", "q")]
    source = write(tmp_path, "r.csv", '#type_slot,rule_name,from_src,action\n' + "".join(f'{slots[k]},{n},"{s}",pass\n' for k, n, s in rows))
    out = str(tmp_path / "out")
    jobs.find_duplicates_in_files(spark, [source], out, slot=2)
    head = "### Duplicate - Signature: (Source: `{}`, Destination: `any`, Port: `any`, Protocol: `any`, Action: `pass`)\n\n"
    assert text_of(f"{out}/duplicate_rules_report") == (
        head.format("a,b") + "| File | Line | Rule Name |\n|---|---|---|\n| `r.csv` | `1` | `web` |\n| `r.csv` | `4` | `Sans nom` |\n"
        "\n---\n\n" + head.format("c") + "| File | Line | Rule Name |\n|---|---|---|\n| `r.csv` | `3` | `Sans nom` |\n| `r.csv` | `5` | `Sans nom` |\n")
    assert text_of(f"{out}/duplicate_nat_report") == (
        head.format("x") + "| File | Line (File) | Line (NAT) | Rule Name |\n|---|---|---|---|\n"
        "| `r.csv` | `2` | `1` | `nat1` |\n| `r.csv` | `6` | `2` | `nat2` |\n")
    assert text_of(f"{out}/delete_duplicates_script") == (
        "# Commands to delete duplicate filter rules\nCONFIG FILTER RULE REMOVE index=2 type=filter position=5\n"
        "CONFIG FILTER RULE REMOVE index=2 type=filter position=4\n\n# Commands to delete duplicate NAT rules\n"
        'CONFIG FILTER RULE REMOVE index=2 type=nat name="nat2"\n\n# Activate the new filter policy\nCONFIG FILTER ACTIVATE\n')
    lone = write(tmp_path, "l.csv", "type_slot,action\nlocal_filter_slot_1,pass\n")
    jobs.find_duplicates_in_files(spark, [lone], str(tmp_path / "lone"))
    assert text_of(tmp_path / "lone" / "duplicate_rules_report") == "No duplicates detected.\n"
    assert not (tmp_path / "lone" / "delete_duplicates_script").exists()


def test_volumes_beyond_doubles_are_exact(spark, tmp_path):
    big = 9007199254740993
    source = write(tmp_path, "in.csv", f"{HEAD}\na,b,c,2024-01-01,{big},0.25,x\na,b,c,2024-01-02,{big},1,x\nz,b,c,2024-01-02,1,0,x\n")
    flows = jobs.analyse_logs(spark, source, str(tmp_path / "out"))
    assert text_of(tmp_path / "out" / "analyzed_logs").splitlines()[1:] == [
        f"a,b,c,2,2024-01-01 00:00:00,2024-01-02 00:00:00,{2 * big},1.25,x", "z,b,c,1,2024-01-02 00:00:00,2024-01-02 00:00:00,1,0.0,x"]
    assert f"{2 * big}.0" not in text_of(tmp_path / "out" / "analysis_summary") and flows.count() == 2


def test_a_vote_finds_the_time_pattern_of_each_file(spark, tmp_path):
    folder = tmp_path / "logs"
    folder.mkdir()
    times = {"iso": ["2024-03-04 05:06:07", "2024-03-25"], "day": ["04/03/2024 05:06:07", "25/03/2024 00:00:00"], "month": ["03/04/2024 05:06:07", "03/25/2024 00:00:00"]}
    for name, (one, two) in times.items():
        # The last row is by the pattern of another file.
        other = "2024-01-01 00:00:00" if name != "iso" else "25/12/2024 00:00:00"
        write(folder, f"{name}.csv", f"{HEAD}\n{name},d,p,{one},1,2,x\n{name},d,p,{two},1,2,x\n{name},d,p,{other},1,2,x\n")
    flows = jobs.analyse_logs(spark, str(folder), str(tmp_path / "out"), vote=True)
    got = {r["srcname"]: (r["count"], r["min_time"], r["max_time"]) for r in flows.collect()}
    assert got == {name: (2, datetime(2024, 3, 4, 5, 6, 7), datetime(2024, 3, 25)) for name in times}


def test_newest_lists_for_suggestions(spark, tmp_path):
    folder = tmp_path / "lists"
    folder.mkdir()
    for i, (name, body) in enumerate([("objects_1.txt", "a\nb\nc\n"), ("objects_2.txt", "a\n"), ("interfaces_1.txt", "b\nc\n")]):
        os.utime(write(folder, name, body), (1000 + i, 1000 + i))
    source = write(tmp_path, "in.csv", f"{HEAD}\na,b,c,2024-01-01,1,1,x\na,d,c,2024-01-01,1,1,x\n")
    flows = jobs.analyse_logs(spark, source, str(tmp_path / "out"))
    found = jobs.append_suggestions(flows, str(tmp_path / "out"), reference_folder=str(folder), generated_at="T").orderBy("rank").collect()
    assert [[m["name"] for m in r["missing"]] for r in found] == [[], ["d"]]
    assert text_of(tmp_path / "out" / "generated_rules_from_logs").count("CONFIG") == 1


def test_jobs_report_files_left_out(spark, tmp_path):
    good = write(tmp_path, "g.csv", "action,source\npass,any\n")
    report = listing.ReadReport()
    with pytest.warns(UserWarning, match="not found"):
        jobs.convert_files(spark, [good, str(tmp_path / "gone.csv")], str(tmp_path / "out"), generated_at="T", report=report)
    assert [*report.left_out.values()] == ["not found"]
