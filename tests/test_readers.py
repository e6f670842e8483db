"""Readers on awkward files: nothing is lost without a word."""

import bz2
import csv
import gzip
import hashlib
import io
import random
import time
from datetime import datetime
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wallflow.operators import flows
from wallflow.plans import catalog, jobs
from wallflow.sources import listing, logs, regular, rules, streams

HEAD = "srcname,dstname,dstportname,time,rcvd,sent"


def write(folder, name, content):
    folder.mkdir(exist_ok=True)
    path = folder / name
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def sources(df):
    return sorted(r["srcname"] for r in df.collect())


@pytest.mark.parametrize("folder", ["my logs", "logs [1] {a,b}", "50%25 off", "é"])
def test_any_path_can_be_read(spark, tmp_path, folder):
    one = write(tmp_path / folder, "a b.csv", f"{HEAD}\na,d,p,2024-01-01,1,2\n")
    write(tmp_path / folder, "c*d.csv", f"{HEAD},more\nb,d,p,2024-01-01,1,2,x\n")
    assert sources(logs.read_logs(spark, str(tmp_path / folder))) == ["a", "b"]
    assert sources(logs.read_logs(spark, one)) == ["a"]
    rule = write(tmp_path / folder, "rules 1.csv", "action\npass\n")
    got = rules.read_rules(spark, rule).first()
    assert (got["_file"], got["_row"], got["action"]) == ("rules 1.csv", 1, "pass")


def test_names_that_spark_skips_are_read(spark, tmp_path):
    write(tmp_path, "_a.csv", f"{HEAD}\na,d,p,2024-01-01,1,2\n")
    write(tmp_path, ".c.csv", f"{HEAD}\nc,d,p,2024-01-01,1,2\n")
    write(tmp_path, "b.csv", f"{HEAD}\nb,d,p,2024-01-01,1,2\n")
    write(tmp_path, "_SUCCESS", "")
    assert sources(logs.read_logs(spark, str(tmp_path))) == ["a", "b", "c"]
    rule = write(tmp_path, "_r.csv", "action\npass\ndrop\n")
    assert [(r["_file"], r["_line"]) for r in rules.read_rules(spark, rule).orderBy("_row").collect()] == [("_r.csv", 1), ("_r.csv", 2)]


def test_damaged_files_are_taken_whole_or_not_at_all(spark, tmp_path):
    rows = "".join(f"s{i},d,p,2024-01-01,{i},2\n" for i in range(20_000))
    whole = gzip.compress(f"{HEAD}\n{rows}".encode())
    write(tmp_path, "cut.csv.gz", whole[: len(whole) // 2])
    write(tmp_path, "two.csv.gz", gzip.compress(f"{HEAD}\nx,d,p,2024-01-01,1,2\n".encode()) + gzip.compress(b"y,d,p,2024-01-01,1,2\n"))
    write(tmp_path, "ok.csv", f"{HEAD}\nz,d,p,2024-01-01,1,2\n")
    report = logs.ReadReport()
    with pytest.warns(UserWarning, match="cut.csv.gz"):
        got = logs.read_logs(spark, str(tmp_path), report=report)
    assert sources(got) == ["x", "y", "z"]
    assert [*report.left_out] == ["cut.csv.gz"]
    bad = write(tmp_path, "r.csv.gz", gzip.compress(b"action\npass\n")[:-6])
    with pytest.warns(UserWarning, match="left out"), pytest.raises(FileNotFoundError):
        rules.read_rules(spark, bad)


def test_unpack_errors():
    packed = gzip.compress(b"x" * 5_000_000)
    assert listing.unpack_error(packed, "gz") is None
    assert listing.unpack_error(packed[:-1], "gz") == "ends too early"
    assert listing.unpack_error(b"no gzip", "gz") and listing.unpack_error(b"no bz2", "bz2")


def test_quoted_line_breaks_are_kept_by_default(spark, tmp_path):
    write(tmp_path, "a.csv", f'{HEAD}\n"two\nlines",d,p,2024-01-01,1,2\nnext,d,p,2024-01-01,1,2\n')
    write(tmp_path, "b.csv", f"{HEAD}\nplain,d,p,2024-01-01,1,2\n")
    assert sources(logs.read_logs(spark, str(tmp_path))) == ["next", "plain", "two\nlines"]


def test_long_quoted_cells_in_short_rows(spark, tmp_path):
    cell = 'say ""hi"", ' * 30_000
    write(tmp_path, "a.csv", f'{HEAD}\n"{cell}",d,p\nlong,"",p,2024-01-01,1,2,"{cell}"\nok,d,p,2024-01-01,1,2\n')
    assert [len(s) for s in sources(logs.read_logs(spark, str(tmp_path)))] == [2, len(cell.replace('""', '"'))]


def test_headers_that_clash(spark, tmp_path):
    assert logs.header_names("User,user,user.1,USER") == ["User", "user.1", "user.1.1", "USER.2"]
    write(tmp_path, "a.csv", f"{HEAD},User,user\na,d,p,2024-01-01,1,2,x,y\n")
    row = logs.read_logs(spark, str(tmp_path)).first()
    assert (row["User"], row["user.1"]) == ("x", "y")
    rule = write(tmp_path, "r.csv", "a,a_1,a\n1,2,3\n")
    row = rules.read_rules(spark, rule).first()
    assert (row["a"], row["a_1"]) == ("1", "3")


def test_headers_of_many_files_take_few_jobs(spark, tmp_path):
    for i in range(50):
        write(tmp_path, f"f{i}.csv", f"{HEAD},extra{i % 3}\ns{i},d,p,2024-01-01,1,2,x\n")
    spark.sparkContext.setJobGroup("headers", "headers")
    got = logs.read_logs(spark, str(tmp_path))
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup("headers"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs_run <= 6
    assert got.count() == 50


def test_a_final_file_without_rules_means_that_all_are_missing(spark, tmp_path):
    source = write(tmp_path, "s.csv", "source,destination,service,action\na,b,c,pass\nd,e,f,pass\ng,h,i,nonsense\n")
    final = write(tmp_path, "f.csv", "")
    with pytest.warns(UserWarning, match="without a header"):
        assert jobs.compare_files(spark, [source], final, str(tmp_path / "out"), generated_at="T") == 3
    lines = "".join(p.read_text() for p in sorted((tmp_path / "out" / "missing_rules_unbuilt").glob("part-*")))
    assert lines.startswith("# Row 3: ") and lines.count("\n") == 1
    assert (tmp_path / "out" / "missing_rules_commands").exists()


def test_jobs_leave_no_scratch_behind(spark, tmp_path, monkeypatch):
    source = write(tmp_path, "s.csv", "type_slot,source,destination,service,action\n" + "local_filter_slot_1,a,b,c,pass\n" * 3)
    monkeypatch.setattr("wallflow.session.scratch_root", lambda _: str(tmp_path / "scratch"))
    counts = jobs.find_duplicates_in_files(spark, [source], str(tmp_path / "out"))
    assert counts == {"filter": 1, "nat": 0, "removals": 2}
    assert not [p for p in (tmp_path / "scratch").rglob("*.parquet")]


def rows_at(spark, read, split_bytes):
    """What a reader gives when files are cut at every so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        return [tuple(r) for r in read().collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def quoted_file(rng, n, end, sep=","):
    """Lines of CSV with quotes of all kinds, line breaks in some, and stray ones that open nothing."""
    cells = ["", "x", 'a"b', '""', '"quoted"', '"two\nlines"', '"say ""hi""\n"', f'"{sep}\n\n{sep}"', '"a"rest', ' "no', '5"', '"\r\n"', "é", f'"{"long " * 60}\n"']
    return "".join(sep.join(rng.choice(cells) for _ in range(rng.randrange(1, 4))) + end for _ in range(n))


@pytest.mark.parametrize(("seed", "end"), [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_quoted_breaks_at_any_split(spark, tmp_path, seed, end):
    """Each split size gives the rows that a reader of whole files gives."""
    body = quoted_file(random.Random(seed), 400, end)
    path = write(tmp_path, "q.csv", f"a,b,c{end}{body}")
    schema = "a string, b string, c string"
    whole = spark.read.schema(schema).options(header=True, escape='"', multiLine=True, enforceSchema=True).csv(path).collect()
    blank = lambda r: not any((c or "").strip() for c in r)
    read = lambda: logs.read_logs(spark, path)
    null = lambda c: None if c in flows.NULL_WORDS else c
    want = sorted((tuple(map(null, r)) for r in whole if not blank(r)), key=repr)
    for size in (1 << 20, 4001, 331, 97):
        assert sorted((r for r in rows_at(spark, read, size) if not blank(r)), key=repr) == want


def test_numbers_of_rules_with_quoted_breaks(spark, tmp_path):
    rng = random.Random(4)
    said = [f'"r{i}{rng.choice(["", chr(10), chr(10) * 2 + "x", ";"])}"' for i in range(500)]
    paths = [write(tmp_path, n, "action;note\n" + "".join(f"pass;{s}\n" for s in said)) for n in ("b.csv", "a.csv")]
    read = lambda: rules.read_rules(spark, paths)
    want = [(f * 500 + i + 1, n, i + 1, "pass", said[i].strip('"').strip()) for f, n in enumerate(("b.csv", "a.csv")) for i in range(500)]
    for size in (1 << 20, 700, 120):
        assert sorted(rows_at(spark, read, size)) == want


def test_a_quoted_cell_over_many_splits(spark, tmp_path):
    cell = "\n".join(f'line {i} ""x"", y' for i in range(400))
    path = write(tmp_path, "w.csv", f'{HEAD}\none,d,p,2024-01-01,1,2\n"{cell}",d,p,2024-01-01,1,2\nlast,d,p,2024-01-01,1,2\n')
    got = rows_at(spark, lambda: logs.read_logs(spark, path), 300)
    assert sorted(r[0] for r in got) == sorted(["one", cell.replace('""', '"'), "last"])


def test_one_quoted_break_leaves_a_file_in_many_tasks(spark, tmp_path):
    body = "".join(f"s{i},d,p,2024-01-01,1,2\n" for i in range(40_000))
    path = write(tmp_path, "big.csv", f'{HEAD}\n"odd\none",d,p,2024-01-01,1,2\n{body}')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        got = logs.read_logs(spark, path)
        assert got.rdd.getNumPartitions() > 8
        assert got.count() == 40_001
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_change_of_splits_is_noticed(spark, tmp_path):
    path = write(tmp_path, "c.csv", f'{HEAD}\n"odd\none",d,p,2024-01-01,1,2\n' + "s,d,p,2024-01-01,1,2\n" * 4000)
    got = logs.read_logs(spark, path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        with pytest.raises(Exception, match="changed while it was read"):
            got.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_the_plan_does_not_grow_with_headers(spark, tmp_path):
    sizes = []
    for folder, kinds in (("few", 2), ("many", 60)):
        for i in range(60):
            names = [*HEAD.split(","), *[f"x{(i % kinds + j) % 60}" for j in range(3)]] if folder == "many" else [*HEAD.split(","), f"x{i % kinds}"]
            rng = random.Random(i)
            rng.shuffle(names)
            cell = {"srcname": f"s{i}", "dstname": "d", "dstportname": "p", "time": "2024-01-01", "rcvd": "1", "sent": "2"}
            write(tmp_path / folder, f"f{i}.csv", ",".join(names) + "\n" + ",".join(cell.get(n, f"{n}of{i}") for n in names) + "\n")
        got = logs.read_logs(spark, str(tmp_path / folder))
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("Relation [") + plan.count("Relation["))
        rows = got.collect()
        assert sorted(r.srcname for r in rows) == sorted(f"s{i}" for i in range(60))
        for r in rows:
            for name in got.columns:
                if name.startswith("x"):
                    assert r[name] in (None, f"{name}of{r.srcname[1:]}")
            assert sum(r[c] is not None for c in got.columns if c.startswith("x")) == (3 if folder == "many" else 1)
    assert sizes[0] == sizes[1]


def test_replacement_characters_stay_and_bad_bytes_go(spark, tmp_path):
    text = f"{HEAD},said\na,d,p,2024-01-01,1,2,".encode() + "�\x01b".encode() + b"\xff\xc3\n"
    write(tmp_path, "bad.csv", text + "b,d,p,2024-01-01,1,2,�é\n".encode())
    write(tmp_path, "good.csv", f"{HEAD},said\nc,d,p,2024-01-01,1,2,�\n")
    got = {r.srcname: r.said for r in logs.read_logs(spark, str(tmp_path)).collect()}
    assert got == {"a": "�\x01b", "b": "�é", "c": "�"}


def test_streams_of_hidden_and_packed_files(spark, tmp_path):
    body = f'{HEAD}\n"two\nlines",d,p,2024-01-01,1,2\r\n\nplain,d,p,2024-01-01,1,2\nlong,d,p,2024-01-01,1,2,more\n'
    write(tmp_path, "_h.csv.gz", gzip.compress(body.encode()))
    write(tmp_path, "_b.csv.bz2", bz2.compress(body.replace("plain", "other").encode()))
    write(tmp_path, ".cut.csv.gz", gzip.compress(body.encode())[:-9])
    report = logs.ReadReport()
    with pytest.warns(UserWarning, match="cut.csv.gz"):
        got = logs.read_logs(spark, str(tmp_path), report=report)
    assert sources(got) == ["other", "plain", "two\nlines", "two\nlines"]
    assert report.left_out == {".cut.csv.gz": "ends too early"}


def test_many_members_take_time_in_proportion():
    member = gzip.compress(b"srcname\n")
    for kind, part in (("gz", member), ("bz2", bz2.compress(b"srcname\n"))):
        seconds = []
        for n in (20_000, 80_000):
            packed = part * n
            begin = time.perf_counter()
            assert listing.unpack_error(packed, kind) is None
            seconds.append(time.perf_counter() - begin)
        assert seconds[1] < 12 * seconds[0]
    big = gzip.compress(b"x" * 200_000_000)
    assert sum(map(len, streams.unpacked(iter([big]), "gz"))) == 200_000_000
    squeezed = bz2.compress(b"x" * 50_000_000)
    assert max(map(len, streams.unpacked(iter([squeezed]), "bz2"))) <= streams.PIECE


def test_rule_files_left_out_are_reported(spark, tmp_path):
    good, empty = write(tmp_path, "g.csv", "action\npass\n"), write(tmp_path, "e.csv", "\n\n")
    report = rules.ReadReport()
    with pytest.warns(UserWarning):
        got = rules.read_rules(spark, [good, empty, str(tmp_path / "gone.csv")], report=report)
    assert got.count() == 1
    assert sorted(report.left_out.values()) == ["no header", "not found"]


def test_a_log_folder_is_written_and_read_in_bounded_portions(spark, tmp_path, monkeypatch):
    """The long texts of the query are never all on disk, and none of their rows is lost, copies and nulls included."""
    at = datetime(2024, 1, 1)
    ids = [*range(1, 61), 7, 7, 20, None]
    events = [(i, at, 5, "view" if i != 21 else None, 1.5, '{"k": 3}') for i in ids]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    monkeypatch.setattr("wallflow.session.scratch_root", lambda _: str(tmp_path / "scratch"))
    monkeypatch.setattr(catalog, "PORTION_BYTES", 200_000, raising=False)
    sizes, read = [], catalog.read_logs

    def measured(spark, folder):
        sizes.append(sum(p.stat().st_size for p in Path(folder).glob("*.csv")))
        return read(spark, folder)

    monkeypatch.setattr(catalog, "read_logs", measured)
    got = [(r["event_id"], r["dstname"], r["rcvd"], r["said"], r["chars"]) for r in catalog.log_folder_scan(spark, str(tmp_path)).collect()]

    def row(i):
        said = None if i % 2 == 0 else "line\n" + '"x", ' * 25_000 + "view" if i % 7 == 0 else "plain"
        return str(i), "view", 3.0, said and hashlib.md5(said.encode()).hexdigest(), said and len(said)

    # A flow needs all of its names, so the row without a type goes, and one without a number is in no file.
    assert sorted(got) == sorted(row(i) for i in ids if i not in (21, None))
    assert len(sizes) > 1 and max(sizes) < sum(sizes) / 1.2
    assert not list((tmp_path / "scratch").glob("logs-*"))


def test_rows_as_long_as_the_widest_header_go_from_narrower_files(spark, tmp_path):
    write(tmp_path, "a.csv", f'{HEAD},x,y\n"one\none",d,p,2024-01-01,1,2,3,4\nshort,d,p,2024-01-01,1,2\n"many\n",d,p,2024-01-01,1,2,3,4,5\n')
    write(tmp_path, "b.csv", f'{HEAD}\n"two\ntwo",d,p,2024-01-01,1,2\n"over\n",d,p,2024-01-01,1,2,3,4\n"less\n",d,p,2024-01-01,1\n')
    got = [(r["srcname"], r["sent"], r["y"]) for r in logs.read_logs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == [("less\n", None, None), ("one\none", "2", "4"), ("short", "2", None), ("two\ntwo", "2", None)]


def test_facts_of_files_sort_no_lines(spark, tmp_path, monkeypatch):
    path = write(tmp_path, "a.csv", f'\n{HEAD}\n"one\none",d,p,2024-01-01,1,2\n')
    frame, plans = type(spark.range(1)), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or collect(df))
    facts = listing.file_facts(spark, listing.find_files(spark, path))
    assert facts[0].header == HEAD and facts[0].open_quotes == {",", ";"}
    assert not [p for p in plans if "SortAggregate" in p]


def regular_file(rng, n):
    """Lines as a CSV writer makes them, most with six cells, and blank ones."""
    cells = ["", "x", "NA", '""', '"two\nlines"', '"say ""hi""\n"', '",\n\n,"', '""""', "é", '"日本\n"', " y ", f'"{"long " * 60}\n"']
    line = lambda: rng.choice([",".join(rng.choice(cells) for _ in range(rng.choice((6, 6, 6, 1, 4, 7)))), "", "  ", "\t"])
    return "".join(line() + "\n" for _ in range(n))


def refuse(*_, **__):
    raise AssertionError("not the way that regular files are read")


@pytest.mark.parametrize(("seed", "last"), [(1, "\n"), (2, ""), (3, "\n\n \n")])
def test_regular_files_are_cut_at_any_byte(spark, tmp_path, monkeypatch, seed, last):
    """No regular expression looks at their lines, and the rows are those of a plain reader, in its order."""
    rng, want = random.Random(seed), []
    for name, head in (("a.csv", HEAD), ("b.csv", "more,sent,rcvd,time,dstportname,dstname,srcname")):
        body = f"\n \n{head}\n{regular_file(rng, 200)}end,\"1\n2\",3{last}"
        path = write(tmp_path, name, body)
        width = head.count(",") + 1
        for row in list(csv.reader(io.StringIO(body, newline="")))[3:]:
            if len(row) > width or (len(row) < 2 and not "".join(row).strip(" \t") and '""' not in row):
                continue
            named = dict(zip(head.split(","), row))
            want.append((path.rsplit("/", 1)[1], *[None if named.get(c) in (None, *flows.NULL_WORDS) else named[c] for c in [*HEAD.split(","), "more"]]))
    monkeypatch.setattr(logs, "quoted_records", refuse)
    monkeypatch.setattr(listing, "opens_quotes", refuse)

    def read():
        rows = logs.read_logs(spark, str(tmp_path), with_order=True).coalesce(1).sortWithinPartitions(*logs.ORDER)
        return rows.select(F.substring_index("_path", "/", -1), *HEAD.split(","), "more")

    blank = lambda r: not any((c or "").strip() for c in r[1:])
    for size in (1 << 20, 4001, 331, 97):
        assert [r for r in rows_at(spark, read, size) if not blank(r)] == [r for r in want if not blank(r)]


def plain_quotes(text):
    """Whether each quote stands where a writer puts it, whether a quoted cell holds a line break, and whether the last one ends."""
    inside = broken = closed = False
    fresh = True
    for c in text:
        if inside:
            if c == '"':
                inside, closed = False, True
            broken |= inside and c == "\n"
        elif c == '"' and (fresh or closed):
            # Behind a closing quote it makes that one double.
            inside, closed = True, False
        elif c == '"' or (closed and c not in ",\n"):
            return False, broken, True
        else:
            closed = False
        fresh = not inside and not closed and c in ",\n"
    return True, broken, not inside


def test_regular_files_are_told_from_others(spark, tmp_path):
    """Files of every kind of quote, looked at in ranges so short that a word of 64 bytes is never full, or is."""
    rng, texts = random.Random(5), {}
    for i in range(400):
        part = "".join(rng.choice(['"', '""', ",", "\n", "x", ',"', '",']) for _ in range(rng.randrange(1, 9)))
        texts[f"f{i}"] = rng.choice(["a,b\n", 'h,"i"\n' * 15, f'"{"long" * 40}\n",b\n']) + part
    files = [(write(tmp_path, name, text), name) for name, text in texts.items()]
    texts |= {"cr": 'a,"b\n"\r\n', "nul": 'a,"b\n\x00"\n', "é": 'é,"é\n"\n', "empty": ""}
    files += [(write(tmp_path, name, texts[name]), name) for name in ("cr", "nul", "é", "empty")]
    files.append((write(tmp_path, "bad", b'a,"b\n\xc3"\n'), "bad"))
    want = {name: facts[1] for name, text in texts.items() if all((facts := plain_quotes(text))[::2]) and name not in ("cr", "nul", "empty")}
    assert 100 < len(want) < 380 and 20 < sum(want.values()) < len(want)
    for size in (1 << 20, 65, 7):
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        try:
            found = regular.shapes(spark, files[-25 if size < 65 else 0 :], ",")
        finally:
            spark.conf.unset("spark.sql.files.openCostInBytes")
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        expected = {name: want[name] for _, name in files[-25 if size < 65 else 0 :] if name in want}
        assert {name: shape["ranges"] is not None for name, shape in found.items()} == expected


def test_rows_of_regular_files_are_not_taken_for_few(spark, tmp_path, monkeypatch):
    path = write(tmp_path, "a.csv", f'{HEAD}\n"two\nlines",d,p,2024-01-01,1,2\n' * 3)
    monkeypatch.setattr(logs, "quoted_records", refuse)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = logs.read_logs(spark, path)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() > 1 << 50
    assert got.count() == 5
    Path(path).write_text("")
    with pytest.raises(Exception, match="changed while it was read"):
        got.count()


def test_long_texts_are_quoted_as_a_csv_writer_does(spark, tmp_path):
    ends = ["view", 'a"b', '""', "x ", "\ty\n", " ", "", "é"]
    rows = spark.createDataFrame([(i, e) for i, e in enumerate(ends)], "n int, e string").coalesce(1)
    parts = [F.lit('line\n"x", '), F.lit('"z" '), F.col("e")]
    rows.select(F.concat(*parts), "n").write.option("escape", '"').csv(str(tmp_path / "writer"))
    lines = rows.select(F.concat(catalog._quoted_cell(parts), F.lit(","), F.col("n").cast("string")))
    catalog._write_lines(lines, "said,n", str(tmp_path / "lines"))
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part-*.csv")))
    assert text("lines") == "said,n\nsaid,n\n" + text("writer")
