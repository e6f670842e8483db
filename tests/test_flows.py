"""Log cleaning and flow rollup on rows with known results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from wallflow.operators import flows

COLUMNS = ["srcname", "dstname", "dstportname", "time", "rcvd", "sent", "action", "user"]


def logs(spark, rows, columns=COLUMNS):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


GOLDEN = [
    ("workstation1", "server1", "https", "2023-10-27 10:01:00", "3000", "1500", "other", "zoe"),
    ("workstation1", "server1", "https", "2023-10-27 10:00:00", "1500", "1000", "pass", "jdoe"),
    ("workstation1", "ssh-server", "ssh", "2023-10-27 10:03:00", "3000", "2000", "pass", "jdoe"),
    ("workstation2", "web-server", "http", "2023-10-27 10:02:00", "100", "500", "block", "psmith"),
]


def test_golden_flow_table(spark, rows_of):
    table = flows.sorted_flows(flows.flow_rollup(logs(spark, GOLDEN)))
    assert table.columns == [*flows.KEYS, *flows.MEASURES, "action_first", "user_first"]
    at = lambda m: datetime(2023, 10, 27, 10, m)
    assert rows_of(table) == [
        ("workstation1", "server1", "https", 2, at(0), at(1), 4500.0, 2500.0, "pass", "jdoe"),
        ("workstation1", "ssh-server", "ssh", 1, at(3), at(3), 3000.0, 2000.0, "pass", "jdoe"),
        ("workstation2", "web-server", "http", 1, at(2), at(2), 100.0, 500.0, "block", "psmith"),
    ]
    assert rows_of(flows.flow_totals(table)) == [(4, 3)]
    assert [r[3] for r in rows_of(flows.top_by_traffic(table))] == [7000.0, 5000.0, 600.0]
    assert [r[3] for r in rows_of(flows.top_by_count(table, 2))] == [2, 1]


def test_dirty_rows(spark, rows_of):
    rows = [
        ("a", "b", "c", "bad", "1", "1", "x", "u"),
        (None, "b", "c", "2023-01-01 00:00:00", "1", "1", "x", "u"),
        ("a", "b", "c", "2023-01-01 00:00:01", "abc", "", None, "u"),
        ("a", "b", "c", "2023-01-01 00:00:02", "1d", None, "first", None),
        ("a", "b", "c", "2023-01-01 00:00:03", " 1.5e1 ", "nan", "second", None),
        ("a", "b", "c", None, "1", "1", "x", "u"),
    ]
    got = rows_of(flows.flow_rollup(logs(spark, rows)))
    assert got == [("a", "b", "c", 3, datetime(2023, 1, 1, 0, 0, 1), datetime(2023, 1, 1, 0, 0, 3), 15.0, 0.0, "first", "u")]


def test_time_formats(spark, rows_of):
    rows = [("a", "b", "c", "27/10/2023 10:00", "1", "1", "x", "u")]
    assert rows_of(flows.flow_rollup(logs(spark, rows))) == []
    got = flows.flow_rollup(logs(spark, rows), time_formats=["dd/MM/yyyy HH:mm"])
    assert rows_of(got)[0][4] == datetime(2023, 10, 27, 10, 0)


def test_ties_use_the_named_column(spark, rows_of):
    rows = [("a", "b", "c", "2023-01-01", "0", "0", v, n) for v, n in [("z", "1"), ("y", "2"), (None, "0")]]
    assert rows_of(flows.flow_rollup(logs(spark, rows), tie_break=["user"]).select("action_first")) == [("z",)]
    assert rows_of(flows.flow_rollup(logs(spark, rows)).select("action_first")) == [("y",)]


def test_missing_column_is_named(spark):
    with pytest.raises(ValueError, match="dstportname"):
        flows.flow_rollup(logs(spark, GOLDEN).drop("dstportname"))


def test_null_words(spark, rows_of):
    df = spark.createDataFrame([(w,) for w in [*flows.NULL_WORDS, "na", "x"]], "v string")
    kept = df.select(flows.null_words_to_null(F.col("v")).alias("v")).dropna()
    assert rows_of(kept) == [("na",), ("x",)]


def test_rollup_plan_has_one_shuffle_and_prunes(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs(spark, GOLDEN).write.parquet(path)
    top = flows.top_by_count(flows.flow_rollup(spark.read.parquet(path)))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan and "TakeOrderedAndProject" in plan
    assert "action" not in plan and "SortAggregate" not in plan


def test_whole_volumes_stay_exact(spark):
    big = 9007199254740993
    rows = [("a", "b", "c", "2024-01-01", str(big), "1e3"), ("a", "b", "c", "2024-01-02", "0.5", "inf"), ("a", "b", "c", "2024-01-03", "x", None)]
    logs = spark.createDataFrame(rows, "srcname string, dstname string, dstportname string, time string, rcvd string, sent string")
    row = flows.flow_rollup(logs, exact=True).first()
    assert (str(row["total_rcvd"]), str(row["total_sent"])) == (f"{big}.500000", "1000.000000")
