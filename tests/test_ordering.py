"""Blocked numbering and running totals against plain loops."""

import random

from pyspark.sql import functions as F

from wallflow.operators import joins, ordering


def keyed(spark, keys):
    return spark.createDataFrame([(k, k % 3 == 0) for k in keys], "k long, flag boolean").repartition(5)


def test_running_total_and_numbers(spark):
    rng = random.Random(7)
    for keys in ([*range(1, 200)], rng.sample(range(-(10**15), 10**15), 150)):
        rng.shuffle(keys)
        df = keyed(spark, keys)
        got = ordering.running_total_before(df, "k", F.col("flag").cast("int"), "before", bits=4)
        got = ordering.number_rows(got, "k", "n", start=5, bits=4)
        total = 0
        expected = []
        for i, k in enumerate(sorted(keys)):
            expected.append((k, total, i + 5))
            total += k % 3 == 0
        assert sorted((r["k"], r["before"], r["n"]) for r in got.collect()) == expected


def test_nth_row(spark):
    keys = [k * 7 for k in range(50)]
    df = keyed(spark, keys)
    assert [ordering.nth_row(df, "k", n, bits=3) for n in (1, 17, 50, 51)] == [0, 112, 343, None]


def test_row_level_plan_has_no_single_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed(spark, range(100)).write.parquet(path)
    plan = ordering.number_rows(spark.read.parquet(path), "k")._jdf.queryExecution().executedPlan().toString()
    # The only single-partition step works on group totals.
    for part in plan.split("Exchange SinglePartition")[1:]:
        assert "_group" in part.splitlines()[1] + part.splitlines()[2]


def test_salted_join_equals_plain_join(spark, rows_of):
    rows = [(i, "hot" if i % 3 else f"k{i % 20}") for i in range(300)]
    left = spark.createDataFrame(rows, "i long, k string").repartition(6)
    right = spark.createDataFrame([("hot", 1), ("k0", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    stats = left.groupBy("k").agg(F.count("*").alias("n"))
    hot = joins.hot_keys(stats, ["k"], "n", rows_per_task=20)
    assert rows_of(hot) == [("hot", 10)]
    for how in ("inner", "left", "left_semi", "left_anti"):
        salted = joins.salted_join(left, right, ["k"], how, hot, "i")
        plain = left.join(right, ["k"], how).select(*salted.columns)
        assert sorted(map(str, rows_of(salted))) == sorted(map(str, rows_of(plain)))


def test_hot_keys_that_do_not_fit_are_joined_by_shuffle(spark, rows_of):
    left = spark.createDataFrame([(i, f"k{i % 30}") for i in range(600)], "i long, k string").repartition(4)
    right = spark.createDataFrame([(f"k{i}", i) for i in range(0, 60, 2)], "k string, v int")
    hot = joins.hot_keys(left.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", rows_per_task=6)
    assert hot.count() == 30
    salted = joins.salted_join(left, right, ["k"], "left", hot, "i", max_rows=3)
    plain = left.join(right, ["k"], "left").select(*salted.columns)
    assert sorted(map(str, rows_of(salted))) == sorted(map(str, rows_of(plain)))
    looked = joins.lookup_join(left, right.select("k"), ["k"], "left_anti", "i", rows_per_task=6, max_rows=1)
    assert looked.count() == 300


def test_lookup_join_checks_the_size(spark, rows_of):
    left = spark.createDataFrame([(i, f"k{i % 4}") for i in range(40)], "i long, k string")
    right = spark.createDataFrame([("k0",), ("k2",)], "k string")
    small = joins.lookup_join(left, right, ["k"], "left_anti", "i")
    large = joins.lookup_join(left, right, ["k"], "left_anti", "i", max_rows=1)
    assert sorted(rows_of(small)) == sorted(rows_of(large.select(*small.columns)))
    assert not joins.fits_broadcast(right, max_bytes=3) and joins.fits_broadcast(right, max_bytes=4)
