import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wallflow.llm import centroid_clustering

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, clusters, dims, rounds):
    """The rounds over every vector and centroid, in Python's whole numbers."""
    kept = [
        (i, [math.floor(64 * float(np.float32(e))) for e in v])
        for i, v, *_ in rows
        if v is not None and len(v) == dims and all(e is not None and math.isfinite(e) for e in v)
    ]
    mark = lambda r: ((r[0] is None), hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(x) for _, x in sorted(kept, key=mark)[:clusters]]
    gap = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min(range(len(centroids)), key=lambda k: (gap(x, centroids[k]), k))
    for _ in range(rounds):
        owner = [nearest(x) for _, x in kept]
        for k in range(len(centroids)):
            own = [x for (_, x), o in zip(kept, owner) if o == k]
            if own:
                centroids[k] = [sum(col) // len(own) for col in zip(*own)]
    out = []
    for i, x in kept:
        k = nearest(x)
        out.append((i, k, gap(x, centroids[k]), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()))
    inertia = {k: sum(r[2] for r in out if r[1] == k) for k in range(len(centroids))}
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), h) for i, k, d, h in out), key=repr)


def found(df, **options):
    rows = centroid_clustering.cluster(df, **options).drop("scans").collect()
    return sorted((tuple(r) for r in rows), key=repr)


def made(dims, n=300):
    rng = np.random.default_rng(2)
    middles = rng.normal(0, 1, (6, dims))
    rows = [(int(i), (middles[rng.integers(6)] + rng.normal(0, 0.2, dims)).astype(float).tolist(), 0) for i in rng.permutation(n)]
    odd = [0.5] * dims
    hot = [(1000 + i, [0.25] * dims, 1) for i in range(n // 2)]
    bad = [(2000, None, 0), (2001, [], 0), (2002, odd[:-1], 0), (2003, odd + [1.0], 0), (2004, [None] + odd[1:], 0)]
    bad += [(2005, [float("nan")] + odd[1:], 0), (2006, [float("inf")] + odd[1:], 0), (2007, odd[1:] + [float("-inf")], 0)]
    return rows + hot + bad + [rows[0], rows[0], (rows[1][0], odd, 0), (None, odd, 0), (2008, [-0.001] * dims, 0)]


@pytest.mark.parametrize(("dims", "clusters", "rounds"), [(64, 16, 3), (3, 5, 6), (2, 1, 2)])
def test_against_every_distance(spark, dims, clusters, rounds):
    rows = made(dims)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    options = {"dims": dims, "clusters": clusters, "rounds": rounds}
    assert found(df, **options) == plain(rows, **options)


def test_bounds_settle_most_vectors(spark):
    df = spark.createDataFrame(made(64), SCHEMA)
    rows = centroid_clustering.cluster(df, rounds=8).collect()
    assert sum(r.scans for r in rows) < 0.6 * 9 * len(rows)


def test_ns_bounds_hold_in_every_round():
    rng = np.random.default_rng(4)
    x = rng.integers(-100, 100, (400, 5))
    history, state = [x[:7].copy()], None
    for _ in range(12):
        state = centroid_clustering.assign(x, state, history)
        all_ = centroid_clustering.squared(x, history[-1])
        assert (state["cluster"] == all_.argmin(axis=1)).all()
        own, others = centroid_clustering.ways(history)
        mine = np.sqrt(all_[np.arange(len(x)), state["cluster"]])
        all_[np.arange(len(x)), state["cluster"]] = 1 << 40
        assert (state["upper"] + own[state["upper_round"], state["cluster"]] >= mine - 1e-6).all()
        assert (state["lower"] - others[state["lower_round"], state["cluster"]] <= np.sqrt(all_.min(axis=1)) + 1e-6).all()
        steps = sum(np.linalg.norm(b - a, axis=1) for a, b in zip(history, history[1:])) if len(history) > 1 else own[0]
        assert (own[0] <= steps + 1e-9).all()
        centroids = history[-1].copy()
        for k in range(7):
            if (state["cluster"] == k).any():
                centroids[k] = x[state["cluster"] == k].sum(axis=0) // (state["cluster"] == k).sum()
        history.append(centroids)


def test_odd_tables(spark):
    assert centroid_clustering.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroid_clustering.cluster(spark.createDataFrame([(1, None, 0)], SCHEMA)).collect() == []
    few = [(i, [float(i)] * 64, 0) for i in range(3)]
    df = spark.createDataFrame(few, SCHEMA)
    assert found(df) == plain(few, 16, 64, 3)
    clash = df.withColumn("x", F.lit(1)).withColumn("cluster", F.lit("a")).withColumn("id", F.lit(None))
    assert found(clash) == plain(few, 16, 64, 3)


def test_components_beyond_the_range_are_held_at_its_end(spark):
    df = spark.createDataFrame([(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0), (3, [0.0] * 64, 0)], SCHEMA)
    rows = centroid_clustering.cluster(df, clusters=1, rounds=0).collect()
    assert max(r.distance for r in rows) == 64 * (2 * centroid_clustering.largest(64)) ** 2 < 1 << 63
