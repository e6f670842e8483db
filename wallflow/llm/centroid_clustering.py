"""k-means in whole numbers, with ns-bounds.

Every vector keeps its cluster, a distance to its centroid (upper bound) and
one to the nearest other centroid (lower bound), each with the round in which
it was measured. All centroids of all rounds are kept. In a later round a bound
is loosened by the norm of the whole way that the centroid went since then,
which is never more than the sum of its steps. Where the loosened bounds do not
settle a vector its upper bound is measured anew, and if that does not either,
all its distances are, exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.session import discard, map_arrow, materialise

CLUSTERS = 16
DIMS = 64
ROUNDS = 3
SCALE = 64
SEED = 1

# Bounds are doubles and may be off by rounding; nearer calls are measured.
_SLACK = 1e-9

_STATE = "id long, x array<int>, cluster int, upper double, upper_round int, lower double, lower_round int, scans int"


def largest(dims: int) -> int:
    """Greatest size of a component for which a squared distance fits in a long."""
    return 1 << ((62 - (dims - 1).bit_length()) // 2 - 1)


def whole_vectors(df: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """``(id, x)`` of the usable vectors, components as whole numbers."""
    vector = F.col(vector_col)
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    bound = largest(dims)
    whole = lambda e: F.least(F.greatest(F.floor(scale * e.cast("double")), F.lit(-bound)), F.lit(bound)).cast("int")
    usable = vector.isNotNull() & (F.size(vector) == dims) & F.coalesce(F.forall(vector, fine), F.lit(False))
    return df.filter(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(vector, whole).alias("x"))


def first_centroids(vectors: DataFrame, clusters: int, seed: int) -> np.ndarray:
    """The vectors with the least hashes of their identifiers; the driver gets so many rows."""
    mark: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("x", mark.alias("mark")).orderBy(F.col("mark").asc_nulls_last(), "x").limit(clusters).collect()
    return np.array([r["x"] for r in rows], dtype=np.int64)


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to each centroid."""
    out = np.empty((len(x), len(centroids)), dtype=np.int64)
    for j, c in enumerate(centroids):
        gap = x - c
        out[:, j] = np.einsum("ij,ij->i", gap, gap)
    return out


def ways(history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How far each centroid went since each round, and the most that any other one did."""
    now = history[-1].astype(np.float64)
    own = np.array([np.linalg.norm(now - past, axis=1) for past in history])
    k = len(now)
    others = np.zeros_like(own)
    for j in range(k):
        if k > 1:
            others[:, j] = np.delete(own, j, axis=1).max(axis=1)
    return own, others


def assign(x: np.ndarray, state: dict[str, np.ndarray] | None, history: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The nearest centroid of each vector, the smaller number among equals, and bounds."""
    now, n = history[-1], len(history) - 1
    if state is None:
        zeros = np.zeros(len(x), dtype=np.int32)
        state = {"cluster": zeros, "upper": np.full(len(x), np.inf), "upper_round": zeros, "lower": np.full(len(x), -np.inf), "lower_round": zeros, "scans": zeros}
    out = {k: v.copy() for k, v in state.items()}
    own, others = ways(history)
    lower = out["lower"] - others[out["lower_round"], out["cluster"]]
    upper = out["upper"] + own[out["upper_round"], out["cluster"]]
    settled = lambda up, low: up * (1 + _SLACK) + _SLACK < low * (1 - _SLACK)
    doubt = np.flatnonzero(~settled(upper, lower))
    gap = x[doubt] - now[out["cluster"][doubt]]
    out["upper"][doubt] = np.sqrt(np.einsum("ij,ij->i", gap, gap).astype(np.float64))
    out["upper_round"][doubt] = n
    doubt = doubt[~settled(out["upper"][doubt], lower[doubt])]
    if len(doubt):
        all_ = squared(x[doubt], now)
        best = all_.argmin(axis=1)
        nearest = all_[np.arange(len(doubt)), best]
        all_[np.arange(len(doubt)), best] = np.iinfo(np.int64).max
        second = all_.min(axis=1) if len(now) > 1 else np.full(len(doubt), np.inf)
        out["cluster"][doubt] = best
        out["upper"][doubt], out["lower"][doubt] = np.sqrt(nearest.astype(np.float64)), np.sqrt(np.asarray(second, dtype=np.float64))
        out["upper_round"][doubt] = out["lower_round"][doubt] = n
        out["scans"][doubt] += 1
    return out


def _vectors(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _round(history: list[np.ndarray], dims: int, known: bool) -> Callable:
    names = ["cluster", "upper", "upper_round", "lower", "lower_round", "scans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names} if known else None
            after = assign(_vectors(batch.column("x"), dims), before, history)
            arrays = [pa.array(after[c], pa.float64() if c in ("upper", "lower") else pa.int32()) for c in names]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("x"), *arrays], names=["id", "x", *names])

    return run


def _distances(centroids: np.ndarray, dims: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster = batch.column("cluster").to_numpy(zero_copy_only=False)
            gap = _vectors(batch.column("x"), dims) - centroids[cluster]
            distance = pa.array(np.einsum("ij,ij->i", gap, gap))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("cluster"), distance, batch.column("scans")], names=["id", "cluster", "distance", "scans"]
            )

    return run


def moved(state: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """Floored means of the clusters; an empty one stays. The driver gets a row per cluster."""
    sums = [F.sum(F.get("x", F.lit(i))).alias(f"s{i}") for i in range(dims)]
    out = centroids.copy()
    for r in state.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums).collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dims)]
    return out


def cluster(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    dims: int = DIMS,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    seed: int = SEED,
) -> DataFrame:
    """One row per usable vector: identifier, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia``, ``centroid_sha256``, ``scans``.

    Usable are vectors with exactly ``dims`` components, none null, infinite
    or not a number; others give no row. Components become floor(scale * x),
    held within ``largest(dims)`` so that distances fit in a long. Rows that
    repeat an identifier are clustered one by one; ties in the first choice go
    to the smaller vector, a row without identifier is chosen last. With fewer
    usable vectors than clusters there are as many clusters as vectors; an
    empty table gives no rows. Other columns are ignored, so clashing names
    cannot matter. ``scans`` counts the rounds in which bounds did not settle a vector.
    """
    spark = df.sparkSession
    state, known = materialise(whole_vectors(df, id_col, vector_col, dims, scale), "vectors"), False
    history = [first_centroids(state, clusters, seed)]
    if not len(history[0]):
        return state.selectExpr(
            f"id AS `{id_col}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "0 AS scans"
        )
    for n in range(rounds + 1):
        after = materialise(map_arrow(state, _round(history, dims, known), _STATE), "assigned")
        discard(state)
        state, known = after, True
        if n < rounds:
            history.append(moved(state, history[-1], dims))
    last = history[-1]
    placed = materialise(map_arrow(state, _distances(last, dims), "id long, cluster int, distance long, scans int"), "placed")
    discard(state)
    sums = {r["cluster"]: int(r["s"]) for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    about = [
        (j, s, sum(sums.values()), hashlib.sha256(",".join(map(str, last[j].tolist())).encode()).hexdigest()) for j, s in sums.items()
    ]
    facts = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return placed.join(F.broadcast(facts), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "scans"
    )
