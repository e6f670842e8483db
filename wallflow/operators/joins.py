"""Lookups that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wallflow.session import materialise

# A side is broadcast only after it was counted and found below both bounds.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20

# Keys with more rows than this are split over several tasks.
ROWS_PER_TASK = 1_000_000

# A sketch of key frequencies: as many keys in its memory, and as many reported
# at most. A key that it misses is as slow as any skewed key, not wrong.
TRACKED_KEYS = 100_000
MOST_HOT = 10_000


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is below both bounds. It is counted in full, by a sum of one row per task."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(0))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes")).first()
    return size["n"] <= max_rows and size["bytes"] <= max_bytes


def hot_keys(
    stats: DataFrame,
    keys: Sequence[str],
    n: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Every key to split, with its number of parts, from a table of rows per key."""
    parts = F.ceil(F.col(n) / rows_per_task).cast("int").alias("_parts")
    return stats.filter(F.col(n) > rows_per_task).select(*keys, parts)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    hot: DataFrame,
    spread: str,
    hot_by: Sequence[str] = (),
    **limits: int,
) -> DataFrame:
    """Equi-join whose hot keys are split by ``spread`` on the left side.

    ``right`` has one row per key; for a hot key it is repeated once per part.
    Right for inner, left, left_semi and left_anti. Keys must not be null.
    ``hot_by`` are the columns of ``hot`` if not the keys. The list of hot keys is broadcast if it fits; if not, it is joined by shuffle,
    where adaptive execution splits the left side.
    """
    keys, hot_by = list(keys), list(hot_by or keys)
    hot = materialise(hot, "hot-keys")
    hot = F.broadcast(hot) if fits_broadcast(hot, **limits) else hot
    part = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(
        F.pmod(F.xxhash64(spread), F.coalesce(F.col("_parts"), F.lit(1))).cast("int")
    )
    left = left.join(hot, hot_by, "left").withColumn("_part", part).drop("_parts")
    right = (
        right.join(hot, hot_by, "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return left.join(right, [*keys, "_part"], how).drop("_part")


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str,
    spread: str,
    small: bool | None = None,
    rows_per_task: int = ROWS_PER_TASK,
    **limits: int,
) -> DataFrame:
    """Join with a table of one row per key: broadcast if it fits, else salted.

    One pass writes the lookups and finds their hot keys by an approximate top-k sketch.
    ``small`` passes on the result of an earlier ``fits_broadcast``.
    """
    if fits_broadcast(right, **limits) if small is None else small:
        return left.join(F.broadcast(right), list(keys), how)
    # While the lookups are written for the join, a sketch finds the keys that many of them share.
    by_hash = F.xxhash64(*[F.col(k) for k in keys])
    seen = Observation()
    sketch = F.call_function("approx_top_k", by_hash, F.lit(MOST_HOT), F.lit(TRACKED_KEYS)).alias("top")
    left = materialise(left.observe(seen, sketch), "lookups")
    hot = [(r["item"], -(-r["count"] // rows_per_task)) for r in seen.get["top"] or [] if r["count"] > rows_per_task]
    table = left.sparkSession.createDataFrame(hot, "_key long, _parts int")
    out = salted_join(
        left.withColumn("_key", by_hash), right.withColumn("_key", by_hash), [*keys, "_key"], how, table, spread, ["_key"]
    )
    return out.drop("_key")
