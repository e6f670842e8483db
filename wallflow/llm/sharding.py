"""Sharding by sampled splitters.

Records are ordered by a key (a hash of the text, then the identifier), so
equal texts lie side by side. A size-weighted sample of keys gives quantile
boundaries, the records are range-partitioned by them, and ranges that turn
out overfull are subdivided by boundaries sampled inside them. Only tables of
one row per range are ever totalled in one task; their number is a parameter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallflow.session import materialise

# Ranges per shard, sampled keys per range, and the load above which a range is subdivided.
RANGES_PER_SHARD = 16
SAMPLES_PER_RANGE = 24
OVERFULL = 2.0
SPLIT_ROUNDS = 2

# Hash values are compared with a probability scaled to this many steps.
_STEPS = 1 << 30


def _sampled(rows: DataFrame, probability: Column, salt: int) -> DataFrame:
    """Rows taken with the given probability; the same rows on every attempt."""
    draw = F.pmod(F.xxhash64(F.lit(salt), "_key"), F.lit(_STEPS))
    return rows.filter(draw < probability * _STEPS)


def _quantiles(sample: DataFrame, parts: int) -> list:
    """Keys that cut a bounded sample into ``parts`` equal runs."""
    keys = [r["_key"] for r in sample.select("_key").orderBy("_key").collect()]
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def _range_of(key: Column, bounds: list) -> Column:
    """Number of boundaries at or below the key: first among every 32nd, then among the 32 there."""
    if not bounds:
        return F.lit(0)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b <= key))

    # One constant for all boundaries keeps the plan small.
    keys = [[{"h": k["h"], "i": k["i"]} for k in bounds[at : at + 32]] for at in range(0, len(bounds), 32)]
    fine = F.from_json(F.lit(json.dumps(keys)), "array<array<struct<h: bigint, i: bigint>>>")
    block = below(F.from_json(F.lit(json.dumps([k[0] for k in keys])), "array<struct<h: bigint, i: bigint>>"))
    inside = below(F.element_at(fine, block))
    return F.when(block == 0, F.lit(0)).otherwise((block - 1) * 32 + inside)


def shard_rows(
    df: DataFrame,
    shards: int = 16,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranges_per_shard: int = RANGES_PER_SHARD,
) -> DataFrame:
    """Add ``size``, ``text_crc32``, ``shard`` and ``slot`` for shards of near equal bytes.

    A row weighs the UTF-8 bytes of its text plus one; a null text has none.
    Equal texts get neighbouring places and so share a shard unless a shard's
    end falls between them. Shard sizes differ by at most about one row.
    Slots count from 0 without gaps inside a shard. Null identifiers come first
    among equal texts; fully equal rows get places next to each other. An empty
    table gives an empty result. The text is dropped before the shuffle; other
    columns are kept, and any named like an added one is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    added = ["size", "text_crc32", "shard", "slot"]
    kept = [c for c in df.columns if c not in (text_col, *added)]
    rows = materialise(
        df.select(
            *[F.col(c) for c in kept],
            (F.octet_length(text).cast("long") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.struct(F.xxhash64(text).alias("h"), F.col(id_col).cast("long").alias("i")).alias("_key"),
        ),
        "shard-rows",
    )
    ranges = shards * ranges_per_shard
    total = rows.agg(F.sum("size").alias("n")).first()["n"] or 0
    wanted = ranges * SAMPLES_PER_RANGE
    weight = F.col("size").cast("double") * wanted / max(total, 1)
    bounds = _quantiles(_sampled(rows, weight, 1), ranges)
    for turn in range(SPLIT_ROUNDS):
        bounds = sorted(set(bounds), key=lambda k: (k["h"], k["i"] is not None, k["i"] or 0))
        ranged = rows.withColumn("_range", _range_of(F.col("_key"), bounds))
        loads = ranged.groupBy("_range").agg(F.sum("size").alias("n")).collect()
        over = {r["_range"]: r["n"] for r in loads if r["n"] > OVERFULL * total / ranges}
        if not over:
            break
        hot = ranged.filter(F.col("_range").isin(list(over)))
        extra = _quantiles(_sampled(hot, weight * 4, 2 + turn), 4 * len(over))
        if not extra:
            break
        bounds += extra
    bounds = sorted(set(bounds), key=lambda k: (k["h"], k["i"] is not None, k["i"] or 0))
    ranged = rows.withColumn("_range", _range_of(F.col("_key"), bounds))
    ordered = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        ranged.groupBy("_range")
        .agg(F.sum("size").alias("_bytes"))
        .select("_range", F.coalesce(F.sum("_bytes").over(ordered), F.lit(0)).alias("_start"))
    )
    inside = Window.partitionBy("_range").orderBy("_key", *sorted(kept)).rowsBetween(Window.unboundedPreceding, 0)
    # One row per range, and the number of ranges is bounded by the parameters.
    middle = F.col("_start") + F.sum("size").over(inside) - F.col("size") / 2
    placed = materialise(
        ranged.join(F.broadcast(starts), "_range").withColumn(
            "shard", F.least(F.floor(middle * shards / max(total, 1)), F.lit(shards - 1)).cast("int")
        ),
        "shard-placed",
    )
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_range", "shard")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select("_range", "shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    place = F.row_number().over(Window.partitionBy("_range", "shard").orderBy("_key", *sorted(kept)))
    return (
        placed.withColumn("_place", place)
        .join(F.broadcast(offsets), ["_range", "shard"])
        .withColumn("slot", (F.col("_offset") + F.col("_place") - 1).cast("long"))
        .select(*kept, *added)
    )
