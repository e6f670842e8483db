"""Row numbers and running totals without a single-partition sort of the rows.

Rows are grouped into blocks of consecutive order keys. Running totals are
taken inside each block (one shuffle, at most ``2**BLOCK_BITS`` keys per
group), and the totals of the blocks before are added from a thin table with
one row per block. Keys must be unique longs, so a block cannot be skewed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallflow.operators.joins import fits_broadcast
from wallflow.session import materialise

BLOCK_BITS = 14
GROUP_BITS = 24

_BEFORE = (Window.unboundedPreceding, -1)


def block_of(order: Column, bits: int = BLOCK_BITS) -> Column:
    """Block of an order key. Works for negative keys as well."""
    return F.shiftright(order.cast("long"), bits)


def block_offsets(block_totals: DataFrame, group_bits: int = GROUP_BITS) -> DataFrame:
    """``(_block, _total)`` to ``(_block, _offset)``: the sum over earlier blocks.

    Sparse keys can give nearly as many blocks as rows, so blocks are grouped
    once more: no window sees more than ``2**group_bits`` two-long rows.
    """
    grouped = block_totals.withColumn("_group", F.shiftright("_block", group_bits))
    groups = grouped.groupBy("_group").agg(F.sum("_total").alias("_group_total"))
    before_group = Window.orderBy("_group").rowsBetween(*_BEFORE)
    groups = groups.select(
        "_group", F.coalesce(F.sum("_group_total").over(before_group), F.lit(0)).alias("_group_offset")
    )
    before_block = Window.partitionBy("_group").orderBy("_block").rowsBetween(*_BEFORE)
    return (
        grouped.withColumn("_inside", F.coalesce(F.sum("_total").over(before_block), F.lit(0)))
        .join(groups, "_group")
        .select("_block", (F.col("_inside") + F.col("_group_offset")).alias("_offset"))
    )


def running_total_before(
    df: DataFrame, order: str, amount: Column, out: str, bits: int = BLOCK_BITS
) -> DataFrame:
    """Add ``out``: the sum of ``amount`` over all rows with a smaller ``order``."""
    rows = df.withColumn("_block", block_of(F.col(order), bits)).withColumn("_amount", amount.cast("long"))
    totals = rows.groupBy("_block").agg(F.sum("_amount").alias("_total"))
    return add_offsets(rows, block_offsets(totals), order, out).drop("_amount", "_block")


def add_offsets(rows: DataFrame, offsets: DataFrame, order: str, out: str) -> DataFrame:
    """Running total of ``_amount`` before each row, given the block offsets."""
    before = Window.partitionBy("_block").orderBy(order).rowsBetween(*_BEFORE)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("_amount").over(before), F.lit(0)))
        .join(offsets, "_block")
        .withColumn(out, F.col("_inside") + F.col("_offset"))
        .drop("_inside", "_offset")
    )


def number_rows(df: DataFrame, order: str, out: str = "_row", start: int = 1, bits: int = BLOCK_BITS) -> DataFrame:
    """Add ``out``: dense row numbers from ``start`` in the order of a unique long column."""
    counted = running_total_before(df, order, F.lit(1), "_before", bits)
    return counted.withColumn(out, F.col("_before") + F.lit(start)).drop("_before")


def number_file_rows(df: DataFrame, file_order: DataFrame, header_rows: int = 0) -> DataFrame:
    """Number the rows of a file scan without moving them.

    ``df`` carries ``_path``, ``_start`` (the split's offset in its file) and
    ``_seq`` (increasing inside a split). Adds ``_line``, counted in each file
    from 1 after ``header_rows`` leading rows, and ``_row``, counted over all
    files in the order given by ``file_order (_path, _file_order)``, whose
    other columns are added; header rows get a ``_line`` below 1. One pass counts the rows of each split; that
    table has a row per split, as Spark's own list of them on the driver, and
    is broadcast if its size allows. Otherwise rows are shuffled by split.
    """
    splits = materialise(
        df.groupBy("_path", "_start").agg(F.min("_seq").alias("_base"), F.count(F.lit(1)).alias("_n")), "splits"
    )
    in_file = Window.partitionBy("_path").orderBy("_start").rowsBetween(*_BEFORE)
    splits = splits.withColumn("_in_file", F.coalesce(F.sum("_n").over(in_file), F.lit(0)))
    files = splits.groupBy("_path").agg((F.sum("_n") - header_rows).alias("_rows")).join(file_order, "_path")
    files = files.withColumn(
        "_in_set", F.coalesce(F.sum("_rows").over(Window.orderBy("_file_order").rowsBetween(*_BEFORE)), F.lit(0))
    )
    about = [c for c in file_order.columns if c not in ("_path", "_file_order")]
    offsets = splits.join(files.select("_path", "_in_set", *about), "_path").select(
        "_path", "_start", "_base", "_in_file", "_in_set", *about
    )
    offsets = F.broadcast(offsets) if fits_broadcast(offsets) else offsets
    return (
        df.join(offsets, ["_path", "_start"])
        .withColumn("_line", F.col("_seq") - F.col("_base") + F.col("_in_file") + 1 - header_rows)
        .withColumn("_row", F.col("_line") + F.col("_in_set"))
        .drop("_base", "_in_file", "_in_set")
    )


def nth_row(df: DataFrame, order: str, n: int, bits: int = BLOCK_BITS) -> int | None:
    """Order key of the ``n``-th row (from 1), or None when there are fewer."""
    rows = df.select(F.col(order).alias("_key"), block_of(F.col(order), bits).alias("_block"))
    totals = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_total"))
    block = (
        block_offsets(totals)
        .join(totals, "_block")
        .filter((F.col("_offset") < n) & (F.col("_offset") + F.col("_total") >= n))
        .first()
    )
    if block is None:
        return None
    inside = rows.filter(F.col("_block") == block["_block"]).withColumn(
        "_n", F.row_number().over(Window.partitionBy("_block").orderBy("_key"))
    )
    return inside.filter(F.col("_n") == n - block["_offset"]).first()["_key"]
