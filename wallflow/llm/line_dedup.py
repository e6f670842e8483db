"""Line deduplication by site-relative frequency.

Rows are grouped by host. A line's share is the number of the host's pages that
contain it, over all pages of the host; lines above ``BOILERPLATE_RATIO`` are
dropped. Pages of one host with equal text count as one page, so a page does
not turn into boilerplate by being copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.llm.common import small_enough, text_of
from wallflow.session import materialise

BOILERPLATE_RATIO = 0.05
MIN_PAGES = 3


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.btrim(line))


def boilerplate_lines(
    df: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = BOILERPLATE_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """``(host, line, pages, ratio)`` of the lines to drop; ``line`` is a hash, a null host is ``''``.

    A line must stand on ``min_pages`` pages at least. Blank lines never count.
    """
    pages = df.select(F.coalesce(F.col(host_col), F.lit("")).alias("host"), text_of(text_col).alias("_text"))
    pages = pages.withColumn("_page", F.xxhash64("_text"))
    hosts = pages.select("host", "_page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("_total"))
    filled = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x) != "")
    lines = pages.select("host", "_page", F.explode(F.array_distinct(F.transform(filled, _line_key))).alias("line"))
    counts = lines.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    # Most lines stand on one page and are gone before the join.
    return (
        counts.filter(F.col("pages") >= min_pages)
        .join(hosts, "host")
        .withColumn("ratio", F.col("pages") / F.col("_total"))
        .filter(F.col("ratio") > ratio)
        .drop("_total")
    )


def drop_boilerplate(
    df: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    id_col: str = "doc_id",
    ratio: float = BOILERPLATE_RATIO,
    min_pages: int = MIN_PAGES,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Every row of ``df`` with its text cleaned, plus ``lines_dropped``.

    Remaining lines keep their order and blank lines stay. A text that loses
    all its lines is empty, a null text stays null, and the row stays. A table
    of lines too large to broadcast is joined by shuffle, one row per line of
    text, with hot lines split over tasks. ``lines_dropped`` replaces a column
    of that name; equal rows are cleaned alike; an empty table stays empty.
    """
    columns = [c for c in df.columns if c != "lines_dropped"]
    known = materialise(boilerplate_lines(df, host_col, text_col, ratio, min_pages), "boilerplate")
    host = F.coalesce(F.col(host_col), F.lit(""))
    small = small_enough(known) if broadcast_rows is None else small_enough(known, broadcast_rows)
    if small:
        sets = known.groupBy(F.col("host").alias("_host")).agg(F.collect_set("line").alias("_drop"))
        rows = df.select(*columns, host.alias("_host")).join(F.broadcast(sets), "_host", "left")
        listed = lambda x: F.array_contains("_drop", _line_key(x))
    else:
        lines = F.array_distinct(F.transform(F.split(text_of(text_col), "\n"), _line_key))
        rows = df.select(*columns, host.alias("_host"), F.xxhash64(host, text_of(text_col)).alias("_page"))
        found = (
            rows.select(F.col("_host").alias("host"), "_page", F.explode(lines).alias("line"))
            .distinct()
            .join(known.select("host", "line"), ["host", "line"])
            .groupBy("_page")
            .agg(F.collect_set("line").alias("_drop"))
        )
        rows = rows.join(found, "_page", "left")
        listed = lambda x: F.array_contains("_drop", _line_key(x))
    # Only the texts of hosts with such lines are taken apart.
    lines = F.split(text_col, "\n")
    kept = F.filter(lines, lambda x: (F.btrim(x) == "") | ~listed(x))
    touched = F.col("_drop").isNotNull()
    return rows.select(
        *[F.when(touched, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c)
          for c in columns],
        F.when(touched & F.col(text_col).isNotNull(), F.size(lines) - F.size(kept)).otherwise(0).cast("long")
        .alias("lines_dropped"),
    )
