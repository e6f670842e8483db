"""Ordered text: a DataFrame of sort columns and ``line``, written in that order.

Lines are range-partitioned by the sort columns, so the part files read one
after the other are the text. Nothing passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ORDER = ["part", "ord", "sub"]


def fixed_lines(spark: SparkSession, part: int, lines: Sequence[str]) -> DataFrame:
    """A few literal lines as block ``part``."""
    rows = [(part, i, 0, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "part int, ord long, sub int, line string")


def block(df: DataFrame, part: int, order: str, *lines: Column) -> DataFrame:
    """One or more lines per row; a null line is left out."""
    numbered = [F.struct(F.lit(i).alias("sub"), line.alias("line")) for i, line in enumerate(lines)]
    return (
        df.select(F.col(order).cast("long").alias("ord"), F.explode_outer(F.array(*numbered)).alias("l"))
        .select(F.lit(part).alias("part"), "ord", "l.sub", "l.line")
        .filter(F.col("line").isNotNull())
    )


def stacked(*blocks: DataFrame) -> DataFrame:
    text = blocks[0]
    for more in blocks[1:]:
        text = text.unionByName(more)
    return text


def write_lines(text: DataFrame, path: str, order: Sequence[str] = tuple(ORDER), mode: str = "errorifexists") -> None:
    text.orderBy(*order).select("line").write.mode(mode).text(path)
