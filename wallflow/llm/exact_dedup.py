"""Exact duplicates by a tree merge of sorted digest runs.

Every input partition makes a run: one row per digest with its smallest
identifier and its number of rows, sorted by digest. In each round neighbouring
runs are merged, ``FAN_IN`` at a time, until one run is left; a run is spread
over all tasks by digest, so no task ever holds one whole. Digests count as
equal only when SHA-256, length and a second hash all agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.llm.common import text_of
from wallflow.session import materialise

RUNS = 64
FAN_IN = 4
KEY = ["_sha", "_bytes", "_check"]


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def merge_runs(digests: DataFrame, runs: int = RUNS, fan_in: int = FAN_IN) -> DataFrame:
    """One row per digest: smallest ``_id`` and number of rows."""
    run = F.pmod(F.spark_partition_id(), F.lit(runs))
    level = digests.groupBy(run.alias("_run"), *KEY).agg(
        F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")
    )
    while runs > 1:
        runs = -(-runs // fan_in)
        level = (
            level.groupBy(F.floor(F.col("_run") / fan_in).alias("_run"), *KEY)
            .agg(F.min("_least").alias("_least"), F.sum("_n").alias("_n"))
            .sortWithinPartitions("_run", "_sha")
        )
    return level.drop("_run")


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` beside the identifier.

    A null text counts as empty, so null and blank texts form groups like any
    other. Of equal texts the smallest identifier stays; when an identifier
    repeats, each of its rows is reported alike. A group without any identifier
    has a null ``keep_id`` and keeps all of its rows. Empty input, empty result.
    """
    text = normalised(text_of(text_col))
    digests = materialise(
        df.select(F.col(id_col).alias("_id"), text.alias("_text")).select(
            "_id",
            F.unhex(F.sha2("_text", 256)).alias("_sha"),
            F.octet_length("_text").alias("_bytes"),
            F.xxhash64("_text").alias("_check"),
        ),
        "digests",
    )
    # Only groups of several rows need a lookup; a hot group is one row of the small side.
    groups = merge_runs(digests).filter(F.col("_n") > 1)
    return digests.join(groups, KEY, "left").select(
        F.col("_id").alias(id_col),
        F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_least")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_n").isNull() | (F.col("_id") == F.col("_least")), F.col("_least").isNull()).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )
