"""Rules of one set that another set does not have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wallflow.functions.fields import field_value, pick, rule_kind
from wallflow.operators.joins import fits_broadcast
from wallflow.operators.ordering import block_of, number_rows
from wallflow.operators.rendering import render
from wallflow.session import materialise

IDENTITY = ["id_source", "id_destination", "id_service", "id_action"]
PREFIX = "MissingRule-"


def with_identity(rules: DataFrame) -> DataFrame:
    """Add the four identity columns; values are compared exactly as written."""
    return rules.select(
        "*",
        field_value(rules, "from_src").alias("id_source"),
        field_value(rules, "to_dest").alias("id_destination"),
        field_value(rules, "service").alias("id_service"),
        pick(rules, ["action"]).alias("id_action"),
    )


def missing_identities(source: DataFrame, final: DataFrame) -> DataFrame:
    """Identities of ``source`` that ``final`` lacks, each with its first ``_row``.

    Both sets are grouped together, so there is one shuffle of rows that were
    already reduced to one per identity and map task, and no join whose hot
    keys would need care.
    """
    tagged = (
        with_identity(source)
        .select(*IDENTITY, "_row")
        .unionByName(with_identity(final).select(*IDENTITY, F.lit(None).cast("long").alias("_row")))
    )
    return (
        tagged.groupBy(*IDENTITY)
        .agg(F.min("_row").alias("_row"), F.count_if(F.col("_row").isNull()).alias("_in_final"))
        .filter(F.col("_in_final") == 0)
        .drop("_in_final")
    )


def missing_rules(source: DataFrame, final: DataFrame, *, start: int = 1) -> DataFrame:
    """Full rows of the missing rules in source order, with their ``position``.

    The first row of each missing identity is kept. Positions are consecutive.
    The thin table of identities is written out: numbering reads it twice, and
    should not compare the sets twice. The wide source stays where it is if the
    rows to keep can be broadcast. If not, only those of its blocks that hold
    one are moved.
    """
    missing = materialise(missing_identities(source, final).select("_row"), "identities")
    firsts = materialise(number_rows(missing, "_row", out="position", start=start), "positions")
    if fits_broadcast(firsts):
        return source.join(F.broadcast(firsts), "_row")
    blocks = materialise(firsts.select(block_of(F.col("_row")).alias("_block")).distinct(), "blocks")
    if fits_broadcast(blocks):
        source = source.withColumn("_block", block_of(F.col("_row"))).join(F.broadcast(blocks), "_block", "left_semi").drop("_block")
    return source.join(firsts, "_row")


def missing_rule_commands(source: DataFrame, final: DataFrame, *, slot: int = 9, start: int = 1) -> DataFrame:
    """Commands that add the rules of ``source`` missing from ``final``."""
    return commands_for_missing(missing_rules(source, final, start=start), slot=slot)


def commands_for_missing(missing: DataFrame, *, slot: int = 9) -> DataFrame:
    """Commands for the rows of ``missing_rules``. All are rendered as filter
    rules; ``kind`` says what the rule is. A rule that cannot be built keeps
    its position and shows the error instead.
    """
    rows = with_identity(missing)
    rows = rows.select("*", rule_kind(rows).alias("_kind"))
    return render(
        rows, "position", prefix=PREFIX, default_slot=slot, kind="FILTER", keep=("_row", "_kind", *IDENTITY)
    ).select("_row", "position", F.col("_kind").alias("kind"), *IDENTITY, "command", "error")
