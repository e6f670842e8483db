"""Candidate rules for the busiest flows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wallflow.operators.dependencies import missing_references
from wallflow.operators.flows import KEYS, top_by_count
from wallflow.operators.rendering import render


def suggest_rules(
    flows: DataFrame,
    known: DataFrame,
    *,
    k: int = 10,
    action: str = "pass",
    slot: int = 9,
    position: int = 1,
    ranks: Sequence[int] | None = None,
    names: Mapping[int, str] | None = None,
    comments: Mapping[int, str] | None = None,
) -> DataFrame:
    """One rule per top flow: what it lacks, and its command if it can be built.

    ``ranks`` (1 is the busiest flow) chooses which of the ``k`` become rules;
    ``names`` and ``comments`` give the rules of some ranks a name or another
    comment. Only ``k`` rows get this far, so ranking them in one task is no burden.
    """
    wanted = [r for r in range(1, k + 1) if ranks is None or r in set(ranks)]
    top = top_by_count(flows, k).withColumn(
        "_row", F.row_number().over(Window.orderBy(F.desc("count"), *KEYS)).cast("long")
    )
    said = [(r, (names or {}).get(r, ""), (comments or {}).get(r)) for r in wanted]
    about = flows.sparkSession.createDataFrame(said, "_row long, rule_name string, _said string")
    top = top.join(F.broadcast(about), "_row")
    rules = top.select(
        "_row",
        *KEYS,
        "count",
        F.col("srcname").alias("from_src"),
        F.col("dstname").alias("to_dest"),
        F.col("dstportname").alias("service"),
        F.lit(action).alias("action"),
        "rule_name",
        F.coalesce("_said", F.concat(F.lit("Rule for "), F.col("srcname"), F.lit(" to "), F.col("dstname"))).alias("comment"),
        F.lit(position).cast("long").alias("position"),
    )
    fields = rules.select("_row", "rule_name", "from_src", "to_dest", "service", "action", "comment", "position", *KEYS, "count")
    missing = (
        missing_references(rules, known)
        .groupBy("_row")
        .agg(F.array_sort(F.collect_set(F.struct("kind", "name"))).alias("missing"))
    )
    commands = render(fields.drop("count"), "position", default_slot=slot, kind="FILTER", keep=("_row", *KEYS))
    counts = top.select("_row", "count")
    return (
        commands.join(counts, "_row")
        .join(missing, "_row", "left")
        .select(
            F.col("_row").alias("rank"),
            *KEYS,
            "count",
            "position",
            F.coalesce("missing", F.array().cast("array<struct<kind:string,name:string>>")).alias("missing"),
            "command",
            "error",
        )
    )
