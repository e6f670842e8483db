"""Command scripts and reports as ordered lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.functions.text import joined_reasons
from wallflow.operators.ordering import number_rows
from wallflow.plans.conversion import PENDING, SAFE
from wallflow.plans.duplicates import FILTER, NAT
from wallflow.sinks.lines import block, fixed_lines, stacked

# Texts of the scripts and reports.
HOST_TITLE = "# --- Objets Hôtes ---"
ACTIVATE = "CONFIG FILTER ACTIVATE"
PENDING_BANNER = [
    "######################################################################",
    "# WARNING: PENDING RULES                                           #",
    "# ------------------------------------------------------------------ #",
    "# The commands in this file have MISSING DEPENDENCIES.               #",
    "# They are provided for debugging purposes and are LIKELY TO FAIL if #",
    "# executed directly on a firewall without first creating the       #",
    "# missing objects or interfaces.                                     #",
    "######################################################################",
]
NOTHING_MISSING = "# No missing dependencies were found."
NO_DUPLICATES = "No duplicates detected."
FILTER_REMOVALS = "# Commands to delete duplicate filter rules"
NAT_REMOVALS = "# Commands to delete duplicate NAT rules"
ACTIVATE_TITLE = "# Activate the new filter policy"

GROUP_ORDER = ["first_file", "first_line", "first_row"]


def _break_after_ten(n: Column) -> Column:
    return F.when(n % 10 == 0, F.lit(""))


def safe_script(
    converted: DataFrame,
    hosts: DataFrame | None = None,
    *,
    sources: Sequence[str],
    generated_at: str,
    slot: int = 9,
    start: int = 1,
    activate: bool = True,
    group_by_10: bool = True,
) -> DataFrame:
    """Header, host objects, safe commands in position order, activation."""
    spark = converted.sparkSession
    safe = converted.filter(F.col("status") == SAFE)
    n_hosts = hosts.count() if hosts is not None else 0
    # The head of the script.
    header = [
        f"# Commands generated on {generated_at}",
        f"# Source CSVs: {', '.join(sources)}",
        f"# Number of commands: {n_hosts + safe.count()}",
        "SYSTEM SESSION language=fr",
        "MODIFY ON FORCE",
        f"CONFIG SLOT ACTIVATE type=filter slot={slot}",
        "",
    ]
    parts = [fixed_lines(spark, 0, header)]

    def with_breaks(n: Column) -> list[Column]:
        return [F.col("command"), *([_break_after_ten(n)] if group_by_10 else [])]

    if n_hosts:
        numbered = number_rows(hosts, "rank", out="n")
        parts += [fixed_lines(spark, 1, [HOST_TITLE]), block(numbered, 2, "n", *with_breaks(F.col("n")))]
        parts.append(fixed_lines(spark, 3, [""]))
    parts.append(block(safe, 4, "position", *with_breaks(F.col("position") - start + 1 + n_hosts)))
    if activate:
        parts.append(fixed_lines(spark, 5, ["", ACTIVATE]))
    return stacked(*parts)


def pending_script(converted: DataFrame, *, generated_at: str) -> DataFrame:
    """Every pending rule with its reasons and, if there is one, its command."""
    # The texts around a pending rule.
    reasons = joined_reasons(F.col("missing"))
    built = F.col("command").isNotNull()
    lacks = F.when(F.size("missing") > 0, F.concat(F.lit("Missing: "), reasons)).otherwise("")
    head = F.when(built, F.concat(F.lit("# PENDING: Missing dependencies: "), reasons)).otherwise(
        F.format_string("# PENDING: Rule from row %d could not be processed.", F.col("_row"))
    )
    why = F.when(~built, F.concat(F.lit("# "), lacks, F.lit(" Build error: "), F.col("error")))
    data = F.when(~built, F.concat(F.lit("# Original data: "), F.col("original")))
    return stacked(
        fixed_lines(converted.sparkSession, 0, [*PENDING_BANNER, "", f"# Generated on: {generated_at}"]),
        block(converted.filter(F.col("status") == PENDING), 1, "_row", head, F.col("command"), why, data, F.lit("")),
    )


def missing_list(missing: DataFrame, *, generated_at: str) -> DataFrame:
    """``KIND: name`` lines; sort by ``part, ord, kind, name``."""
    spark = missing.sparkSession
    # The head of the list.
    head = [f"# Missing dependencies found on {generated_at}", ""]
    if missing.isEmpty():
        head.append(NOTHING_MISSING)
    fixed = fixed_lines(spark, 0, head).select("part", "ord", F.lit("").alias("kind"), F.lit("").alias("name"), "line")
    names = missing.select(
        F.lit(1).alias("part"),
        F.lit(0).cast("long").alias("ord"),
        "kind",
        "name",
        F.concat_ws(": ", "kind", "name").alias("line"),
    )
    return stacked(fixed, names)


MISSING_ORDER = ["part", "ord", "kind", "name"]


def missing_rules_script(commands: DataFrame, *, generated_at: str) -> DataFrame:
    """Commands that add missing rules, a blank line after every tenth."""
    built = number_rows(commands.filter(F.col("command").isNotNull()), "position", out="n")
    head = [
        f"# Generated on {generated_at}",
        f"# {commands.filter(F.col('command').isNotNull()).count()} commands to add rules that are missing"
        " from the final configuration.",
        "",
    ]
    return stacked(
        fixed_lines(commands.sparkSession, 0, head), block(built, 1, "n", F.col("command"), _break_after_ten(F.col("n")))
    )


def unbuilt_rule_lines(commands: DataFrame) -> DataFrame:
    """One line for each missing rule that no command can be built for, with the reason."""
    line = F.format_string("# Row %d: %s", F.col("_row"), F.col("error"))
    return block(commands.filter(F.col("command").isNull()), 0, "position", line)


REPORT_ORDER = [*GROUP_ORDER, "sub", "file", "place", "_row"]


def duplicate_report(members: DataFrame, kind: str) -> DataFrame:
    """Markdown sections, one per signature; sort by ``REPORT_ORDER``."""
    members = members.filter(F.col("kind") == kind)
    first = members.orderBy(*GROUP_ORDER).select("first_row").first()
    place = ["file", "place", "_row"]
    if first is None:
        return members.sparkSession.createDataFrame(
            [("", 0, 0, 0, "", 0, 0, NO_DUPLICATES)],
            "first_file string, first_line long, first_row long, sub int, file string, place long, _row long, line string",
        )
    # Title and columns of a section.
    title = F.format_string(
        "### Duplicate - Signature: (Source: `%s`, Destination: `%s`, Port: `%s`, Protocol: `%s`, Action: `%s`)",
        "source", "destination", "port", "protocol", "action",
    )
    if kind == NAT:
        columns, rule = "| File | Line (File) | Line (NAT) | Rule Name |", "|---|---|---|---|"
        row = F.format_string("| `%s` | `%d` | `%d` | `%s` |", "file", "line", "nat_line", "name")
    else:
        columns, rule = "| File | Line | Rule Name |", "|---|---|---|"
        row = F.format_string("| `%s` | `%d` | `%s` |", "file", "line", "name")
    not_first = F.col("first_row") != first["first_row"]
    heading = [F.when(not_first, F.lit(t)) for t in ("", "---", "")] + [title, *map(F.lit, ("", columns, rule))]
    numbered = F.array(*[F.struct(F.lit(i).alias("sub"), t.alias("line")) for i, t in enumerate(heading)])
    headings = members.filter("is_kept").select(*GROUP_ORDER, *place, F.explode(numbered).alias("h"))
    headings = headings.select(*GROUP_ORDER, "h.sub", *place, "h.line").filter(F.col("line").isNotNull())
    rows = members.select(*GROUP_ORDER, F.lit(len(heading)).alias("sub"), *place, row.alias("line"))
    return stacked(headings, rows)


# Every removal shifts what stands behind it, so positions go from the bottom up.
REMOVAL_ORDER = ["part", "remove_order", *GROUP_ORDER, "file", "place", "_row"]


def removal_script(removals: DataFrame) -> DataFrame | None:
    """Commands that remove the copies, filter rules first; None if there are none.

    Sort by ``REMOVAL_ORDER``.
    """
    counts = {r["kind"]: r["count"] for r in removals.groupBy("kind").count().collect()}
    if not counts:
        return None
    keys = REMOVAL_ORDER[1:]

    def fixed(part: int, lines: Sequence[str]) -> DataFrame:
        rows = [(part, 0, "", 0, i, "", 0, 0, line) for i, line in enumerate(lines)]
        return removals.sparkSession.createDataFrame(
            rows,
            "part int, remove_order long, first_file string, first_line long, first_row long, file string, place long,"
            " _row long, line string",
        )

    parts = []
    for part, (kind, title) in enumerate([(FILTER, FILTER_REMOVALS), (NAT, NAT_REMOVALS)]):
        if kind in counts:
            parts.append(fixed(2 * part, [title] if not parts else ["", title]))
            commands = removals.filter(F.col("kind") == kind)
            parts.append(commands.select(F.lit(2 * part + 1).alias("part"), *keys, F.col("command").alias("line")))
    return stacked(*parts, fixed(4, ["", ACTIVATE_TITLE, ACTIVATE]))


def suggested_rule_lines(suggestions: DataFrame, *, generated_at: str) -> DataFrame:
    """The suggested rules that can be built, each under a dated comment."""
    # Fixed value: the comment above a suggested rule.
    note = F.lit(f"# Rule generated from log analysis on {generated_at}")
    return block(suggestions.filter(F.col("command").isNotNull()), 0, "rank", note, F.col("command"), F.lit(""))
