"""Flow tables and summaries as files."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from wallflow.functions.fields import named
from wallflow.operators.flows import flow_totals, sorted_flows, top_by_count, top_by_traffic
from wallflow.sinks.lines import fixed_lines

TOTALS = ["total_rcvd", "total_sent"]
SUMMARY_COLUMNS = ["rule_name", "from_src", "to_dest", "service", "action", "comment"]

_CSV = {"header": True, "escape": '"', "emptyValue": "", "nullValue": ""}


def whole_columns(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """Those of the columns that hold whole numbers only."""
    checks = [F.coalesce(F.every(F.col(c) == F.floor(c)), F.lit(True)).alias(c) for c in columns]
    row = df.agg(*checks).first()
    return {c for c in columns if row[c]}


def write_flows(flows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Flow table as CSV in key order. Whole totals are written without decimals."""
    whole = whole_columns(flows, TOTALS)
    # A decimal loses the zeros on its end, but for one place.
    exact = [c for c in TOTALS if isinstance(flows.schema[c].dataType, DecimalType)]
    shown = {
        **{c: F.regexp_replace(F.col(c).cast("string"), r"(\.[0-9]+?)0+$", "$1") for c in exact},
        **{c: F.col(c).cast("decimal(38,0)") for c in whole},
        **{c: F.col(c).cast("string") for c in ("min_time", "max_time")},
    }
    out = sorted_flows(flows).select(*[shown.get(c, named(c)).alias(c) for c in flows.columns])
    out.write.mode(mode).options(**_CSV).csv(path)


def _table(rows: Sequence[Row], columns: Sequence[str]) -> str:
    """A few rows as right-aligned text columns, numbers with a wider gap."""
    texts, gaps = [], []
    for c in columns:
        values = [r[c] for r in rows]
        numeric = any(isinstance(v, int | float | Decimal) for v in values)
        if any(isinstance(v, float | Decimal) for v in values):
            if all(v == int(v) for v in values):
                values = [int(v) for v in values]
            else:
                shown = [f"{v:.6f}".rstrip("0") for v in values]
                places = max(1, *(len(s.split(".")[1]) for s in shown))
                values = [f"{v:.{places}f}" for v in values]
        texts.append([c, *map(str, values)])
        gaps.append("  " if numeric and texts[1:] else " " if texts[1:] else "")
    widths = [max(map(len, column)) for column in texts]
    return "\n".join(
        "".join(gap + cell.rjust(width) for gap, cell, width in zip(gaps, line, widths)) for line in zip(*texts)
    )


def summary_text(flows: DataFrame, k: int = 10) -> str:
    """Totals and the two top-``k`` tables; only ``k`` rows of each are fetched."""
    totals = flow_totals(flows).first()
    by_count, by_traffic = top_by_count(flows, k), top_by_traffic(flows, k)
    return "\n".join([
        "Firewall Log Analysis Summary",
        "=" * 30,
        f"Total rows processed: {totals['rows_processed']}",
        f"Total unique flows identified: {totals['unique_flows']}",
        "",
        f"Top {k} Flows by Count:",
        "-" * 25,
        _table(by_count.collect(), by_count.columns),
        "",
        f"Top {k} Flows by Total Traffic (Received + Sent):",
        "-" * 50,
        _table(by_traffic.collect(), by_traffic.columns),
    ])


def write_summary(flows: DataFrame, path: str, k: int = 10, mode: str = "errorifexists") -> None:
    text = fixed_lines(flows.sparkSession, 0, summary_text(flows, k).split("\n"))
    text.coalesce(1).select("line").write.mode(mode).text(path)


def write_missing_summary(rows: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """The descriptive columns that the missing rules have, as ``;`` CSV."""
    columns = [c for c in SUMMARY_COLUMNS if c in rows.columns]
    if columns:
        rows.orderBy("_row").select(*columns).write.mode(mode).options(**_CSV, sep=";").csv(path)
    return bool(columns)
