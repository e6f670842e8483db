"""Log cleaning, one row per flow, and the top-k reports over flows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wallflow.functions.fields import named
from wallflow.operators.joins import fits_broadcast
from wallflow.session import materialise

KEYS = ["srcname", "dstname", "dstportname"]
REQUIRED = [*KEYS, "time", "rcvd", "sent"]
MEASURES = ["count", "min_time", "max_time", "total_rcvd", "total_sent"]

# Texts that mean "no value" in a log cell.
NULL_WORDS = [
    "", "NA", "N/A", "n/a", "NULL", "null", "NaN", "nan", "None", "<NA>", "#N/A", "#NA",
    "-nan", "-NaN", "1.#IND", "1.#QNAN", "-1.#IND", "-1.#QNAN", "#N/A N/A",
]

# Volumes that must stay exact.
EXACT = "decimal(38,6)"

# Patterns of times that a vote chooses from beside ISO; among equals the first wins.
TIME_PATTERNS = [
    "dd/MM/yyyy HH:mm:ss", "MM/dd/yyyy HH:mm:ss", "yyyy/MM/dd HH:mm:ss", "dd-MM-yyyy HH:mm:ss", "dd.MM.yyyy HH:mm:ss",
    "dd MMM yyyy HH:mm:ss", "MMM dd yyyy HH:mm:ss", "dd/MMM/yyyy:HH:mm:ss", "dd/MM/yyyy HH:mm", "MM/dd/yyyy HH:mm",
]

_NUMBER = r"^\s*[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity))\s*\z"


def check_columns(logs: DataFrame) -> None:
    """Raise for the first required log column that is absent."""
    for column in REQUIRED:
        if column not in logs.columns:
            raise ValueError(f"required log column {column!r} is absent")


def null_words_to_null(c: Column) -> Column:
    # A long text is none of them, and need not be hashed to know it.
    longest = max(len(w.encode()) for w in NULL_WORDS)
    return F.when((F.octet_length(c) > longest) | ~c.isin(NULL_WORDS), c)


def as_number(df: DataFrame, column: str, exact: bool = False) -> Column:
    """Double; text that is not a plain number, null and NaN count as 0.

    ``exact`` gives a decimal with six places instead, in which whole numbers
    of any size stay whole; infinite values count as 0 there.
    """
    c = named(column)
    if exact:
        value = c.try_cast(EXACT)
        if isinstance(df.schema[column].dataType, T.StringType):
            value = F.when(c.rlike(_NUMBER), F.trim(c).try_cast(EXACT))
        return F.coalesce(value, F.lit(0).cast(EXACT))
    if isinstance(df.schema[column].dataType, T.StringType):
        value = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    else:
        value = c.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def as_time(df: DataFrame, column: str, formats: Sequence[str] = ()) -> Column:
    """Timestamp, ISO first and then the given patterns; null when none fits."""
    c = named(column)
    if not isinstance(df.schema[column].dataType, T.StringType):
        return c
    tries = [c.try_cast("timestamp_ntz")]
    tries += [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tries)


def voted_times(logs: DataFrame, patterns: Sequence[str], by: str, column: str = "time") -> DataFrame:
    """``logs`` with times by the one pattern, ISO or of ``patterns``, that fits most rows of equal ``by``; others are null.

    One aggregate counts the fits of every pattern; among equals the earlier
    wins, ISO first. The winners, a row for each value of ``by``, are broadcast
    if they fit. Of a column of times nothing changes.
    """
    if not isinstance(logs.schema[column].dataType, T.StringType):
        return logs
    text = named(column)
    read = [text.try_cast("timestamp_ntz"), *[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in patterns]]
    fits = logs.groupBy(named(by).alias("_voter")).agg(*[F.count(t).alias(f"_n{i}") for i, t in enumerate(read)])
    # The greatest count, and the least place among those that have it.
    best = F.array_max(F.array(*[F.struct(F.col(f"_n{i}").alias("n"), F.lit(-i).alias("place")) for i in range(len(read))]))
    winners = materialise(fits.select("_voter", (-best["place"]).alias("_winner")), "time-formats")
    winners = F.broadcast(winners) if fits_broadcast(winners) else winners
    time = F.coalesce(*[F.when(F.col("_winner") == i, t) for i, t in enumerate(read)])
    joined = logs.join(winners, named(by).eqNullSafe(F.col("_voter")), "left")
    return joined.select(*[time.alias(c) if c == column else named(c) for c in logs.columns])


def clean_logs(
    logs: DataFrame, time_formats: Sequence[str] = (), exact: bool = False, vote_by: str | None = None
) -> DataFrame:
    """Typed log rows; those without a key or a valid time are dropped.

    With ``vote_by``, a column such as the path of the file, rows that share its
    value are read by one time pattern, see ``voted_times``; the candidates are
    ``time_formats``, or ``TIME_PATTERNS`` if none are given. Without, each row
    takes the first pattern that fits it.
    """
    check_columns(logs)
    if vote_by is not None:
        logs = voted_times(logs, time_formats or TIME_PATTERNS, vote_by)
    typed = {
        "time": as_time(logs, "time", time_formats),
        "rcvd": as_number(logs, "rcvd", exact),
        "sent": as_number(logs, "sent", exact),
    }
    cleaned = logs.select(*[typed.get(c, named(c)).alias(c) for c in logs.columns])
    return cleaned.dropna(subset=[*KEYS, "time"])


def flow_rollup(
    logs: DataFrame,
    tie_break: Sequence[str] = (),
    time_formats: Sequence[str] = (),
    exact: bool = False,
    vote_by: str | None = None,
) -> DataFrame:
    """One row per (source, destination, port): counts, times, volumes, firsts.

    Every further column ``x`` becomes ``x_first``, its first non-null value in
    time order. Rows with equal times are ordered by ``tie_break`` columns
    (which are not reported), and without any by the value itself, so the
    result never depends on how the rows were partitioned. ``exact`` sums
    volumes as decimals, so totals beyond 2**53 and their order do not matter.
    ``vote_by`` finds the time pattern of each file, see ``clean_logs``.

    One shuffle. Each map task sends one row per flow it saw, so a flow that
    owns a large share of the log does not overload the task that finishes it.
    """
    cleaned = clean_logs(logs, time_formats, exact, vote_by)
    extras = sorted(
        (c for c in cleaned.columns if c not in REQUIRED and c not in tie_break), key=lambda c: f"{c}_first"
    )

    def first_value(c: str) -> Column:
        when_seen = F.struct(F.col("time"), *[named(t) for t in (tie_break or [c])])
        seen = named(c).isNotNull()
        # min_by skips rows whose ordering is null.
        return F.min_by(named(c), F.when(seen, when_seen)).alias(f"{c}_first")

    return cleaned.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("count"),
        F.min("time").alias("min_time"),
        F.max("time").alias("max_time"),
        F.sum("rcvd").alias("total_rcvd"),
        F.sum("sent").alias("total_sent"),
        *[first_value(c) for c in extras],
    )


def with_traffic(flows: DataFrame) -> DataFrame:
    return flows.withColumn("total_traffic", F.col("total_rcvd") + F.col("total_sent"))


def flow_totals(flows: DataFrame) -> DataFrame:
    """Rows behind the flows and number of flows, from the flow table alone."""
    return flows.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows_processed"), F.count(F.lit(1)).alias("unique_flows")
    )


def top_by_count(flows: DataFrame, k: int = 10) -> DataFrame:
    return flows.orderBy(F.desc("count"), *KEYS).limit(k).select(*KEYS, "count")


def top_by_traffic(flows: DataFrame, k: int = 10) -> DataFrame:
    return (
        with_traffic(flows)
        .orderBy(F.desc("total_traffic"), *KEYS)
        .limit(k)
        .select(*KEYS, "total_traffic", "total_rcvd", "total_sent")
    )


def sorted_flows(flows: DataFrame) -> DataFrame:
    return flows.orderBy(*KEYS)
