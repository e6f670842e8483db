"""Rule set to commands: which rules are safe, at which position, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallflow.functions.fields import is_separator
from wallflow.functions.net import host_object_name
from wallflow.operators import ordering
from wallflow.operators.dependencies import references
from wallflow.operators.hosts import host_addresses
from wallflow.operators.joins import fits_broadcast, lookup_join
from wallflow.operators.rendering import (
    MAX_DIGITS,
    build_error,
    command_parts,
    digits_of,
    dropped_service,
    finished_command,
)
from wallflow.session import materialise

SAFE, PENDING = "SAFE", "PENDING"
BEFORE = "safe_before_in_block"
_RULE = "RULE"
_NAMES = "array<struct<kind:string,name:string>>"
_HOST_NAME = "^H_[0-9]{1,3}(?:_[0-9]{1,3}){3}\\z"
# What decides if a rule is safe, and what is only needed to show it. The second
# group travels as one value, which the counting pass does not read at all.
_DECIDES = ["error", "fits_digits"]
_SHOWN = ["kind", "cmd_head", "cmd_name", "cmd_rest", "name_auto", "dropped_service", "original"]


def checked_rules(
    rules: DataFrame, known: DataFrame, *, default_slot: int = 9, prefix: str = "", create_hosts: bool = False
) -> DataFrame:
    """Command parts and missing names of every rule that is no separator.

    The rules are scanned once and shuffled once, by block of consecutive rows,
    while they are still raw. All that follows keeps that partitioning: each
    row becomes its command parts and the names it needs, the names go through
    an anti join with the broadcast universe, what is missing is gathered per
    row, and the numbering runs inside the blocks. Only a universe too large
    to broadcast, or hosts to create, cost further shuffles: the names alone are
    taken from a scan of their own and looked up, and those that are missing
    come to the blocks, where the rules wait for them.
    """
    hosts = materialise(host_addresses(rules), "hosts") if create_hosts else None
    source_columns = [c for c in rules.columns if not c.startswith("_")]
    small = fits_broadcast(known)
    thin = not small or hosts is not None
    rules = scanned = rules.filter(~is_separator(rules)).withColumn("_block", ordering.block_of(F.col("_row")))
    rules = rules.repartition("_block").select(
        "*",
        (F.array().cast(_NAMES) if thin else references(rules)).alias("_references"),
        dropped_service(rules).alias("dropped_service"),
        F.to_json(F.struct(*[F.col(f"`{c}`") for c in source_columns])).alias("_original"),
    )
    parts = command_parts(
        rules,
        default_slot=default_slot,
        prefix=prefix,
        hosts=hosts,
        keep=("_block", "_row", "_references", "dropped_service", "_original"),
    )
    # The source row is shown only where a command may be impossible.
    original = F.when(F.col("error").isNotNull() | (F.col("fits_digits") < MAX_DIGITS), F.col("_original"))
    parts = parts.withColumn("original", original)
    carrier = F.array(F.struct(F.lit(_RULE).alias("kind"), F.col("_row").cast("string").alias("name")))
    # Never empty; explode() would only add an inferred filter on the whole array.
    needs = parts.select("*", F.explode_outer(F.concat(carrier, F.col("_references"))).alias("_need"))
    is_rule = F.col("_need.kind") == _RULE
    needs = needs.select(
        "_block",
        "_row",
        F.col("_need.kind").alias("need_kind"),
        F.col("_need.name").alias("need_name"),
        *[F.when(is_rule, F.col(c)).alias(c) for c in _DECIDES],
        F.when(is_rule, F.struct(*_SHOWN)).alias("_shown"),
    )
    known = known.select(F.col("kind").alias("need_kind"), F.col("name").alias("need_name"))
    looked_up = needs
    if thin:
        # explode() would have Spark infer a size filter and so evaluate the array twice.
        named = scanned.select("_block", "_row", F.explode_outer(references(scanned)).alias("_need"))
        looked_up = named.select("_block", "_row", F.col("_need.kind").alias("need_kind"), F.col("_need.name").alias("need_name"))
        looked_up = looked_up.filter(F.col("need_name").isNotNull())
    unmet = lookup_join(looked_up, known, ["need_kind", "need_name"], "left_anti", "_row", small)
    if hosts is not None:
        unmet = _without_generated_hosts(unmet, hosts)
    if thin:
        unmet = needs.unionByName(unmet.repartition("_block"), allowMissingColumns=True)
    missing = F.when(
        F.col("need_kind") != _RULE, F.struct(F.col("need_kind").alias("kind"), F.col("need_name").alias("name"))
    )
    gathered = unmet.groupBy("_block", "_row").agg(
        *[F.any_value(c, True).alias(c) for c in [*_DECIDES, "_shown"]],
        F.array_sort(F.collect_set(missing)).alias("missing"),
    )
    return gathered.select("_block", "_row", *_DECIDES, "missing", *[F.col(f"_shown.{c}") for c in _SHOWN])


def _without_generated_hosts(unmet: DataFrame, hosts: DataFrame) -> DataFrame:
    """Drop needs that a generated host object will satisfy.

    Only names of that form can match; every other row gets a key of its own
    so that they spread over all tasks.
    """
    may_match = (F.col("need_kind") == "OBJECT") & F.col("need_name").rlike(_HOST_NAME)
    key = F.when(may_match, F.col("need_name")).otherwise(
        F.concat_ws("|", F.lit("-"), F.col("_row").cast("string"), F.col("need_kind"), F.col("need_name"))
    )
    names = hosts.select(host_object_name(F.col("ip")).alias("_key"))
    return lookup_join(unmet.withColumn("_key", key), names, ["_key"], "left_anti", "_row").drop("_key")


def _candidate(digits: int) -> Column:
    """Nothing missing, no error, and room for at least this many digits."""
    return (
        (F.size("missing") == 0) & F.col("error").isNull() & (F.col("fits_digits") >= digits)
    )


def _digit_steps(checked: DataFrame, start: int, last_digits: int) -> list[tuple[int, int]]:
    """Rows from which positions have one more digit: ``[(first row, digits)]``.

    Needed only when a command fits at a short position and not at a longer
    one. A rule is safe if it fits, and whether it fits depends on how many
    rules before it were safe; but that number matters only through its count
    of digits, so it is enough to find the few rows where the count changes.
    """
    digits = len(str(start))
    thin = materialise(checked.filter(_candidate(digits)).select("_row", "fits_digits"), "candidates")
    steps, position, after = [], start, None
    while digits < last_digits:
        pool = thin.filter(F.col("fits_digits") >= digits)
        if after is not None:
            pool = pool.filter(F.col("_row") > after)
        row = ordering.nth_row(pool, "_row", 10**digits - position)
        if row is None:
            break
        position, after, digits = 10**digits, row, digits + 1
        steps.append((row + 1, digits))
    return steps


def positioned_rules(checked: DataFrame, start: int = 1) -> DataFrame:
    """Add ``safe`` and ``position``. Only safe rules use a position up."""
    if start < 0:
        raise ValueError("the first position cannot be negative")
    digits = len(str(start))
    safe = _candidate(digits)
    # One thin row per block: enough to number the rows, and to see whether
    # any rule is so long that its position decides if it fits.
    per_block = materialise(
        checked.groupBy("_block").agg(
            F.count_if(safe).alias("_total"),
            F.min(F.when(safe, F.col("fits_digits"))).alias("_tightest"),
        ),
        "blocks",
    )
    size = per_block.agg(F.sum("_total").alias("n"), F.min("_tightest").alias("tightest")).first()
    last_digits = len(str(start + (size["n"] or 0)))
    totals = per_block.select("_block", "_total")
    if size["tightest"] is not None and size["tightest"] < last_digits:
        needed = F.lit(digits)
        for first_row, d in _digit_steps(checked, start, last_digits):
            needed = F.when(F.col("_row") >= first_row, F.lit(d)).otherwise(needed)
        safe = _candidate(digits) & (F.col("fits_digits") >= needed)
        totals = checked.groupBy("_block").agg(F.count_if(safe).alias("_total"))
    elif BEFORE in checked.columns:
        # The place inside the block was counted when the rules were checked.
        offsets = ordering.block_offsets(totals)
        offsets = F.broadcast(offsets) if fits_broadcast(offsets) else offsets
        placed = checked.withColumn("safe", safe).join(offsets, "_block")
        return placed.withColumn("position", F.col(BEFORE) + F.col("_offset") + F.lit(start)).drop(BEFORE, "_offset", "_block")
    flagged = checked.drop(BEFORE).withColumn("safe", safe).withColumn("_amount", F.col("safe").cast("long"))
    numbered = ordering.add_offsets(flagged, ordering.block_offsets(totals), "_row", "_before")
    return numbered.withColumn("position", F.col("_before") + F.lit(start)).drop("_before", "_amount")


def counted_inside(checked: DataFrame, start: int) -> DataFrame:
    """Add ``BEFORE``: the safe rules before a rule in its block, if no position is too long for its command.

    Rules come here by block, so they are not moved for it.
    """
    inside = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    safe = _candidate(len(str(max(start, 0)))).cast("long")
    return checked.withColumn(BEFORE, F.coalesce(F.sum(safe).over(inside), F.lit(0)))


def convert_rules(
    rules: DataFrame,
    known: DataFrame,
    *,
    default_slot: int = 9,
    start: int = 1,
    prefix: str = "",
    create_hosts: bool = False,
) -> DataFrame:
    """One row per rule that is no separator.

    ``rules`` needs ``_row``, a unique ascending long. Result: ``_row, kind,
    status, position, command, error, missing, dropped_service, original``.
    ``SAFE`` rules have a command and no missing name; their positions are
    dense from ``start``. A ``PENDING`` rule shows the position it would take.
    """
    # Counted inside blocks before they are written, so that numbering moves no rule again.
    checked = checked_rules(rules, known, default_slot=default_slot, prefix=prefix, create_hosts=create_hosts)
    checked = materialise(counted_inside(checked, start), "checked")
    position = F.col("position")
    command = finished_command(position, prefix)
    return positioned_rules(checked, start).select(
        "_row",
        "kind",
        F.when(F.col("safe"), F.lit(SAFE)).otherwise(F.lit(PENDING)).alias("status"),
        "position",
        command.alias("command"),
        build_error(position).alias("error"),
        "missing",
        "dropped_service",
        F.when(command.isNull(), F.col("original")).alias("original"),
    )


def conversion_counts(rules: DataFrame, converted: DataFrame, create_hosts: bool = False) -> DataFrame:
    """Run counters in one row: rows read, safe commands, pending, distinct missing.

    Generated host objects count as safe commands.
    """
    zero = {c: F.lit(0).cast("long").alias(c) for c in ("rows_read", "safe_commands", "pending", "missing")}

    def counter(df: DataFrame, **counts: Column) -> DataFrame:
        return df.agg(*[counts[c].alias(c) if c in counts else F.max(z).alias(c) for c, z in zero.items()])

    parts = [
        counter(rules, rows_read=F.count(F.lit(1))),
        counter(
            converted,
            safe_commands=F.count_if(F.col("status") == SAFE),
            pending=F.count_if(F.col("status") == PENDING),
        ),
        counter(converted_missing(converted), missing=F.count(F.lit(1))),
    ]
    if create_hosts:
        parts.append(counter(host_addresses(rules), safe_commands=F.count(F.lit(1))))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)
    return total.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in zero])


def converted_missing(converted: DataFrame) -> DataFrame:
    """Distinct ``(kind, name)`` missing in any converted rule."""
    return converted.select(F.explode("missing").alias("m")).select("m.kind", "m.name").distinct()

