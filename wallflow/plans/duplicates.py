"""Rules that say the same thing, and the commands that remove the copies.

Results are relations with one row per occurrence. A group is never gathered
into an array or a window: one signature may own a large share of all rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallflow.functions.fields import field_value, named, pick
from wallflow.functions.text import or_default, sorted_list
from wallflow.operators.joins import hot_keys, salted_join
from wallflow.operators.ordering import number_rows, running_total_before
from wallflow.session import materialise

SIGNATURE = ["source", "destination", "port", "protocol", "action"]
FILTER, NAT = "filter", "nat"

# Slot names of the two rule lists, and texts for absent values.
SLOT_MARKS = {FILTER: "local_filter_slot", NAT: "local_nat_slot"}
UNNAMED = "Sans nom"
NO_FILE = "N/A"

_GROUP = ["kind", *SIGNATURE]


def _line(rules: DataFrame) -> Column:
    """Line of the rule in its file; ``original_line`` in the data wins."""
    counted = F.col("_line") if "_line" in rules.columns else F.col("_row")
    if "original_line" in rules.columns:
        return F.coalesce(named("original_line").try_cast("long"), counted)
    return counted


def nat_lines(rules: DataFrame) -> DataFrame:
    """NAT rows with ``nat_line``, their running number, by ``original_line`` where the data has it."""
    slot = named("type_slot") if "type_slot" in rules.columns else F.lit("")
    nats = rules.filter(slot.contains(SLOT_MARKS[NAT]))
    if "original_line" not in rules.columns:
        return number_rows(nats, "_row", out="nat_line")
    # A line occurs once per file, so rows of one line are few; the lines are numbered as rows are.
    nats = nats.withColumn("_at", F.coalesce(_line(rules), F.lit(0)).cast("long"))
    lines = nats.groupBy("_at").agg(F.count(F.lit(1)).alias("_of_line"))
    before = running_total_before(lines, "_at", F.col("_of_line"), "_before").drop("_of_line")
    inside = F.row_number().over(Window.partitionBy("_at").orderBy("_row"))
    numbered = nats.withColumn("_inside", inside).join(before, "_at")
    return numbered.withColumn("nat_line", F.col("_before") + F.col("_inside")).drop("_at", "_before", "_inside")


def _occurrences(rules: DataFrame, kind: str, nat_line: Column) -> DataFrame:
    """Signature, place and name of each rule of one list that says anything."""
    says_something = pick(rules, ["action", "from_src", "to_dest"]) != ""
    return rules.filter(says_something).select(
        "_row",
        F.lit(kind).alias("kind"),
        or_default(sorted_list(field_value(rules, "from_src")), "any").alias("source"),
        or_default(sorted_list(field_value(rules, "to_dest")), "any").alias("destination"),
        or_default(sorted_list(field_value(rules, "service")), "any").alias("port"),
        or_default(field_value(rules, "proto"), "any").alias("protocol"),
        or_default(pick(rules, ["action"]), "any").alias("action"),
        (F.col("_file") if "_file" in rules.columns else F.lit(NO_FILE)).alias("file"),
        _line(rules).alias("line"),
        nat_line.alias("nat_line"),
        or_default(pick(rules, ["rule_name"]), UNNAMED).alias("name"),
    )


def rule_signatures(rules: DataFrame, *, with_nat_lines: bool = False) -> DataFrame:
    """Every rule of the filter and the NAT list with its normalised signature.

    ``nat_line`` costs a numbering pass and is null unless asked for.
    """
    if "type_slot" not in rules.columns:
        rules = rules.withColumn("type_slot", F.lit(""))
    none = F.lit(None).cast("long")
    filters = rules.filter(named("type_slot").contains(SLOT_MARKS[FILTER]))
    if with_nat_lines:
        nats, line = nat_lines(rules), F.col("nat_line")
    else:
        nats, line = rules.filter(named("type_slot").contains(SLOT_MARKS[NAT])), none
    return _occurrences(filters, FILTER, none).unionByName(_occurrences(nats, NAT, line))


def _place() -> Column:
    """Sort order of the occurrences of one group.

    Filter rules go by file and line. NAT rules go by file and running number,
    which has the order of the lines, or else of the rows.
    """
    line = F.when(F.col("kind") == NAT, F.coalesce("nat_line", "_row")).otherwise(F.col("line"))
    return F.struct(F.col("file").alias("file"), line.alias("line"), F.col("_row").alias("row"))


def _rows_are_places(rules: DataFrame) -> bool:
    """Whether ``_row`` alone says where a rule stands (one source, no own lines)."""
    return not {"_file", "_line", "original_line"} & set(rules.columns)


def signature_stats(signatures: DataFrame, rows_are_places: bool = False) -> DataFrame:
    """Per signature: size, first occurrence in reading order and in sort order.

    If ``_row`` is the place, one minimum of a long gives both, and the
    aggregate can hash. A minimum of structs has to sort.
    """
    if rows_are_places:
        row = F.col("_min_row")
        file = F.lit(NO_FILE).alias("file")
        return (
            signatures.groupBy(*_GROUP)
            .agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_min_row"))
            .select(
                *_GROUP,
                "n",
                F.struct(row.alias("_row"), file, row.alias("line")).alias("_first"),
                F.struct(file, row.alias("line"), row.alias("row")).alias("_kept"),
            )
        )
    return signatures.groupBy(*_GROUP).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct("_row", "file", "line")).alias("_first"),
        F.min(_place()).alias("_kept"),
    )


def duplicate_groups(rules: DataFrame) -> DataFrame:
    """Signatures that occur more than once, one row each."""
    stats = signature_stats(rule_signatures(rules), _rows_are_places(rules)).filter(F.col("n") > 1)
    return stats.select(
        *_GROUP, "n", F.col("_first.file").alias("first_file"), F.col("_first.line").alias("first_line")
    )


def duplicate_members(rules: DataFrame, *, with_nat_lines: bool = False) -> DataFrame:
    """Every occurrence of every duplicated signature.

    ``is_kept`` marks the one that stays. Groups are ordered by ``first_file``,
    ``first_line`` and occurrences inside by ``file``, ``place``, ``_row``.

    The signatures and the table of duplicated ones are written out, since
    both are read several times and cost more to derive than to read.
    """
    signatures = materialise(rule_signatures(rules, with_nat_lines=with_nat_lines), "signatures")
    stats = materialise(signature_stats(signatures, _rows_are_places(rules)).filter(F.col("n") > 1), "duplicated")
    members = salted_join(signatures, stats, _GROUP, "inner", hot_keys(stats, _GROUP, "n"), "_row")
    return members.select(
        *_GROUP,
        "_row",
        "file",
        "line",
        "nat_line",
        "name",
        "n",
        _place()["line"].alias("place"),
        (F.col("_row") == F.col("_kept.row")).alias("is_kept"),
        F.col("_first.file").alias("first_file"),
        F.col("_first.line").alias("first_line"),
        F.col("_first._row").alias("first_row"),
    )


def duplicate_removals(
    rules: DataFrame, *, slot: int = 9, is_global: bool = False, members: DataFrame | None = None
) -> DataFrame:
    """One command per copy that goes; unnamed NAT rules cannot be addressed.

    A filter rule is removed by name when the name is unique in its group,
    else by position. Every removal shifts the positions behind it, so the
    commands are safe to run in ascending ``remove_order``: by position from
    the bottom up, then by name. ``members`` passes on the finished table of
    ``duplicate_members``.
    """
    if members is None:
        members = materialise(duplicate_members(rules), "members")
    by_name = [*_GROUP, "name"]
    names = members.filter(F.col("kind") == FILTER).groupBy(*by_name).agg(F.count(F.lit(1)).alias("_same_name"))
    goes = members.filter(~F.col("is_kept") & ((F.col("kind") == FILTER) | (F.col("name") != UNNAMED)))
    goes = salted_join(
        goes, names.filter(F.col("_same_name") > 1), by_name, "left", hot_keys(names, by_name, "_same_name"), "_row"
    )
    by_position = (F.col("kind") == FILTER) & ((F.col("name") == UNNAMED) | F.col("_same_name").isNotNull())
    target = F.when(by_position, F.format_string("position=%d", F.col("line"))).otherwise(
        F.format_string('name="%s"', F.col("name"))
    )
    head = F.format_string("CONFIG FILTER RULE REMOVE index=%d type=%s ", F.lit(slot), F.col("kind"))
    return goes.select(
        *_GROUP,
        "_row",
        "file",
        "line",
        "place",
        "name",
        "first_file",
        "first_line",
        "first_row",
        F.when(by_position, -F.col("line")).otherwise(F.lit(0)).alias("remove_order"),
        F.concat(head, target, F.lit(" global=1" if is_global else "")).alias("command"),
    )
