"""Rules as command text.

A command is built in two steps. ``command_parts`` makes everything that does
not depend on the rule's position, in the scan. ``finished_command`` puts the
position in once it is known. Between the two only the parts travel, not the
rule's columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.functions.fields import (
    FIELD_TOKENS,
    HOST_HEADERS,
    NAT_ONLY_FIELDS,
    SLOT_HEADERS,
    coerced_action,
    field_value,
    has_field,
    pick,
    rule_kind,
)
from wallflow.functions.net import host_object_name
from wallflow.functions.text import (
    NAME_LIMIT,
    base_form,
    capped_name,
    cli_value,
    constant_cli_value,
    first_of_list,
    is_bare,
    python_quoted,
    quoted_unless_bare,
    strip_accents,
    strip_ws,
)
from wallflow.operators.hosts import created_test

MAX_COMMAND = 1024
MAX_DIGITS = 19

# Error texts.
UNKNOWN_ACTION = "action de filtre inconnue: "
BAD_SLOT = "invalid slot number: "
TOO_LONG = "generated command line too long"

PARTS = ["kind", "cmd_head", "cmd_name", "cmd_rest", "name_auto", "error", "fits_digits"]

FILTER, NAT = "FILTER", "NAT"
_DEFAULT_NAME = {FILTER: "FilterRule-", NAT: "NatRule-"}


def _auto_base(prefix: str, kind: str) -> str:
    return base_form((prefix + _DEFAULT_NAME[kind]).replace("\n", " ").strip())


def _auto_name(prefix: str, kind: str, position: Column) -> Column:
    """``rulename=`` token of a rule that has neither a name nor a comment."""
    name = capped_name(F.concat(F.lit(_auto_base(prefix, kind)), F.format_string("%04d", position)))
    return F.concat(F.lit("rulename="), quoted_unless_bare(name))


def _auto_width(prefix: str, kind: str, digits: int) -> int:
    """Length of that token and of a position with this many digits."""
    name = _auto_base(prefix, kind) + "0" * max(digits, 4)
    if len(name) > NAME_LIMIT:
        name = name[: NAME_LIMIT - 3] + "..."
    return len(" rulename=") + len(constant_cli_value(name)) + digits


def _quoted_values(values: list[Column]) -> Column:
    """The values that cannot stand bare, cleaned and quoted; null for the others.

    One lambda serves all fields. With such an expression per field the plan
    grows so large that Catalyst needs longer for it than Spark for the data.
    """
    special = F.array(*[F.when(~is_bare(v), v) for v in values])
    return F.transform(special, lambda v: F.when(v.isNotNull(), cli_value(v)))


def _spaced(c: Column) -> Column:
    """Length a part adds to a command, its leading blank included."""
    return F.when(c == "", F.lit(0)).otherwise(F.length(c) + 1)


def _fits_digits(prefix: str, kinds: list[str]) -> Column:
    """How many digits the position may have (0 to 19) before the line is too long."""
    fixed = F.length("cmd_head") + _spaced(F.col("cmd_rest"))
    named_room = F.lit(MAX_COMMAND) - fixed - _spaced(F.col("cmd_name"))
    fits = F.greatest(F.lit(0), F.least(F.lit(MAX_DIGITS), named_room))
    room = F.lit(MAX_COMMAND) - fixed
    for kind in kinds:
        auto = F.lit(0)
        for digits in range(1, MAX_DIGITS + 1):
            auto = auto + (room >= _auto_width(prefix, kind, digits)).cast("int")
        fits = F.when(F.col("name_auto") & (F.col("kind") == kind), auto).otherwise(fits)
    return fits


def command_parts(
    rules: DataFrame,
    *,
    default_slot: int = 9,
    prefix: str = "",
    hosts: DataFrame | None = None,
    kind: str | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Position-independent parts of each rule's command.

    Columns: those of ``keep``, then ``kind`` (classified per row unless
    forced), ``cmd_head`` (up to ``position=``), ``cmd_name`` (the name token;
    for ``name_auto`` rules it follows from the position), ``cmd_rest`` (all
    later tokens), ``error`` and ``fits_digits``.
    """
    rules, created = created_test(rules, hosts)
    fields = [f for f in FIELD_TOKENS if f not in ("rule_name", "comment") and has_field(rules, f)]
    own_kind = F.lit(kind) if kind else rule_kind(rules)

    # First stage: one column per canonical field, so that each alias chain is
    # evaluated once and not once per use.
    values = rules.select(
        *keep,
        own_kind.alias("kind"),
        pick(rules, SLOT_HEADERS).alias("_slot"),
        field_value(rules, "rule_name").alias("_name"),
        field_value(rules, "comment").alias("_comment"),
        *[field_value(rules, f).alias(f"_v_{f}") for f in fields],
        *[created[f].alias(f"_created_{f}") for f in fields if f in HOST_HEADERS],
    )
    action = coerced_action(F.col("_v_action")) if "action" in fields else F.lit(None).cast("string")
    named_rule = F.coalesce(F.nullif("_name", F.lit("")), F.nullif("_comment", F.lit("")))
    full_name = F.concat(F.lit(prefix), named_rule)
    values = values.select(
        "*",
        F.expr("try_cast(nullif(_slot, '') as bigint)").alias("_slot_number"),
        strip_accents(strip_ws(F.replace(full_name, F.lit("\n"), F.lit(" ")))).alias("_full_name"),
        action.alias("_action"),
    )

    def shown(field: str) -> Column:
        """Text of a field in the command; null where the rule does not show it."""
        value = F.col(f"_v_{field}")
        given, text = value != "", value
        if field == "action":
            given, text = given & (F.col("kind") == FILTER), F.col("_action")
        elif field == "service":
            given = given & (F.col("kind") == FILTER)
        elif field in NAT_ONLY_FIELDS:
            given = given & (F.col("kind") == NAT)
        if field == "ip_proto":
            text = first_of_list(value)
        if field in HOST_HEADERS:
            text = F.when(F.col(f"_created_{field}"), host_object_name(value)).otherwise(value)
        return F.when(given, text)

    # Second stage: the texts that are shown. Third: those that need quotes.
    comment = F.when((F.col("_name") != "") & (F.col("_comment") != ""), F.col("_comment"))
    tokens = {"comment": comment, **{f: shown(f) for f in fields}}
    values = values.select("*", *[text.alias(f"_t_{f}") for f, text in tokens.items()])
    values = values.select("*", _quoted_values([F.col(f"_t_{f}") for f in tokens]).alias("_quoted"))
    rest = F.concat_ws(
        " ",
        *[
            F.concat(F.lit(f"{FIELD_TOKENS[f]}="), F.coalesce(F.col("_quoted")[i], F.col(f"_t_{f}")))
            for i, f in enumerate(tokens)
        ],
    )
    slot = F.coalesce(F.col("_slot_number"), F.lit(default_slot)).cast("string")
    head = F.concat(
        F.lit("CONFIG FILTER RULE INSERT index="),
        slot,
        F.when(F.col("kind") == NAT, F.lit(" type=nat action=nat position=")).otherwise(
            F.lit(" type=filter position=")
        ),
    )
    name = F.when(F.col("_full_name") == "", F.lit("")).otherwise(
        F.concat(F.lit("rulename="), quoted_unless_bare(strip_ws(capped_name(F.col("_full_name")))))
    )
    error = F.when(
        (F.col("_slot") != "") & F.col("_slot_number").isNull(), F.concat(F.lit(BAD_SLOT), python_quoted(F.col("_slot")))
    )
    if "action" in fields:
        error = error.when(
            (F.col("kind") == FILTER) & (F.col("_v_action") != "") & F.col("_action").isNull(),
            F.concat(F.lit(UNKNOWN_ACTION), python_quoted(F.col("_v_action"))),
        )
    parts = values.select(
        *keep,
        "kind",
        head.alias("cmd_head"),
        F.coalesce(name, F.lit("")).alias("cmd_name"),
        rest.alias("cmd_rest"),
        F.col("_full_name").isNull().alias("name_auto"),
        error.alias("error"),
    )
    return parts.withColumn("fits_digits", _fits_digits(prefix, [kind] if kind else [FILTER, NAT]))


def dropped_service(rules: DataFrame) -> Column:
    """A NAT rule whose service appears in no token of its command."""
    return (
        (rule_kind(rules) == NAT) & (field_value(rules, "service") != "") & (field_value(rules, "to_port") == "")
    )


def digits_of(position: Column) -> Column:
    return F.length(position.cast("string"))


def finished_command(position: Column, prefix: str = "") -> Column:
    """The command at ``position``; null when it cannot be built or is too long."""
    auto = F.when(F.col("kind") == NAT, _auto_name(prefix, NAT, position)).otherwise(
        _auto_name(prefix, FILTER, position)
    )
    name = F.when(F.col("name_auto"), auto).otherwise(F.nullif("cmd_name", F.lit("")))
    line = F.concat_ws(
        " ", F.concat(F.col("cmd_head"), position.cast("string")), name, F.nullif("cmd_rest", F.lit(""))
    )
    return F.when(F.col("error").isNull() & (digits_of(position) <= F.col("fits_digits")), line)


def build_error(position: Column) -> Column:
    """Why there is no command at ``position``; null when there is one."""
    return F.coalesce(F.col("error"), F.when(digits_of(position) > F.col("fits_digits"), F.lit(TOO_LONG)))


def render(rules: DataFrame, position: str, *, prefix: str = "", keep: tuple[str, ...] = ("_row",), **options) -> DataFrame:
    """Commands of rules whose position is already a column."""
    parts = command_parts(rules, prefix=prefix, keep=tuple(dict.fromkeys((*keep, position))), **options)
    at = F.col(position)
    return parts.select(
        *keep,
        *([position] if position not in keep else []),
        "kind",
        finished_command(at, prefix).alias("command"),
        build_error(at).alias("build_error"),
    ).withColumnRenamed("build_error", "error")
