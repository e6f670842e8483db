"""Vocabulary of a rule set: canonical fields, their headers and their tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.functions.text import blank_to_null, strip_ws

# Canonical rule field -> command token. The order is the order
# of the tokens in a rendered command.
FIELD_TOKENS = {
    "rule_name": "rulename",
    "comment": "comment",
    "state": "state",
    "action": "action",
    "count": "count",
    "rate": "rate",
    "set_tos": "settos",
    "inspection": "inspection",
    "service": "service",
    "log_level": "loglevel",
    "schedule": "schedule",
    "route": "route",
    "no_conn_log": "noconnlog",
    "tos": "tos",
    "ip_proto": "ipproto",
    "proto": "proto",
    "from_user_type": "srcusertype",
    "from_user_domain": "srcuserdomain",
    "from_user_method": "srcusermethod",
    "from_src": "srctarget",
    "from_geo": "srcgeo",
    "from_ip_rep": "srciprep",
    "from_host_rep": "srchostrep",
    "from_port": "srcport",
    "from_if": "srcif",
    "via": "via",
    "to_dest": "dsttarget",
    "to_geo": "dstgeo",
    "to_ip_rep": "dstiprep",
    "to_host_rep": "dsthostrep",
    "to_port": "dstport",
    "to_if": "dstif",
    "nat_before_vpn": "beforevpn",
    "nat_from_target": "natsrctarget",
    "nat_from_arp": "natsrcarp",
    "nat_from_port": "natsrcport",
    "nat_from_load_balancing": "natsrclb",
    "nat_to_target": "natdsttarget",
    "nat_to_arp": "natdstarp",
    "nat_to_port": "natdstport",
    "nat_to_load_balancing": "natdstlb",
}

# Fields that also answer to other headers, first one wins.
ALIASES = {
    "rule_name": ["rule_name", "rulename", "rule name"],
    "service": ["service", "to_port", "dstport"],
    "from_src": ["from_src", "source"],
    "to_dest": ["to_dest", "destination"],
    "nat_from_target": ["nat_from_target", "natsrctarget"],
    "nat_to_target": ["nat_to_target", "natdsttarget"],
    "nat_to_port": ["nat_to_port", "natdstport"],
    "log_level": ["log_level", "loglevel"],
    "proto": ["proto", "ip_proto"],
}

# Tokens that exist for NAT rules only.
NAT_ONLY_FIELDS = [
    "nat_before_vpn",
    "nat_from_target",
    "nat_from_arp",
    "nat_from_port",
    "nat_from_load_balancing",
    "nat_to_target",
    "nat_to_arp",
    "nat_to_port",
    "nat_to_load_balancing",
]

# Accepted actions, and the spellings translated to them.
ACTIONS = ["pass", "block", "drop", "bypass", "deleg", "reset", "log", "decrypt", "nat"]
ACTION_SYNONYMS = {"allow": "pass", "accept": "pass", "deny": "drop"}

# Headers that may hold the address of a generated host object.
HOST_HEADERS = {
    "from_src": ["from_src", "source_ip", "src", "source", "src_ip"],
    "to_dest": ["to_dest", "destination_ip", "dest_ip", "dst_ip", "destination"],
    "nat_from_target": ["nat_from_target", "natsrctarget", "src_translation", "to_src"],
    "nat_to_target": [
        "nat_to_target", "natdsttarget", "dst_translation", "to_dst", "translated_ip", "to",
    ],
}

# Fields whose names must exist as objects, and as interfaces.
OBJECT_FIELDS = [
    "from_src", "to_dest", "service", "nat_from_target", "nat_to_target", "nat_to_port",
    "schedule", "route", "from_geo", "to_geo", "from_ip_rep", "to_ip_rep",
]
INTERFACE_FIELDS = ["from_if", "to_if"]

# Headers that name the slot of a rule, first one first.
SLOT_HEADERS = ["policy", "slot", "index"]


def named(column: str) -> Column:
    """A column by its literal name, whatever characters it holds."""
    return F.col("`" + column.replace("`", "``") + "`")


def pick(df: DataFrame, headers: Sequence[str]) -> Column:
    """First non-blank of the headers that ``df`` has, trimmed; ``""`` if none."""
    present = [h for h in headers if h in df.columns]
    return F.coalesce(*[blank_to_null(named(h).cast("string")) for h in present], F.lit(""))


def headers_of(field: str) -> list[str]:
    return ALIASES.get(field, [field])


def has_field(df: DataFrame, field: str) -> bool:
    """Whether any header of ``field`` is in ``df`` (decided while planning)."""
    return any(h in df.columns for h in headers_of(field))


def field_value(df: DataFrame, field: str) -> Column:
    """Value of a canonical field through its aliases."""
    return pick(df, headers_of(field))


def coerced_action(value: Column) -> Column:
    """Canonical action, or null when it is not a known one."""
    v = F.lower(strip_ws(F.coalesce(value, F.lit(""))))
    known = F.when(v.isin(ACTIONS), v)
    for spelling, action in ACTION_SYNONYMS.items():
        known = known.when(v == spelling, F.lit(action))
    return known


def rule_kind(df: DataFrame) -> Column:
    """``NAT`` or ``FILTER``; reads canonical headers only, not aliases."""
    is_nat = (
        F.lower(pick(df, ["type_slot"])).contains("nat")
        | (F.lower(pick(df, ["action"])) == "nat")
        | (pick(df, ["nat_from_target"]) != "")
        | (pick(df, ["nat_to_target"]) != "")
    )
    return F.when(is_nat, F.lit("NAT")).otherwise(F.lit("FILTER"))


def is_separator(df: DataFrame) -> Column:
    """Rows that only draw a coloured line between rules."""
    return pick(df, ["separator_color"]) != ""
