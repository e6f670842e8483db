"""Host objects generated for the plain addresses of a rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.functions.fields import HOST_HEADERS, headers_of, pick
from wallflow.functions.net import host_object_name, ip_text_rank, is_host_ip
from wallflow.operators.joins import lookup_join


def host_addresses(rules: DataFrame) -> DataFrame:
    """Distinct ``ip`` over the four address groups of every row."""
    groups = F.array(*[pick(rules, headers) for headers in HOST_HEADERS.values()])
    return rules.select(F.explode_outer(groups).alias("ip")).filter(is_host_ip(F.col("ip"))).distinct()


def host_objects(rules: DataFrame) -> DataFrame:
    """``ip``, object name and creation command, one row per address."""
    name = host_object_name(F.col("ip"))
    return host_addresses(rules).select(
        "ip",
        name.alias("name"),
        F.format_string('CONFIG OBJECT HOST NEW name=%s ip=%s comment=""', name, F.col("ip")).alias("command"),
        ip_text_rank(F.col("ip")).alias("rank"),
    )


def _may_be_shadowed(rules: DataFrame, field: str) -> bool:
    """Whether the rendered field can differ from the value its group offers.

    A group lists more headers than the field does. As long as no such header
    that is in the data stands before one of the field's own, the first
    non-blank of the group is the field's value.
    """
    present = [h for h in HOST_HEADERS[field] if h in rules.columns]
    own = [h for h in present if h in headers_of(field)]
    return present[: len(own)] != own


def created_test(rules: DataFrame, hosts: DataFrame | None) -> tuple[DataFrame, dict[str, Column]]:
    """For each address field, whether its value has a generated object.

    ``hosts (ip)`` are the addresses that objects are generated for, at least
    those of ``rules``; None if no objects are generated.

    A rendered address is always in the generated set if it is also what the
    row's own address group offers, so usually no lookup is needed. Only where
    another header may hide it is the row checked against the whole set.
    """
    if hosts is None:
        return rules, {field: F.lit(False) for field in HOST_HEADERS}
    offered = F.array(*[pick(rules, headers) for headers in HOST_HEADERS.values()])
    shadowed = [f for f in HOST_HEADERS if _may_be_shadowed(rules, f)]
    certain = {
        f: is_host_ip(pick(rules, headers_of(f))) for f in HOST_HEADERS if f not in shadowed
    }
    if not shadowed:
        return rules, certain
    values = F.array(*[pick(rules, headers_of(f)) for f in shadowed])
    unsure = rules.select(
        "_row", F.explode_outer(F.array_distinct(F.filter(values, is_host_ip))).alias("ip"), offered.alias("_offered")
    ).filter(F.col("ip").isNotNull() & ~F.array_contains("_offered", F.col("ip")))
    found = lookup_join(unsure.drop("_offered"), hosts.select("ip"), ["ip"], "left_semi", "_row")
    per_row = found.groupBy("_row").agg(F.collect_set("ip").alias("_hosts"))
    rules = rules.join(per_row, "_row", "left")
    for f in shadowed:
        value = pick(rules, headers_of(f))
        listed = F.coalesce(F.array_contains("_hosts", value), F.lit(False))
        certain[f] = is_host_ip(value) & (F.array_contains(offered, value) | listed)
    return rules, certain
