"""Names that rules use, checked against the known objects and interfaces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.functions.fields import INTERFACE_FIELDS, OBJECT_FIELDS, field_value, has_field
from wallflow.functions.net import is_ip_or_network
from wallflow.functions.text import split_names
from wallflow.operators.joins import lookup_join

OBJECT, INTERFACE = "OBJECT", "INTERFACE"

_NO_NAMES = "array<string>"


def references(rules: DataFrame) -> Column:
    """Distinct (kind, name) pairs that a rule needs, as an array.

    A whole value ``any`` names nothing; neither does a whole address, network
    or range in an object field. Inside a list such texts count as names.
    """
    entries = [
        F.struct(F.lit(kind).alias("kind"), field_value(rules, field).alias("value"))
        for kind, fields in ((OBJECT, OBJECT_FIELDS), (INTERFACE, INTERFACE_FIELDS))
        for field in fields
        if has_field(rules, field)
    ]
    if not entries:
        return F.array().cast("array<struct<kind:string,name:string>>")

    def names(entry: Column) -> Column:
        exempt = (F.lower(entry["value"]) == "any") | (
            (entry["kind"] == OBJECT) & is_ip_or_network(entry["value"])
        )
        listed = F.when(exempt, F.array().cast(_NO_NAMES)).otherwise(split_names(entry["value"]))
        return F.transform(listed, lambda n: F.struct(entry["kind"].alias("kind"), n.alias("name")))

    given = F.filter(F.array(*entries), lambda e: e["value"] != "")
    return F.array_distinct(F.flatten(F.transform(given, names)))


def known_names(objects: DataFrame | None, interfaces: DataFrame | None, hosts: DataFrame | None = None) -> DataFrame:
    """``(kind, name)`` universe. Interfaces also count as objects, not the reverse."""
    some = next(df for df in (objects, interfaces, hosts) if df is not None)
    parts = []
    for df, kinds in ((objects, [OBJECT]), (interfaces, [OBJECT, INTERFACE]), (hosts, [OBJECT])):
        if df is not None:
            parts += [df.select(F.lit(kind).alias("kind"), F.col("name")) for kind in kinds]
    names = parts[0] if parts else some.limit(0)
    for part in parts[1:]:
        names = names.unionByName(part)
    return names.dropna().distinct()


def needed_names(rules: DataFrame) -> DataFrame:
    """One row per rule and name it needs: ``_row``, ``kind``, ``name``."""
    # explode() would have Spark infer a size filter and so evaluate the array twice.
    refs = rules.select("_row", F.explode_outer(references(rules)).alias("_ref"))
    return refs.select("_row", F.col("_ref.kind").alias("kind"), F.col("_ref.name").alias("name")).dropna()


def missing_references(rules: DataFrame, known: DataFrame) -> DataFrame:
    """``(_row, kind, name)`` for every name of a rule that is not known."""
    return lookup_join(needed_names(rules), known, ["kind", "name"], "left_anti", "_row")


def missing_names(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct unknown ``(kind, name)``.

    Both sides are tagged and grouped together: one shuffle of pre-aggregated
    names, no join, so it does not matter how often a name is used.
    """
    tagged = (
        needed_names(rules)
        .select("kind", "name", F.lit(0).alias("_known"))
        .unionByName(known.select("kind", "name", F.lit(1).alias("_known")))
    )
    return tagged.groupBy("kind", "name").agg(F.max("_known").alias("_known")).filter("_known = 0").select("kind", "name")
