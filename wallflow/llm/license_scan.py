"""Licence scan with ordered signature rules.

A text without any gate word is done after a few substring searches. In the
others each rule with its keyword in the text is matched; matches inside a
longer match are suppressed, and of two that overlap the one with the higher
priority stays. Everything happens inside the row, so nothing is shuffled.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.llm.common import text_of
from wallflow.llm.license_rules import rules

# Words: runs of a-z, 0-9 and everything beyond ASCII, after A-Z is lower-cased.
_IN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORDS = f"{_IN}+"

# Base phrases and their labels, by first word.
BASE = {"mit": ("mit license", "mit"), "apache": ("apache license", "apache"), "general": ("general public license", "gpl")}

_PHRASES = "|".join(p.replace(" ", f"{_OUT}+") for p, _ in BASE.values())
_BASE = f"(?i)(?<!{_IN})(?:{_PHRASES})(?!{_IN})"

# Keywords and gate words are looked for in the text with one space for each of these.
_BETWEEN = "[^a-z0-9]+"

_HIT = "struct<s: int, e: int, p: int, label: string>"


def keyword(rule: dict) -> str:
    """The keyword of a rule with one space between its words."""
    return re.sub(_BETWEEN, " ", rule["keyword"])


def gates(table: list[dict]) -> list[str]:
    """Few words of which every match of every rule needs one."""
    words = ["licen", "permission", "copyright", "public domain", "gnu", "gpl", "redistribut"]
    rest = set()
    for rule in table:
        needed = rule["regex"]
        while needed != (shorter := re.sub(r"\(\?:[^()]*\)[?*]", "", needed)):
            needed = shorter
        # Alternatives do not count as needed.
        needed = re.sub(r"\([^()]*\|[^()]*\)", "", needed)
        if not any(w in keyword(rule) or w in needed for w in words):
            rest.add(keyword(rule))
    return words + sorted(w for w in rest if not any(x != w and x in w for x in rest))


def _words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)))


def detections(text: Column, plain: Column, table: list[dict]) -> Column:
    """Suppressed matches of all rules in a lower-case text, as an array of start, end, priority and label.

    ``plain`` is the text with one space between its words.
    """
    # A point in a rule is any character, a line break too.
    known = F.from_json(
        F.lit(json.dumps([{**rule, "keyword": keyword(rule), "regex": f"(?s){rule['regex']}"} for rule in table])), "array<struct<label: string, priority: int, keyword: string, regex: string>>"
    )
    none = F.lit(None).cast(f"array<{_HIT}>")

    def matches(rule: Column) -> Column:
        found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
        parts = F.split(text, rule["regex"], -1)

        def step(state: Column, i: Column) -> Column:
            stop = state["at"] + F.length(F.element_at(found, i))
            hit = F.struct(
                state["at"].alias("s"), stop.alias("e"), rule["priority"].alias("p"), rule["label"].alias("label")
            ).cast(_HIT)
            at = stop + F.length(F.element_at(parts, i + 1))
            return F.struct(at.alias("at"), F.array_append(state["hits"], hit).alias("hits"))

        empty = F.array().cast(f"array<{_HIT}>")
        start = F.struct(F.length(F.element_at(parts, 1)).alias("at"), empty.alias("hits"))
        all_hits = F.aggregate(F.sequence(F.lit(1), F.size(found)), start, step, lambda s: s["hits"])
        return F.when(F.size(found) > 0, all_hits).otherwise(none)

    keyed = F.filter(known, lambda r: F.contains(plain, r["keyword"]))
    hits = F.flatten(F.filter(F.transform(keyed, matches), lambda h: h.isNotNull()))
    # By start, the longer first, then by priority.
    ordered = F.array_sort(
        F.transform(hits, lambda h: F.struct(h["s"].alias("s"), (-h["e"]).alias("n"), (-h["p"]).alias("q"), h.alias("h")))
    )

    def sweep(kept: Column, x: Column) -> Column:
        h, size = x["h"], F.size(kept)
        last = F.get(kept, size - 1)
        lower = (h["e"] <= last["e"]) | ((h["s"] < last["e"]) & (h["p"] <= last["p"]))
        higher = (h["s"] < last["e"]) & (h["p"] > last["p"])
        return (
            F.when((size > 0) & lower, kept)
            .when((size > 0) & higher, F.array_append(F.slice(kept, 1, size - 1), h))
            .otherwise(F.array_append(kept, h))
        )

    return F.aggregate(ordered, F.array().cast(f"array<{_HIT}>"), sweep)


def scan_licenses(df: DataFrame, text_col: str = "text", table: list[dict] | None = None) -> DataFrame:
    """Add word and phrase counts, labels, score and detections to every row.

    ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``,
    ``labels``, ``score`` and ``detections`` replace columns of those names. A
    null or empty text has no words and no labels (empty strings), score 0.
    Detections count characters from 0. The score is that of the strongest
    signature, as its priority in hundredths. Equal rows get equal results.
    """
    table = rules() if table is None else table
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    kept = [c for c in df.columns if c not in added]
    rows = df.select(*kept, text_of(text_col).alias("_text")).withColumn("_lower", F.lower("_text"))
    rows = rows.withColumn("_plain", F.regexp_replace("_lower", _BETWEEN, " "))
    gate = F.lit(False)
    for word in gates(table):
        gate = gate | F.contains("_plain", F.lit(word))
    rows = rows.select(*kept, "_text", "_lower", "_plain", gate.alias("_gate"), _words(F.col("_text")).alias("_n"))
    based = F.col("_gate") & F.col("_text").rlike(_BASE)
    empty = F.array().cast("array<string>")
    found = F.when(based, F.regexp_extract_all("_text", F.lit(_BASE), F.lit(0))).otherwise(empty)
    parts = F.when(based, F.split("_text", _BASE, -1)).otherwise(empty)
    hits = F.when(F.col("_gate"), detections(F.col("_lower"), F.col("_plain"), table)).otherwise(F.array().cast(f"array<{_HIT}>"))
    rows = rows.select(*kept, "_n", found.alias("_found"), parts.alias("_parts"), hits.alias("_hits"))
    any_base = F.size("_found") > 0
    last = F.col("_n") - _words(F.element_at("_parts", -1)) - _words(F.element_at("_found", -1))
    named = F.transform(
        "_found",
        lambda m: F.when(F.lower(m).startswith("mit"), F.lit(BASE["mit"][1]))
        .when(F.lower(m).startswith("apache"), F.lit(BASE["apache"][1]))
        .otherwise(F.lit(BASE["general"][1])),
    )
    base = F.array_sort(F.array_distinct(named))
    every = F.array_sort(F.array_distinct(F.concat(named, F.transform("_hits", lambda h: h["label"]))))
    best = F.array_max(F.transform("_hits", lambda h: h["p"])) / 100.0
    return rows.select(
        *kept,
        F.col("_n").cast("long").alias("n_words"),
        F.size("_found").cast("long").alias("n_base"),
        F.when(any_base, _words(F.element_at("_parts", 1))).cast("long").alias("first_word"),
        F.when(any_base, last).cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(any_base, 0.8).otherwise(0.0)).alias("score"),
        F.transform(
            "_hits", lambda h: F.struct(h["s"].alias("start"), h["e"].alias("stop"), h["p"].alias("priority"), h["label"])
        ).alias("detections"),
    )
