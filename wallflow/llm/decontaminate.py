"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question asked again
with other values keeps its template. Windows of template tokens are hash-joined
against all windows of the benchmark; where one meets, the text is laid beside
the whole item, and beside the item moved by up to ``BAND`` tokens where windows
meet there too, as they do after a word put in or left out. It counts as a leak
when enough of the item's tokens agree and its slots are filled consistently:
whenever a value of the item repeats, the value that stands for it must repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wallflow.llm.common import small_enough, text_of
from wallflow.session import materialise

WINDOW = 6
MIN_AGREEMENT = 0.6
# How far parts of an item may be moved against each other.
BAND = 4

# Three characters for private use; they are blanked where a text has them itself.
NUMBER, NAME, UNIT = "\ue001", "\ue002", "\ue003"

_NUMBER = r"\p{Nd}+(?:[.,]\p{Nd}+)*"
# Capitalised after a word or comma, so not merely at the start of a sentence. A word all in capitals is a word.
_NAME = rf"(?<=[\p{{L}}\p{{M}}\p{{Nd}}{NUMBER}{UNIT},;] )\p{{Lu}}+[\p{{Ll}}\p{{M}}][\p{{L}}\p{{M}}]*"
_UNITS = (
    "km|m|cm|mm|kg|g|mg|l|ml|h|hours?|min|minutes?|s|seconds?|days?|weeks?|months?|years?|miles?|feet|foot|inch(?:es)?"
    "|pounds?|lbs?|ounces?|dollars?|cents?|euros?|percent|degrees?|liters?|litres?|meters?|metres?|grams?|kilograms?"
    "|kilometers?|kilometres?|mph|kph"
)
_UNIT = rf"(?i)(?<={NUMBER} )(?: *)(?:{_UNITS})(?![\p{{L}}\p{{M}}])"
_TOKEN = rf"{_NUMBER}|[\p{{L}}\p{{M}}]+"
_GAP = rf"[^\p{{L}}\p{{M}}{NUMBER}{NAME}{UNIT}]+"


def template(text: Column) -> Column:
    """Template tokens of a text. There is one for each of ``values``."""
    plain = F.regexp_replace(text, f"[{NUMBER}{NAME}{UNIT}]", " ")
    marked = F.regexp_replace(plain, _NUMBER, f" {NUMBER} ")
    marked = F.regexp_replace(marked, _UNIT, f"{UNIT}")
    marked = F.regexp_replace(marked, _NAME, NAME)
    return F.filter(F.split(F.lower(marked), _GAP), lambda t: t != "")


def values(text: Column) -> Column:
    """The numbers and words of a text in lower case, as they stand."""
    plain = F.regexp_replace(text, f"[{NUMBER}{NAME}{UNIT}]", " ")
    return F.transform(F.regexp_extract_all(plain, F.lit(f"({_TOKEN})"), F.lit(1)), F.lower)


def _window(tokens: Column, start: Column, size: int) -> Column:
    return F.xxhash64(F.slice(tokens, start, size))


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """``(width, hash, item_id, place)``: every window of an item; a shorter item is one window."""
    items = benchmark.select("item_id", template(text_of()).alias("_tokens")).filter(F.size("_tokens") > 0)
    width = F.least(F.size("_tokens"), F.lit(window))
    places = F.sequence(F.lit(1), F.size("_tokens") - width + 1)
    return (
        items.select("item_id", "_tokens", width.alias("width"), F.explode(places).alias("place"))
        .select("width", F.xxhash64(F.slice("_tokens", F.col("place"), F.col("width"))).alias("hash"), "item_id", "place")
        .distinct()
    )


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    window: int = WINDOW,
    min_agreement: float = MIN_AGREEMENT,
    broadcast_rows: int | None = None,
) -> DataFrame:
    """``(doc_id, item_id, start, agreement, slots)``: the best place of each item in each contaminated document.

    ``start`` is the template token of the text where the item begins, from 0
    (negative when its beginning is missing), ``slots`` the number of
    placeholders in the item. Null or empty texts and items without words match
    nothing; items shorter than a window must be there whole; null identifiers
    are ordinary values; repeated rows are reported once; other columns are
    ignored; empty tables give no rows. A passage shared by many documents
    costs a few rows in each, and no two documents are ever paired.
    """
    limit = {} if broadcast_rows is None else {"rows": broadcast_rows}
    wanted = materialise(benchmark_windows(benchmark, window), "benchmark-windows")
    small = small_enough(wanted, **limit)
    widths = sorted({r["width"] for r in wanted.select("width").distinct().limit(window).collect()})
    docs = df.select(F.col(id_col).alias("doc_id"), text_of().alias("text"))
    tokens = docs.select("doc_id", template(F.col("text")).alias("_tokens"))
    if not widths:
        none = docs.select("doc_id").limit(0).selectExpr(
            "doc_id", "CAST(null AS LONG) item_id", "0 start", "0D agreement", "0 slots"
        )
        return none.withColumnRenamed("doc_id", id_col)

    def windows(width: int) -> Column:
        last = F.size("_tokens") - width
        spots = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(spots, lambda i: _window(F.col("_tokens"), i + 1, width))

    def marked(width: int) -> Column:
        pair = lambda h, i: F.struct(F.lit(width).alias("width"), i.alias("at"), h.alias("hash"))
        return F.transform(windows(width), pair)

    if len(widths) == 1:
        here = tokens.select("doc_id", F.lit(widths[0]).alias("width"), F.posexplode(windows(widths[0])).alias("at", "hash"))
    else:
        # Items shorter than a window add widths; the texts are still read once.
        here = tokens.select("doc_id", F.explode(F.concat(*map(marked, widths))).alias("w")).select("doc_id", "w.*")
    hits = here.join(F.broadcast(wanted) if small else wanted, ["width", "hash"])
    # The same place is met by several windows of an item; they are one row, and the item is laid there once.
    places = materialise(
        hits.groupBy("doc_id", "item_id", (F.col("at") - F.col("place") + 1).alias("start")).agg(
            F.min("place").alias("lo"), F.max(F.col("place") + F.col("width")).alias("hi")
        ),
        "benchmark-hits",
    )
    ids = places.select(F.col("doc_id").alias("_hit")).distinct()
    few = small_enough(ids, **limit)
    ids = F.broadcast(ids) if few else ids
    found = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_hit")), "left_semi").distinct()
    found = found.select("doc_id", template(F.col("text")).alias("_t"), values(F.col("text")).alias("_v"))
    # All places of an item in a text are one row; they are fewer than its tokens.
    spots = places.groupBy(F.col("doc_id").alias("_hit"), "item_id").agg(
        F.array_sort(F.collect_list(F.struct("start", "lo", "hi"))).alias("_runs")
    )
    items = benchmark.select("item_id", template(text_of()).alias("_it"), values(text_of()).alias("_iv")).distinct()
    laid = found.join(spots, F.col("doc_id").eqNullSafe(F.col("_hit"))).drop("_hit")
    laid = laid.join(F.broadcast(items) if small else items, "item_id")
    steps = F.sequence(F.lit(1), F.size("_it"))
    slot = lambda i: F.element_at("_it", i).isin(NUMBER, NAME, UNIT)

    def agrees(i: Column, start: Column) -> Column:
        at = i + start - 1
        return F.coalesce(
            (F.get("_t", at) == F.element_at("_it", i)) | (F.get("_v", at) == F.element_at("_iv", i)), F.lit(False)
        )

    def score(run: Column, k: Column) -> Column:
        """Agreement of the item laid at a run; parts of it may lie at runs beside this one."""
        # Starts are distinct and in order, so all runs within the band are among these.
        beside = F.slice("_runs", F.greatest(k + 1 - BAND, F.lit(1)), F.lit(2 * BAND + 1))
        beside = F.filter(beside, lambda r: F.abs(r["start"] - run["start"]) <= BAND)
        inside = lambda i, r: (i >= r["lo"]) & (i < r["hi"]) & agrees(i, r["start"])
        moved = lambda i: F.get(F.filter(beside, lambda r: inside(i, r)), F.lit(0))["start"]

        def place(i: Column) -> Column:
            met = F.when(inside(i, run), run["start"]).otherwise(moved(i))
            loose = F.when(agrees(i, run["start"]), run["start"])
            return F.struct(i.alias("i"), F.coalesce(met, loose).alias("at"), met.isNotNull().alias("met"))

        agree = F.filter(F.transform(steps, place), lambda p: p["at"].isNotNull())
        # Beside other runs, a slot outside of all windows may have met a stranger.
        alone = F.size(beside) == 1
        filled = F.transform(
            F.filter(agree, lambda p: slot(p["i"]) & (p["met"] | alone)),
            lambda p: F.struct(F.element_at("_iv", p["i"]).alias("item"), F.get("_v", p["i"] + p["at"] - 1).alias("here")),
        )
        pairs = F.array_distinct(filled)
        # A value of the item that is filled in two ways shows as one item value in two pairs.
        consistent = F.size(pairs) == F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"])))
        agreement = (F.size(agree) / F.size("_it")).alias("agreement")
        return F.struct(agreement, (-run["start"]).alias("back"), consistent.alias("consistent"))

    scores = F.filter(F.transform("_runs", score), lambda x: x["consistent"] & (x["agreement"] >= min_agreement))
    top = laid.select("doc_id", "item_id", F.array_max(scores).alias("_top"), F.size(F.filter(steps, slot)).alias("slots"))
    scored = top.filter("_top IS NOT NULL").select(
        "doc_id", "item_id", F.col("_top.agreement").alias("agreement"), (-F.col("_top.back")).alias("start"), "slots"
    )
    best = F.max(F.struct("agreement", -F.col("start"), "slots")).alias("_best")
    return (
        scored.groupBy("doc_id", "item_id")
        .agg(best)
        .select(
            F.col("doc_id").alias(id_col),
            "item_id",
            (-F.col("_best.col2")).alias("start"),
            F.col("_best.agreement").alias("agreement"),
            F.col("_best.slots").alias("slots"),
        )
    )


def decontaminate(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose identifier has no leak. Rows with a null identifier are judged together."""
    bad = materialise(leaks(df, benchmark, id_col).select(F.col(id_col).alias("_bad")).distinct(), "leaks")
    bad = F.broadcast(bad) if small_enough(bad) else bad
    return df.join(bad, df[id_col].eqNullSafe(F.col("_bad")), "left_anti")
