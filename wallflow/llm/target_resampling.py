"""Importance resampling towards a target distribution, by hashed n-grams.

A line break separates words, so texts are cut into lines and the features of
each distinct line are counted once, however often the line occurs: bucket
counts multiply them by its occurrences, and a document's gain is the sum over
its lines. Runs of words that go over a line break are no line's own; they are
found in the whole text and added. (With single words there are none.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wallflow.llm.common import small_enough
from wallflow.operators.ordering import block_offsets
from wallflow.session import discard, materialise

NGRAM = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ASCII characters but letters and digits stand between words.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A to Z in lower case."""
    return F.filter(F.split(F.translate(text, _UPPER, _LOWER), _BETWEEN), lambda w: w != "")


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(feature, "UTF-8")) % buckets).cast("int")


def _runs(tokens: Column, starts: Column, length: int, buckets: int) -> Column:
    return F.transform(starts, lambda i: _bucket(F.array_join(F.slice(tokens, i, length), " "), buckets))


def line_features(tokens: Column, ngram: int, buckets: int) -> Column:
    """Bucket of every run of 1 to ``ngram`` words of one line, repeats included."""
    out = [F.transform(tokens, lambda w: _bucket(w, buckets))]
    for length in range(2, ngram + 1):
        last = F.size(tokens) - length + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        out.append(_runs(tokens, starts, length, buckets))
    return F.concat(*out)


def cross_features(text: Column, ngram: int, buckets: int) -> Column:
    """Bucket of every run of 2 to ``ngram`` words of a text that goes over a line break."""
    lines = F.transform(F.split(text, "\n"), words)
    tokens = F.flatten(lines)
    line_of = F.flatten(F.transform(lines, lambda x, i: F.array_repeat(i, F.size(x))))
    out = [F.array().cast("array<int>")]
    for length in range(2, ngram + 1):
        last = F.size(tokens) - length + 1
        starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        over = F.filter(starts, lambda i: F.get(line_of, i - 1) != F.get(line_of, i + length - 2))  # noqa: B023
        out.append(_runs(tokens, over, length, buckets))
    return F.concat(*out)


def _key(line: Column) -> list[Column]:
    """128 bits that tell lines apart."""
    return [F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(1), line).alias("k2")]


def distinct_lines(texts: DataFrame, ngram: int, buckets: int) -> DataFrame:
    """Each distinct line of ``text``: key, number of words, buckets of its features, and how often it occurs."""
    lines = texts.select(F.explode(F.split("text", "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("times"))
    tokens = lines.select("line", "times", words(F.col("line")).alias("tokens")).filter(F.size("tokens") > 0)
    return tokens.select(
        *_key(F.col("line")), "times", F.size("tokens").alias("n_words"), line_features(F.col("tokens"), ngram, buckets).alias("buckets")
    )


def bucket_counts(texts: DataFrame, lines: DataFrame, ngram: int, buckets: int) -> DataFrame:
    """``(bucket, n)``: how many features of all texts fall into a bucket; buckets without any are left out."""
    found = lines.select(F.explode("buckets").alias("bucket"), "times")
    if ngram > 1:
        over = texts.select(F.explode(cross_features(F.col("text"), ngram, buckets)).alias("bucket"), F.lit(1).cast("long").alias("times"))
        found = found.union(over)
    return found.groupBy("bucket").agg(F.sum("times").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int) -> list[int]:
    """Gain of each bucket; the driver gets the ``buckets`` numbers, whatever the data."""
    both = raw.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t")).union(
        target.select("bucket", F.lit(0).cast("long"), "n")
    )
    counts = materialise(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "bucket-counts")
    total = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    every = counts.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    whole = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    above = (whole("t") + 1.0) * F.lit(float(total["s"] + buckets))
    below = (whole("s") + 1.0) * F.lit(float(total["t"] + buckets))
    gains = every.select("bucket", F.floor(1000.0 * F.log(above / below)).alias("gain")).orderBy("bucket").collect()
    discard(counts)
    return [r["gain"] for r in gains]


def _sum_of(gains: list[int]):
    """Sum of the gains of an array of buckets."""
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<long>")
    zero = F.lit(0).cast("long")
    return lambda found: F.aggregate(found, zero, lambda total, b: total + F.get(table, b))


def weigh(df: DataFrame, lines: DataFrame, gains: list[int], ngram: int, buckets: int) -> DataFrame:
    """``id, n_words, n_features, weight`` of each row of ``(id, text)``."""
    gain = _sum_of(gains)
    known = lines.select("k1", "k2", "n_words", F.size("buckets").alias("n"), gain(F.col("buckets")).alias("gain"))
    rows = df.withColumn("row", F.monotonically_increasing_id())
    over = cross_features(F.col("text"), ngram, buckets) if ngram > 1 else None
    own = (F.size(over), gain(over)) if ngram > 1 else (F.lit(0), F.lit(0).cast("long"))
    # What the whole text adds goes with its first line.
    parts = rows.select("row", "id", own[0].cast("long").alias("more_n"), own[1].alias("more_gain"), F.posexplode_outer(F.split("text", "\n")).alias("at", "line"))
    first = lambda c: F.when(F.col("at") == 0, F.col(c)).otherwise(0).alias(c)
    parts = parts.select("row", "id", first("more_n"), first("more_gain"), *_key(F.col("line")))
    # A common line is one row on the right; the left is split by adaptive execution.
    sums = parts.join(known, ["k1", "k2"], "left").groupBy("row", "id").agg(
        F.coalesce(F.sum("n_words"), F.lit(0)).cast("long").alias("n_words"),
        (F.coalesce(F.sum("n"), F.lit(0)) + F.sum("more_n")).cast("long").alias("n_features"),
        (F.coalesce(F.sum("gain"), F.lit(0)) + F.sum("more_gain")).alias("total"),
    )
    mean = F.expr("CASE WHEN n_features > 0 THEN (total - pmod(total, n_features)) DIV n_features ELSE 0L END")
    return sums.select("id", "n_words", "n_features", mean.alias("weight"))


def _noise(seed: int) -> Column:
    """Gumbel noise in thousandths, decided by the identifier."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _drawn(scored: DataFrame, min_words: int, percent: int) -> DataFrame:
    """Add ``rank``: 1, 2, ... for the highest scores, else null.

    Scores are whole numbers of a narrow range, so the rows above each come
    from a short table of counts; only rows of one score are sorted together.
    """
    able = scored.filter(F.col("n_words") >= min_words)
    counts = materialise(able.groupBy((-F.col("score")).alias("_block")).agg(F.count(F.lit(1)).alias("_total")), "scores")
    n = counts.agg(F.coalesce(F.sum("_total"), F.lit(0)).alias("n")).first()["n"] * percent // 100
    above = block_offsets(counts).filter(F.col("_offset") < n).select((-F.col("_block")).alias("score"), "_offset")
    above = F.broadcast(above) if small_enough(above) else above
    reach = scored.join(above, "score", "left").withColumn("_in", (F.col("n_words") >= min_words) & F.col("_offset").isNotNull())
    none = F.lit(None).cast("long")
    out = reach.filter(~F.col("_in")).withColumn("rank", none)
    order = Window.partitionBy("score").orderBy(F.col("id").asc_nulls_last(), "n_features", "weight")
    place = F.col("_offset") + F.row_number().over(order)
    ranked = reach.filter("_in").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return out.unionByName(ranked).drop("_offset", "_in")


def resample(
    df: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ngram: int = NGRAM,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``df``: the identifier, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank``.

    Texts like those of ``target`` (its column of the same name) weigh more.
    The best ``percent`` of the documents with at least ``min_words`` words
    are drawn and ranked from 1; the others have no rank. Null and empty texts
    have no features, weight 0, and are not drawn unless ``min_words`` is 0.
    Ties go to the smaller identifier; rows that repeat an identifier have the
    same noise and ranks of their own. A row without identifier comes last
    among ties, its noise that of an empty one. Other columns are ignored, so
    clashing names cannot matter; empty tables give no rows, and an empty
    target gives every bucket the gain of its rarity.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    wanted = target.select(F.col(text_col).alias("text"))
    lines = materialise(distinct_lines(texts, ngram, buckets), "lines")
    gains = bucket_gains(
        bucket_counts(texts, lines, ngram, buckets),
        bucket_counts(wanted, distinct_lines(wanted, ngram, buckets), ngram, buckets),
        buckets,
    )
    weighed = weigh(texts, lines, gains, ngram, buckets)
    scored = materialise(weighed.withColumn("score", F.col("weight") + _noise(seed)), "scored")
    discard(lines)
    return _drawn(scored, min_words, percent).select(
        F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", "rank"
    )
