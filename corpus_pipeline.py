"""From raw documents to packed training sequences, one operator a stage.

Each stage reads what its predecessor kept and returns the columns of
``documents``; the last returns the places of all pieces in the sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wallflow.llm import decontaminate, language_id, line_dedup, packing, simhash
from wallflow.llm.common import small_enough
from wallflow.llm.queries import TOKENIZER
from wallflow.session import discard, materialise

# A text whose phrases are shorter than this on average has nothing in common with any language.
MIN_PHRASE_CHARS = 1.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognisable language; a missing label is filled in.

    Null and empty texts and texts without letters have no language and go.
    Repeated rows stay or go together; columns beside those of ``documents``
    are carried along.
    """
    rows = language_id.identify(docs, language_id.fit(docs))
    known = rows.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("phrase_chars") >= MIN_PHRASE_CHARS))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that are boilerplate of their source; ``n_chars`` follows.

    Every row stays, if need be with an empty text; a null text stays null, a
    null source is a source of its own, and equal texts of a source count once.
    """
    rows = line_dedup.drop_boilerplate(docs)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that with the least identifier, of those linked by their fingerprints.

    Texts without words, null ones among them, have equal fingerprints and are
    linked. Among rows with the least identifier one stays, that whose text has
    the least hash. A row without identifier counts as the greatest of its group.
    """
    rows = docs.withColumn("_row", F.xxhash64("text"))
    found = simhash.near_duplicates(rows, carry="_row").groupBy("root", "doc_id", "_row").agg(F.count(F.lit(1)).alias("_n"))
    groups = materialise(found, "groups")
    # Structs are compared field by field, so null identifiers come last.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    least = groups.groupBy("root").agg(F.min(order).alias("_least"))
    tagged = groups.join(least, "root").withColumn("_stays", order.eqNullSafe(F.col("_least")))
    keys = lambda df, name: materialise(df.select(F.col("doc_id").alias("_id"), F.col("_row").alias("_text")), name)
    gone = keys(tagged.filter("NOT _stays"), "copies")
    again = keys(tagged.filter("_stays AND _n > 1"), "repeats")
    here = (F.col("_row") == F.col("_text")) & F.col("doc_id").eqNullSafe(F.col("_id"))
    side = lambda df: F.broadcast(df) if small_enough(df) else df
    left = rows.join(side(gone), here, "left_anti")
    once = left.join(side(again), here, "left_anti")
    kept = once.unionByName(left.join(side(again), here, "left_semi").dropDuplicates(["doc_id", "_row"]))
    return kept.select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no benchmark item.

    Null and empty texts hold none and stay; of rows that share an identifier
    all go if one holds an item, and rows without identifier are judged by
    themselves.
    """
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.decontaminate(docs, benchmark).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place every document in sequences of 1024 tokens.

    A row per piece; a null or empty text is one piece, the end token alone.
    Repeated rows are placed once each.
    """
    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_site_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("packing", pack_sequences),
]

# Cross-parsing, SimHash and token ids are beyond SQL; the tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next one reads it, and removed when that one is written."""
    docs, written = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
