"""Queries against their SQL, and each stage of the pipeline against what it must do."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests import compare
from wallflow.llm import queries, simhash
from wallflow.llm.decontaminate import leaks

SMALL = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SMALL).is_dir(), reason="no tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    tables = compare.open_tables(SMALL)
    got = queries.QUERIES[name](spark, SMALL)
    cursor = tables.execute(queries.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, map(tuple, want)))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_one_row_for_each_input_row(spark, name):
    got = queries.QUERIES[name](spark, SMALL)
    count = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet").count()
    if name.startswith("op2_"):
        ids = spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id").distinct().count()
        assert got.count() == ids + 1
    elif name.startswith("op3_"):
        assert got.filter("piece = 0").count() == count("documents")
    elif name.startswith("op4_"):
        assert 0 < got.count() < count("documents")
    else:
        table = {"op5": "pages", "op13": "embeddings"}.get(name.split("_")[0], "documents")
        assert got.count() == count(table)


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").cache()
    odd = spark.createDataFrame(
        [(9001, None, None, "src1", 0), (9002, "12 34 %%", None, "src1", 8), (9003, "漢字漢字漢字", None, "src1", 6)], docs.schema
    )
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language_id"](spark, docs.unionByName(odd), SMALL).cache()
    assert sorted(r.doc_id for r in named.collect()) == sorted(r.doc_id for r in docs.collect())
    lines = stages["line_dedup"](spark, named, SMALL).cache()
    assert lines.count() == named.count() and lines.filter("n_chars != length(text)").count() == 0
    single = stages["near_dedup"](spark, lines, SMALL).cache()
    groups = simhash.near_duplicates(lines)
    assert sorted(r.doc_id for r in single.collect()) == sorted(r[0] for r in groups.select("component_id").distinct().collect())
    clean = stages["decontaminate"](spark, single, SMALL).cache()
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert single.count() - clean.count() == leaks(single, bench).select("doc_id").distinct().count()
    assert leaks(clean, bench).count() == 0
    assert all(x.columns == docs.columns for x in (named, lines, single, clean))
    packed = stages["packing"](spark, clean, SMALL)
    assert packed.filter("piece = 0").count() == clean.count()


def test_near_dedup_keeps_one_row_of_each_group(spark, docs):
    words = [f"w{i}" for i in range(400)]
    text, near, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    differ = bin(simhash.fingerprint(text) ^ simhash.fingerprint(near)).count("1")
    rows = [(5, text), (5, text), (6, text), (None, text), (3, other), (3, other), (3, "one two three four"), (None, "q r s"), (None, "q r s"), (8, None), (9, "")]
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    kept = stage(spark, docs([*rows, (5, near), (2, near)]), SMALL)
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    alone = [(3, other), (3, "one two three four"), (None, "q r s"), (8, None)]
    assert got == sorted([*alone, (2, near)] + ([] if differ <= 2 else [(5, text)]), key=repr)
    clash = docs(rows).withColumn("root", F.lit(1)).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(None))
    assert stage(spark, clash, SMALL).columns == clash.columns and stage(spark, clash, SMALL).count() == 5


def test_run_is_the_stages_one_after_another(spark):
    got = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    kept = lambda x: sorted(tuple(r) for r in x.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    assert kept(got) == kept(docs)


def test_run_on_nothing(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SMALL)
    assert empty.count() == 0
