import zlib

from pyspark.sql import functions as F

from wallflow.llm.sharding import _range_of, shard_rows


def by_shard(rows):
    out = {}
    for r in rows:
        out.setdefault(r.shard, []).append(r)
    return out


def test_sizes_slots_and_digests(docs, sample):
    rows = shard_rows(docs([(i, t) for i, t, *_ in sample]), 16).collect()
    text = {i: t.encode() for i, t, *_ in sample}
    assert sorted(r.doc_id for r in rows) == sorted(text)
    assert all(r.size == len(text[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id]) for r in rows)
    total, most = sum(r.size for r in rows), max(r.size for r in rows)
    shards = by_shard(rows)
    assert set(shards) <= set(range(16))
    for own in shards.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 16) <= most


def test_hot_text_is_spread_and_small_groups_stay_together(docs):
    rows = [(i, "same words again and again") for i in range(600)]
    rows += [(1000 + i, f"text number {i // 3} " * 4) for i in range(900)]
    got = shard_rows(docs(rows), 8).collect()
    sizes = [sum(r.size for r in own) for own in by_shard(got).values()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)
    homes = {}
    for r in got:
        if r.doc_id >= 1000:
            homes.setdefault((r.doc_id - 1000) // 3, set()).add(r.shard)
    assert sum(len(h) > 1 for h in homes.values()) <= 8


def test_nulls_empty_texts_repeated_rows_and_clashing_names(spark, docs):
    rows = docs([(None, None), (None, None), (1, ""), (1, ""), (2, "é" * 50_000), (3, "x")]).withColumn("slot", F.lit("own"))
    got = shard_rows(rows, 4).collect()
    assert len(got) == 6
    assert sorted(r["size"] for r in got) == [1, 1, 1, 1, 2, 100_001]
    for own in by_shard(got).values():
        assert sorted(r.slot for r in own) == list(range(len(own)))


def test_empty_table(docs):
    assert shard_rows(docs([]), 4).collect() == []


def test_range_lookup(spark):
    bounds = [{"h": h, "i": None if h % 2 else h} for h in range(-100, 100, 3)]
    key = F.struct(F.col("id").alias("h"), F.col("id").alias("i"))
    got = spark.range(-110, 110).select("id", _range_of(key, bounds).alias("r")).collect()
    order = lambda h, i: (h, i is not None, i or 0)
    for r in got:
        assert r.r == sum(order(b["h"], b["i"]) <= order(r.id, r.id) for b in bounds)
