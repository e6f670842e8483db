import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wallflow.llm import simhash


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Root of each fingerprint by looking at all pairs."""
    parent = {f: f for f in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    return {f: root(f) for f in fps}


TEXTS = [None, "", " \n", "One", "one two", "A b c d", "é É x y z", "word " * 5_000, "a b c " * 9 + "d"]


def test_fingerprints(docs):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    got = simhash.fingerprints(docs(rows)).collect()
    assert {r.doc_id: r.fp % 2**64 for r in got} == {i: plain_fingerprint(t) for i, t in rows}


def test_hash_is_the_same_as_in_sql(spark):
    texts = ["a", "hello world abc", "é" * 40, "x" * 333]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.xxhash64("t").alias("h")).collect()
    assert all(r.h % 2**64 == xxhash.xxh64_intdigest(r.t.encode(), 42) for r in got)


def test_anchors_of_fingerprints_within_two_bits_meet(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample([*range(64), 63, 0], rng.choice([1, 2])):
            b ^= 1 << bit
        pairs.append((simhash._signed(a), simhash._signed(b)))
    rows = spark.createDataFrame(pairs, "a long, b long")
    got = rows.select(simhash.anchors(F.col("a")).alias("a"), simhash.anchors(F.col("b")).alias("b")).collect()
    assert all(set(r.a) & set(r.b) for r in got)
    assert max(len(set(r.a)) for r in got) <= 33


def test_links_connect_exactly_what_is_near(spark):
    rng = random.Random(7)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:60]:
        # Chains, and a ball around one of them.
        for _ in range(rng.choice([1, 2, 6])):
            f ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            fps.add(f)
    centre = next(iter(fps))
    fps |= {centre ^ (1 << i) ^ (1 << j) for i in range(0, 64, 5) for j in range(i)}
    fps = {simhash._signed(f) for f in fps}
    rows = spark.createDataFrame([(f,) for f in fps], "fp long").repartition(3)
    edges = simhash.links(rows)
    roots = {r.fp: r.root for r in simhash.components(edges).collect()}
    want = plain_components({f % 2**64 for f in fps})
    groups = {}
    for f in fps:
        groups.setdefault(want[f % 2**64], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_near_duplicates_against_all_pairs(docs, sample):
    rows = [(i, t) for i, t, *_ in sample] + [(1000 + i, t) for i, t in enumerate(TEXTS)]
    rows += [(2000 + i, t.replace("e", "é", 1)) for i, t, *_ in sample[:60]]
    rows += [(3000, "same again"), (3000, "same again"), (None, "same again"), (None, "alone here with null")]
    table = docs(rows).withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = simhash.near_duplicates(table).collect()
    assert len(got) == len(rows)
    roots = plain_components({r.fp % 2**64 for r in got})
    least = {}
    for r in got:
        if r.doc_id is not None:
            k = roots[r.fp % 2**64]
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(r.component_id == least.get(roots[r.fp % 2**64]) for r in got)


def test_empty_table(docs):
    assert simhash.near_duplicates(docs([])).collect() == []


def test_forest_links_a_chain():
    chain = np.array([0, 3, 15, 63, 255 << 20], dtype=np.int64)
    assert simhash._forest(chain) == [(0, 3), (0, 15), (0, 63)]
