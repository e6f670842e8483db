import hashlib
import random

import pytest
from pyspark.sql import functions as F

from wallflow.llm import substring_dedup


def plain(rows, window):
    """Words removed and kept of each row, by looking at every window."""
    first = {}
    ident = lambda i: substring_dedup.LAST if i is None else i
    texts = [(i, [w for w in (t or "").replace("\v", " ").replace("\f", " ").split(" ") if w]) for i, t in rows]
    for i, w in texts:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(ident(i), first.get(key, substring_dedup.LAST))
    out = []
    for i, w in texts:
        gone = set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < ident(i):
                gone.update(range(k, k + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


def made(seed=3):
    """Texts of few words, with copies, shared passages, runs of one word, and odd rows."""
    rng = random.Random(seed)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 900}"
    passages = [[word() for _ in range(n)] for n in (5, 6, 12, 13, 14, 27, 60)]
    rows = []
    for i in rng.sample(range(1000), 150):
        text = [word() for _ in range(rng.choice([0, 3, 12, 13, 40, 200]))]
        for p in rng.sample(passages, rng.randrange(3)):
            at = rng.randrange(len(text) + 1)
            text[at:at] = p
        if rng.random() < 0.2:
            text += ["same"] * rng.choice([12, 13, 14, 40])
        if rows and rng.random() < 0.3:
            text = rng.choice(rows)[1].split()
            if text and rng.random() < 0.5:
                text[rng.randrange(len(text))] = "changed"
        rows.append((i, " ".join(text)))
    hot = " ".join(word() for _ in range(90))
    rows += [(2000 + k, hot) for k in range(60)] + [rows[0], rows[0], (rows[1][0], hot), (None, hot), (None, hot)]
    return rows + [(5000, None), (5001, ""), (5002, " \v\f "), (5003, "é ü " * 30), (5004, "é ü " * 13)]


def found(df, **options):
    rows = substring_dedup.remove_repeats(df, **options).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in rows), key=repr)


@pytest.mark.parametrize("window", [1, 6, 13, 30])
def test_against_every_window(docs, window):
    rows = made()
    for chunk in (50, 1 << 20):
        assert found(docs(rows), window=window, chunk_words=chunk) == plain(rows, window)


def test_levels_double():
    assert substring_dedup.levels(13) == [6, 13]
    assert substring_dedup.levels(50) == [6, 12, 25, 50]
    assert substring_dedup.levels(7) == [7]


def test_each_window_is_stood_for_by_the_same_part_wherever_it_stands():
    import numpy as np

    rng = np.random.default_rng(0)
    words = rng.integers(0, 40, 400, dtype=np.uint64)
    for length in (6, 12, 25):
        parts = []
        for shift in (0, 3, 11):
            chunk = substring_dedup._Chunk()
            chunk.add(1, 0, rng.integers(0, 40, shift + 50, dtype=np.uint64), None)
            chunk.add(2, 0, words, None)
            at = chunk.windows(50, length, None, 6)
            parts.append({int(p) - chunk.starts[1] for p in at if p >= chunk.starts[1]})
        assert parts[0] == parts[1] == parts[2]


def test_odd_tables(spark, docs):
    assert substring_dedup.remove_repeats(docs([])).count() == 0
    rows = made(4)
    clash = docs(rows).withColumn("doc", F.lit(1)).withColumn("place", F.lit("x")).withColumn("n", F.lit(None)).withColumn("kept", F.lit(1))
    assert found(clash) == plain(rows, 13)
    nothing = [(i, None) for i in range(3)]
    assert found(docs(nothing)) == [(i, 0, 0, "") for i in range(3)]


def test_very_long_text(docs):
    rng = random.Random(9)
    text = [f"w{rng.randrange(50_000)}" for _ in range(120_000)]
    rows = [(1, " ".join(text)), (2, " ".join(text[:60_000] + ["x"] + text[60_000:])), (3, "a " * 50_000)]
    got = found(docs(rows), chunk_words=30_000)
    assert [(r[1], r[2]) for r in got] == [(120_000, 0), (120_001, 120_000), (50_000, 0)]
    assert hashlib.sha256(got[1][3].encode()).hexdigest() == hashlib.sha256(b"x").hexdigest()
