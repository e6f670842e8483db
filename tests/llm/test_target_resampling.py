import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from wallflow.llm import target_resampling


def features(text, ngram):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return words, [" ".join(words[i : i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]


def plain(rows, target, ngram=1, buckets=100, min_words=4, percent=30):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in rows]), (t, target)):
        for text in texts:
            for f in features(text, ngram)[1]:
                counts[bucket(f)] += 1
    gain = [math.floor(1000 * math.log(((b + 1.0) * (sum(s) + buckets)) / ((a + 1.0) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in rows:
        words, found = features(text, ngram)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words), len(found), weight, weight + noise])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = len(able) * percent // 100
    ranks = {id(r): k + 1 for k, r in enumerate(able[:drawn])}
    return sorted(((*r, ranks.get(id(r))) for r in out), key=repr)


def made():
    rng = random.Random(1)
    lines = [" ".join(rng.choice(["Alpha", "beta", "ÉTÉ", "x1", "Z-z", "l'an"]) for _ in range(rng.randrange(8))) for _ in range(20)]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 7)))) for i in range(60)]
    hot = lines[3] + " common"
    rows += [(100 + i, hot) for i in range(30)] + [(7, rows[7][1]), (200, None), (201, ""), (202, "\n\n"), (203, "!!"), (None, hot)]
    rows += [(300, "one two three four " * 3000), (301, "a\nb\n\nc\nd e\r\nf")]
    return rows, ["alpha beta\nétÉ x1", None, "common alpha alpha"]


def found(spark, df, target, **options):
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    return sorted((tuple(r) for r in target_resampling.resample(df, wanted, **options).collect()), key=repr)


def test_against_plain_counts(spark, docs):
    rows, target = made()
    for ngram in (1, 3):
        options = {"ngram": ngram, "buckets": 100, "min_words": 4, "percent": 30}
        assert found(spark, docs(rows), target, **options) == plain(rows, target, **options)


def test_odd_tables(spark, docs):
    rows, target = made()
    assert found(spark, docs([]), target) == []
    options = {"buckets": 100, "min_words": 0, "percent": 100}
    assert found(spark, docs(rows), [], **options) == plain(rows, [], **options)
    clash = docs(rows).withColumn("line", F.lit(1)).withColumn("rank", F.lit("x")).withColumn("score", F.lit(None)).withColumn("k1", F.lit(2))
    assert found(spark, clash, target, **options) == plain(rows, target, **options)


def test_a_distinct_line_is_counted_once(spark, docs):
    rows, _ = made()
    lines = target_resampling.distinct_lines(docs(rows).select("text"), 1, 100).collect()
    texts = {line for _, t in rows for line in (t or "").split("\n") if features(line, 1)[0]}
    assert len(lines) == len(texts)
    assert sum(r.times * len(r.buckets) for r in lines) == sum(len(features(t, 1)[1]) for _, t in rows)
