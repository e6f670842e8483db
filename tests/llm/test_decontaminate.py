import random

import pytest
from pyspark.sql import functions as F

from wallflow.llm.decontaminate import NAME, NUMBER, UNIT, decontaminate, leaks, template, values

ITEM = "A farmer has 12 cows and sells 5 cows to Anna, walks 3 km home and then the farmer feeds the other 12 animals."
ASKED_AGAIN = "A farmer has 40 cows and sells 8 cows to Peter, walks 7 miles home and then the farmer feeds the other 40 animals."
INCONSISTENT = "A farmer has 40 cows and sells 8 cows to Peter, walks 7 miles home and then the farmer feeds the other 41 animals."
OTHER = "the quick brown fox jumps over the lazy dog while seven wizards quietly brew a potion in the old tower"


@pytest.fixture
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def found(rows):
    return sorted((r.doc_id, r.item_id) for r in rows.collect())


@pytest.mark.parametrize("bound", [None, 0])
def test_copies_and_new_parameters_are_found(docs, bench, bound):
    rows = docs(
        [
            (1, f"Before. {ITEM} After."),
            (2, f"Before. {ASKED_AGAIN} After."),
            (3, INCONSISTENT),
            (4, "A farmer has 12 cows and a dog. " * 20),
            (5, f"{OTHER}\n{OTHER} and {OTHER.upper()}"),
            (6, None),
            (7, ""),
            (8, "filler " * 40_000 + ITEM + " filler" * 10),
            (9, f"{ITEM} {OTHER}"),
        ]
    )
    got = leaks(rows, bench([(10, ITEM), (11, OTHER), (12, None), (13, "")]), broadcast_rows=bound)
    assert found(got) == [(1, 10), (2, 10), (5, 11), (8, 10), (9, 10), (9, 11)]


def test_every_item_is_found_in_every_document_that_holds_it(spark, docs, sample):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(i, t) for i, t, *_ in sample]
    rows += [(5000 + k, f"{sample[k][1]}\n{t}\n{sample[-k - 1][1]}") for k, (_, t) in enumerate(items)]
    squeeze = lambda t: " ".join(t.lower().split())
    want = {(i, k) for i, t in rows for k, x in items if squeeze(x) in squeeze(t)}
    got = set(found(leaks(docs(rows), bench)))
    assert want <= got and len(want) >= len(items)
    # Nothing but what holds an item, up to punctuation.
    words = lambda t: " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
    assert got <= {(i, k) for i, t in rows for k, x in items if words(x)[10:-10] in words(t)}


def test_short_items_must_be_there_whole(docs, bench):
    rows = docs([(1, "we saw red green blue today"), (2, "red green"), (3, "blue green red")])
    assert found(leaks(rows, bench([(1, "Red green blue")]))) == [(1, 1)]


def test_template_and_values_stand_side_by_side(spark):
    texts = [ITEM, "x1y2 3.5kg 7 km, Then We and NATO", "É à l'été 5% ½ ４２", " a b", "", "1,000.50 2.", "a Bc D Ef"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in rows.select(template(F.col("t")).alias("a"), values(F.col("t")).alias("b")).collect():
        assert len(r.a) == len(r.b)
        assert all(x == y or x in "" for x, y in zip(r.a, r.b, strict=True))


def test_rows_are_dropped_by_identifier(docs, bench):
    rows = docs([(1, ITEM), (1, ITEM), (2, "clean"), (None, OTHER), (None, "clean too"), (3, ITEM)]).withColumn("hash", F.lit(1))
    kept = decontaminate(rows, bench([(1, ITEM), (2, OTHER)]))
    assert [r.doc_id for r in kept.collect()] == [2]
    assert decontaminate(rows, bench([(1, ITEM)])).count() == 3


def test_empty_tables(docs, bench):
    assert leaks(docs([]), bench([(1, ITEM)])).collect() == []
    assert leaks(docs([(1, ITEM)]), bench([])).collect() == []
    assert decontaminate(docs([(1, ITEM)]), bench([])).count() == 1


def test_no_python_in_the_plan(docs, bench):
    plan = leaks(docs([(1, ITEM)]), bench([(1, ITEM)]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_text_of_many_numbers(docs, bench):
    rng = random.Random(3)
    item = "How much is " + ", ".join(str(rng.randrange(100)) for _ in range(40)) + " together in the end?"
    figures = " ".join(str(rng.randrange(1000)) for _ in range(20_000))
    rows = [(1, figures), (2, figures[:40_000] + " " + item), (3, "no figures at all")]
    got = {r.doc_id: r.agreement for r in leaks(docs(rows), bench([(1, item)])).collect()}
    assert got[2] == 1.0 and 3 not in got


def altered(tokens, how):
    """Text of an item with the change named."""
    half = len(tokens) // 2
    if how == "put in":
        return tokens[:half] + ["otherwise"] + tokens[half:]
    if how == "left out":
        return tokens[:half] + tokens[half + 1 :]
    if how == "every eighth":
        return ["otherwise" if k % 8 == 7 else t for k, t in enumerate(tokens)]
    return [t.upper() for t in tokens] if how == "capitals" else tokens


@pytest.mark.parametrize("how", ["as it is", "put in", "left out", "every eighth", "capitals"])
def test_altered_items_are_found(spark, docs, sample, how):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    rows = [(k, f"{sample[k][1]}\n{' '.join(altered(t.split(), how))}\n{sample[-k - 1][1]}") for k, (_, t) in enumerate(items)]
    got = set(found(leaks(docs(rows), bench)))
    assert sum((k, i) in got for k, (i, _) in enumerate(items)) >= 0.9 * len(items)


def plain_leaks(text, item):
    """Whether the item may be laid beside the text: tokens are given as (template, value) pairs."""
    size, width = len(item), min(6, len(item))
    same = lambda i, s: 0 <= i + s < len(text) and (text[i + s][0] == item[i][0] or text[i + s][1] == item[i][1])
    runs = {}
    for p in range(size - width + 1):
        for at in range(len(text) - width + 1):
            if all(text[at + j][0] == item[p + j][0] for j in range(width)):
                lo, hi = runs.get(at - p, (p, p + width))
                runs[at - p] = (min(lo, p), max(hi, p + width))
    for s in runs:
        beside = [r for r in sorted(runs) if abs(r - s) <= 4]
        agree, means, fine = 0, {}, True
        for i in range(size):
            met = [r for r in [s, *beside] if runs[r][0] <= i < runs[r][1] and same(i, r)]
            at = met[0] if met else s if same(i, s) else None
            agree += at is not None
            if at is not None and item[i][0] in "" and (met or len(beside) == 1):
                fine &= means.setdefault(item[i][1], text[i + at][1]) == text[i + at][1]
        if fine and agree >= 0.6 * size:
            return True
    return False


def test_against_plain_code(spark, docs, bench):
    rng = random.Random(5)
    words = ["red", "blue", "sees", "Anna", "Bob", "3", "47", "km", "and", "then", "home", "walks"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 9, 14])))) for k in range(8)]
    rows = []
    for d in range(80):
        part = altered(items[d % 8][1].split(), rng.choice(["put in", "left out", "every eighth", "capitals"]))
        part = [rng.choice(words) if rng.random() < 0.12 else w for w in part]
        rows.append((d, " ".join([*(rng.choice(words) for _ in range(d % 5)), *part, *(rng.choice(words) for _ in range(4))])))
    tokens = lambda df: {r[0]: list(zip(r.t, r.v, strict=True)) for r in df.select(df.columns[0], template(F.col("text")).alias("t"), values(F.col("text")).alias("v")).collect()}  # noqa: E731,E501
    texts, wanted = tokens(docs(rows)), tokens(bench(items))
    want = sorted((d, k) for d in texts for k in wanted if plain_leaks(texts[d], wanted[k]))
    assert found(leaks(docs(rows), bench(items))) == want and 20 < len(want) < 600
