import hashlib
import re

from wallflow.llm.exact_dedup import exact_duplicates, merge_runs


def plain(rows):
    body = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    least, count = {}, {}
    for i, t in body:
        count[t] = count.get(t, 0) + 1
        if i is not None:
            least[t] = min(least.get(t, i), i)
    return sorted(
        ((i, least.get(t), count[t], least.get(t) in (i, None), hashlib.sha256(t.encode()).hexdigest()) for i, t in body),
        key=repr,
    )


def test_against_plain_code(docs, rows_of):
    rows = [(9, "a  b"), (3, "a\tb"), (5, "a b "), (6, " a b"), (1, None), (8, ""), (2, "é" * 200_000), (4, "a\n\x0bb")]
    rows += [(2, "é" * 200_000), (None, "only null"), (None, "only null"), (None, "a b"), (7, "a b"), (11, "  ")]
    rows += [(i, "hot") for i in range(100, 400)]
    assert sorted(rows_of(exact_duplicates(docs(rows))), key=repr) == plain(rows)


def test_empty_table(docs):
    assert exact_duplicates(docs([])).collect() == []


def test_runs_merge_to_one_row_per_digest(spark):
    rows = [(i, f"k{i % 7}".encode(), 1, 1) for i in range(500)]
    digests = spark.createDataFrame(rows, "_id long, _sha binary, _bytes int, _check long").repartition(13)
    for runs, fan_in in ((1, 4), (13, 2), (64, 4), (5, 3)):
        got = sorted((bytes(r._sha), r._least, r._n) for r in merge_runs(digests, runs, fan_in).collect())
        assert got == sorted((f"k{k}".encode(), k, len(range(k, 500, 7))) for k in range(7))


def test_no_python_in_the_plan(docs):
    plan = exact_duplicates(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
