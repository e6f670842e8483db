import random

import pytest
from pyspark.sql import functions as F

from wallflow.llm.line_dedup import drop_boilerplate


def plain(rows, ratio, least):
    pages = {}
    for _, t, s in rows:
        pages.setdefault(s or "", set()).add(t or "")
    bad = {}
    for s, texts in pages.items():
        count = {}
        for t in texts:
            for line in {x.strip(" ") for x in t.split("\n")} - {""}:
                count[line] = count.get(line, 0) + 1
        bad[s] = {x for x, n in count.items() if n >= least and n / len(texts) > ratio}
    out = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if x.strip(" ") not in bad[s or ""]]
        out.append((i, None if t is None else "\n".join(kept), len(lines) - len(kept)))
    return sorted(out, key=repr)


def made():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lines = [f"own {i} {k}" for k in range(3)] + rng.choice([["Home"], [" Home "], ["About", "", "Home"], []])
        rows.append((i, "\n".join(lines), rng.choice(["a", "a", "a", "b", None])))
    rows += [(1000 + i, "copied page\nwith two lines", "a") for i in range(200)]
    rows += [(2000, None, "a"), (2001, "", "a"), (2002, "\n\n", "b"), (2003, "Home", "a"), (2003, "Home", "a"), (None, "Home\nx", None)]
    rows += [(3000, "long line " * 30_000 + "\nHome", "b"), (3001, "Home\nHome\nx", "b"), (3002, "only page\nof its site", "c")]
    return rows


@pytest.mark.parametrize("bound", [None, 0])
def test_both_ways_against_plain_code(docs, bound):
    rows = made()
    got = drop_boilerplate(docs(rows), ratio=0.1, broadcast_rows=bound)
    assert sorted(((r.doc_id, r.text, r.lines_dropped) for r in got.collect()), key=repr) == plain(rows, 0.1, 3)


def test_copies_of_a_page_do_not_make_it_boilerplate(docs):
    got = drop_boilerplate(docs(made()), ratio=0.1).filter("doc_id BETWEEN 1000 AND 1199").select("text").distinct().collect()
    assert [r.text for r in got] == ["copied page\nwith two lines"]


def test_clashing_names_and_empty_table(docs):
    table = docs([(1, "x", "a")]).withColumn("lines_dropped", F.lit("own")).withColumn("host", F.lit("h")).withColumn("line", F.lit(1))
    assert drop_boilerplate(table).first().lines_dropped == 0
    assert drop_boilerplate(docs([])).collect() == []
