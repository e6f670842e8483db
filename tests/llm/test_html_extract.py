import html
import re

import numpy as np
import pytest

from wallflow.llm import html_extract
from wallflow.llm.html_extract import (
    CHROME,
    MAIN,
    MIN_RUN,
    NEUTRAL,
    blocks,
    cover,
    distinct_prefixes,
    extract_pages,
    pack,
    prefixes,
    unpack,
)

SCHEMA = "page_id long, url string, html string"


def main_text(page):
    return " ".join(t for r, t in blocks(page) if r == MAIN)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<article>a <b>b</b>c<br>d</article>", "a bc d"),
        ("<article>x<script>var t='</p><p>no';</script>y<style>p{}</style> z<!-- <p>no</p> --></article>", "x y z"),
        ("<nav>menu</nav><article><h1>T&amp;t</h1><p>one<p>two &#233;&eacute;&nbsp; three</article><footer>f</footer>", "T&t one two éé three"),
        ("<article><p>a</p><div class='ad-box'>buy</div><aside>s</aside><form>f<button>b</button></form><p>c</p></article>", "a c"),
        ("<main><header><h1>Title</h1></header><p>x</p><section id=comments><article>me too</article></section></main>", "Title x"),
        ("<article><p class=notice>gone<p>kept <span hidden>no</span>yes<div style='display: none'>no</div></article>", "kept yes"),
        ("<article>1 < 2 & 3 > 2 <unknown a='>'>tag</unknown>", "1 < 2 & 3 > 2 tag"),
        ('<article title="unbalanced>text</article><p>later', "text"),
        ("<ARTICLE><P>Up</P></ARTICLE>", "Up"),
        ("<article><ul><li>a<li>b</ul>cut <p", "a b cut"),
        ("<article>cut &am", "cut &am"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


def test_roles():
    got = blocks("<body class='has-sidebar'><div>n</div><div class=menu>m</div><article>a</article>")
    assert got == [(NEUTRAL, "n"), (CHROME, "m"), (MAIN, "a")]


def test_long_and_deep_pages_take_linear_time():
    assert main_text("<article>" + "<b>" * 20_000 + "x" + "<" * 20_000).startswith("x")
    assert main_text("<article>" + "<p>word " * 50_000).count("word") == 50_000
    assert blocks("<a href='" * 3_000) is not None


def plain_repeated(streams, owners, run):
    seen = {}
    for s, o in zip(streams, owners, strict=True):
        for i in range(len(s) - run + 1):
            seen.setdefault(tuple(s[i : i + run]), set()).add(o)
    out = []
    for s in streams:
        cover = np.zeros(len(s), dtype=bool)
        for i in range(len(s) - run + 1):
            if len(seen[tuple(s[i : i + run])]) > 1:
                cover[i : i + run] = True
        out.append(cover)
    return out


@pytest.mark.parametrize("run", [1, 2, 3, 6, 8])
def test_covered_runs_against_a_table_of_all_runs(run):
    rng = np.random.default_rng(run)
    streams = [[("a", "é", "ab")[k] for k in rng.integers(0, 3, size=rng.integers(0, 40))] for _ in range(12)]
    owners = [0, 1, 2, 2, 2, 3, 4, 5, 6, 7, 7, 8]
    found = [prefixes(" ".join(s), 7, run)[0] for s in streams]
    assert [prefixes(" ".join(s), 7, run)[1] for s in streams] == [len(s) for s in streams]
    every, least, greatest = distinct_prefixes(found, owners)
    again = every[least < greatest]
    got = [cover(len(s), np.flatnonzero(np.isin(f, again)), run) for s, f in zip(streams, found, strict=True)]
    assert all((a == b).all() for a, b in zip(got, plain_repeated(streams, owners, run), strict=True))


def test_packed_numbers_come_back():
    rng = np.random.default_rng(1)
    for numbers in ([], [0], [0, 0, 1, 127, 128, 1 << 14, 1 << 35, (1 << 62) - 1], sorted(rng.integers(0, 1 << 50, size=500))):
        ascending = np.array(numbers, dtype=np.uint64)
        assert (unpack(pack(ascending)) == ascending).all()


def made_pages():
    """Unmarked pages of three hosts with shared passages, copies and repeated rows."""
    rng = np.random.default_rng(4)
    word = lambda: f"w{rng.integers(0, 4000)}"
    shared = [" ".join(word() for _ in range(n)) for n in (5, 6, 7, 30)]
    rows = []
    for i in range(240):
        parts = [" ".join(word() for _ in range(rng.integers(0, 30))) for _ in range(3)]
        if rng.random() < 0.3:
            parts.insert(int(rng.integers(0, 4)), shared[rng.integers(0, 4)])
        rows.append((i, f"http://h{i % 3}.example/{i}", "".join(f"<p>{x}</p>" for x in parts)))
    rows += [(1000 + i, f"http://h1.example/copy{i}", rows[1][2]) for i in range(30)] + [rows[2]] * 3
    return [*rows, (None, None, None), (5000, None, ""), (5001, None, "<p>" + "word " * 9), (5002, None, "<div>" + "x y z " * 20_000), (5003, None, "<p>" + "long" * 300_000 + " a b c d e f")]


@pytest.mark.parametrize("bound", [2_000_000, 0])
@pytest.mark.parametrize("chunk", [1 << 20, 300])
def test_hosts_against_a_table_of_all_runs(spark, monkeypatch, bound, chunk):
    monkeypatch.setattr(html_extract, "CHUNK", chunk)
    monkeypatch.setattr(html_extract, "RANGE", 1 << 10)
    rows, want = made_pages(), []
    hosts = {}
    for k, (_, u, _) in enumerate(rows):
        hosts.setdefault((u or "").split("/")[2] if u else "", []).append(k)
    for ks in hosts.values():
        texts = [" ".join(t for _, t in blocks(rows[k][2])) for k in ks]
        streams = [t.split() for t in texts]
        for k, words, c in zip(ks, streams, plain_repeated(streams, texts, MIN_RUN), strict=True):
            want.append((rows[k][0], rows[k][1], " ".join(w for w, h in zip(words, c, strict=True) if not h), int(c.sum())))
    got = extract_pages(spark.createDataFrame(rows, SCHEMA).repartition(5), broadcast_prefixes=bound).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("n", [100, 4000])
def test_a_passage_on_two_pages_is_found_on_hosts_of_any_size(spark, n):
    passage = " ".join(f"said{k}" for k in range(30))
    rows = [(i, f"http://a.example/{i}", "<p>" + " ".join(f"own{i}x{k}" for k in range(12))) for i in range(n)]
    rows += [(n + i, f"http://a.example/{n + i}", f"<p>first{i} page{i}</p><p>{passage}</p>") for i in range(2)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()}
    assert [(got[n + i].text, got[n + i].covered) for i in range(2)] == [("first0 page0", 30), ("first1 page1", 30)]
    assert sum(r.covered for r in got.values()) == 60


def test_repeated_runs_go_and_unique_runs_stay(spark):
    # No element says what is menu and what is text.
    page = "<div>Home News About Contact Imprint Jobs</div><div>{}</div><div>Copyright by us in this year and all later ones</div>"
    story = lambda i: " ".join(f"word{i}x{k}" for k in range(9))
    rows = [(i, f"https://a.example/{i}", page.format(story(i))) for i in range(300)]
    rows += [(900 + i, f"https://b.example/{i}", f"<p>alone on its host {i}") for i in range(1)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 301
    assert all(got[i].text == story(i) for i in range(300))
    assert got[900].text == "alone on its host 0"


def test_copied_articles_stay(spark):
    page = "<nav>a b c d e f g</nav><article>the same article on many pages of this host</article>"
    rows = [(i, f"http://h.example/{i % 2}", page) for i in range(50)] + [(None, None, None), (None, None, None), (7, None, "")]
    got = extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 53
    assert sorted({r.text for r in got}) == ["", "the same article on many pages of this host"]


def test_whole_table_against_a_plain_reading(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(rows).collect()}
    for r in rows.collect():
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*)</article>", r.html, re.S)[1])
        want = " ".join(" ".join(html.unescape(x) for x in re.split(r"<[^>]*>", inner)).split())
        assert got[r.page_id] == want


def test_empty_table(spark):
    assert extract_pages(spark.createDataFrame([], SCHEMA)).collect() == []
