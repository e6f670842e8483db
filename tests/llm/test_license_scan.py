import re

from pyspark.sql import functions as F

from wallflow.llm.license_rules import rules
from wallflow.llm.license_scan import gates, scan_licenses

TEXTS = [
    None, "", "no words about it", "Released under the MIT License.", "MITLicense mit-license: é apache\n license General  Public (License)",
    "Licensed under the Apache License, Version 2.0. MIT\nLICENSE", "xmit license mit licenses mitélicense émit license", "MIT LICENSE " * 3_000,
    "GNU General Public License, version 3. All rights reserved.", "SPDX-License-Identifier: GPL-2.0-or-later",
    "https://creativecommons.org/licenses/by-nc/4.0/ and CC BY-SA 4.0", "This is a 3-clause BSD thing", "Kelvin MIT License İ",
    "gnu lesser general public license version 2.1 mit license", "word " * 20_000 + "apache license",
]

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = [(("mit", "license"), "mit"), (("apache", "license"), "apache"), (("general", "public", "license"), "gpl")]


def plain_base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(i, name) for p, name in BASE for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    at = sorted(i for i, _ in places)
    return (
        len(words), len(places), at[0] if at else None, at[-1] if at else None, ",".join(sorted({n for _, n in places}))
    )


def plain_hits(text, table):
    """Matches by the rules, inner ones removed, of overlapping ones the stronger."""
    lower = (text or "").lower()
    hits = sorted(
        (m.start(), -m.end(), -r["priority"], r["label"])
        for r in table
        if r["keyword"] in lower
        for m in re.finditer(r["regex"], lower)
    )
    kept = []
    for start, end, priority, label in hits:
        h = (start, -end, -priority, label)
        if kept and h[1] <= kept[-1][1]:
            continue
        if kept and h[0] < kept[-1][1]:
            if h[2] > kept[-1][2]:
                kept[-1] = h
            continue
        kept.append(h)
    return kept


def test_against_plain_code(docs, sample):
    rows = list(enumerate(TEXTS)) + [(1000 + i, t) for i, t, *_ in sample]
    table = rules()
    for r in scan_licenses(docs(rows)).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(r.text)
        hits = plain_hits(r.text, table)
        assert [tuple(d) for d in r.detections] == hits
        want = {h[3] for h in hits} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(want))
        assert 0.0 <= r.score <= 1.0 and (r.score > 0) == bool(r.labels)


def test_gates_let_every_match_through():
    """Each rule's shortest text has a gate word."""
    table = rules()
    words = gates(table)
    assert len(table) >= 200 and len(words) < 45
    for r in table:
        short = r["regex"].replace("(?<![a-z0-9])", "").replace("(?![a-z0-9])", "")[3:-1]
        short = short.replace("[^a-z0-9]{1,6}", " ").replace("[^a-z0-9]{0,6}", "").replace("[sc]", "s")
        while short != (less := re.sub(r"\(\?:[^()]*\)[?*]", "", short)):
            short = less
        while short != (less := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)", r"\1", short)):
            short = less
        if re.fullmatch(r["regex"], short) and r["keyword"] in short:
            assert any(w in short for w in words), r


def test_clashing_names_and_empty_table(docs):
    table = docs([(None, "MIT License"), (1, "MIT License"), (1, "MIT License")]).withColumn("score", F.lit("own"))
    got = scan_licenses(table).collect()
    assert [(r.labels, r.n_base) for r in got] == [("mit", 1)] * 3
    assert scan_licenses(docs([])).collect() == []


def test_no_shuffle_and_no_python(docs):
    plan = scan_licenses(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow"))


def test_any_gap_between_the_words_of_every_rule(docs):
    """The shortest text of each rule, its words wrapped, spaced or hyphenated, is detected whole."""
    shortest = []
    for r in rules():
        short = r["regex"].replace("(?<![a-z0-9])", "").replace("(?![a-z0-9])", "")[3:-1]
        short = short.replace("[^a-z0-9]++", " ").replace("[^a-z0-9]*+", " ").replace("[sc]", "s").replace(".{0,40}", "").replace(".{1,80}?", "x")
        short = short.replace("\\S{1,6}", "xxx").replace("[23]", "2").replace("[0-9]", "9")
        while short != (less := re.sub(r"\(\?:[^()]*\)[?*]", "", short)):
            short = less
        while short != (less := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)*\)", r"\1", short)):
            short = less
        shortest.append(" ".join(re.sub("[a-z]\\?", "", short).split()))
    assert not any(set(t) & set("[](){}|?*+\\") for t in shortest)
    gaps = [" ", "\n", "  ", "-", "\n          * "]
    texts = [(i * 10 + k, "Some words. " + t.replace(" ", g) + ".") for i, t in enumerate(shortest) for k, g in enumerate(gaps)]
    for r in scan_licenses(docs(texts).repartition(4)).collect():
        assert any(d.start == 12 and d.stop >= len(r.text) - 1 for d in r.detections), r.text


def test_wrapped_and_hyphenated_names(docs):
    texts = ["Creative\nCommons Attribution 4.0", "Creative  Commons Attribution 4.0", "cc-by-sa 4.0", "european-union public licence", "See the file COPYING for details"]
    got = scan_licenses(docs(list(enumerate(texts)))).orderBy("doc_id").collect()
    assert all(r.labels for r in got), [r.labels for r in got]


def test_notice_wrapped_in_its_gap(docs):
    notice = "Neither the name of {}nor the names of its contributors may be used to endorse or promote products"
    rows = [(i, notice.format(x)) for i, x in enumerate(["Foo Inc ", "Foo\nInc ", "the University of\n * Foo\r\n * "])]
    got = scan_licenses(docs(rows)).collect()
    assert all("bsd-3-clause" in r.labels for r in got)
