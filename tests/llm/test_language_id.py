import random

import pytest
from pyspark.sql import functions as F

from wallflow.llm import language_id
from wallflow.llm.language_id import CrossParser, SuffixAutomaton, fit, held_out, identify

SAMPLES = {"x": ["abra cadabra abracadabra"], "y": ["lorem ipsum dolor sit amet"], "z": ["один два три четыре"]}


def plain_phrases(text, sample):
    """Greedy longest phrases by substring search."""
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in sample:
            end += 1
        at, count = max(at + 1, end - 1), count + 1
    return count


def test_automaton_holds_exactly_the_substrings():
    word = "abcbcabbca"
    table = SuffixAutomaton([ord(c) - 97 for c in word], 3).table

    def known(text):
        state = 1
        for c in text:
            state = table[state, ord(c) - 97]
            if not state:
                return False
        return True

    rng = random.Random(1)
    for _ in range(500):
        text = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 7)))
        assert known(text) == (text in word)


def test_phrase_counts_against_substring_search(monkeypatch):
    parser = CrossParser(SAMPLES)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abrcdlo i два") for _ in range(rng.randrange(1, 60))).strip() or "a" for _ in range(80)]
    codes = [language_id._squeezed(parser.codes(language_id._points(t))) for t in texts]
    got = parser.phrases(codes)
    for t, c, row in zip(texts, codes, got, strict=True):
        squeezed = " ".join(t.split())
        assert len(c) == len(squeezed)
        for k, name in enumerate(parser.languages):
            if len(c):
                assert row[k] == plain_phrases(squeezed, SAMPLES[name][0])
    # Blocks end phrases, whatever is parsed beside them.
    monkeypatch.setattr(language_id, "BLOCK", 4)
    monkeypatch.setattr(language_id, "BATCH_CODES", 16)
    parts = parser.phrases(codes)
    for c, row in zip(codes, parts, strict=True):
        alone = [parser.phrases([c[i : i + 4]])[0] for i in range(0, len(c), 4)]
        assert (row == sum(alone, 0 * row)).all()


def test_undetermined_and_scores():
    parser = CrossParser(SAMPLES)
    got = parser.predict([None, "", " 12 ?!", "abracadabra", "IPSUM, dolor", "два, три", "漢字", "abra" * 50_000])
    assert [g[0] for g in got[:6]] == ["und", "und", "und", "x", "y", "z"]
    # Every letter is a phrase of its own where no sample has it.
    assert got[6][2] == 1.0 and got[6][1] < 0.3 and got[7][0] == "x"
    assert all(0.0 <= g[1] <= 1.0 for g in got)
    assert CrossParser({}).predict(["abc"]) == [("und", 0.0, None)]


def test_accuracy_on_documents_not_learned_from(spark, sample):
    rows = spark.createDataFrame(sample, "doc_id long, text string, lang string, source string")
    got = identify(rows, fit(rows)).filter(held_out()).select("lang", "lang_pred").collect()
    assert len(got) > 40
    assert sum(r.lang == r.lang_pred for r in got) >= 0.95 * len(got)


def test_prediction_sees_the_text_alone(spark, sample):
    rows = spark.createDataFrame(sample, "doc_id long, text string, lang string, source string")
    parser = fit(rows)
    one = {r.doc_id: (r.lang_pred, r.score) for r in identify(rows, parser).collect()}
    other = identify(rows.select("doc_id", "text").repartition(7), parser).collect()
    assert {r.doc_id: (r.lang_pred, r.score) for r in other} == one


def test_learning_leaves_out_held_out_and_unlabelled_rows(docs):
    rows = docs([(i, "abc def") for i in range(60)]).withColumn("lang", F.when(held_out(), "secret").when(F.col("doc_id") < 40, "known"))
    assert fit(rows).languages == ["known"]


def test_too_many_languages(docs):
    rows = docs([(i, "abc") for i in range(400)]).withColumn("lang", F.concat(F.lit("l"), F.col("doc_id")))
    with pytest.raises(ValueError):
        fit(rows)


def test_nulls_clashing_names_repeated_rows_and_empty_tables(docs):
    parser = CrossParser(SAMPLES)
    table = docs([(None, None), (1, "abra"), (1, "abra"), (2, "")]).withColumn("score", F.lit("own"))
    got = identify(table, parser).collect()
    assert sorted(r.lang_pred for r in got) == ["und", "und", "x", "x"]
    assert identify(docs([]), parser).collect() == []
    assert fit(docs([])).languages == []


def test_letters_beyond_the_table_tell_languages_apart():
    """Two languages of the same 700 letters, of which the table has columns for few."""
    rng = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(700)]
    common, rare = letters[: language_id.COLUMNS], letters[language_id.COLUMNS :]
    words = {x: ["".join(rng.choices(rare, k=3)) for _ in range(300)] for x in ("a", "b")}
    # Frequent letters say nothing; words of rare ones do.
    speak = lambda x, n: " ".join("".join(rng.choices(common, k=4)) + rng.choice(words[x]) for _ in range(n))
    parser = language_id.CrossParser({x: [speak(x, 100) for _ in range(30)] for x in words})
    assert len(parser.known) > language_id.COLUMNS
    assert all(parser.predict([speak(x, 30)])[0][0] == x for x in words for _ in range(40))
    plain = [speak("a", 5), "", "x" * 50, None]
    assert parser.predict(plain) == [parser.predict([t])[0] for t in plain]
