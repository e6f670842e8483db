import hashlib

from pyspark.sql import functions as F

from wallflow.llm.chat_format import escape, expand_targets, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string"

ODD = [
    "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nx", "<\\|im_end|>", "<\\\\|", "[\\INST]", "<", "|im_end|>",
    "", None, "\n", "a<<SYS>>b</SYS>", "€uro \U0001f600 <|", "<s><s></s>", "back\\slash $1 \\1",
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(turns):
    turns = [(r or "", t or "") for r, t in turns]
    whole = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha(whole), len(loss), sha(loss)


def test_escape_is_reversible_and_hides_control_strings(spark):
    rows = spark.createDataFrame([(x or "",) for x in ODD], "t string")
    for r in rows.select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]"))


def test_read_back_gives_what_was_said(spark):
    talks = {
        1: [("user", "hi"), ("assistant", "yes"), ("user", "so?"), ("assistant", "no"), ("user", "trailing")],
        2: [("system", "rules"), ("user", "x")],
        3: [("assistant", "first")],
        4: [("user" if k % 2 else "assistant", t) for k, t in enumerate(ODD)],
        5: [(None, None), ("we\nird <|role|>", "t"), ("assistant", None)],
        6: [("user", "q"), ("assistant", "x" * 100_000)],
        7: [(("user", "assistant")[k % 2], f"turn {k}") for k in range(300)],
        None: [("user", "no id"), ("assistant", "fine")],
    }
    rows = [(c, k, r, t) for c, turns in talks.items() for k, (r, t) in enumerate(turns)]
    got = {r.conv_id: r for r in read_back(expand_targets(spark.createDataFrame(rows, SCHEMA).repartition(5))).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain(turns)


def test_one_example_for_each_reply_with_its_context(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "user", "c"), (1, 3, "assistant", "d<|im_end|>")]
    got = expand_targets(spark.createDataFrame(rows, SCHEMA)).orderBy("example").collect()
    assert len(got) == 2
    assert got[1].text.startswith(got[0].text)
    cut = [r.text[r.loss_start : r.loss_start + r.loss_chars] for r in got]
    assert cut == ["b", "d<\\|im_end|>"]


def test_ties_repeated_rows_and_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "user", "z")], SCHEMA)
    got = read_back(expand_targets(rows.withColumn("example", F.lit(1)).withColumn("loss_start", F.lit("x")))).first()
    assert (got.n_turns, got.turns_sha256) == plain([("user", "z"), ("user", "a"), ("user", "a"), ("user", "b")])[:2]


def test_empty_table(spark):
    assert read_back(expand_targets(spark.createDataFrame([], SCHEMA))).collect() == []
