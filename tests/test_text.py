"""Text and address expressions against plain Python on many values."""

import ipaddress
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wallflow.functions import net, text


def evaluate(spark, values, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select(expr(F.col("v")).alias("o"), "i").orderBy("i").collect()]


def plain_base(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def plain_cli(s):
    s = plain_base(s).strip()
    if not s:
        return '""'
    try:
        network = "/" in s and bool(ipaddress.ip_network(s, strict=False)) and s.count(".") == 3
    except ValueError:
        network = False
    bare = re.fullmatch("[a-zA-Z0-9_.-]+", s) or network
    return s if bare else '"' + s.replace('"', '\\"') + '"'


def test_strip_accents_every_code_point(spark):
    points = [cp for cp in range(1, 0x30000) if not 0xD800 <= cp <= 0xDFFF]
    values = ["".join(map(chr, points[i:i + 256])) for i in range(0, len(points), 256)]
    assert evaluate(spark, values, text.strip_accents) == [plain_base(v) for v in values]


def test_strip_ws_matches_python(spark):
    values = [f"{chr(i)}a b{chr(i)}" for i in range(1, 0x3001) if chr(i).isspace()] + ["", "x", "  "]
    assert evaluate(spark, values, text.strip_ws) == [v.strip() for v in values]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from('aZ0_.-/ ,;"\'\\éßﬁ½각\u0301\u00a0\n'), max_size=9), min_size=40, max_size=80))
def test_cli_value_and_lists(spark, values):
    assert evaluate(spark, values, text.cli_value) == [plain_cli(v) for v in values]

    def plain_sorted(v):
        parts = sorted(p.strip() for p in re.split("[,;]", v) if p.strip())
        return ",".join(parts) if len(parts) > 1 else v.strip()

    assert evaluate(spark, values, text.sorted_list) == [plain_sorted(v) for v in values]
    assert evaluate(spark, values, text.split_names) == [
        [p.strip() for p in v.split(",") if p.strip()] for v in values
    ]
    assert evaluate(spark, values, text.clean_cell) == [v.strip().strip('"') for v in values]


@pytest.mark.parametrize("value,expected", [
    ("any", "any"), ("ANY", "ANY"), ("10.0.0.1", "10.0.0.1"), ("10.0.0.0/8", "10.0.0.0/8"),
    ("10.0.0.1-10.0.0.9", "10.0.0.1-10.0.0.9"), ("café", "cafe"), ("a b", '"a b"'),
    ('say "x"', '"say \\"x\\""'), ("", '""'), ("\u0301", '""'), ("a/b", '"a/b"'),
])
def test_cli_value_cases(spark, value, expected):
    assert evaluate(spark, [value], text.cli_value) == [expected]


def test_python_quoted(spark):
    values = ["a", "it's", 'say "x"', "it's \"x\"", "a\\b", "a\nb"]
    assert evaluate(spark, values, text.python_quoted) == [repr(v) for v in values]


def test_ip_predicates(spark):
    values = ["1.2.3.4", "01.2.3.4", "256.1.1.1", "1.2.3", "1.2.3.4/32", "1.2.3.4/33", "1.2.3.4/08",
              "1.2.3.4-1.2.3.1", "1.2.3.4-", "1.2.3.4\n", " 1.2.3.4", "299.0.0.1", "199.0.0.1", "001.1.1.1"]
    assert evaluate(spark, values, net.is_host_ip) == [
        True, True, False, False, False, False, False, False, False, False, False, False, True, False]
    assert evaluate(spark, values, net.is_ip_or_network) == [
        True, True, False, False, True, False, True, True, False, False, False, False, True, False]


def test_ip_text_rank_is_text_order(spark):
    ips = sorted(["1.1.1.1", "1.1.1.10", "1.1.1.2", "10.0.0.1", "1.10.0.0", "255.255.255.255", "0.0.0.0", "9.9.9.9"])
    ranks = evaluate(spark, ips, net.ip_text_rank)
    assert ranks == sorted(ranks) and len(set(ranks)) == len(ranks)


def test_capped_name_and_defaults(spark):
    values = ["x" * 64, "x" * 65, "é" * 70]
    assert evaluate(spark, values, text.capped_name) == ["x" * 64, "x" * 61 + "...", "é" * 61 + "..."]
    assert evaluate(spark, ["", None, "a"], lambda c: text.or_default(c, "any")) == ["any", "any", "a"]
    assert evaluate(spark, ["6,17", "6", ",x"], text.first_of_list) == ["6", "6", ""]


def test_numbers_of_characters(spark):
    values = ["", "abc", "é", "日本", "a\U0001f600b", "x" * 100_000, "x" * 100_000 + "\u00ff", "\x7f\x80", None]
    assert evaluate(spark, values, text.characters) == [None if v is None else len(v) for v in values]
