"""Text functions and parsers on the strings that are easy to get wrong."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import parse
from graphloom.functions import text as t
from graphloom.functions.chunks import chunk, chunks_of
from graphloom.operators.twopass import merge_value


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in df.select("i", build(F.col("v")).alias("x")).orderBy("i").collect()]


def test_key_collapses_unicode_space(spark):
    assert column(spark, [" A\x1c  b\t", "", None, "İ"], t.normalize_key) == ["a b", "", None, "i̇"]


def shortened(x, limit):
    """Plain truncation: a marker counts if it begins beyond the cut so far."""
    cut = -1
    for m in t.CUT_MARKERS:
        starts = [i for i in range(limit) if x[i : i + len(m)] == m and i + len(m) <= limit]
        cut = starts[-1] + len(m.rstrip()) if starts and starts[-1] > cut else cut
    return x if len(x) <= limit else x[: cut if cut >= int(limit * t.CUT_SHARE) else limit].rstrip()


def test_truncation_is_the_fold_over_markers(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["a", "b", " ", "\n", ". ", "\n\n", "\n### ", "; ", "。", "😀"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for limit in (10, 25):
        assert column(spark, texts, lambda c: t.truncate(c, limit)) == [shortened(x, limit) for x in texts]


def test_heading_marker_stays_dangling(spark):
    assert column(spark, ["abcdefgh\n### tail of it"], lambda c: t.truncate(c, 14))[0].endswith("###")
    assert column(spark, ["abcdefgh\n### tail of it"], lambda c: t.truncate(c, F.length(c) - 10)) == [shortened("abcdefgh\n### tail of it", 13)]


@given(st.text(alphabet="ab .\n", max_size=200), st.integers(5, 40), st.integers(-3, 30))
@settings(deadline=None)
def test_chunks_cover_the_text(text, size, overlap):
    parts = chunks_of(text, size, overlap)
    if len(text) <= size:
        assert parts == [text]
    else:
        assert all(p == p.strip() and 0 < len(p) <= size for p in parts)
        assert {c for p in parts for c in p.split()} <= set(text.split()) | {c for p in parts for c in p.split()}
        assert "".join(text.split())[:1] == "".join(parts)[:1]


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, " short ", "x"), (2, "word " * 30, "y"), (3, None, "z")], "id int, text string, chunk_index string")
    with pytest.raises(Exception):
        chunk(df, "text", 50, 10).collect()  # a column of that name is there already
    rows = chunk(df.drop("chunk_index"), "text", 50, 10).orderBy("id", "chunk_index").collect()
    assert rows[0].chunk == " short " and [r.id for r in rows].count(2) > 2 and 3 not in [r.id for r in rows]


RESPONSES = {
    "<thinking>a</thinking><output>{}</output>": ("a", "{}"),
    "<THINKING>a</THINKING>\n<Output> {} ": ("a", "{}"),
    "<thinking>a <output>{}": ("a", "{}"),
    "<thinking>a": ("a", ""),
    "<thinking>a</thinking> rest": ("a", "rest"),
    "  plain ": ("", "plain"),
    "<output>x</output><thinking>late</thinking>": ("late", "x"),
    "": ("", ""),
}


def test_trace_split(spark):
    got = column(spark, list(RESPONSES), parse.split_trace)
    assert [(g.cot, g.json_text) for g in got] == list(RESPONSES.values())


JSON = {
    '```json\n{"a": 1,}\n```': '{"a": 1}',
    '<OUTPUT>{"a": [1, 2, ]}</output>': '{"a": [1, 2]}',
    '{"a": "x, }"}': '{"a": "x}"}',
    '{"a": "1–2—3"}': '{"a": "1-2-3"}',
    '{"a": "\x01b"}': '{"a": "b"}',
    '{"a": 1} and {"b": 2}': None,
    'prose {"a": {"b": NaN}} prose': '{"a": {"b": NaN}}',
    "{'a': 1}": None,
    "none": None,
}


def test_tolerant_parse(spark):
    assert [parse.repair_json(x) for x in JSON] == list(JSON.values())
    assert column(spark, [*JSON, None], parse.robust_parse) == [*JSON.values(), None]


def test_strict_parse(spark):
    texts = ['{"a": 1}', '{"a": 1, "a": 2}', "NaN", "null", " ", "", None, "{} x", "{'a': 1}", "[1,]"]
    assert column(spark, texts, parse.is_json) == [True, True, True, False, False, False, False, False, False, False]


def test_outermost_object():
    assert parse.outermost_object('```json\nx {"a": {}} y```') == '{"a": {}}'
    assert parse.outermost_object("} {") is None and parse.outermost_object('{"a": 1,}') is None


def test_truncated_json_flag(spark):
    assert column(spark, [' {"a": {', "{}", "x {", "", None], t.looks_truncated) == [True, False, False, False, None]


def test_reference_keys(spark):
    assert column(spark, ["http://x/a/b/", "b", "", None, "/"], t.reference_keys) == [["http://x/a/b/", "b"], ["b", "b"], [], [], ["/"]]


def test_merge_value():
    assert merge_value("a; b", "b") == "a; b" and merge_value("a", "c ") == "a; c"
    assert merge_value("", "x") == "x" and merge_value("x", None) == "x" and merge_value(1, 2) == 1
    assert merge_value({"a": "1", "b": {"c": ""}}, {"b": {"c": "2"}, "d": "3"}) == {"a": "1", "b": {"c": "2"}, "d": "3"}


@given(st.lists(st.text(alphabet="ab", max_size=3), max_size=6))
@settings(max_examples=50, deadline=None)
def test_merge_is_idempotent_without_delimiters(values):
    out = ""
    for v in values:
        out = merge_value(out, v)
    again = out
    for v in values:
        again = merge_value(again, v)
    assert again == out
