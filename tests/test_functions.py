"""Hand cases of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from chronotext.functions import divergence as dv
from chronotext.functions import text as tx


def value(spark, expression, data=None, schema="x string"):
    df = spark.createDataFrame(data, schema) if data is not None else spark.range(1)
    rows = [row[0] for row in df.select(expression).collect()]
    return rows[0] if len(rows) == 1 else rows


def test_slug(spark):
    got = value(spark, tx.slug("x"), [("Café_x Ñ!",), ("¿?",), ("A b-C",)])
    assert got == ["caf_x", "", "abc"]


def test_flatten_whitespace_keeps_spaces(spark):
    assert value(spark, tx.flatten_whitespace("x"), [("a\r\n\tb  c\n",)]) == "a b  c "


def test_fields_follow_the_trailing_rule(spark):
    lines = [("a\tb\tc\t\t",), ("a\tb\t",), ("a\tb\tc\td",), ("\t\t",), ("",), ("\ta",)]
    got = value(spark, tx.fields("x"), lines)
    assert got == [["a", "b", "c"], ["a", "b"], ["a", "b", "c", "d"], [], [""], ["", "a"]]


def test_field_is_null_when_absent(spark):
    firsts = [("\t\t",), ("a\tb",), ("",), ("\ta",), ("a",)]
    assert value(spark, tx.first_field("x"), firsts) == [None, "a", "", "", "a"]
    assert value(spark, tx.field("x", 0), firsts) == [None, "a", "", "", "a"]
    assert value(spark, tx.field("x", 0), [("\t\t",), ("a\tb",)]) == [None, "a"]
    assert value(spark, tx.field("x", 1), [("a",), ("a\tb",)]) == [None, "b"]


def test_letter_tokens(spark):
    assert value(spark, tx.letter_tokens("x"), [("Don't 'tis ÉLAN 3rd",)]) == ["don't", "tis", "lan", "rd"]


def test_word_tokens(spark):
    assert value(spark, tx.word_tokens("x"), [("This is_a 3rd .é-x",)]) == ["this", "is_a", "3rd", "x"]


def test_topic_tokens_keep_repetitions(spark):
    text = [("The whale AND the whale, 1851 ii 3rd b",)]
    assert value(spark, tx.topic_tokens("x"), text) == ["the", "whale", "the", "whale", "3rd"]


def test_stopword_lists():
    assert len(set(tx.VOCABULARY_STOPWORDS)) == len(tx.VOCABULARY_STOPWORDS) == 60
    assert "i" not in tx.VOCABULARY_STOPWORDS
    assert len(tx.TOPIC_STOPWORDS) == 59


def test_drop_tokens(spark):
    tokens = F.split("x", " ")
    assert value(spark, tx.drop_tokens(tokens, ["a"]), [("a b a b",)]) == ["b", "b"]


@pytest.mark.parametrize(
    "text, year",
    [
        ("in 0450 and 2200, then (1805)", "1805"),
        ("é1911 x1913 19166 1_912", None),
        ("0501", "0501"),
        ("0500 2199", "2199"),
        ("1914-1915", "1914"),
        ("1911١ 1912", "1912"),
        ("", None),
    ],
)
def test_first_year(spark, text, year):
    assert value(spark, tx.first_year("x"), [(text,)]) == year


def test_leading_year(spark):
    assert value(spark, tx.leading_year("x"), [("1805-02-01",), ("c.1805",), ("",)]) == [1805, None, None]


def test_clip(spark):
    assert value(spark, tx.clip("x", 3), [("abcdef",), ("ab",)]) == ["abc", "ab"]


def test_sparse_line(spark):
    terms = "array(named_struct('idx', 0L, 'n', 1L), named_struct('idx', 3L, 'n', 2L))"
    assert value(spark, tx.sparse_line(F.expr(terms))) == "2 0:1 3:2"
    assert value(spark, tx.sparse_line(F.expr(f"slice({terms}, 1, 0)"))) == "0 "


def arrays(spark, p, q):
    return spark.createDataFrame([(p, q)], "p array<double>, q array<double>")


@pytest.mark.parametrize(
    "p, q, kl, js",
    [
        ([0.5, 0.5], [0.9, 0.1], 0.510826, 0.101749),
        ([1.0, 0.0], [0.0, 1.0], math.inf, math.log(2)),
        ([0.0, 1.0], [0.5, 0.5], math.log(2), 0.215762),
        ([0.2, 0.8], [0.2, 0.8], 0.0, 0.0),
    ],
)
def test_divergences(spark, p, q, kl, js):
    row = arrays(spark, p, q).select(dv.kl("p", "q").alias("kl"), dv.js("p", "q").alias("js")).first()
    assert row.kl == pytest.approx(kl, abs=1e-6)
    assert row.js == pytest.approx(js, abs=1e-6)


def test_divergence_stops_at_the_shorter(spark):
    row = arrays(spark, [0.5, 0.5, 9.0], [0.9, 0.1]).select(dv.kl("p", "q").alias("kl"), dv.pairwise_mean("p", "q").alias("m")).first()
    assert row.kl == pytest.approx(0.510826, abs=1e-6)
    assert row.m == pytest.approx([0.7, 0.3])


def test_normalize(spark):
    df = spark.createDataFrame([([1.0, 3.0],), ([0.0, 0.0],)], "w array<double>")
    assert [row[0] for row in df.select(dv.normalize("w")).collect()] == [[0.25, 0.75], [None, None]]


def test_rescale(spark):
    df = spark.createDataFrame([(1.0, 0.0, 2.0), (1.0, 1.0, 1.0)], "x double, low double, high double")
    got = [row[0] for row in df.select(dv.rescale("x", F.col("low"), F.col("high"), 3.0, 0.01)).collect()]
    assert got[0] == pytest.approx(1.505) and got[1] is None
