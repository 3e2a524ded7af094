import math
import random
import sys

from pyspark.sql import functions as F

from parley.fixed_values import WHITESPACE
from parley.functions.text import (
    capitalise,
    float_or_null,
    float_text,
    strip,
    two_decimals,
    word_count,
    words,
)


def apply(spark, values, column, kind="string"):
    rows = [(i, value) for i, value in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, c {kind}")
    return [row[0] for row in frame.orderBy("i").select(column(F.col("c"))).collect()]


def test_whitespace_set_is_complete():
    assert set(WHITESPACE) == {chr(p) for p in range(sys.maxunicode + 1) if chr(p).isspace()}


def test_strip_and_words_over_every_whitespace(spark):
    texts = [f"{space}a{space}{space}b c{space}" for space in WHITESPACE]
    texts += ["", " \n", "one", "a​b zero width stays", "\x1fx\x85y"]
    assert apply(spark, texts, strip) == [text.strip() for text in texts]
    assert apply(spark, texts, lambda c: words(strip(c))) == [text.split() for text in texts]
    assert apply(spark, texts, lambda c: word_count(strip(c))) == [len(text.split()) for text in texts]


def test_word_count_stops_at_limit(spark):
    assert apply(spark, ["a b c d e", "a b", ""], lambda c: word_count(strip(c), 3)) == [3, 2, 0]


def test_capitalise(spark):
    assert apply(spark, ["éa B", "", "ßx"], capitalise) == ["Éa B", "", "SSx"]


def test_numbers_in_text(spark):
    texts = ["12", " 1.5 ", "1_000", "1__0", "_1", "1d", "1f", "1e3", "-.5", "5.", ".", "", "long",
             "nan", "-inf", "Infinity", "+7", "0x10", "1e", "\xa03\xa0"]

    def expected(text):
        try:
            return float(text)
        except ValueError:
            return None

    got = apply(spark, texts, float_or_null)
    for text, value in zip(texts, got):
        want = expected(text)
        same = value == want or (want is not None and math.isnan(want) and math.isnan(value))
        assert same, (text, value, want)


def test_double_text_matches_shortest_form(spark):
    source = random.Random(3)
    values = [0.0, 1.0, 20.5, 1e7, 12345678.9, 1e15, 1e16, 1.5e300, 1e-3, 1e-4, 1.5e-4, 1e-5, 2.5e-7, -1e22, -0.0, float("inf"), float("nan"), None]
    values += [source.uniform(-1, 1) * 10 ** source.randint(-12, 25) for _ in range(3000)]
    assert apply(spark, values, float_text, "double") == [
        None if value is None else repr(value) for value in values
    ]


def test_two_decimals_is_exact(spark):
    source = random.Random(4)
    values = [1.005, 2.675, 0.125, 0.375, 0.005, 0.015, 1e-9, 999.995, 0.995, -0.125, -3.14159, 1e12 + 0.125]
    values += [source.randint(-4000, 4000) / 8 for _ in range(200)]
    values += [source.randint(-10**6, 10**6) / 1000 for _ in range(300)]
    values += [source.uniform(-1e6, 1e6) for _ in range(300)]
    assert apply(spark, values, two_decimals, "double") == [f"{value:.2f}" for value in values]
