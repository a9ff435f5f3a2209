import pytest
from pyspark.sql import functions as F

from lexigrade.functions import text as T
from lexigrade.functions.identifiers import identifier_words, is_identifier, split_identifier
from lexigrade.functions.licenses import is_license_line, is_license_text, is_structured
from lexigrade.functions.redundancy import redundancy


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_counts(spark):
    s = one(spark, T.text_stats(F.col("t")), t="The cat sat on the mat. It was happy.")
    assert s.asDict() == {"sentences": 2, "words": 9, "syllables": 10, "letters": 27, "complex_words": 0}
    assert one(spark, T.text_stats(F.col("t")), t="Prefer a cache, e.g. an LRU one.\nthe raw bytes").sentences == 2


@pytest.mark.parametrize(
    ("word", "hard"),
    [("documentation", 1), ("recipes", 1), ("created", 0), ("committed", 0), ("processes", 0), ("documenting", 1), ("state-of-the-art", 0), ("high-performance", 1), ("cat", 0)],
)
def test_complex_words(spark, word, hard):
    assert one(spark, T.text_stats(F.col("t")), t=word).complex_words == hard


def test_null_and_empty_have_no_stats(spark):
    rows = spark.createDataFrame([(None,), ("",), ("1 2 3",)], "t string").select(T.text_stats(F.col("t")).alias("s")).collect()
    assert [r.s.words for r in rows] == [0, 0, 0]


def test_js_round(spark):
    got = spark.createDataFrame([(-0.125,), (0.285,), (1.005,)], "x double").select(T.js_round(F.col("x"), 2).alias("y")).collect()
    assert [r.y for r in got] == [-0.12, 0.28, 1.0]


def test_identifiers(spark):
    assert one(spark, split_identifier(F.col("t")), t="getHTTPServerName_x") == "get http server name x"
    assert one(spark, split_identifier(F.col("t")), t="a::b_c()") == "a b c"
    assert one(spark, identifier_words(F.array("t")), t="utf8Decode") == ["utf", "decode"]
    for token, yes in (("getUser", True), ("iOS", False), ("word", False), ("a_b", True), ("foo()", True), ("e.g", False), ("os.path", True)):
        assert one(spark, is_identifier(F.col("t")), t=token) is yes, token


def test_license_and_structure(spark):
    assert one(spark, is_license_text(F.col("t")), t="Copyright (c) 2020 X. Released under the MIT License.") is True
    assert one(spark, is_license_text(F.col("t")), t="Released under the MIT License.") is False
    assert one(spark, is_license_line(F.col("t")), t="Released under the MIT License.") is True
    assert one(spark, is_license_line(F.col("t")), t="furnished to do so, subject to the following conditions") is True
    assert one(spark, is_license_line(F.col("t")), t="the cache is flushed on every write") is False
    assert one(spark, is_structured(F.col("t")), t='"a": 1,\n"b": 2,\n}') is True
    assert one(spark, is_structured(F.col("t")), t="plain words here\nand here\nand there") is False


@pytest.mark.parametrize(
    ("text", "symbol", "yes"),
    [("Gets the user name.", "getUserName", True), ("Returns the maximum length", "max_len", False), ("The maximum length", "max_len", True), ("Flushes stale entries to disk", "getUserName", False), ("", "x", False)],
)
def test_redundancy(spark, text, symbol, yes):
    assert one(spark, redundancy(F.col("t"), F.col("s")), t=text, s=symbol).redundant is yes
