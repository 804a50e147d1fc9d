import math

import pytest
from pyspark.sql import functions as F

from quillspark.functions import analyzer, scoring
from quillspark.plans.parser import And, Not, Or, QueryError, Term, parse
from quillspark.plans.search import format_bytes, format_duration, page_count, page_offset


@pytest.mark.parametrize(
    "text, expected",
    [
        ("Hello, World! Rust-based search", ["hello", "world", "rust", "based", "search"]),
        ("café résumé naïve", ["café", "résumé", "naïve"]),
        ("", []),
        ("   ", []),
        ("!@#$%", []),
        (None, []),
        ("version 3 of rust2024", ["version", "3", "of", "rust2024"]),
        ("HELLO WORLD", ["hello", "world"]),
        ("foo_bar x²", ["foo", "bar", "x²"]),
        ("İstanbul ΣΑΣ", ["istanbul", "σασ"]),
    ],
)
def test_tokens(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(analyzer.tokens(F.col("t"))).first()[0] == expected


def test_positions(spark):
    df = spark.createDataFrame([(1, "Hello, World!")], "id int, t string")
    assert sorted(map(tuple, analyzer.positions(df, "id", "t").collect())) == [(1, 0, "hello"), (1, 1, "world")]


t = Term


@pytest.mark.parametrize(
    "query, tree",
    [
        ("rust", t("rust")),
        ("rust programming", And((t("rust"), t("programming")))),
        ("rust AND programming", And((t("rust"), t("programming")))),
        ("rust or python", Or((t("rust"), t("python")))),
        ("rust fast search", And((t("rust"), t("fast"), t("search")))),
        ("(rust OR python) AND web", And((Or((t("rust"), t("python"))), t("web")))),
        ("a OR b c", Or((t("a"), And((t("b"), t("c")))))),
        ("(a OR b) AND (c OR d)", And((Or((t("a"), t("b"))), Or((t("c"), t("d")))))),
        ("NOT java", Not(t("java"))),
        ("rust NOT java", And((t("rust"), Not(t("java"))))),
        ("HELLO WORLD", And((t("hello"), t("world")))),
        ("title:foo*", And((t("title"), t("foo")))),
    ],
)
def test_parse(query, tree):
    assert parse(query) == tree


@pytest.mark.parametrize("query", ["", "(rust", "NOT NOT a", "a OR", "AND a", "a )", "()", "!!"])
def test_parse_errors(query):
    with pytest.raises(QueryError):
        parse(query)


def test_lengths(spark):
    lengths = [0, 1, 2, 5, 10, 13, 50, 100, 500, 1000, 5000, 10000]
    df = spark.createDataFrame([(n,) for n in lengths], "n int").withColumn("b", scoring.encode_length(F.col("n")))
    got = [tuple(r) for r in df.select("n", "b", scoring.decode_length(F.col("b"))).collect()]
    assert got[1:] == [(1, 16, 1), (2, 25, 2), (5, 41, 5), (10, 55, 10), (13, 60, 12), (50, 90, 48), (100, 106, 98), (500, 143, 489), (1000, 159, 980), (5000, 196, 4870), (10000, 212, 9741)]
    assert got[0] == (0, 0, 0)


def test_idf_and_bm25(spark):
    df = spark.createDataFrame([(10, 10**7), (1000, 10**7), (9 * 10**6, 10**7), (10**7, 10**7)], "df int, n int")
    got = [round(r[0], 6) for r in df.select(scoring.idf(F.col("df"), F.col("n"))).collect()]
    assert got == [13.766720, 9.209841, 0.105361, 0.0]
    row = spark.range(1).select(scoring.bm25(F.lit(3), F.lit(10), F.lit(20.0), F.lit(2.0)), scoring.block_bound(F.lit(3), F.lit(0), F.lit(20.0), F.lit(2.0))).first()
    assert math.isclose(row[0], 2 * 3 * 2.2 / (3 + 1.2 * (0.25 + 0.75 * 0.5)))
    assert row[1] > row[0]


def test_vbyte(spark):
    values = [0, 127, 128, 16383, 16384, 2097151, 2097152, 268435455, 268435456]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    assert [r[0] for r in df.select(scoring.vbyte_size(F.col("v"))).collect()] == [1, 1, 2, 2, 3, 3, 4, 4, 5]


def test_presentation():
    assert (format_bytes(5), format_bytes(2048), format_bytes(3 << 20)) == ("5 B", "2.0 KB", "3.0 MB")
    assert (format_duration(0.123), format_duration(12.34)) == ("0.12 ms", "12.3 ms")
    assert (page_offset(3, 10), page_count(21, 10)) == (20, 3)
