import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from ledgerlens.functions.text import citation, fiscal_period, normalize_numbers, query_keywords, word_count

NUMBERS = [
    ("23,2", "23.2"), ("1,234.56", "1234.56"), ("1 234,56", "1234.56"), ("1 234 567", "1234 567"), ("1,234,567", "1234,567"), ("104 647", "104647"),
    ("aug 5 2025", "aug 52025"), ("12,34,567", "12.34567"), ("1,5a", "1,5a"), ("", ""), (None, None),
]


def test_numbers(spark):
    df = spark.createDataFrame([(a,) for a, _ in NUMBERS], "t string").select("t", normalize_numbers(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [b for _, b in NUMBERS]


def test_words_are_split_at_unicode_white_space(spark):
    texts = ["a b", " a b c ", "　", "", None, "x​y", "a\x1cb"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [2, 3, 0, 0, None, 1, 1]


def test_citation(spark):
    df = spark.createDataFrame([("t", "d.pdf", 3, 1), (None, "d.pdf", None, 2)], "t string, d string, p int, i int")
    got = [r[0] for r in df.select(citation(*[F.col(c) for c in "tdpi"])).collect()]
    assert got == ["t\n\n(Source: d.pdf, page 3, chunk 1)", "\n\n(Source: d.pdf, page N/A, chunk 2)"]
    with pytest.raises(SparkRuntimeException):
        spark.createDataFrame([("t", " ", 3, 1)], "t string, d string, p int, i int").select(citation(*[F.col(c) for c in "tdpi"])).collect()


def test_keywords_and_periods(spark):
    df = spark.createDataFrame([("What is the net debt in 23.2?",), ("the",), ("",), (None,)], "q string")
    assert [r[0] for r in df.select(query_keywords(F.col("q"))).collect()] == [["net", "debt", "23", "2", "net debt", "23 2"], [], [], None]
    labels = ["Q3 FY24", "H1 2026", "May-21", "2021-05", "soon", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "x string").select(fiscal_period(F.col("x"))).collect()]
    assert got == ["2024-Q3", "2026-H1", "2021-05", "2021-05", None, None]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="0123456789,. a ", max_size=20), min_size=1, max_size=20))
def test_numbers_like_plain_python(spark, texts):
    def plain(t):
        t = re.sub(r"([0-9]+),([0-9]{1,2})(?!\w)", r"\1.\2", t)
        t = re.sub("([0-9])[  ]+([0-9]{3})", r"\1\2", t)
        return re.sub(r"([0-9]+),([0-9]{3})", r"\1\2", t)

    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_numbers(F.col("t"))).collect()]
    assert got == [plain(t) for t in texts]
