import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkdex.functions.coords import parse_point, parse_vector
from sparkdex.functions.types import ColumnType, SchemaError, coerce, truncate_bytes, truncate_text


def test_declared_types():
    assert str(ColumnType.parse("VARCHAR")) == "VARCHAR[1]"
    assert str(ColumnType.parse("varchar[20]")) == "VARCHAR[20]"
    assert ColumnType.parse("DATE").length == 10
    assert str(ColumnType.parse("BOOL")) == "VARCHAR[255]"
    assert str(ColumnType.parse("ARRAY[FLOAT]")) == "ARRAY[FLOAT]"


def test_coercion():
    assert coerce("007", ColumnType("INT")) == 7
    assert coerce(1.9, ColumnType("INT")) == 1
    assert coerce("007", ColumnType("VARCHAR", 9)) == "007"
    assert coerce("Carla", ColumnType("VARCHAR", 4)) == "Carl"
    assert coerce("3", ColumnType("FLOAT")) == 3.0
    assert coerce("[1, 2]", ColumnType("ARRAY")) == [1.0, 2.0]
    assert coerce(None, ColumnType("INT")) is None
    for bad in ("1.5", "abc", "", str(2**31)):
        with pytest.raises(SchemaError):
            coerce(bad, ColumnType("INT"))


def test_truncation_matches_bytes(spark):
    texts = ["", "abc", "año", "ñññ", "€uro", "a€", "😀x", "x😀", "日本語", None, "é"]
    for n in (1, 2, 3, 4, 5):
        d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
        got = {r[0]: r[1] for r in d.select("i", truncate_bytes(F.col("t"), n)).collect()}
        assert got == {i: None if t is None else truncate_text(t, n) for i, t in enumerate(texts)}, n


def test_points(spark):
    good = {"(1,2)": (1, 2), "[1, 2]": (1, 2), "1,2": (1, 2), "  ( +1.5 ,-02)  ": (1.5, -2), "(.5,3.)": (0.5, 3)}
    bad = ["", " ", None, "N/A", "1", "(1,)", "(,)", "()", "(1;2)", "(1,2,3)", "(1,abc)", "(1,2", "1,2]", "(1,2]", "1 2,3"]
    rows = [(k,) for k in [*good, *bad]]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, "t string").select("t", parse_point(F.col("t"))).collect()}
    assert {k: tuple(v) for k, v in got.items() if v} == good
    v = spark.createDataFrame([("(1,2,3)",), ("7",), ("x",)], "t string").select(parse_vector(F.col("t")).alias("v")).collect()
    assert [r.v for r in v] == [[1, 2, 3], [7], None]


@settings(max_examples=30, deadline=None)
@given(st.text(max_size=12), st.integers(1, 8))
def test_truncated_text_fits_or_marks_the_cut(s, n):
    out = truncate_text(s.encode("utf-8", "ignore").decode(), n)
    assert len(out.encode()) <= n or out.endswith("�")
