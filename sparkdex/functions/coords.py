"""Parsing of plane points written as text, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One signed decimal number; blanks around it are allowed.
NUMBER = r"\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)\s*"


def parse_point(text: Column) -> Column:
    """STRUCT<x, y> of texts such as "(1,2)", "[1, 2]" or "1,2"; null for anything else.

    Exactly two numbers split by a comma make a point, with or without one pair of
    round or square brackets and blanks anywhere around the numbers.
    """
    t = F.trim(text)
    pair = rf"{NUMBER},{NUMBER}"
    good = t.rlike(rf"^(?:\({pair}\)|\[{pair}\]|{pair})$")
    parts = F.split(F.regexp_replace(t, r"[()\[\]\s]", ""), ",")
    return F.when(good, F.struct(parts[0].cast("double").alias("x"), parts[1].cast("double").alias("y")))


def parse_vector(text: Column) -> Column:
    """ARRAY<DOUBLE> of one or more comma-split numbers in optional brackets, else null."""
    t = F.trim(text)
    seq = rf"{NUMBER}(?:,{NUMBER})*"
    good = t.rlike(rf"^(?:\({seq}\)|\[{seq}\]|{seq})$")
    parts = F.split(F.regexp_replace(t, r"[()\[\]\s]", ""), ",")
    return F.when(good, F.transform(parts, lambda p: p.cast("double")))
