"""Declared column types, their Spark fields, and the coercion of values and literals."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RID = "__rid"
INT32 = (-(2**31), 2**31 - 1)


class SchemaError(ValueError):
    """A statement that does not fit a table's schema."""


@dataclass(frozen=True)
class ColumnType:
    """A declared type: INT, LONG, FLOAT, VARCHAR, DATE, TIMESTAMP or ARRAY, with a byte limit for texts."""

    name: str
    length: int | None = None

    @classmethod
    def parse(cls, text: str) -> ColumnType:
        """INT, FLOAT, DATE, VARCHAR[n], ARRAY[FLOAT]; bare VARCHAR holds one byte, anything else is VARCHAR[255]."""
        t = text.strip().upper()
        if t in ("INT", "LONG", "FLOAT", "TIMESTAMP"):
            return cls(t)
        if t == "DATE":
            return cls("DATE", 10)
        m = re.fullmatch(r"VARCHAR\s*(?:\[\s*(\d+)\s*\])?", t)
        if m:
            n = int(m.group(1) or 1)
            if n < 1:
                raise SchemaError("VARCHAR needs at least one byte")
            return cls("VARCHAR", n)
        if re.fullmatch(r"ARRAY\s*\[\s*FLOAT\s*\]", t):
            return cls("ARRAY")
        return cls("VARCHAR", 255)

    @classmethod
    def of(cls, kind: T.DataType) -> ColumnType:
        """The declared type that stands for an existing Spark column."""
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            return cls("INT")
        if isinstance(kind, T.LongType):
            return cls("LONG")
        if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
            return cls("FLOAT")
        if isinstance(kind, T.ArrayType):
            return cls("ARRAY")
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return cls("TIMESTAMP")
        return cls("VARCHAR")

    @property
    def spark(self) -> T.DataType:
        return {"INT": T.IntegerType(), "LONG": T.LongType(), "FLOAT": T.DoubleType(), "ARRAY": T.ArrayType(T.DoubleType()), "TIMESTAMP": T.TimestampNTZType()}.get(self.name, T.StringType())

    def __str__(self) -> str:
        if self.name == "ARRAY":
            return "ARRAY[FLOAT]"
        return f"VARCHAR[{self.length}]" if self.name == "VARCHAR" and self.length else self.name


def truncate_text(s: str, n: int | None) -> str:
    """The first n UTF-8 bytes; a character cut in two becomes U+FFFD."""
    return s if n is None else s.encode("utf-8")[:n].decode("utf-8", errors="replace")


def truncate_bytes(c: Column, n: int) -> Column:
    """truncate_text as a built-in expression; values that fit pass unchanged."""
    raw = F.encode(c, "utf-8")
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, 1)), 16, 10).cast("int")
    tail = lambda i: byte(i).between(128, 191)
    lost = F.when(~tail(n + 1), 0).when(~tail(n), 1)
    if n > 1:
        lost = lost.when(~tail(n - 1), 2)
    lost = lost.otherwise(3)
    kept = F.decode(F.substring(raw, F.lit(1), F.lit(n) - lost), "utf-8")
    cut = F.concat(kept, F.when(lost > 0, F.lit("\ufffd")).otherwise(F.lit("")))
    return F.when(F.octet_length(c) > n, cut).otherwise(c)


def _number(v: object) -> float | int:
    if isinstance(v, bool):
        raise SchemaError("a boolean is no number")
    if isinstance(v, (int, float)):
        return v
    s = str(v).strip()
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    try:
        return float(s)
    except ValueError:
        raise SchemaError(f"not a number: {v!r}") from None


def coerce(v: object, t: ColumnType) -> object:
    """A value as a column of type t stores it; SchemaError where it cannot."""
    if v is None:
        return None
    if t.name in ("INT", "LONG"):
        if isinstance(v, str) and not re.fullmatch(r"\s*[+-]?\d+\s*", v):
            raise SchemaError(f"not an integer: {v!r}")
        n = _number(v)
        if isinstance(n, float) and not math.isfinite(n):
            raise SchemaError(f"not an integer: {v!r}")
        n = int(n)
        if t.name == "INT" and not INT32[0] <= n <= INT32[1]:
            raise SchemaError(f"out of range for INT: {n}")
        return n
    if t.name == "FLOAT":
        return float(_number(v))
    if t.name == "ARRAY":
        if isinstance(v, str):
            body = v.strip().strip("[]()")
            v = [x for x in body.split(",") if x.strip()]
        return [float(_number(x)) for x in v]
    if isinstance(v, (list, tuple)):
        v = "[" + ", ".join(str(float(x)) for x in v) + "]"
    return truncate_text(str(v), t.length)


def bound(v: object, t: ColumnType) -> object:
    """A comparison bound: numbers are compared exactly, texts are cut as stored values are."""
    if t.name in ("INT", "LONG", "FLOAT"):
        return _number(v)
    return coerce(v, t)
