"""Vectors as compact binary columns, exact copies collapsed."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def cell_type(dim: int, fractional: bool, most: float, least: float) -> np.dtype:
    """The narrowest (column, value) pair that holds every non-zero cell of vectors of `dim` numbers
    between `least` and `most` without loss; fractional values are doubles."""
    column = "u1" if dim <= 1 << 8 else "<u2" if dim <= 1 << 16 else "<u4"
    if fractional:
        value = "<f8"
    else:
        value = next((t for t in ("u1", "<u2", "<i4") if np.iinfo(t).min <= least and most <= np.iinfo(t).max), "<i8")
    return np.dtype([("i", column), ("v", value)])


def pack_sparse(m: np.ndarray, cell: np.dtype) -> pa.Array:
    """One binary value per row of a matrix: (column, value) of its non-zero cells."""
    r, c = np.nonzero(m)
    cells = np.empty(len(r), dtype=cell)
    cells["i"], cells["v"] = c, m[r, c]
    ends = np.concatenate([[0], np.cumsum(np.bincount(r, minlength=len(m)))]) * cell.itemsize
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cells.tobytes())])


def unpack_sparse(values: Iterable[bytes], dim: int, cell: np.dtype) -> np.ndarray:
    """The rows pack_sparse made, as doubles."""
    values = list(values)
    n = np.fromiter((len(v) for v in values), dtype=np.int64, count=len(values)) // cell.itemsize
    cells = np.frombuffer(b"".join(values), dtype=cell)
    out = np.zeros((len(values), dim), dtype=np.float64)
    out[np.repeat(np.arange(len(values)), n), cells["i"]] = cells["v"]
    return out


def unpack_floats(values: Iterable[bytes], dim: int) -> np.ndarray:
    values = list(values)
    return np.frombuffer(b"".join(values), dtype="<f4").reshape(len(values), dim)


def list_matrix(col: pa.Array, dim: int, dtype: type) -> np.ndarray:
    """The rows of a list column of `dim` numbers as a matrix (nulls inside count as zero)."""
    flat = col.flatten()
    if flat.null_count:
        flat = flat.fill_null(0)
    return flat.to_numpy(zero_copy_only=False).astype(dtype, copy=False).reshape(len(col), dim)


def copy_key(value: Column) -> list[Column]:
    """Two 64-bit hashes that stand for a value: equal values share them, others do not
    (128 bits; a collision among 10^12 values has a chance below 10^-14). Arrays must hold no
    nulls: the hash passes over them, so [1, null] and [null, 1] would be one."""
    return [F.xxhash64(value).alias("k1"), F.xxhash64(F.lit("second"), value, F.lit(7)).alias("k2")]


def first_copies(rows: DataFrame, id_col: str, by: list[str]) -> DataFrame:
    """One row per group of exact copies: by, rep (its smallest id) and copies (its size)."""
    return rows.groupBy(*by).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("copies"))


def salted_join(many: DataFrame, one: DataFrame, on: list[str], groups: DataFrame, id_col: str, rows: int, salts: int = 32, hot_share: int = 10_000) -> DataFrame:
    """Inner join of `many` rows per key with `one` row per key that a hot key cannot load on one task.

    `groups` has the keys with their size `copies`. Keys above max(1000, rows / hot_share)
    rows, fewer than hot_share of them, are spread over at least `salts` parts, more for larger ones.
    """
    limit = max(1000, rows // hot_share)
    hot = F.broadcast(groups.where(F.col("copies") > limit).select(*on, F.greatest(F.lit(salts), F.ceil(F.col("copies") / limit)).cast("int").alias("_s")))
    left = many.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(id_col), F.coalesce("_s", F.lit(1))).cast("int")).drop("_s")
    right = one.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
    return left.join(right, [*on, "_salt"]).drop("_salt")
