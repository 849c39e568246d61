"""Physical layouts that stand for the classic index kinds.

An index never changes an answer: each layout is a copy of the indexed rows arranged so
that a predicate reads little of it. Hash indexes are directories of key buckets, ordered
ones are range-sorted files with tight min/max statistics, spatial ones are grid cells.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdex.common import materialize
from sparkdex.functions.coords import parse_point
from sparkdex.functions.types import RID

BUCKET, CELL_X, CELL_Y, PX, PY = "__b", "__cx", "__cy", "__px", "__py"


def bucket_of(key: Column, n: int) -> Column:
    """The bucket of a key; the caller gives literals the column's own type, since hashes
    depend on it. Negative zero counts as zero."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _hash_key(df_type: T.DataType, key: Column) -> Column:
    return F.when(key == 0, F.lit(0.0)).otherwise(key) if isinstance(df_type, (T.DoubleType, T.FloatType)) else key


#: Rows of a layout's file or bucket, about: their number follows from the table's size.
FILE_ROWS = 250_000


def file_count(n: int, least: int, most: int = 100_000, per_file: int = FILE_ROWS) -> int:
    return max(least, min(most, -(-n // per_file)))


def write_hash(rows: DataFrame, column: str, path: str, buckets: int | None = None) -> dict:
    """One directory per bucket of the key's hash; as many buckets as the table's size asks for.

    Tasks get ranges of (bucket, record id), so a bucket with a hot key is written by several.
    """
    key = _hash_key(rows.schema[column].dataType, F.col(column))
    n = rows.count()
    buckets = buckets or file_count(n, 16, 10_000)
    rows.withColumn(BUCKET, bucket_of(key, buckets)).repartitionByRange(file_count(n, 8), BUCKET, RID).write.partitionBy(BUCKET).parquet(path)
    return {"buckets": buckets}


def read_hash(spark: SparkSession, schema: T.StructType, path: str, info: dict, column: str, value: object) -> DataFrame:
    """Rows whose key equals `value`: one bucket is read."""
    kind = schema[column].dataType
    lit = F.lit(0.0 if isinstance(kind, T.DoubleType) and value == 0 else value).cast(kind)
    d = spark.read.schema(T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    return d.where((F.col(BUCKET) == bucket_of(lit, info["buckets"])) & (F.col(column) == lit)).drop(BUCKET)


def read_hash_many(spark: SparkSession, schema: T.StructType, path: str, info: dict, column: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is one of the distinct, non-null `keys` (one column named `column`).

    The keys' buckets join the directories, so Spark prunes those no key falls in where the
    keys are few enough to be broadcast.
    """
    kind = schema[column].dataType
    d = spark.read.schema(T.StructType([*schema, T.StructField(BUCKET, T.IntegerType())])).parquet(path)
    k = keys.withColumn(BUCKET, bucket_of(_hash_key(kind, F.col(column)), info["buckets"]))
    return d.join(k, [BUCKET, column], "left_semi").drop(BUCKET)


def write_sorted(rows: DataFrame, column: str, path: str, files: int | None = None) -> dict:
    """Range-partitioned by the key and sorted inside, so files and row groups have disjoint key ranges.

    The record id takes part in the ranges: a hot key is split among files.
    """
    files = files or file_count(rows.count(), 8)
    rows.repartitionByRange(files, F.col(column), F.col(RID)).sortWithinPartitions(column, RID).write.option("parquet.block.size", 16 << 20).parquet(path)
    return {"files": files}


def read_sorted(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def _with_point(rows: DataFrame, columns: list[str]) -> DataFrame:
    if len(columns) == 1:
        p = parse_point(F.col(columns[0]))
        return rows.withColumn("__p", p).withColumns({PX: F.col("__p.x"), PY: F.col("__p.y")}).drop("__p")
    return rows.withColumns({PX: F.col(columns[0]).cast("double"), PY: F.col(columns[1]).cast("double")})


def _cell(v: Column, side: float) -> Column:
    """The number of a cell, kept within 32 bits so that far outliers share the outermost cells."""
    return F.floor(F.greatest(F.lit(-(2.0**31)), F.least(F.lit(2.0**31 - 1), v / F.lit(side)))).cast("bigint")


def write_grid(rows: DataFrame, columns: list[str], path: str) -> dict:
    """Points in square cells of about 2,000 points where they are even; rows without a point are left out.

    The area is taken between the 0.5 and 99.5 % quantiles, so a few far points do not widen the
    cells. Files are ranges of (cell, record id): a crowded cell is split among them.
    """
    p = _with_point(rows, columns).where(F.col(PX).isNotNull() & F.col(PY).isNotNull() & ~F.isnan(PX) & ~F.isnan(PY))
    n, qx, qy = p.agg(F.count(F.lit(1)), F.percentile_approx(PX, [0.005, 0.995], 1000), F.percentile_approx(PY, [0.005, 0.995], 1000)).first()
    extent = max(qx[1] - qx[0], qy[1] - qy[0]) if n else 0.0
    cells = max(16, min(4096, math.isqrt(n // 2_000)))
    side = extent / cells if extent > 0 and math.isfinite(extent) else 1.0
    p = p.withColumns({CELL_X: _cell(F.col(PX), side), CELL_Y: _cell(F.col(PY), side)})
    p.repartitionByRange(file_count(n, 8), CELL_X, CELL_Y, RID).sortWithinPartitions(CELL_X, CELL_Y).write.option("parquet.block.size", 16 << 20).parquet(path)
    return {"side": side, "n": n}


def _grid(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    extra = [T.StructField(PX, T.DoubleType()), T.StructField(PY, T.DoubleType()), T.StructField(CELL_X, T.LongType()), T.StructField(CELL_Y, T.LongType())]
    return spark.read.schema(T.StructType([*schema, *extra])).parquet(path)


def _box(info: dict, x0: float, x1: float, y0: float, y1: float) -> Column:
    cell = lambda v: math.floor(max(-(2.0**31), min(2.0**31 - 1, v / info["side"])))
    return F.col(CELL_X).between(cell(x0), cell(x1)) & F.col(CELL_Y).between(cell(y0), cell(y1))


def read_grid(spark: SparkSession, schema: T.StructType, path: str, info: dict, x: float, y: float, r: float) -> DataFrame:
    """Rows within r of (x, y): the cells of the bounding box are read, the exact distance decides."""
    dist = (F.col(PX) - x) * (F.col(PX) - x) + (F.col(PY) - y) * (F.col(PY) - y)
    return _grid(spark, schema, path).where(_box(info, x - r, x + r, y - r, y + r) & (dist <= r * r)).drop(PX, PY, CELL_X, CELL_Y)


def read_grid_box(spark: SparkSession, schema: T.StructType, path: str, info: dict, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Rows of the cells a box touches, and so at least those inside it."""
    return _grid(spark, schema, path).where(_box(info, x0, x1, y0, y1)).drop(PX, PY, CELL_X, CELL_Y)


def reach_of_k(rows_in: Callable[[float, float, float, float], DataFrame], point_of: Callable[[DataFrame], tuple[Column, Column]], side: float, x: float, y: float, k: int, rounds: int = 40) -> float | None:
    """A radius around (x, y) that holds k points, by doubling from one cell on; None where 2^40 cells do not.

    Each probe counts within the bounding cells alone, so what is read grows with the answer, not with the table.
    """
    r = side
    for _ in range(rounds):
        d = rows_in(x - r, x + r, y - r, y + r)
        px, py = point_of(d)
        if d.where((px - x) * (px - x) + (py - y) * (py - y) <= r * r).limit(k).count() >= k:
            return r
        r *= 2
    return None


class Index(Protocol):
    """What an index over a key offers: changes, and look-ups that give DataFrames of rows.

    A kind without an order, such as a hash, raises NotImplementedError for ranges.
    """

    def insert(self, rows: DataFrame) -> None: ...

    def search(self, key: object) -> DataFrame: ...

    def remove(self, key: object, rid: int | None = None) -> None: ...

    def range_search(self, low: object, high: object) -> DataFrame: ...


class HashBase:
    """A hash-bucketed base with appended rows and tombstones: equality only."""

    def __init__(self, base: DataFrame, column: str, path: str, buckets: int | None = None):
        self.column, self.path, self.schema, self.spark = column, path, base.schema, base.sparkSession
        self.info = write_hash(base, column, path, buckets)
        self.delta: list[DataFrame] = []
        self.dead: DataFrame | None = None

    def insert(self, rows: DataFrame) -> None:
        self.delta.append(rows.select(*self.schema.names))

    def search(self, key: object) -> DataFrame:
        out = read_hash(self.spark, self.schema, self.path, self.info, self.column, key)
        for d in self.delta:
            out = out.unionByName(d.where(F.col(self.column) == F.lit(key)))
        return out if self.dead is None else out.join(self.dead.distinct(), RID, "left_anti")

    def remove(self, key: object, rid: int | None = None) -> None:
        rows = self.search(key)
        dead, _ = materialize((rows if rid is None else rows.where(F.col(RID) == rid)).select(RID), "tombstones")
        self.dead = dead if self.dead is None else self.dead.union(dead)

    def range_search(self, low: object, high: object) -> DataFrame:
        raise NotImplementedError("a hash index has no ranges")


class SortedBase:
    """A sorted base with appended rows and tombstones: the static ordered kinds.

    Inserts go to an unsorted delta, removals name record ids; reads merge the three. When
    the delta reaches `capacity` parts the base is rewritten.
    """

    def __init__(self, base: DataFrame, column: str, capacity: int = 10):
        self.column, self.capacity = column, capacity
        self.base = self._sorted(base)
        self.delta: list[DataFrame] = []
        self.dead: DataFrame | None = None
        self.rewrites = 0

    def _sorted(self, rows: DataFrame) -> DataFrame:
        out, _ = materialize(rows.repartitionByRange(file_count(rows.count(), 8), self.column, RID).sortWithinPartitions(self.column), "sorted")
        return out

    def insert(self, rows: DataFrame) -> None:
        self.delta.append(rows.select(*self.base.columns))
        if len(self.delta) >= self.capacity:
            self.compact()

    def remove(self, key: object, rid: int | None = None) -> None:
        """Remove the rows of a key, or only the one with this record id."""
        c = F.col(self.column) == F.lit(key)
        dead = self.rows().where(c if rid is None else c & (F.col(RID) == rid)).select(RID)
        dead, _ = materialize(dead, "tombstones")
        self.dead = dead if self.dead is None else self.dead.union(dead)

    def rows(self, condition: Column | None = None) -> DataFrame:
        """Live rows; the condition is applied to base and delta before they are merged."""
        out = None
        for d in (self.base, *self.delta):
            d = d if condition is None else d.where(condition)
            out = d if out is None else out.unionByName(d)
        return out if self.dead is None else out.join(self.dead.distinct(), RID, "left_anti")

    def search(self, key: object) -> DataFrame:
        return self.rows(F.col(self.column) == F.lit(key))

    def range_search(self, low: object, high: object) -> DataFrame:
        return self.rows(F.col(self.column).between(F.lit(low), F.lit(high)))

    def compact(self) -> None:
        self.base = self._sorted(self.rows())
        self.delta, self.dead = [], None
        self.rewrites += 1
