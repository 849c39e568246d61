"""Versioned tables: immutable parquet parts with a record id that keeps insertion order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkdex.functions.types import RID, SchemaError, coerce
from sparkdex.sources.catalog import Catalog, TableEntry


def table_schema(entry: TableEntry) -> T.StructType:
    return T.StructType([T.StructField(n, t.spark) for n, t in entry.types().items()])


def stored_schema(entry: TableEntry) -> T.StructType:
    return T.StructType([T.StructField(RID, T.LongType()), *table_schema(entry)])


#: Deleted record ids up to this many are broadcast to the readers, 8 bytes each; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def living(spark: SparkSession, entry: TableEntry, rows: DataFrame) -> DataFrame:
    """`rows` (with record ids) without those deleted since the parts were written."""
    if not entry.dead:
        return rows
    dead = spark.read.schema(T.StructType([T.StructField(RID, T.LongType())])).parquet(*entry.dead)
    return rows.join(F.broadcast(dead) if entry.dead_rows <= BROADCAST_IDS else dead, RID, "left_anti")


def scan(spark: SparkSession, entry: TableEntry, parts: Sequence[str] | None = None) -> DataFrame:
    """The table's living rows with their record id; only the named parts if given."""
    return living(spark, entry, stored(spark, entry, parts))


def stored(spark: SparkSession, entry: TableEntry, parts: Sequence[str] | None = None) -> DataFrame:
    """All rows of the parts, those deleted since included."""
    parts = entry.parts if parts is None else list(parts)
    if entry.rid_column:
        d = spark.read.parquet(*parts)
        return d.select(F.col(entry.rid_column).cast("bigint").alias(RID), *[F.col(n).cast(t.spark).alias(n) if t.name != "TIMESTAMP" else F.col(n) for n, t in entry.types().items()])
    if not parts:
        return spark.createDataFrame([], stored_schema(entry))
    return spark.read.schema(stored_schema(entry)).parquet(*parts)


def fetch(spark: SparkSession, entry: TableEntry, rids: DataFrame) -> DataFrame:
    """The rows whose record ids are in the one column of `rids`: a semi-join, never a look-up per row."""
    return scan(spark, entry).join(rids.select(F.col(rids.columns[0]).cast("bigint").alias(RID)), RID, "left_semi")


def append(catalog: Catalog, entry: TableEntry, rows: DataFrame) -> int:
    """Write `rows` (the table's columns) as a new part, return how many; ids rise in the rows' partition order.

    An id is the table's next free one plus the partition number and the row's place in its
    partition, so it needs no shuffle, and a task run again gives the same ids. They are not
    dense; only their order means anything.
    """
    path = catalog.folder(entry.name, "part")
    rows.select((F.monotonically_increasing_id() + F.lit(entry.next_rid)).alias(RID), *[F.col(n).cast(t.spark).alias(n) for n, t in entry.types().items()]).write.parquet(path)
    n, last = catalog.spark.read.schema(T.StructType([T.StructField(RID, T.LongType())])).parquet(path).agg(F.count(F.lit(1)), F.max(RID)).first()
    entry.parts.append(path)
    entry.sizes.append(n)
    entry.next_rid = entry.next_rid if last is None else last + 1
    return n


def insert_rows(catalog: Catalog, entry: TableEntry, rows: Sequence[Sequence[object]]) -> TableEntry:
    """Append literal rows, coerced to the column types."""
    types = entry.types()
    cooked = []
    for r in rows:
        if len(r) != len(types):
            raise SchemaError(f"{entry.name} has {len(types)} columns, the row has {len(r)}")
        cooked.append(tuple(coerce(v, t) for v, t in zip(r, types.values())))
    spark = catalog.spark
    path = catalog.folder(entry.name, "part")
    with_ids = [(entry.next_rid + i, *r) for i, r in enumerate(cooked)]
    spark.createDataFrame(with_ids, stored_schema(entry)).coalesce(1).write.parquet(path)
    entry.parts.append(path)
    entry.sizes.append(len(cooked))
    entry.next_rid += len(cooked)
    return entry


def bury(catalog: Catalog, entry: TableEntry, rids: DataFrame) -> int:
    """Mark the rows with these record ids as deleted; returns how many. Nothing is rewritten."""
    path = catalog.folder(entry.name, "dead")
    rids.select(RID).write.parquet(path)
    n = catalog.spark.read.schema(T.StructType([T.StructField(RID, T.LongType())])).parquet(path).count()
    if n:
        entry.dead.append(path)
        entry.dead_rows += n
    else:
        catalog.files.delete(path)
    return n


def merge(catalog: Catalog, entry: TableEntry, first: int = 0) -> list[str]:
    """Write the living rows of the parts from number `first` on as one part; returns the files it replaces.

    Record ids are kept: their order is all that is observable. Merging all parts drops
    the marks of deleted rows too.
    """
    path = catalog.folder(entry.name, "part")
    scan(catalog.spark, entry, entry.parts[first:]).write.parquet(path)
    n = catalog.spark.read.schema(T.StructType([T.StructField(RID, T.LongType())])).parquet(path).count()
    old, entry.parts, entry.sizes = entry.parts[first:], [*entry.parts[:first], path], [*entry.sizes[:first], n]
    if first == 0:
        old, entry.dead, entry.dead_rows = [*old, *entry.dead], [], 0
    entry.version += 1
    return old


def merge_dead(catalog: Catalog, entry: TableEntry) -> list[str]:
    """Write the marks of deleted rows as one file; returns the files it replaces."""
    path = catalog.folder(entry.name, "dead")
    catalog.spark.read.parquet(*entry.dead).coalesce(max(1, entry.dead_rows // 10_000_000)).write.parquet(path)
    old, entry.dead = entry.dead, [path]
    return old
