"""The engine: statements and API calls to DataFrames over versioned tables.

Every result is an ordinary lazy DataFrame; which layout a predicate reads is decided
while it is built, and reported in `used_index`. Indexes never change an answer: rows
appended after an index was built are scanned beside it, and any change that would make
an index stale rebuilds or refreshes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.common import ship_package
from sparkdex.functions.coords import parse_point, parse_vector
from sparkdex.functions.types import RID, ColumnType, SchemaError, bound, coerce
from sparkdex.operators import batch, layouts, media
from sparkdex.operators.fulltext import FtsIndex
from sparkdex.plans import ast
from sparkdex.plans.parser import index_kind, parse_script
from sparkdex.sources import ingest, storage
from sparkdex.sources import media as files
from sparkdex.sources.catalog import Catalog, CatalogError, IndexSpec, TableEntry

DEFAULT_LIMIT = 100
ORDERED = ("BTREE", "ISAM", "SEQ")
LAYOUTS = (*ORDERED, "EHASH", "RTREE")
#: Appended parts of like size that are merged into one, so their number grows with the logarithm of the rows.
MERGE_PARTS = 8
#: Rows beside an index that are scanned rather than indexed, however small the table.
FRESH_ROWS = 10_000
#: Words of a media query where nothing names their number.
DEFAULT_K = 20


class EngineError(ValueError):
    """A statement that cannot be answered, such as a ranked query without its index."""


@dataclass
class QueryResult:
    """What a statement gives: rows as a lazy DataFrame, or counts."""

    ok: bool = True
    frame: DataFrame | None = None
    columns: list[str] = field(default_factory=list)
    used_index: dict | None = None
    used_method: str | None = None
    info: dict = field(default_factory=dict)

    def rows(self) -> list[list]:
        """Collected rows; scores as text with six decimals."""
        if self.frame is None:
            return []
        return [[f"{v:.6f}" if c == "score" and isinstance(v, float) else v for c, v in zip(self.columns, r)] for r in self.frame.collect()]

    def payload(self) -> dict:
        """The envelope a service returns."""
        out: dict = {"ok": self.ok, **self.info}
        if self.frame is not None:
            out |= {"columns": self.columns, "rows": self.rows()}
        if self.used_index:
            out["used_index"] = self.used_index
        if self.used_method:
            out["used_method"] = self.used_method
        return out


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str):
        ship_package(spark)
        self.spark = spark
        self.catalog = Catalog(spark, warehouse)

    # --- statements -------------------------------------------------------------------

    def sql(self, script: str) -> list[QueryResult]:
        """Run a script; each statement's effects last even if a later one fails."""
        return [self.execute(s) for s in parse_script(script)]

    def execute(self, s: ast.Statement) -> QueryResult:
        match s:
            case ast.CreateTable():
                self.create_table(s.table, [(c.name, c.type) for c in s.columns], [(c.name, c.index) for c in s.columns if c.index])
                return QueryResult()
            case ast.CreateFromFile():
                n = self.load_csv(s.table, s.path, create=True)
                if s.index:
                    self.create_index(s.table, [s.index[1]], s.index[0])
                return QueryResult(info={"inserted": n})
            case ast.CreateIndex():
                self.create_index(s.table, list(s.columns), s.kind)
                return QueryResult()
            case ast.CreateFts():
                return QueryResult(info={"total_docs": self.create_fts(s.table, list(s.columns))})
            case ast.CreateMm():
                return QueryResult(info={"total_objects": self.create_mm(s.table, s.column, s.k)})
            case ast.DropIndex():
                self.drop_index(s.table, list(s.columns))
                return QueryResult()
            case ast.Insert():
                return QueryResult(info={"inserted": self.insert(s.table, s.rows)})
            case ast.Delete():
                return QueryResult(info={"deleted": self.delete(s.table, s.where)})
            case ast.Select():
                return self.select(s.table, list(s.columns), s.where, s.limit or DEFAULT_LIMIT)
        raise EngineError(f"not a statement: {s!r}")

    # --- tables -------------------------------------------------------------------------

    def create_table(self, name: str, columns: Sequence[tuple[str, str]], indexes: Sequence[tuple[str, str]] = ()) -> None:
        if self.catalog.exists(name):
            raise CatalogError(f"table {name!r} exists")
        if len({c for c, _ in columns}) != len(columns):
            raise SchemaError("a column is named twice")
        types = [(c, ColumnType.parse(t)) for c, t in columns]
        entry = TableEntry(name, [[c, t.name, t.length] for c, t in types])
        self.catalog.save(entry)
        for c, kind in indexes:
            self.create_index(name, [c], kind)

    def attach(self, name: str, frame_path: str, rid_column: str, columns: Sequence[str] | None = None) -> None:
        """A read-only table over parquet kept elsewhere; `rid_column` gives the rows' order."""
        schema = self.spark.read.parquet(frame_path).schema
        names = columns or [f.name for f in schema]
        types = [(n, ColumnType.of(schema[n].dataType)) for n in names]
        self.catalog.save(TableEntry(name, [[n, t.name, t.length] for n, t in types], [frame_path], rid_column=rid_column))

    def table(self, name: str) -> DataFrame:
        """All rows as a DataFrame, without record ids."""
        return storage.scan(self.spark, self.catalog.load(name)).drop(RID)

    def load_csv(self, name: str, path: str, header: bool = True, create: bool = False, first_rows: int | None = None) -> int:
        """Load a CSV file; a new table gets inferred types, an existing one keeps its own.

        Types come from the whole file, or from its first `first_rows` rows alone: longer texts
        after those are cut, and a cell that is no number fails the load.
        """
        exists = self.catalog.exists(name)
        if exists and create:
            raise CatalogError(f"table {name!r} exists")
        cells = ingest.read_csv(self.spark, path, header)
        if exists:
            entry = self.catalog.load(name)
            types = list(entry.types().items())
            if len(types) != len(cells.columns):
                raise SchemaError(f"{name} has {len(types)} columns, the file {len(cells.columns)}")
        else:
            types = ingest.infer_types(cells, first_rows)
            entry = TableEntry(name, [[c, t.name, t.length] for c, t in types])
        return self._appended(entry, storage.append(self.catalog, entry, ingest.cast_cells(cells, types)))

    def load_csv_bytes(self, name: str, data: bytes, header: bool = True) -> int:
        """load_csv of a file's content, through a file of the warehouse."""
        path = f"{self.catalog.warehouse}/uploads/{uuid.uuid4().hex}.csv"
        self.catalog.files.write_bytes(path, data)
        try:
            return self.load_csv(name, path, header)
        finally:
            self.catalog.files.delete(path)

    def fetch(self, name: str, rids: DataFrame) -> DataFrame:
        """The rows with the record ids of a one-column DataFrame."""
        return storage.fetch(self.spark, self.catalog.load(name), rids)

    def insert(self, name: str, rows: Sequence[Sequence[object]]) -> int:
        entry = self._own(name)
        storage.insert_rows(self.catalog, entry, rows)
        return self._appended(entry, len(rows))

    def insert_frame(self, name: str, frame: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Append the rows of a DataFrame that has the table's columns.

        A batch (stream id, number) is appended once: the last number of each stream is saved with its rows.
        """
        entry = self._own(name)
        if batch is not None:
            stream, number = batch
            if entry.streams.get(stream, -1) >= number:
                return 0
            entry.streams[stream] = number
        return self._appended(entry, storage.append(self.catalog, entry, frame))

    def _appended(self, entry: TableEntry, n: int) -> int:
        """Save the entry after an append, its small parts merged and indexes rebuilt where that is due.

        Only parts no index covers are merged, and only with others of like size. An index is
        rebuilt when the rows beside it are more than half of those it holds, so a row is
        rewritten a number of times that grows with the logarithm of the table.
        """
        old: list[str] = []
        low = max((i.covered for i in entry.indexes), default=0)
        first, size = len(entry.parts) - 1, entry.sizes[-1]
        while first > low and entry.sizes[first - 1] <= 2 * max(1, size):
            first -= 1
            size += entry.sizes[first]
        if len(entry.parts) - first >= MERGE_PARTS:
            old += storage.merge(self.catalog, entry, first)
        for spec in [i for i in entry.indexes if i.kind in LAYOUTS]:
            held = sum(entry.sizes[: spec.covered])
            if sum(entry.sizes[spec.covered :]) > max(FRESH_ROWS, held // 2):
                old += self._replace_index(entry, spec)
        self.catalog.save(entry)
        self._forget(old)
        return n

    def delete(self, name: str, where: ast.Eq) -> int:
        """Remove the rows that match.

        Their record ids are marked as deleted, for the table and all its layouts at once;
        nothing is rewritten until a fifth of the table is. Ranked indexes, whose weights
        depend on every record, are rebuilt by their next query.
        """
        entry = self._own(name)
        rows, _ = self.access(entry, where)
        n = storage.bury(self.catalog, entry, rows)
        if not n:
            return 0
        old: list[str] = []
        if entry.dead_rows * 5 > sum(entry.sizes):
            old += storage.merge(self.catalog, entry)
            for spec in entry.indexes:
                old += self._replace_index(entry, spec)
        else:
            for spec in entry.indexes:
                if spec.kind in ("FTS", "MM"):
                    spec.covered = -1
            if len(entry.dead) > MERGE_PARTS:
                old += storage.merge_dead(self.catalog, entry)
        self.catalog.save(entry)
        self._forget(old)
        return n

    def _own(self, name: str) -> TableEntry:
        entry = self.catalog.load(name)
        if entry.rid_column:
            raise EngineError(f"table {name!r} is attached and read-only")
        return entry

    def _forget(self, paths: Sequence[str]) -> None:
        for p in paths:
            if p.startswith(self.catalog.warehouse):
                self.catalog.files.delete(p)

    # --- indexes ------------------------------------------------------------------------

    def create_index(self, table: str, columns: list[str], kind: str) -> None:
        kind = index_kind(kind)
        entry = self.catalog.load(table)
        for c in columns:
            entry.column(c)
        if len(columns) > 2 or (len(columns) == 2 and kind != "RTREE"):
            raise EngineError("only RTREE takes two columns")
        spec = IndexSpec(columns, kind)
        old = entry.index(spec.key, *LAYOUTS)
        if old:  # one live index per column key
            entry.indexes.remove(old)
        self._build(entry, spec)
        entry.indexes.append(spec)
        self.catalog.save(entry)
        if old and old.path:
            self._forget([old.path])

    def create_fts(self, table: str, columns: list[str], profile: str = "spanish") -> int:
        entry = self.catalog.load(table)
        for c in columns:
            entry.column(c)
        spec = IndexSpec(columns, "FTS", info={"profile": profile})
        entry.indexes = [i for i in entry.indexes if not (i.kind == "FTS" and i.key == spec.key)]
        self._build(entry, spec)  # its segments count the documents
        entry.indexes.append(spec)
        self.catalog.save(entry)
        return spec.info["n_docs"]

    def create_mm(self, table: str, column: str, k: int) -> int:
        entry = self.catalog.load(table)
        entry.column(column)
        if k < 1:
            raise EngineError("K must be at least 1")
        entry.indexes = [i for i in entry.indexes if not (i.kind == "MM" and i.key == column and i.info["k"] == k)]
        spec = IndexSpec([column], "MM", info={"k": k})
        self._build(entry, spec)
        entry.indexes.append(spec)
        self.catalog.save(entry)
        return spec.info["n_index"]

    def drop_index(self, table: str, columns: list[str]) -> None:
        """Remove every index over exactly these columns, with its files."""
        entry = self.catalog.load(table)
        gone = [i for i in entry.indexes if i.key == ",".join(columns)]
        if not gone:
            raise CatalogError(f"no index on {table}({','.join(columns)})")
        entry.indexes = [i for i in entry.indexes if i not in gone]
        self.catalog.save(entry)
        self._forget([p for i in gone for p in (i.path, *[g["path"] for g in i.info.get("segments", [])]) if p])

    def _replace_index(self, entry: TableEntry, spec: IndexSpec) -> list[str]:
        """Build an index anew; returns the files of the old one."""
        old = [spec.path, *[g["path"] for g in spec.info.get("segments", [])]]
        self._build(entry, spec)
        return [p for p in old if p]

    def _current(self, entry: TableEntry, spec: IndexSpec) -> None:
        """Bring a ranked index up to its table: appended rows become a segment of their own."""
        if spec.covered == len(entry.parts):
            return
        old: list[str] = []
        if spec.covered < 0 or len(spec.info["segments"]) >= MERGE_PARTS:
            old = self._replace_index(entry, spec)
        else:
            self._extend(entry, spec, entry.parts[spec.covered :])
        self.catalog.save(entry)
        self._forget(old)

    def _documents(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
        return rows.select(F.col(RID).alias("doc_id"), text.alias("text"))

    def _build(self, entry: TableEntry, spec: IndexSpec) -> None:
        spec.path = self.catalog.folder(entry.name, f"index-{spec.kind.lower()}")
        rows = storage.scan(self.spark, entry)
        if spec.kind == "EHASH":
            spec.info = layouts.write_hash(rows, spec.columns[0], spec.path)
        elif spec.kind in ORDERED:
            spec.info = layouts.write_sorted(rows, spec.columns[0], spec.path)
        elif spec.kind == "RTREE":
            spec.info = layouts.write_grid(rows, spec.columns, spec.path)
        else:
            kept = {"FTS": ("profile",), "MM": ("k",)}[spec.kind]
            spec.info = {k: spec.info[k] for k in kept} | {"segments": []}
            self._extend(entry, spec, entry.parts)
            spec.path = ""  # the files are the segments'
        spec.covered = len(entry.parts)

    def _extend(self, entry: TableEntry, spec: IndexSpec, parts: Sequence[str]) -> None:
        """Index the rows of some parts as one more segment of a ranked index."""
        path = self.catalog.folder(entry.name, f"index-{spec.kind.lower()}")
        rows = storage.scan(self.spark, entry, parts)
        if spec.kind == "FTS":
            segment = FtsIndex.write_segment(self._documents(rows, spec.columns), path, spec.info["profile"])
        else:
            segment = self._media_segment(rows, spec, path)
        spec.info["segments"].append(segment)
        for n in [c for c in segment if c.startswith("n_")]:
            spec.info[n] = sum(g[n] for g in spec.info["segments"])
        spec.covered = len(entry.parts)

    def _media_segment(self, rows: DataFrame, spec: IndexSpec, path: str) -> dict:
        """Descriptors and histograms of the rows' objects; the first segment's descriptors train the words."""
        paths = rows.select(F.col(RID).alias("obj_id"), F.col(spec.columns[0]).alias("path"))
        if "modality" not in spec.info:
            spec.info["modality"] = files.collection_modality(paths)
        modality = spec.info["modality"]
        files.extract(paths, modality).write.parquet(f"{path}/descriptors")
        found = self.spark.read.schema("obj_id bigint, descriptor array<float>").parquet(f"{path}/descriptors")
        if "codebook" not in spec.info:
            spec.info["codebook"] = media.train_codebook(found, spec.info["k"]).tolist()
        media.histograms(media.quantize(found, np.array(spec.info["codebook"]))).write.parquet(f"{path}/histograms")
        hist = self.spark.read.schema("obj_id bigint, word int, tf bigint").parquet(f"{path}/histograms")
        n_seq = hist.select("obj_id").distinct().count()
        # unreadable sounds count as empty histograms in an index's N, unreadable images do not
        n_index = found.select("obj_id").distinct().count() if modality == "audio" else n_seq
        return {"path": path, "n_index": n_index, "n_seq": n_seq}

    # --- queries -----------------------------------------------------------------------

    def select(self, table: str, columns: Sequence[str] = ("*",), where: ast.Predicate | None = None, limit: int | None = None) -> QueryResult:
        """Rows in insertion order, or by rank with a leading score; no limit unless given."""
        entry = self.catalog.load(table)
        names = [n for n, _, _ in entry.columns] if "*" in columns else list(columns)
        for n in names:
            entry.column(n)
        if isinstance(where, ast.Match):
            return self._match(entry, names, where, limit)
        if isinstance(where, ast.Similar):
            return self._similar(entry, names, where, limit)
        rows, used = self.access(entry, where)
        rows = rows.orderBy(RID).limit(limit) if limit is not None else rows
        return QueryResult(frame=_pick(rows, names), columns=names, used_index=used)

    def access(self, entry: TableEntry, where: ast.Predicate | None) -> tuple[DataFrame, dict | None]:
        """The rows a predicate selects, with record ids, and the index that served it."""
        if where is None:
            return storage.scan(self.spark, entry), None
        condition = self._condition(entry, where)
        spec, served = self._served(entry, where)
        if served is None:
            return storage.scan(self.spark, entry).where(condition), None
        served = storage.living(self.spark, entry, served)
        fresh = entry.parts[spec.covered :]
        if fresh:
            served = served.unionByName(storage.scan(self.spark, entry, fresh).where(condition))
        return served, {"column": spec.key, "type": spec.kind}

    def _served(self, entry: TableEntry, where: ast.Predicate) -> tuple[IndexSpec | None, DataFrame | None]:
        schema = storage.stored_schema(entry)
        if isinstance(where, ast.Eq):
            spec = entry.index(where.column, "EHASH", *ORDERED)
            if spec and spec.kind == "EHASH":
                value = coerce(where.value, entry.column(where.column))
                return spec, layouts.read_hash(self.spark, schema, spec.path, spec.info, where.column, value)
            if spec:
                return spec, layouts.read_sorted(self.spark, schema, spec.path).where(self._condition(entry, where))
        elif isinstance(where, ast.Between):
            spec = entry.index(where.column, *ORDERED)
            if spec:
                return spec, layouts.read_sorted(self.spark, schema, spec.path).where(self._condition(entry, where))
        elif isinstance(where, ast.Radius) and len(where.center) == 2:
            spec = entry.index(",".join(where.columns), "RTREE")
            if spec:
                return spec, layouts.read_grid(self.spark, schema, spec.path, spec.info, *where.center, where.radius)
        return None, None

    def _equals(self, entry: TableEntry, where: ast.Eq) -> Column:
        t = entry.column(where.column)
        value = coerce(where.value, t)
        if t.name == "ARRAY":
            return F.col(where.column) == F.array(*[F.lit(v) for v in value])
        return F.col(where.column) == F.lit(value).cast(t.spark)

    def _condition(self, entry: TableEntry, where: ast.Predicate) -> Column:
        if isinstance(where, ast.Eq):
            return self._equals(entry, where)
        if isinstance(where, ast.Between):
            t = entry.column(where.column)
            lo, hi = bound(where.low, t), bound(where.high, t)
            return F.col(where.column).between(F.lit(lo), F.lit(hi))
        if isinstance(where, ast.Radius):
            kinds = [entry.column(c) for c in where.columns]
            limit = where.radius * where.radius
            if len(where.columns) == 2:
                if any(t.name not in ("INT", "LONG", "FLOAT") for t in kinds):
                    raise SchemaError("a radius over two columns needs number columns")
                d2 = sum(((F.col(c).cast("double") - v) * (F.col(c).cast("double") - v) for c, v in zip(where.columns, where.center)), F.lit(0.0))
                return F.coalesce(d2 <= limit, F.lit(False))
            c = F.col(where.columns[0])
            if len(where.center) == 2 and kinds[0].name != "ARRAY":
                p = parse_point(c.cast("string"))
                d2 = sum(((p[f] - v) * (p[f] - v) for f, v in zip(("x", "y"), where.center)), F.lit(0.0))
                return F.coalesce(d2 <= limit, F.lit(False))
            v = c if kinds[0].name == "ARRAY" else parse_vector(c.cast("string"))
            d2 = F.aggregate(F.zip_with(v, F.array(*[F.lit(x) for x in where.center]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
            return F.coalesce((F.size(v) == len(where.center)) & (d2 <= limit), F.lit(False))
        raise EngineError("a ranked predicate is no filter")

    def knn(self, table: str, columns: Sequence[str], point: tuple[float, float], k: int) -> QueryResult:
        """The k rows nearest to a point: by squared distance, then insertion order.

        With an RTREE over the columns, cells around the point are read in growing squares until
        they hold k points; only those within that reach are ranked.
        """
        entry = self.catalog.load(table)
        x, y = map(float, point)
        spec = entry.index(",".join(columns), "RTREE")
        names = [n for n, _, _ in entry.columns]
        used = None
        rows = storage.scan(self.spark, entry)
        if spec is not None and spec.info["n"] >= k > 0:
            fresh = entry.parts[spec.covered :]

            def inside(x0: float, x1: float, y0: float, y1: float) -> DataFrame:
                d = storage.living(self.spark, entry, layouts.read_grid_box(self.spark, storage.stored_schema(entry), spec.path, spec.info, x0, x1, y0, y1))
                return d.unionByName(storage.scan(self.spark, entry, fresh)) if fresh else d

            reach = layouts.reach_of_k(inside, lambda d: self._point(columns), spec.info["side"], x, y, k)
            if reach is not None:
                rows, used = inside(x - reach, x + reach, y - reach, y + reach), {"column": spec.key, "type": spec.kind}
        px, py = self._point(columns)
        d2 = (px - x) * (px - x) + (py - y) * (py - y)
        near = rows.withColumn("d2", d2).where(F.col("d2").isNotNull()).orderBy("d2", RID).limit(k)
        return QueryResult(frame=near.select(*[F.col(f"`{n}`") for n in names], "d2"), columns=[*names, "d2"], used_index=used)

    def knn_many(self, table: str, columns: Sequence[str], centers: DataFrame, k: int) -> DataFrame:
        """(center_id, row, d2, rank): the k rows nearest to each of centers (center_id, x, y), in a few joins."""
        return batch.knn_many(storage.scan(self.spark, self.catalog.load(table)), list(columns), centers, k, RID).drop(RID)

    def _point(self, columns: Sequence[str]) -> tuple[Column, Column]:
        if len(columns) == 1:
            p = parse_point(F.col(columns[0]))
            return p["x"], p["y"]
        return F.col(columns[0]).cast("double"), F.col(columns[1]).cast("double")

    def _with_fresh(self, entry: TableEntry, spec: IndexSpec, served: DataFrame) -> DataFrame:
        """Living rows of an index's layout together with those appended since."""
        served = storage.living(self.spark, entry, served)
        fresh = entry.parts[spec.covered :]
        return served.unionByName(storage.scan(self.spark, entry, fresh)) if fresh else served

    def probe_many(self, table: str, column: str, keys: DataFrame) -> DataFrame:
        """Every row of the table that equals one of the keys: many look-ups in one join.

        An index serves it: of a hash the buckets the keys fall in are read, of an ordered one
        the files between the least and the greatest key.
        """
        entry = self.catalog.load(table)
        entry.column(column)
        spec = entry.index(column, *ORDERED, "EHASH")
        schema = storage.stored_schema(entry)
        if spec is None:
            return batch.lookup_many(storage.scan(self.spark, entry).drop(RID), column, keys)
        wanted = batch.key_column(keys, column, schema[column].dataType)
        if spec.kind == "EHASH":
            served = layouts.read_hash_many(self.spark, schema, spec.path, spec.info, column, wanted)
        else:
            least, most = wanted.agg(F.min(column), F.max(column)).first()
            served = layouts.read_sorted(self.spark, schema, spec.path).where(F.col(column).between(F.lit(least), F.lit(most)))
        return batch.lookup_many(self._with_fresh(entry, spec, served).drop(RID), column, wanted)

    def ranges_many(self, table: str, column: str, ranges: DataFrame) -> DataFrame:
        """Every (range_id, row) within ranges (range_id, low, high): many range scans in one join.

        An ordered index serves it: the files between the lowest and the highest bound are read.
        """
        entry = self.catalog.load(table)
        entry.column(column)
        spec = entry.index(column, *ORDERED)
        rows = storage.scan(self.spark, entry)
        if spec is not None:
            least, most = ranges.where("low <= high").agg(F.min("low"), F.max("high")).first()
            served = layouts.read_sorted(self.spark, storage.stored_schema(entry), spec.path)
            rows = self._with_fresh(entry, spec, served.where(F.col(column).between(F.lit(least), F.lit(most))))
        return batch.ranges_many(rows.drop(RID), column, ranges)

    def radius_many(self, table: str, columns: Sequence[str], centers: DataFrame, radius: float) -> DataFrame:
        """Every (center_id, row) within `radius` of centers (center_id, x, y): many radius searches in one join.

        An RTREE over the columns serves it: the cells of the box around all centers are read.
        """
        entry = self.catalog.load(table)
        spec = entry.index(",".join(columns), "RTREE")
        rows = storage.scan(self.spark, entry)
        if spec is not None:
            x0, x1, y0, y1 = centers.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
            if x0 is not None and y0 is not None:
                served = layouts.read_grid_box(self.spark, storage.stored_schema(entry), spec.path, spec.info, x0 - radius, x1 + radius, y0 - radius, y1 + radius)
                rows = self._with_fresh(entry, spec, served)
        return batch.radius_many(rows.drop(RID), list(columns), centers, radius)

    def _ranked(self, entry: TableEntry, names: list[str], scores: DataFrame, limit: int | None) -> DataFrame:
        """The scored rows, best first; scores (id, score) under a limit are broadcast."""
        scores = scores.withColumnRenamed(scores.columns[0], RID)
        rows = storage.scan(self.spark, entry).join(F.broadcast(scores) if limit is not None and limit <= storage.BROADCAST_IDS else scores, RID)
        return _pick(rows.orderBy(F.desc("score"), F.desc(RID)), ["score", *names])

    def _match(self, entry: TableEntry, names: list[str], where: ast.Match, limit: int | None) -> QueryResult:
        entry.column(where.column)
        spec = next((i for i in entry.indexes if i.kind == "FTS" and where.column in i.columns), None)
        if spec is None:
            raise EngineError(f"no full-text index holds {where.column!r}")
        self._current(entry, spec)
        ix = FtsIndex(spec.info["segments"], spec.info["profile"])
        scores = ix.search(self.spark, where.query, limit)
        return QueryResult(frame=self._ranked(entry, names, scores, limit), columns=["score", *names], used_index={"type": "FTS", "column": spec.key})

    def _similar(self, entry: TableEntry, names: list[str], where: ast.Similar, limit: int | None, data: bytes | None = None) -> QueryResult:
        entry.column(where.column)
        modality = files.modality_of(where.path)
        specs = [i for i in entry.indexes if i.kind == "MM" and i.key == where.column and i.info["modality"] == modality]
        k = where.k or (specs[0].info["k"] if specs else DEFAULT_K)
        spec = next((i for i in specs if i.info["k"] == k), None)
        if spec is None:
            raise EngineError(f"no {modality} index on {where.column!r} with K={k}")
        self._current(entry, spec)
        book = np.array(spec.info["codebook"])
        found = files.extract_bytes(files.read_bytes(where.path) if data is None else data, modality)
        counts: dict[int, int] = {}
        if found is not None and found.shape[1] == book.shape[1]:
            near = ((book * book).sum(1)[None] - 2 * found.astype(np.float64) @ book.T).argmin(1)
            counts = {int(w): int(n) for w, n in zip(*np.unique(near, return_counts=True))}
        hist = self.spark.read.schema("obj_id bigint, word int, tf bigint").parquet(*[f"{g['path']}/histograms" for g in spec.info["segments"]])
        n = spec.info["n_seq" if where.mode == "SEQ" else "n_index"]
        weights = media.word_weights(hist, n)
        idf = {r["word"]: r["idf"] for r in weights.select("word", "idf").distinct().collect()}  # at most K words
        query = {w: c * idf[w] for w, c in counts.items() if w in idf}
        ids = self.spark.read.schema("obj_id bigint, descriptor array<float>").parquet(*[f"{g['path']}/descriptors" for g in spec.info["segments"]])
        if modality == "image":  # unreadable images are no objects, unreadable sounds are empty ones
            ids = ids.where(F.col("descriptor").isNotNull())
        ids = ids.select("obj_id").distinct()
        scores = media.similar(weights, query, limit, where.mode, ids)
        used = None if where.mode == "SEQ" else {"type": "MM", "column": spec.key}
        return QueryResult(frame=self._ranked(entry, names, scores, limit), columns=["score", *names], used_index=used, used_method=where.mode)

    def similar_to_bytes(self, table: str, column: str, name: str, data: bytes, k: int | None = None, mode: str = "INDEX", limit: int | None = None) -> QueryResult:
        """Objects like an uploaded file; `name` tells the modality by its extension."""
        entry = self.catalog.load(table)
        return self._similar(entry, [n for n, _, _ in entry.columns], ast.Similar(column, name, k, mode), limit, data)


def _pick(rows: DataFrame, names: list[str]) -> DataFrame:
    """Columns by name, in order; a name may come twice."""
    return rows.select(*[F.col(f"`{n}`") for n in names])
