"""The catalog: a folder of numbered JSON files per table in the warehouse, the highest one valid.

The warehouse may be on any file system Spark reaches. A change is written beside the old
file and renamed to the next number, which fails if another writer has taken it: a reader
sees the table before or after a statement, and no writer undoes another's.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from sparkdex.functions.types import ColumnType


class CatalogError(KeyError):
    """A table, column or index that does not exist, or exists already."""

    def __str__(self) -> str:
        return str(self.args[0])


@dataclass
class IndexSpec:
    """An index over `columns`: its kind, its files, and how many parts of the table it covers."""

    columns: list[str]
    kind: str
    path: str = ""
    covered: int = 0
    info: dict = field(default_factory=dict)

    @property
    def key(self) -> str:
        return ",".join(self.columns)


@dataclass
class TableEntry:
    """A table: its columns, the parquet parts of its current version, and its indexes."""

    name: str
    columns: list[list]  # name, type, length
    parts: list[str] = field(default_factory=list)
    next_rid: int = 0
    version: int = 0
    rid_column: str | None = None  # of a table kept elsewhere
    streams: dict[str, int] = field(default_factory=dict)  # the last micro-batch inserted, by stream
    dead: list[str] = field(default_factory=list)  # files of the record ids deleted since the parts were written
    dead_rows: int = 0
    sizes: list[int] = field(default_factory=list)  # rows of each part
    revision: int = 0  # the catalog file this entry was read from
    indexes: list[IndexSpec] = field(default_factory=list)

    def types(self) -> dict[str, ColumnType]:
        return {n: ColumnType(t, length) for n, t, length in self.columns}

    def column(self, name: str) -> ColumnType:
        try:
            return self.types()[name]
        except KeyError:
            raise CatalogError(f"no column {name!r} in table {self.name!r}") from None

    def index(self, key: str, *kinds: str) -> IndexSpec | None:
        return next((i for i in self.indexes if i.key == key and (not kinds or i.kind in kinds)), None)


class Files:
    """The few file operations the catalog needs, on Hadoop's file systems."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def write_new(self, path: str, text: str) -> bool:
        """Write beside the target and rename to it; False where the target exists already."""
        tmp = f"{path}.{uuid.uuid4().hex}.tmp"
        p, fs = self._at(tmp)
        out = fs.create(p, True)
        out.write(bytearray(text.encode("utf-8")))
        out.close()
        ctx = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), self.conf)
        opts = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        opts[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").NONE
        try:
            ctx.rename(p, self.jvm.org.apache.hadoop.fs.Path(path), opts)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
                raise
            fs.delete(p, False)
            return False
        return True

    def write_bytes(self, path: str, data: bytes) -> None:
        p, fs = self._at(path)
        out = fs.create(p, True)
        out.write(bytearray(data))
        out.close()

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)


class Catalog:
    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse, self.files = spark, warehouse.rstrip("/"), Files(spark)

    def _folder(self, table: str) -> str:
        if not re.fullmatch(r"\w+", table):
            raise CatalogError(f"not a table name: {table!r}")
        return f"{self.warehouse}/{table}.table"

    def _revisions(self, table: str) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.files.names(self._folder(table)) if re.fullmatch(r"\d+\.json", n))

    def load(self, table: str) -> TableEntry:
        known = self._revisions(table)
        if not known:
            raise CatalogError(f"no table {table!r}")
        d = json.loads(self.files.read(f"{self._folder(table)}/{known[-1]:08d}.json"))
        d["indexes"] = [IndexSpec(**i) for i in d["indexes"]]
        return TableEntry(**(d | {"revision": known[-1]}))

    def exists(self, table: str) -> bool:
        return bool(self._revisions(table))

    def save(self, entry: TableEntry) -> None:
        """Make this entry the table's state; CatalogError where another writer changed it since it was read."""
        entry.revision += 1
        folder = self._folder(entry.name)
        if not self.files.write_new(f"{folder}/{entry.revision:08d}.json", json.dumps(asdict(entry), indent=1)):
            raise CatalogError(f"table {entry.name!r} was changed by another writer; run the statement again")
        for old in self._revisions(entry.name):
            if old < entry.revision - 1:  # a reader may still be about to open the one before
                self.files.delete(f"{folder}/{old:08d}.json")

    def tables(self) -> list[str]:
        return [n.removesuffix(".table") for n in self.files.names(self.warehouse) if n.endswith(".table")]

    def tables_frame(self) -> DataFrame:
        return self.spark.createDataFrame([(t,) for t in self.tables()], "table_name string")

    def schema_frame(self, table: str) -> DataFrame:
        """(position, column_name, type, length, indexes): kinds of the indexes over each column, comma-joined."""
        e = self.load(table)
        rows = [(i, n, t, length, ",".join(x.kind for x in e.indexes if n in x.columns)) for i, (n, t, length) in enumerate(e.columns)]
        return self.spark.createDataFrame(rows, "position int, column_name string, type string, length int, indexes string")

    def folder(self, table: str, what: str) -> str:
        return f"{self.warehouse}/{table}/{what}-{uuid.uuid4().hex[:12]}"
