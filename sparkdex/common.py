"""Session helpers shared by every operator: table reading and lineage cutting."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_sparkdex_shipped", False):
        return
    sc._sparkdex_shipped = True
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    to = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sparkdex/package-{uuid.uuid4().hex}.zip")
    fs = to.getFileSystem(sc._jsc.hadoopConfiguration())
    out = fs.create(to, True)
    out.write(bytearray(packed.getvalue()))
    out.close()
    fs.deleteOnExit(to)
    sc.addPyFile(to.toString())


def session_of(df: DataFrame) -> SparkSession:
    """The session of a DataFrame; every operator asks here, so its Python workers have the package."""
    spark = df.sparkSession
    ship_package(spark)
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` of a data directory."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Where the setting is absent and all executors live in this process (tests, a laptop) a
    temporary folder is made and remembered in the session; on a cluster that is an error,
    since a folder of one machine would lose data with it.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not known:
        known = spark.conf.get("sparkdex.shared.dir", None)
    if not known:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder all executors share (master {master})")
        known = "file://" + tempfile.mkdtemp(prefix="sparkdex-")
        spark.conf.set("sparkdex.shared.dir", known)
        atexit.register(_remove_local, known)
    return known.rstrip("/")


def _remove_local(uri: str) -> None:
    import shutil

    shutil.rmtree(uri.removeprefix("file://"), ignore_errors=True)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder, whatever its file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder when the application ends."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)


def materialize(df: DataFrame, label: str = "t") -> tuple[DataFrame, str]:
    """Write `df` as a table of the shared folder and read it back.

    This cuts the lineage at a place that outlives any executor; the table goes when the
    application ends. Returns the read DataFrame and its path, so that loops can drop what
    a later round replaces.
    """
    spark = session_of(df)
    path = f"{shared_dir(spark)}/sparkdex/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path
