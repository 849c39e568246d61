"""CSV files: read as text, types inferred from the values, cast in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.functions.types import INT32, ColumnType, truncate_bytes

#: What a cell must look like to count as an integer, a number or a date.
INT_CELL, FLOAT_CELL, DATE_CELL = r"^-?\d+$", r"^-?\d+(?:\.\d+)?$", r"^\d{4}-\d{2}-\d{2}$"
#: Fixed value: the longest text an inferred column declares, in bytes.
LONGEST = 255


def spans_lines(spark: SparkSession, path: str) -> bool:
    """Whether a cell of the file may span lines: some line has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return bool(spark.read.text(path).where(quotes % 2 == 1).limit(1).count())


def read_csv(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Every cell as text. Quotes double inside quotes, cells may span lines, a byte-order
    mark is dropped, blank lines are skipped, short rows have nulls; unnamed columns are
    col0, col1, ... Files are split among tasks unless a quoted cell spans lines."""
    d = (
        spark.read.option("header", header).option("inferSchema", False).option("multiLine", spans_lines(spark, path)).option("quote", '"').option("escape", '"')
        .option("encoding", "UTF-8").option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False).option("emptyValue", "").csv(path)
    )
    if not header:
        d = d.toDF(*[f"col{i}" for i in range(len(d.columns))])
        if d.columns:
            d = d.withColumn("col0", F.regexp_replace("col0", "^\ufeff", ""))
    else:
        d = d.toDF(*[c.removeprefix("\ufeff") for c in d.columns])
    blank = F.lit(True)
    for c in d.columns:
        blank = blank & F.col(f"`{c}`").isNull()
    return d.where(~blank)


def infer_types(cells: DataFrame, sample_rows: int | None = None) -> list[tuple[str, ColumnType]]:
    """A type per column from all rows, in one aggregation, or from the first `sample_rows` alone.

    All cells integers: INT (LONG beyond 32 bits); integers and decimals: FLOAT; anything
    else, an empty or missing cell included: VARCHAR of the longest value in bytes, at
    least 1 and at most 255. Cells are taken without surrounding blanks.
    """
    aggs = []
    for i, c in enumerate(cells.columns):
        v = F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))
        as_long = F.expr(f"try_cast(trim(`{c}`) as decimal(38, 0))")
        aggs += [
            F.coalesce(F.bool_and(v.rlike(INT_CELL)), F.lit(False)).alias(f"i{i}"), F.coalesce(F.bool_and(v.rlike(FLOAT_CELL)), F.lit(False)).alias(f"f{i}"),
            F.coalesce(F.max(F.octet_length(v)), F.lit(0)).alias(f"n{i}"), F.min(as_long).alias(f"lo{i}"), F.max(as_long).alias(f"hi{i}"),
        ]
    r = (cells if sample_rows is None else cells.limit(sample_rows)).agg(*aggs).first()
    out = []
    for i, c in enumerate(cells.columns):
        if r[f"i{i}"] and INT32[0] <= r[f"lo{i}"] and r[f"hi{i}"] <= INT32[1]:
            t = ColumnType("INT")
        elif r[f"i{i}"] and -(2**63) <= r[f"lo{i}"] and r[f"hi{i}"] < 2**63:
            t = ColumnType("LONG")
        elif r[f"f{i}"]:
            t = ColumnType("FLOAT")
        else:
            t = ColumnType("VARCHAR", min(LONGEST, max(1, r[f"n{i}"])))
        out.append((c, t))
    return out


def cast_cells(cells: DataFrame, types: list[tuple[str, ColumnType]]) -> DataFrame:
    """The cells, by position, as columns of the given types.

    Past the rows the types came from an empty cell of a number column is 0, and a text longer than
    its column is cut by bytes; a number cell that is none fails the load.
    """
    cols = []
    for c, (name, t) in zip(cells.columns, types):
        v = F.coalesce(F.col(f"`{c}`"), F.lit(""))
        if t.name in ("INT", "LONG", "FLOAT"):
            s = F.trim(v)
            number = F.when(s == "", F.lit("0")).otherwise(s)
            cols.append((number.cast("double") if t.name == "FLOAT" else number.cast("double").cast(t.spark) if t.name == "INT" else number.cast(t.spark)).alias(name))
        else:
            cols.append((truncate_bytes(F.trim(v), t.length) if t.length else F.trim(v)).alias(name))
    return cells.select(*cols)
