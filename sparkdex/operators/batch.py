"""Many probes at once: look-ups, range scans and radius searches as joins.

One probe of a distributed table costs a job; a set of probes costs one join, whatever
their number. Keys and ranges are rows, so they may be as many as the table's.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkdex.common import materialize, session_of


def key_column(keys: DataFrame, column: str, kind: T.DataType) -> DataFrame:
    """The distinct keys of a one-column DataFrame, named and typed as the column they look up; null is none."""
    return keys.select(F.col(keys.columns[0]).cast(kind).alias(column)).where(F.col(f"`{column}`").isNotNull()).distinct()


def lookup_many(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose `column` equals a key of the one-column `keys`, each once. Null keys match nothing."""
    return rows.join(key_column(keys, column, rows.schema[column].dataType), column, "left_semi")


def _number_bounds(ranges: DataFrame, kind: T.DataType) -> DataFrame:
    """(range_id, _lo, _hi) of ranges (range_id, low, high) in a column's own type, so that no bound is rounded.

    Of fractional bounds on whole numbers the whole numbers inside count. Bounds beyond the
    type's range take its first or last number.
    """
    if isinstance(kind, T.IntegralType):
        low, high = (ranges.schema[c].dataType for c in ("low", "high"))
        exact = isinstance(low, T.IntegralType) and isinstance(high, T.IntegralType)
        if exact:
            lo, hi = F.col("low").cast("bigint"), F.col("high").cast("bigint")
        else:
            wide = "decimal(38, 0)"
            least, most = F.lit(-(2**63)).cast(wide), F.lit(2**63 - 1).cast(wide)
            part = lambda c, whole: F.when(c.cast("double") < -(2.0**63), least).when(c.cast("double") >= 2.0**63, most).otherwise(whole(c).cast(wide))
            lo = part(F.col("low"), F.ceil)
            hi = part(F.col("high"), F.floor)
            known = ~F.isnan(F.col("low").cast("double")) & ~F.isnan(F.col("high").cast("double"))
            lo, hi = F.when(known, lo).cast("bigint"), F.when(known, hi).cast("bigint")
    elif isinstance(kind, T.DecimalType):
        if any(isinstance(ranges.schema[c].dataType, (T.DoubleType, T.FloatType)) for c in ("low", "high")):
            raise TypeError("ranges of a decimal column need decimal or whole bounds")
        lo, hi = F.col("low"), F.col("high")
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        lo, hi = F.col("low").cast("double"), F.col("high").cast("double")
    else:
        raise TypeError(f"ranges need a number column, not {kind.simpleString()}")
    return ranges.select("range_id", lo.alias("_lo"), hi.alias("_hi")).where("_lo <= _hi")


def ranges_many(rows: DataFrame, column: str, ranges: DataFrame, most_cells: int = 64) -> DataFrame:
    """(range_id, row columns) for rows within low..high of ranges (range_id, low, high), ends included.

    The number axis is cut into cells as wide as the mean range, a range is repeated to
    the cells it touches, and cell and row meet in an equi-join; the bounds, in the
    column's own type, decide. The cell of a number never falls as the number rises, rounding included,
    so no row of a range is missed. Ranges over more than `most_cells` cells are joined on
    cells that many times wider, level by level, so wide ranges do not multiply. Empty and
    null ranges and null values match nothing. TypeError for columns that are no numbers.
    """
    session_of(rows)
    kind = rows.schema[column].dataType
    r = _number_bounds(ranges, kind)
    span = F.col("_hi").cast("double") - F.col("_lo").cast("double")
    mean, widest = r.agg(F.avg(span), F.max(span)).first()
    if widest is not None and not math.isfinite(widest):  # open ranges end where the column does
        least, most = rows.agg(F.min(F.col(f"`{column}`").cast("double")), F.max(F.when(~F.isnan(F.col(f"`{column}`").cast("double")), F.col(f"`{column}`").cast("double")))).first()
        r = r.select("range_id", F.greatest("_lo", F.lit(least)).alias("_lo"), F.least("_hi", F.lit(most)).alias("_hi")).where("_lo <= _hi")
        mean, widest = r.agg(F.avg(span), F.max(span)).first()
    width = mean if mean and mean > 0 and math.isfinite(mean) else 1.0
    value = F.col(f"`{column}`").cast("double") if isinstance(kind, T.FloatType) else F.col(f"`{column}`")
    place = F.col(f"`{column}`").cast("double")
    levels, top = [width], width * most_cells
    while widest is not None and math.isfinite(widest) and widest > top and len(levels) < 16:
        levels.append(top)
        top *= most_cells
    out = None
    for i, w in enumerate(levels):
        part = r
        if i > 0:
            part = part.where(span > w)
        if i + 1 < len(levels):
            part = part.where(span <= levels[i + 1])
        cells = part.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_lo").cast("double") / w), F.floor(F.col("_hi").cast("double") / w))))
        met = rows.withColumn("_cell", F.floor(place / w)).join(cells, "_cell").where((value >= F.col("_lo")) & (value <= F.col("_hi")))
        met = met.select("range_id", *[F.col(f"`{c}`") for c in rows.columns])
        out = met if out is None else out.unionByName(met)
    return out


def radius_many(rows: DataFrame, columns: Sequence[str], centers: DataFrame, radius: float, hot_rows: int = 2_000, hot_share: int = 10_000) -> DataFrame:
    """(center_id, row columns) for rows at most `radius` from centers (center_id, x, y).

    `columns` are two number columns. Cells as wide as the radius: a centre is repeated to
    the nine cells around its own. Cells above max(hot_rows, rows / hot_share) rows, of
    which there are fewer than hot_share, are spread over as many parts as they hold limits,
    and their centres repeated to each. Null and NaN coordinates are within no distance.
    """
    return _near(rows, columns, centers, radius, hot_rows, hot_share).drop("_d2")


def _near(rows: DataFrame, columns: Sequence[str], centers: DataFrame, radius: float, hot_rows: int = 2_000, hot_share: int = 10_000) -> DataFrame:
    """radius_many with the squared distance as _d2."""
    if radius <= 0:
        raise ValueError("radius must be positive")
    session_of(rows)
    px, py = (F.col(f"`{c}`").cast("double") for c in columns)
    known = px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py)
    placed = rows.where(known).withColumns({"_cx": F.floor(px / radius), "_cy": F.floor(py / radius)})
    sizes = placed.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"))
    total, most = sizes.agg(F.sum("_n"), F.max("_n")).first()
    limit = max(hot_rows, (total or 0) // hot_share)
    near = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    c = centers.select("center_id", F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).withColumn("_d", F.explode(near))
    c = c.select("center_id", "_x", "_y", (F.floor(F.col("_x") / radius) + F.col("_d.i")).alias("_cx"), (F.floor(F.col("_y") / radius) + F.col("_d.j")).alias("_cy"))
    on = ["_cx", "_cy"]
    if (most or 0) > limit:
        hot = F.broadcast(sizes.where(F.col("_n") > limit).select("_cx", "_cy", F.ceil(F.col("_n") / limit).cast("int").alias("_s")))
        placed = placed.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{x}`") for x in rows.columns]), F.coalesce("_s", F.lit(1))).cast("int")).drop("_s")
        c = c.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_s", F.lit(1)) - 1))).drop("_s")
        on = [*on, "_salt"]
    d2 = (px - F.col("_x")) * (px - F.col("_x")) + (py - F.col("_y")) * (py - F.col("_y"))
    return placed.join(c, on).where(d2 <= radius * radius).select("center_id", *[F.col(f"`{x}`") for x in rows.columns], d2.alias("_d2"))


def knn_many(rows: DataFrame, columns: Sequence[str], centers: DataFrame, k: int, order: str) -> DataFrame:
    """(center_id, row columns, d2, rank): the k rows nearest to each center (center_id, x, y).

    By squared distance, ties to the smaller `order` (a unique column of the rows). A radius
    search finds the centers that have k rows within it; the others search again with twice
    the radius, so a center sees few more rows than it needs. The first radius is that of a
    circle that holds k rows where they are even. Null and NaN coordinates take no part; a
    table of fewer than k rows gives all of them.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    px, py = (F.col(f"`{c}`").cast("double") for c in columns)
    known = rows.where(px.isNotNull() & py.isNotNull() & ~F.isnan(px) & ~F.isnan(py))
    asked = centers.select("center_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    asked = asked.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    n, qx, qy = known.agg(F.count(F.lit(1)), F.percentile_approx(px, [0.005, 0.995], 1000), F.percentile_approx(py, [0.005, 0.995], 1000)).first()
    names = [F.col(f"`{c}`") for c in rows.columns]
    w = Window.partitionBy("center_id").orderBy("_d2", order)
    ranked = lambda d: d.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("center_id", *names, F.col("_d2").alias("d2"), "rank")
    if n <= k:  # every row answers every center
        d2 = (px - F.col("_x")) * (px - F.col("_x")) + (py - F.col("_y")) * (py - F.col("_y"))
        few = F.broadcast(known)  # at most k rows
        return ranked(asked.select("center_id", F.col("x").alias("_x"), F.col("y").alias("_y")).join(few).select("center_id", *names, d2.alias("_d2")))
    extent = max(qx[1] - qx[0], qy[1] - qy[0])
    radius = extent * math.sqrt(k / n) if extent > 0 else 1.0
    out = None
    while True:
        found, _ = materialize(_near(known, columns, asked, radius), "near")
        full = found.groupBy("center_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= k).select("center_id")
        got = ranked(found.join(full, "center_id", "left_semi"))
        out = got if out is None else out.unionByName(got)
        asked, _ = materialize(asked.join(full, "center_id", "left_anti"), "centers")
        if not asked.limit(1).count():
            return out
        radius *= 2
