"""Spatial joins: points near points, and points inside regions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def known_position(lat: Column, lon: Column) -> Column:
    """True for a usable geographic position: not null, not NaN, not 0/0, within +-90/+-180."""
    good = (~F.isnan(lat)) & (~F.isnan(lon)) & lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.coalesce(good, F.lit(False))


def distinct_points(df: DataFrame, id_col: str, x: Column, y: Column) -> DataFrame:
    """(id, x, y) once per id; the caller has dropped unusable rows.

    Repeated deliveries of an id collapse to its smallest (x, y), a partial aggregate,
    so heavily repeated ids do not travel.
    """
    return df.select(F.col(id_col).alias("id"), F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")).alias("p")).where(
        F.col("id").isNotNull()
    ).groupBy("id").agg(F.min("p").alias("p")).select("id", F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def pairs_within(points: DataFrame, radius: float, hot_rows: int = 2_000, hot_share: int = 10_000, salts: int = 16) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of points (id, x, y) at most `radius` apart.

    A grid of cells `radius` wide turns the range predicate into an equi-join: a point
    keeps its own cell and is offered to that cell and four of its neighbours, so each
    pair meets in exactly one cell; the exact distance decides. Cells above
    max(hot_rows, points / hot_share) points, of which there are fewer than hot_share,
    are split: one side is spread over `salts` parts and the other repeated to each.
    Points with a null or NaN coordinate are in no pair; the border counts as within.
    Distances whose square is within rounding (1e-12 relative) of the limit are kept.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    cell = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("bigint")
    p = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    per_cell = p.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    total, most = per_cell.agg(F.sum("n"), F.max("n")).first()
    limit = max(hot_rows, (total or 0) // hot_share)
    left = p
    right = p.withColumn("d", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))])))
    right = right.select(
        F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), (F.col("cx") + F.col("d.i")).alias("cx"), (F.col("cy") + F.col("d.j")).alias("cy"),
        ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("same"),
    )
    on = ["cx", "cy"]
    if (most or 0) > limit:
        hot = F.broadcast(per_cell.where(F.col("n") > limit).select("cx", "cy", F.lit(salts).alias("s")))
        left = left.join(hot, on, "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("s", F.lit(1))).cast("int")).drop("s")
        right = right.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("s", F.lit(1)) - 1))).drop("s")
        on = ["cx", "cy", "salt"]
    d2 = (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) + (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2"))
    near = left.join(right, on).where((d2 <= radius * radius * (1 + 1e-12)) & (~F.col("same") | (F.col("id") < F.col("id2"))))
    return near.select(F.least("id", "id2").alias("id_a"), F.greatest("id", "id2").alias("id_b"))


# ---------------------------------------------------------------------------
# Points in regions: trapezoidal decomposition
# ---------------------------------------------------------------------------
# An edge is y(x) over [x0, x1]: a segment (kind 0: a + b * x) or a half circle
# (kind +1 / -1: cy +- sqrt(r^2 - (x - cx)^2)), stored as (x0, x1, kind, a, b, c, zone).


def region_edges(zone: int, kind: str, xs: list[float], ys: list[float], radius: float | None) -> list[tuple]:
    """The non-vertical border pieces of one region; malformed regions have none.

    kind is "rect" (two opposite corners), "circulo" (centre and radius) or "poligono"
    (corners in order, not closed).
    """
    if xs is None or ys is None or len(xs) != len(ys) or any(v is None or v != v for v in (*xs, *ys)):
        return []
    if kind == "circulo":
        if len(xs) != 1 or radius is None or not radius > 0:
            return []
        return [(xs[0] - radius, xs[0] + radius, s, xs[0], ys[0], radius, zone) for s in (-1, 1)]
    if kind == "rect":
        if len(xs) != 2:
            return []
        (xa, xb), (ya, yb) = sorted(xs), sorted(ys)
        xs, ys = [xa, xb, xb, xa], [ya, ya, yb, yb]
    elif kind != "poligono" or len(xs) < 3:
        return []
    out = []
    for i in range(len(xs)):
        j = (i + 1) % len(xs)
        (x0, y0), (x1, y1) = sorted(((xs[i], ys[i]), (xs[j], ys[j])))
        if x0 < x1:
            b = (y1 - y0) / (x1 - x0)
            out.append((x0, x1, 0, y0 - b * x0, b, 0.0, zone))
    return out


def _crossings(e: np.ndarray) -> np.ndarray:
    """x positions where two edges cross, each pair's common span considered."""
    n = len(e)
    if n < 2:
        return np.empty(0)
    i, j = np.triu_indices(n, 1)
    near = (e[i, 0] < e[j, 1]) & (e[j, 0] < e[i, 1])
    i, j = i[near], j[near]
    lo, hi = np.maximum(e[i, 0], e[j, 0]), np.minimum(e[i, 1], e[j, 1])
    xs, arc_i, arc_j = [], e[i, 2] != 0, e[j, 2] != 0
    with np.errstate(all="ignore"):
        k = ~arc_i & ~arc_j
        xs.append((-(e[i, 3] - e[j, 3]) / (e[i, 4] - e[j, 4]), k))
        for seg, arc, k in ((i, j, ~arc_i & arc_j), (j, i, arc_i & ~arc_j)):
            b, a = e[seg, 4], e[seg, 3] - e[arc, 4]
            cx, r = e[arc, 3], e[arc, 5]
            qa, qb, qc = 1 + b * b, 2 * (a * b - cx), cx * cx + a * a - r * r
            root = np.sqrt(qb * qb - 4 * qa * qc)
            xs += [((-qb + s * root) / (2 * qa), k) for s in (-1, 1)]
        k = arc_i & arc_j
        dx, dy, r0, r1 = e[j, 3] - e[i, 3], e[j, 4] - e[i, 4], e[i, 5], e[j, 5]
        d2 = dx * dx + dy * dy
        t = (r0 * r0 - r1 * r1 + d2) / (2 * d2)
        h = np.sqrt(r0 * r0 / d2 - t * t)
        xs += [(e[i, 3] + t * dx + s * h * dy, k) for s in (-1, 1)]
        return np.concatenate([x[k & (x > lo) & (x < hi)] for x, k in xs])


class SlabMap:
    """Ordered slabs of a set of edges between x = lo and x = hi, for point location.

    Slab borders are all edge ends and crossings, so inside a slab the edges do not
    cross and are ordered; a point is located by binary search over its slab's edges,
    and every gap between neighbouring edges has one known set of regions.
    """

    def __init__(self, edges: list[tuple], lo: float = -np.inf, hi: float = np.inf):
        e = np.array([x for x in edges if x[0] < hi and x[1] > lo], dtype=np.float64).reshape(-1, 7)
        self.e = e
        cuts = np.unique(np.concatenate([e[:, 0], e[:, 1], _crossings(e)])) if len(e) else np.empty(0)
        self.cuts = cuts[(cuts >= lo) & (cuts <= hi)]
        if len(e):
            before, after = cuts[cuts < lo][-1:], cuts[cuts > hi][:1]
            self.cuts = np.concatenate([before, self.cuts, after])
        sets: dict[tuple, int] = {(): 0}
        self.sets: list[tuple] = [()]
        flip: dict[tuple[int, int], int] = {}
        order, start, gaps = [], [0], []
        for x0, x1 in zip(self.cuts[:-1], self.cuts[1:]):
            mid = (x0 + x1) / 2
            live = np.nonzero((e[:, 0] <= x0) & (e[:, 1] >= x1))[0]
            live = live[np.argsort(self._y(live, np.full(len(live), mid)), kind="stable")]
            cur = 0
            for k in live:
                z = int(e[k, 6])
                to = flip.get((cur, z))
                if to is None:
                    s = tuple(sorted(set(self.sets[cur]) ^ {z}))
                    to = sets.get(s)
                    if to is None:
                        to = sets[s] = len(self.sets)
                        self.sets.append(s)
                    flip[(cur, z)] = to
                gaps.append(to)
                cur = to
            order.append(live)
            start.append(start[-1] + len(live))
        self.order = np.concatenate(order) if order else np.empty(0, dtype=np.int64)
        self.start = np.array(start)
        self.gaps = np.array(gaps, dtype=np.int64)
        self.sizes = np.array([len(s) for s in self.sets])
        self.flat = np.array([z for s in self.sets for z in s], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]

    def _y(self, k: np.ndarray, x: np.ndarray) -> np.ndarray:
        e = self.e[k]
        with np.errstate(invalid="ignore"):
            arc = e[:, 4] + e[:, 2] * np.sqrt(np.maximum(0, e[:, 5] ** 2 - (x - e[:, 3]) ** 2))
        return np.where(e[:, 2] == 0, e[:, 3] + e[:, 4] * x, arc)

    def locate(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point number, zone) for every region holding a point."""
        none = np.empty(0, dtype=np.int64)
        if len(self.cuts) < 2 or not len(x):
            return none, none
        slab = np.searchsorted(self.cuts, x, side="right") - 1
        inside = np.nonzero((slab >= 0) & (slab < len(self.cuts) - 1))[0]
        slab, px, py = slab[inside], x[inside], y[inside]
        base, lo = self.start[slab], np.zeros(len(slab), dtype=np.int64)
        hi = self.start[slab + 1] - base
        while True:
            open_ = np.nonzero(lo < hi)[0]
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            below = self._y(self.order[base[open_] + mid], px[open_]) < py[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)
        k = np.nonzero(lo > 0)[0]
        s = self.gaps[base[k] + lo[k] - 1]
        n = self.sizes[s]
        at = np.repeat(self.first[s] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(inside[k], n), self.flat[at]


def points_in_regions(points: DataFrame, regions: DataFrame, stripes: int = 24, part_rows: int = 100_000) -> DataFrame:
    """(id, zone_id) for every point (id, x, y) inside a region.

    `regions` has zone_id, forma, xs, ys, radio. The x axis is cut into stripes at
    quantiles of the points; regions are repeated to the stripes they touch, and each
    stripe is decomposed into slabs by the tasks that locate its points. A stripe with
    many points is spread over several parts of about `part_rows`. Regions may overlap;
    null, NaN and malformed points or regions match nothing. A point on a border may
    count either way.
    """
    spark = points.sparkSession
    p = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y")).select("id", "x", "y")
    id_type = points.schema["id"].dataType
    zone_type = regions.schema["zone_id"].dataType
    out = T.StructType([T.StructField("id", id_type), T.StructField("zone_id", zone_type)])
    cuts = p.agg(F.percentile_approx("x", [i / stripes for i in range(1, stripes)], 1000)).first()[0]
    if not cuts:
        return spark.createDataFrame([], out)
    cuts = sorted(set(cuts))
    stripe_of = F.aggregate(F.array(*[F.lit(float(c)) for c in cuts]), F.lit(0), lambda a, c: a + F.when(F.col("x") >= c, 1).otherwise(0))
    placed = p.withColumn("stripe", stripe_of)
    counts = {r[0]: r[1] for r in placed.groupBy("stripe").count().collect()}
    parts = F.element_at(F.create_map(*[F.lit(v) for s, n in counts.items() for v in (s, max(1, -(-n // part_rows)))]), F.col("stripe"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    bounds = [-float("inf"), *cuts, float("inf")]
    lo_x = F.when(F.col("forma") == "circulo", F.col("xs")[0] - F.col("radio")).otherwise(F.array_min("xs"))
    hi_x = F.when(F.col("forma") == "circulo", F.col("xs")[0] + F.col("radio")).otherwise(F.array_max("xs"))
    table = spark.createDataFrame([(s, i, bounds[s], bounds[s + 1]) for s, n in counts.items() for i in range(max(1, -(-n // part_rows)))], "stripe int, part int, b0 double, b1 double")
    spread = regions.select("zone_id", "forma", "xs", "ys", "radio", lo_x.alias("lo"), hi_x.alias("hi")).join(
        F.broadcast(table), (F.col("lo") <= F.col("b1")) & (F.col("hi") >= F.col("b0"))
    )

    def locate(pts: pd.DataFrame, zones: pd.DataFrame) -> pd.DataFrame:
        if pts.empty or zones.empty:
            return pd.DataFrame({"id": [], "zone_id": []})
        names = list(zones["zone_id"])
        edges = []
        for i, (f, xs, ys, r) in enumerate(zip(zones["forma"], zones["xs"], zones["ys"], zones["radio"])):
            ok = xs is not None and ys is not None
            edges += region_edges(i, f, list(xs) if ok else None, list(ys) if ok else None, None if r is None or r != r else float(r))
        x, y = pts["x"].to_numpy(float), pts["y"].to_numpy(float)
        k, z = SlabMap(edges, x.min(), x.max()).locate(x, y)
        return pd.DataFrame({"id": pts["id"].to_numpy()[k], "zone_id": np.array(names, dtype=object)[z] if len(z) else []})

    return placed.groupBy("stripe", "part").cogroup(spread.groupBy("stripe", "part")).applyInPandas(locate, out)


def knn(points: DataFrame, x: float, y: float, k: int) -> DataFrame:
    """The k points (id, x, y) nearest to (x, y): by squared distance, then id."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("d2", d2).orderBy("d2", "id").limit(k)
