"""Grouping vectors into clusters of mutually similar ones by parallel pivot clustering.

Records have a random order (a hash of the id). Each round takes the first records of that
order that no pivot has absorbed yet; tasks find the local minima among them, those with no
earlier one within the radius, which become pivots; and all live records within the radius of a
new pivot are absorbed, in one pass without a shuffle. Absorbed records take no part in later
rounds, so a round reads only what is left. Then members go to their closest pivot, medoids are
recomputed, and clusters linked by records within the radius of each other can be merged into
groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdex.common import delete_on_exit, materialize, remove_path, session_of, shared_dir
from sparkdex.llm.vectors import copy_key, first_copies, list_matrix, salted_join, unpack_floats

#: The hash order of a record: 62 bits, so that stretches of it can be computed in longs.
_ORDER_BITS = 62


def usable_vector(vec: Column, dim: Column) -> Column:
    """Not null, `dim` numbers long, none of them null or NaN."""
    bad = F.exists(vec, lambda v: v.isNull() | F.isnan(v))
    return F.coalesce(vec.isNotNull() & (F.size(vec) == dim) & ~bad, F.lit(False))


def _augment_points(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float32)
    return np.concatenate([x, (x * x).sum(1, keepdims=True), np.ones((len(x), 1), np.float32)], axis=1)


def _augment_pivots(p: np.ndarray) -> np.ndarray:
    p = p.astype(np.float32)
    return np.concatenate([-2 * p, np.ones((len(p), 1), np.float32), (p * p).sum(1, keepdims=True)], axis=1).T.copy()


def _hits(x: np.ndarray, xa: np.ndarray, p: np.ndarray, pa_: np.ndarray, limit: np.ndarray | float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot number, distance) of all pairs within `limit` (one, or one per pivot).

    A single-precision product finds the pairs within a slightly wider limit; their
    distances are then computed in double precision.
    """
    rows, cols, dist = [], [], []
    lim = np.asarray(limit, dtype=np.float64)
    scale = float((x.astype(np.float64) ** 2).sum(1).max(initial=0)) + float((p.astype(np.float64) ** 2).sum(1).max(initial=0))
    wide = (lim * lim * (1 + 1e-5) + scale * 2e-6).astype(np.float32)
    step = max(64, min(4096, 8_000_000 // max(1, len(p))))
    for s in range(0, len(x), step):
        mask = (xa[s : s + step] @ pa_) <= wide
        flat = np.flatnonzero(mask)
        r, c = flat // len(p), flat % len(p)
        for t in range(0, len(r), 100_000):
            rr, cc = r[t : t + 100_000] + s, c[t : t + 100_000]
            d = np.sqrt(((x[rr].astype(np.float64) - p[cc]) ** 2).sum(1))
            ok = d <= (lim if lim.ndim == 0 else lim[cc])
            rows.append(rr[ok])
            cols.append(cc[ok])
            dist.append(d[ok])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def _local_minima(spark: SparkSession, x: np.ndarray, radius: float, tile: int = 1024) -> np.ndarray:
    """Rows of x, in order, with no earlier row within the radius; each task takes a share of the rows."""
    if len(x) <= tile:
        return np.nonzero(~_has_earlier(x, 0, len(x), radius))[0]
    bc = spark.sparkContext.broadcast(x)
    n_tiles = -(-len(x) // tile)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for t in b["id"]:
                lo, hi = t * tile, min(len(bc.value), (t + 1) * tile)
                yield pd.DataFrame({"row": lo + np.nonzero(~_has_earlier(bc.value, lo, hi, radius))[0]})

    rows = spark.range(0, n_tiles, 1, n_tiles).mapInPandas(run, "row bigint").toPandas()["row"].to_numpy()  # at most the round's candidates
    bc.destroy()
    return np.sort(rows)


def _has_earlier(x: np.ndarray, lo: int, hi: int, radius: float) -> np.ndarray:
    """For the rows lo..hi of x whether an earlier row is within the radius."""
    out = np.zeros(hi - lo, dtype=bool)
    y = x[lo:hi]
    ya = _augment_points(y)
    for s in range(0, hi, 1024):
        p = x[s : min(hi, s + 1024)]
        r, c, _ = _hits(y, ya, p, _augment_pivots(p), radius)
        out[r[c + s < r + lo]] = True
    return out


def _absorb(live: DataFrame, pivot_id: np.ndarray, pivot_vec: np.ndarray, radius: float, dim: int) -> tuple[DataFrame, Broadcast]:
    """Every row of live (id, ord, vec) with the closest of the pivots within the radius, ties to the smaller, or none; open is 1 where there is none."""
    by_id = np.argsort(pivot_id, kind="stable")
    bc = live.sparkSession.sparkContext.broadcast((pivot_id[by_id], pivot_vec[by_id].astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, p = bc.value
        aug = _augment_pivots(p)
        for b in batches:
            if not len(b):
                continue
            x = unpack_floats(b.column("vec").to_pylist(), dim)
            r, c, d = _hits(x, _augment_points(x), p, aug, radius)
            o = np.lexsort((c, d, r))
            r, c, d = r[o], c[o], d[o]
            first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.empty(0, bool)
            pivot, dist, open_ = np.zeros(len(x), np.int64), np.zeros(len(x)), np.ones(len(x), np.int32)
            pivot[r[first]], dist[r[first]], open_[r[first]] = ids[c[first]], d[first], 0
            none = open_ == 1
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("ord"), b.column("vec"), pa.array(pivot, mask=none), pa.array(dist, mask=none), pa.array(open_)], names=["id", "ord", "vec", "pivot", "dist", "open"]
            )

    return live.select("id", "ord", "vec").mapInArrow(run, "id bigint, ord bigint, vec binary, pivot bigint, dist double, open int"), bc


def pivot_rounds(base: DataFrame, radius: float, dim: int, batch: int = 8192) -> tuple[DataFrame, int]:
    """(id, vec, pivot, dist) of every record of base (id, ord, vec) with the pivot that absorbed it; rounds taken.

    No two pivots are within the radius of each other. A round has about `batch` candidates,
    the live records before a bound of the hash order; they and their pivots are broadcast.
    """
    spark = session_of(base)
    end, at = 1 << _ORDER_BITS, 0
    live, n_live, waiting, rounds = base, base.count(), 0, 0
    out: DataFrame | None = None
    schema = "id bigint, vec binary, pivot bigint, dist double"
    while n_live:
        room = max(batch - waiting, batch // 4)
        at = min(end, at + int((end - at) * room / max(1, n_live - waiting)) + 1)
        got = live.where(F.col("ord") < at).select("id", "ord", "vec").toPandas().sort_values(["ord", "id"])  # about `batch` rows: the order is a hash
        if not len(got):
            continue
        x = unpack_floats(got["vec"], dim)
        keep = _local_minima(spark, x, radius)
        path = f"{shared_dir(spark)}/sparkdex/absorbed-{uuid.uuid4().hex}"
        absorbed, bc = _absorb(live, got["id"].to_numpy()[keep], x[keep], radius, dim)
        absorbed.write.partitionBy("open").parquet(path)
        bc.destroy()
        delete_on_exit(spark, path)
        table = spark.read.schema("id bigint, ord bigint, vec binary, pivot bigint, dist double, open int").parquet(path)
        done = table.where("open = 0").select("id", "vec", "pivot", "dist")
        out = done if out is None else out.unionByName(done)
        live = table.where("open = 1").select("id", "ord", "vec")
        n_live, waiting = live.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("ord") < at).cast("bigint")), F.lit(0))).first()
        rounds += 1
    return out if out is not None else spark.createDataFrame([], schema), rounds


def _parted(pivots: DataFrame, part_rows: int) -> DataFrame:
    """(pivot, parts): in how many parts the members of a cluster are worked on."""
    return pivots.select("pivot", F.greatest(F.lit(1), F.ceil(F.col("size") / part_rows)).cast("int").alias("parts"))


def place_members(members: DataFrame, pivots: DataFrame, part_rows: int = 20_000) -> DataFrame:
    """members (id, vec, pivot, dist) with the part of their cluster they belong to.

    Only clusters above `part_rows` have more than one part; there are fewer of them than
    rows / part_rows, and they alone are broadcast.
    """
    large = F.broadcast(_parted(pivots.where(F.col("size") > part_rows), part_rows))
    return members.join(large, "pivot", "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")


def near_pivots(pivots: DataFrame, dim: int, limit: np.ndarray | float, both: bool, block: int = 16_384) -> DataFrame:
    """(a, b, dist, axis) of pairs of pivots (pivot, size, extent, vec) not farther apart than limit plus, with
    `both`, their extents. At least one of the two has other members; a pair comes once.

    Blocks of about `block` such pivots are broadcast one after another and met by all pivots.
    """
    spark = session_of(pivots)
    wide = pivots.where(F.col("size") > 1)
    n = wide.count()
    out = spark.createDataFrame([], "a bigint, b bigint, dist double, axis binary")
    n_blocks = -(-n // block)
    order = F.pmod(F.xxhash64("pivot"), F.lit(max(1, n_blocks)))
    for i in range(n_blocks):
        q = wide.where(order == i).select("pivot", "extent", "vec").toPandas()  # a block of the clusters, about `block` rows
        if q.empty:
            continue
        bc = spark.sparkContext.broadcast((q["pivot"].to_numpy(), unpack_floats(q["vec"], dim), q["extent"].to_numpy()))

        def near(batches: Iterator[pd.DataFrame], bc=bc) -> Iterator[pd.DataFrame]:
            ids, p, ext = bc.value
            aug = _augment_pivots(p)
            for b in batches:
                x, e, own = unpack_floats(b["vec"], dim), b["extent"].to_numpy(), b["pivot"].to_numpy()
                r, c, d = _hits(x, _augment_points(x), p, aug, limit + ((ext + (e.max() if len(e) else 0)) if both else 0))
                ok = (own[r] != ids[c]) & ((own[r] < ids[c]) | (b["size"].to_numpy()[r] == 1))
                ok &= d <= limit + ((ext[c] + e[r]) if both else 0)
                r, c, d = r[ok], c[ok], d[ok]
                axis = (p[c] - x[r]) / np.linalg.norm(p[c] - x[r], axis=1, keepdims=True)
                yield pd.DataFrame({"a": own[r], "b": ids[c], "dist": d, "axis": [v.tobytes() for v in axis.astype("<f4")]})

        out = out.unionByName(pivots.select("pivot", "size", "extent", "vec").mapInPandas(near, "a bigint, b bigint, dist double, axis binary"))
    return out


def reassign(placed: DataFrame, pivots: DataFrame, radius: float, dim: int) -> DataFrame:
    """(id, pivot, dist) of members (id, vec, pivot, dist, part) with their closest pivot, ties to the smaller.

    A pivot closer to a member than its own is within twice the member's distance of its own, so a
    cluster's members are compared with the pivots within twice the radius of theirs alone, and
    clusters without such pivots stay as they are.
    """
    pairs, _ = materialize(near_pivots(pivots, dim, 2 * radius, False).select("a", "b"), "near")
    around = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("other")).unionByName(pairs.select(F.col("b").alias("pivot"), F.col("a").alias("other")))
    around = around.join(pivots.select(F.col("pivot").alias("other"), F.col("vec").alias("other_vec")), "other")
    parts = pivots.select("pivot", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.col("size") / 20_000)).cast("int") - 1)).alias("part"))
    around = around.join(parts, "pivot")

    def closest(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if m.empty:
            return pd.DataFrame({"id": [], "pivot": [], "dist": []})
        best, dist = m["pivot"].to_numpy().copy(), m["dist"].to_numpy().copy()
        if len(q):
            x, q = unpack_floats(m["vec"], dim), q.sort_values("other")
            p, ids = unpack_floats(q["other_vec"], dim), q["other"].to_numpy()
            for s in range(0, len(p), 512):
                r, c, d = _hits(x, _augment_points(x), p[s : s + 512], _augment_pivots(p[s : s + 512]), radius)
                o = np.lexsort((c, d, r))
                r, c, d = r[o], c[o], d[o]
                first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.empty(0, bool)
                r, c, d = r[first], c[first], d[first]
                nearer = (d < dist[r]) | ((d == dist[r]) & (ids[c + s] < best[r]))
                best[r[nearer]], dist[r[nearer]] = ids[c[nearer] + s], d[nearer]
        return pd.DataFrame({"id": m["id"].to_numpy(), "pivot": best, "dist": dist})

    crowded = around.select("pivot").distinct()
    moved = placed.join(crowded, "pivot", "left_semi").select("id", "vec", "pivot", "dist", "part").groupBy("pivot", "part").cogroup(around.groupBy("pivot", "part"))
    alone = placed.join(crowded, "pivot", "left_anti").select("id", "pivot", "dist")
    return alone.unionByName(moved.applyInPandas(closest, "id bigint, pivot bigint, dist double"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of an undirected graph (a, b): root is the smallest node of the component.

    Labels spread along edges and through their own labels until nothing changes; each
    round is written to the shared folder and the one before is dropped. Nodes of very many
    edges and roots of very many nodes are joined in parts.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct()
    both, _ = materialize(both, "edges")
    degrees, _ = materialize(both.groupBy(F.col("b").alias("node")).agg(F.count(F.lit(1)).alias("copies")), "degrees")
    n_edges = degrees.agg(F.sum("copies")).first()[0] or 0
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root"))
    labels, path = materialize(labels, "labels")
    while True:
        met = salted_join(both.select("a", F.col("b").alias("node")), labels, ["node"], degrees, "a", n_edges)
        near = met.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.least("root", "near").alias("root"), (F.col("near") < F.col("root")).alias("moved"))
        step, step_path = materialize(step, "labels")
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("r2"))
        sizes = step.groupBy("root").agg(F.count(F.lit(1)).alias("copies"))
        nxt = salted_join(step, jump, ["root"], sizes, "node", n_edges).select("node", F.least("root", "r2").alias("root"), "moved")
        nxt, nxt_path = materialize(nxt, "labels")
        remove_path(labels.sparkSession, path)
        remove_path(labels.sparkSession, step_path)
        changed = nxt.where("moved").limit(1).count()
        labels, path = nxt.select("node", "root"), nxt_path
        if not changed:
            return labels


def member_links(placed: DataFrame, pivots: DataFrame, radius: float, dim: int, part_rows: int = 20_000, tile: int = 4096) -> DataFrame:
    """(a, b): pairs of clusters with members within the radius of each other.

    `placed` has id, vec, pivot, part; pivots has pivot, size, extent (the farthest member), vec.
    Only clusters whose pivots are within radius + both extents can be linked. Such a pair is
    first put to the test of its axis: the members that reach farthest towards each other along
    the line between the pivots. If even these are more than a radius apart along the line, no
    members are within a radius; if they are within it, the clusters are linked; only what
    stays open is compared in full, restricted to members beyond the other's reach, in tiles of
    `tile` members of each side.
    """
    spark = session_of(placed)
    schema = "a bigint, b bigint"
    pairs, _ = materialize(near_pivots(pivots, dim, radius, True), "pairs")
    if pairs.limit(1).count() == 0:
        return spark.createDataFrame([], schema)
    sizes = pivots.select("pivot", F.greatest(F.lit(1), F.ceil(F.col("size") / part_rows)).cast("int").alias("parts"))
    asked = pairs.select(F.col("a").alias("pivot"), F.col("b").alias("other"), F.lit(1).alias("sign"), "axis").union(
        pairs.select(F.col("b"), F.col("a"), F.lit(-1), F.col("axis"))
    )
    asked = asked.join(sizes, "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    vecs = placed.select("pivot", "part", "id", "vec").join(asked.select("pivot").distinct(), "pivot", "left_semi")

    def reach(m: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if m.empty or q.empty:
            return pd.DataFrame({"pivot": [], "other": [], "sign": [], "reach": [], "vec": []})
        x = unpack_floats(m["vec"], dim).astype(np.float64)
        ax = unpack_floats(q["axis"], dim).astype(np.float64) * q["sign"].to_numpy()[:, None]
        far, val = np.empty(len(ax), np.int64), np.empty(len(ax))
        for s in range(0, len(ax), 256):
            pr = x @ ax[s : s + 256].T
            far[s : s + 256] = pr.argmax(0)
            val[s : s + 256] = pr.max(0)
        return pd.DataFrame({"pivot": q["pivot"].to_numpy(), "other": q["other"].to_numpy(), "sign": q["sign"].to_numpy(), "reach": val, "vec": m["vec"].to_numpy()[far]})

    best = (
        vecs.groupBy("pivot", "part").cogroup(asked.groupBy("pivot", "part"))
        .applyInPandas(reach, "pivot bigint, other bigint, sign int, reach double, vec binary")
        .groupBy("pivot", "other", "sign").agg(F.max(F.struct("reach", "vec")).alias("m"))
    )
    best, _ = materialize(best, "reach")
    one = best.where("sign = 1").select(F.col("pivot").alias("a"), F.col("other").alias("b"), F.col("m.reach").alias("ra"), F.col("m.vec").alias("va"))
    two = best.where("sign = -1").select(F.col("other").alias("a"), F.col("pivot").alias("b"), (-F.col("m.reach")).alias("rb"), F.col("m.vec").alias("vb"))
    slack = 1e-3 * radius

    def distance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            d = np.linalg.norm(unpack_floats(b["va"], dim).astype(np.float64) - unpack_floats(b["vb"], dim), axis=1) if len(b) else np.empty(0)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "ra": b["ra"], "rb": b["rb"], "linked": d <= radius})

    tested = one.join(two, ["a", "b"]).where(F.col("rb") - F.col("ra") <= radius + slack).mapInPandas(distance, "a bigint, b bigint, ra double, rb double, linked boolean")
    tested, _ = materialize(tested, "tested")
    links = tested.where("linked").select("a", "b")
    still = tested.where("not linked").join(pairs.select("a", "b", "axis"), ["a", "b"])
    if still.limit(1).count() == 0:
        return links

    def beyond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                pr = (unpack_floats(b["vec"], dim).astype(np.float64) * unpack_floats(b["axis"], dim)).sum(1)
                ok = np.where(b["left"], pr >= b["rb"] - radius - slack, pr <= b["ra"] + radius + slack)
                yield b[ok][["a", "b", "left", "id", "vec"]]

    sides = still.select("a", "b", "ra", "rb", "axis", F.explode(F.array(F.lit(True), F.lit(False))).alias("left")).withColumn("pivot", F.when(F.col("left"), F.col("a")).otherwise(F.col("b")))
    sides = sides.join(sizes, "pivot").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    close = sides.join(vecs, ["pivot", "part"]).select("a", "b", "ra", "rb", "axis", "left", "id", "vec").mapInPandas(beyond, "a bigint, b bigint, left boolean, id bigint, vec binary")
    close, _ = materialize(close, "close")
    many = close.groupBy("a", "b").agg(F.sum(F.col("left").cast("int")).alias("nl"), F.sum((~F.col("left")).cast("int")).alias("nr"))
    tiles = many.where("nl > 0 and nr > 0").select("a", "b", F.ceil(F.col("nl") / tile).cast("int").alias("tl"), F.ceil(F.col("nr") / tile).cast("int").alias("tr"))
    h = F.xxhash64("id")
    spread = close.join(tiles, ["a", "b"])
    i = F.when(F.col("left"), F.array(F.pmod(h, F.col("tl")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("tl") - 1))
    j = F.when(F.col("left"), F.sequence(F.lit(0), F.col("tr") - 1)).otherwise(F.array(F.pmod(h, F.col("tr")).cast("int")))
    spread = spread.withColumn("i", F.explode(i)).withColumn("j", F.explode(j)).select("a", "b", "i", "j", "left", "vec")

    def touch(key: tuple, m: pd.DataFrame) -> pd.DataFrame:
        left = m["left"].to_numpy(bool)
        if left.all() or not left.any():
            return pd.DataFrame({"a": [], "b": []})
        x, y = unpack_floats(m["vec"][left], dim), unpack_floats(m["vec"][~left], dim)
        for s in range(0, len(y), 2048):
            r, _, _ = _hits(x, _augment_points(x), y[s : s + 2048], _augment_pivots(y[s : s + 2048]), radius)
            if len(r):
                return pd.DataFrame({"a": [key[0]], "b": [key[1]]})
        return pd.DataFrame({"a": [], "b": []})

    return links.union(spread.groupBy("a", "b", "i", "j").applyInPandas(touch, schema)).distinct()


def pivot_clusters(vectors: DataFrame, radius: float, dim: int, batch: int = 8192, merge: bool = True, settle: bool = True) -> tuple[DataFrame, DataFrame]:
    """Clusters of (id, vec array) at Euclidean distance `radius`.

    Returns (id, cluster, group, dist) for every row, and the base table (id, ord, vec
    binary) of distinct vectors the rounds worked on. cluster is the closest pivot (ties to
    the smaller), or without `settle` the one that absorbed the record first; group the smallest id of the records connected through pairs within the
    radius; without `merge`, group is the cluster. Rows that are exact copies share both.
    Vectors must be usable (see usable_vector); null ids are dropped; an empty table gives no rows.
    """
    session_of(vectors)
    keyed = vectors.where(F.col("id").isNotNull()).select("id", "vec", *copy_key(F.col("vec")))
    on = ["k1", "k2"]
    groups, _ = materialize(first_copies(keyed, "id", on), "groups")
    total = groups.agg(F.sum("copies")).first()[0] or 0

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = np.ascontiguousarray(list_matrix(b.column("vec"), dim, np.float32))
            ends = (np.arange(len(m) + 1) * dim * 4).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ord"), pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends), pa.py_buffer(m.tobytes())])], names=["id", "ord", "vec"])

    reps = keyed.drop(*on).join(groups.select(F.col("rep").alias("id")), "id")
    order = F.shiftrightunsigned(F.xxhash64("id", F.lit("pivot order")), 64 - _ORDER_BITS)
    base, _ = materialize(reps.select("id", order.alias("ord"), "vec").mapInArrow(pack, "id bigint, ord bigint, vec binary"), "base")
    members, _ = pivot_rounds(base, radius, dim, batch)
    own = F.max(F.when(F.col("id") == F.col("pivot"), F.col("vec"))).alias("vec")
    pivots, _ = materialize(members.groupBy("pivot").agg(F.count(F.lit(1)).alias("size"), F.max("dist").alias("extent"), F.min("id").alias("least"), own), "pivots")
    placed, _ = materialize(place_members(members, pivots), "placed")
    closest = placed.select("id", "pivot", "dist")
    if settle:
        closest, _ = materialize(reassign(placed, pivots, radius, dim), "closest")
    if merge:
        root = connected(member_links(placed, pivots, radius, dim))
        named = pivots.join(root.select(F.col("node").alias("pivot"), "root"), "pivot", "left").select("pivot", F.coalesce("root", "pivot").alias("root"), "least", "size")
        named, _ = materialize(named, "roots")
        group = named.groupBy("root").agg(F.min("least").alias("group"))
        of_pivot = salted_join(named.select("pivot", "root"), group, ["root"], named.groupBy("root").agg(F.count(F.lit(1)).alias("copies")), "pivot", total).select("pivot", "group")
    else:
        of_pivot = pivots.select("pivot", F.col("pivot").alias("group"))
    # clusters as they are after members went to their closest pivot
    sizes = closest.groupBy("pivot").agg(F.count(F.lit(1)).alias("copies"))
    out = salted_join(closest, of_pivot, ["pivot"], sizes, "id", total).select(F.col("id").alias("rep"), F.col("pivot").alias("cluster"), "dist", "group")
    lists = out.join(groups, "rep")
    wide = salted_join(keyed.select("id", *on), lists.drop("copies"), on, groups, "id", total)
    return wide.select("id", "cluster", "group", "dist"), base


def describe_clusters(assigned: DataFrame, vectors: DataFrame, typical: int = 3, least: int = 1) -> DataFrame:
    """(cluster, size, medoid, typical_ids) of (id, cluster) with their (id, vec array).

    The medoid is the member with the least sum of squared distances to all members. That sum is
    the size times the squared distance to the mean plus a number equal for all, so it is, exactly,
    the member closest to the mean. typical_ids are the `typical` first members in that
    order, ties to the smaller id. Means are partial sums; the nearest members are kept by a
    rank limit applied before the shuffle, so a large cluster is never gathered.
    """
    rows = assigned.select("id", "cluster").join(vectors.select("id", "vec"), "id")
    cells = rows.select("cluster", F.posexplode("vec").alias("i", "v"))
    means = cells.groupBy("cluster", "i").agg(F.avg("v").alias("m")).groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c"))
    means = means.select("cluster", F.col("c.m").alias("mean"))
    sizes = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    spread = means.join(sizes, "cluster").withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("size") / 20_000)).cast("int"))
    hot = F.broadcast(spread.where("salts > 1").select("cluster", "salts"))  # fewer than rows / 20,000
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    d = F.aggregate(F.zip_with("vec", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = rows.join(hot, "cluster", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts").join(spread, ["cluster", "salt"]).select("cluster", "id", "size", F.round(F.sqrt(d), 6).alias("d"))
    w = Window.partitionBy("cluster").orderBy("d", "id")
    top = near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= typical)
    return top.groupBy("cluster").agg(F.max("size").alias("size"), F.min(F.struct("r", "id"))["id"].alias("medoid"), F.transform(F.array_sort(F.collect_list(F.struct("r", "id"))), lambda x: x["id"]).alias("typical_ids"))
