"""Most similar vectors for every vector, by cosine.

Vectors are routed to the cells of a coarse codebook, and neighbouring cells to one task, so
a query travels once for several of its cells; inside a cell a query scans four-bit product codes trained with a score-aware loss, which penalises the part of the quantisation
error that is parallel to the vector more than the rest since only that part changes high
inner products; what the scan keeps is reranked by exact cosines. Exact copies are collapsed
first and expanded last.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkdex.common import materialize, session_of
from sparkdex.llm.vectors import cell_type, copy_key, list_matrix, pack_sparse, salted_join, unpack_sparse


def unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(np.float32)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def coarse_codebook(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """k spherical k-means centres of unit vectors; fewer if there are fewer vectors."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(b @ c.T, axis=1) for b in np.array_split(x, max(1, len(x) // 4096))])
        order = np.argsort(near, kind="stable")
        cut = np.searchsorted(near[order], np.arange(k))
        full = np.nonzero(np.bincount(near, minlength=k))[0]
        sums = np.zeros_like(c)
        sums[full] = np.add.reduceat(x[order], cut[full], axis=0)
        empty = np.setdiff1d(np.arange(k), full)
        sums[empty] = x[rng.choice(len(x), len(empty), replace=False)]
        c = unit(sums)
    return c


def _split(x: np.ndarray, sub: int) -> np.ndarray:
    """(rows, subspaces, sub), the last subspace filled up with zeros."""
    spare = -x.shape[1] % sub
    if spare:
        x = np.concatenate([x, np.zeros((len(x), spare), x.dtype)], axis=1)
    return x.reshape(len(x), -1, sub)


@dataclass
class FourBitCodes:
    """Product quantiser with 16 centres per subspace and a score-aware loss.

    The loss of a vector x with code x' and error e = x - x' is
    |e|^2 + (eta - 1) * (e . x / |x|)^2; eta = (d - 1) t^2 / (1 - t^2) for scores above t.
    """

    centres: np.ndarray  # (m, 16, sub)
    eta: float

    @classmethod
    def train(cls, x: np.ndarray, sub: int = 4, t: float = 0.2, rounds: int = 6, seed: int = 7) -> FourBitCodes:
        n, d = x.shape
        eta = max(1.0, (d - 1) * t * t / (1 - t * t))
        rng = np.random.default_rng(seed)
        xs = _split(x, sub)
        m = xs.shape[1]
        centres = np.stack([xs[rng.choice(n, 16, replace=n < 16), j] for j in range(m)]).astype(np.float32)
        self = cls(centres, 1.0)
        for r in range(rounds):
            self.eta = 1.0 if r < 2 else eta  # plain k-means first
            code = self._codes(x)
            rec = self.centres[np.arange(m), code]
            par = ((xs - rec) * xs).sum(-1)  # (n, m): each subspace's share of x . e
            whole = par.sum(1)
            g = self.eta - 1
            for j in range(m):
                rest = whole - par[:, j]
                v, a = xs[:, j], code[:, j]
                sq = (v * v).sum(1)
                for q in range(16):
                    k = a == q
                    if k.any():
                        vk = v[k]
                        lhs = k.sum() * np.eye(sub, dtype=np.float32) + g * vk.T @ vk
                        rhs = vk.sum(0) + g * ((rest[k] + sq[k])[:, None] * vk).sum(0)
                        self.centres[j, q] = np.linalg.solve(lhs, rhs)
        return self

    def _codes(self, x: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """(n, m) centre numbers by coordinate descent on the loss."""
        m, _, sub = self.centres.shape
        xs = _split(x, sub)
        cn = (self.centres**2).sum(-1)  # (m, 16)
        dots = np.einsum("nms,mqs->nmq", xs, self.centres, optimize=True)
        sq = (xs * xs).sum(-1)
        err = sq[:, :, None] - 2 * dots + cn[None]
        code = err.argmin(-1)
        if self.eta > 1:
            par = sq[:, :, None] - dots  # parallel error of each choice
            rows = np.arange(len(x))
            cur = par[rows[:, None], np.arange(m)[None], code]
            whole = cur.sum(1)
            for _ in range(sweeps):
                for j in range(m):
                    rest = whole - cur[:, j]
                    loss = err[:, j] + (self.eta - 1) * (rest[:, None] + par[:, j]) ** 2
                    code[:, j] = loss.argmin(1)
                    cur[:, j] = par[rows, j, code[:, j]]
                    whole = rest + cur[:, j]
        return code

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, m / 2) bytes: two four-bit centre numbers each."""
        out = []
        for b in np.array_split(x, max(1, len(x) // 8192)):
            c = self._codes(b)
            if c.shape[1] % 2:
                c = np.concatenate([c, np.zeros((len(c), 1), dtype=c.dtype)], axis=1)
            out.append((c[:, 0::2] | (c[:, 1::2] << 4)).astype(np.uint8))
        return np.concatenate(out) if out else np.empty((0, (self.centres.shape[0] + 1) // 2), np.uint8)

    def own_scores(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each vector's inner product with its own code. Dividing by it takes out what the code
        loses along its vector, so that a scan of the vector itself scores 1."""
        m, _, sub = self.centres.shape
        each = np.stack([codes & 15, codes >> 4], axis=2).reshape(len(codes), -1)[:, :m]
        rec = self.centres[np.arange(m)[None], each].reshape(len(codes), -1)
        return np.maximum((_split(x, sub).reshape(len(x), -1) * rec).sum(1), 0.05)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(m / 2, n, 256) partial scores of every code byte for each query."""
        m, _, sub = self.centres.shape
        t = np.einsum("nms,mqs->mnq", _split(q, sub), self.centres, optimize=True).astype(np.float32)
        if m % 2:
            t = np.concatenate([t, np.zeros((1, *t.shape[1:]), np.float32)])
        return (t[1::2, :, :, None] + t[0::2, :, None, :]).reshape((m + 1) // 2, len(q), 256)

    def scan(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, codes) approximate scores by table look-ups."""
        t = self.tables(q)
        cols = np.ascontiguousarray(codes.T)
        out = np.take(t[0], cols[0], axis=1)
        part = np.empty_like(out)
        for j in range(1, len(t)):
            np.take(t[j], cols[j], axis=1, out=part, mode="clip")
            out += part
        return out


@dataclass
class SimilarityIndex:
    """Coarse cells in groups of neighbours, and four-bit codes, of one kind of vectors, fitted on a bounded sample."""

    dim: int
    pair: np.dtype  # how vectors are packed
    cells: np.ndarray
    group: np.ndarray  # of each cell
    codes: FourBitCodes

    @classmethod
    def fit(cls, sample: np.ndarray, k: int, pair: np.dtype, group_cells: int = 64, code_rows: int = 8192) -> SimilarityIndex:
        """`sample` is in random order; the codes are trained on its first `code_rows` rows."""
        x = unit(sample)
        if k <= 1024:
            cells = coarse_codebook(x, k)
        else:  # two levels: groups of the sample first, then cells inside each
            top = coarse_codebook(x, math.isqrt(k))
            near = np.concatenate([np.argmax(b @ top.T, axis=1) for b in np.array_split(x, max(1, len(x) // 4096))])
            parts = [x[near == g] for g in range(len(top))]
            cells = np.concatenate([coarse_codebook(p, max(1, round(k * len(p) / len(x)))) for p in parts if len(p)])
        n_groups = max(1, len(cells) // group_cells)
        group = np.argmax(cells @ coarse_codebook(cells, n_groups).T, axis=1).astype(np.int32)
        return cls(x.shape[1], pair, cells, group, FourBitCodes.train(x[:code_rows]))


def cell_count(rows: int, cell_rows: int = 512, fixed: int = 2048) -> int:
    """Cells of about `cell_rows` rows up to `fixed` cells, then in proportion to the root of the rows: a
    query that scans a fixed number of cells looks at a share of the rows that falls as they grow."""
    return max(1, min(rows // cell_rows, max(fixed, 4 * math.isqrt(rows))))


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(1))


def _exact(q: np.ndarray, d: np.ndarray, qn: np.ndarray, dn: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (r, c), rounded to 9 decimals."""
    out = np.empty(len(r))
    for s in range(0, len(r), 100_000):
        rr, cc = r[s : s + 100_000], c[s : s + 100_000]
        out[s : s + 100_000] = np.einsum("ij,ij->i", q[rr], d[cc]) / (qn[rr] * dn[cc])
    return np.round(out, 9)


def _best(q: np.ndarray, d: np.ndarray, cos: np.ndarray, k: int) -> pd.DataFrame:
    """The k best (q, d, cosine) of each q; ties go to the smaller d."""
    o = np.lexsort((d, -cos, q))
    q, d, cos = q[o], d[o], cos[o]
    if not len(q):
        return pd.DataFrame({"q": np.empty(0, np.int64), "d": np.empty(0, np.int64), "cosine": np.empty(0)})
    first = np.concatenate([[True], q[1:] != q[:-1]])
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    keep = place < k
    return pd.DataFrame({"q": q[keep], "d": d[keep], "cosine": cos[keep]})


def _scan(ix: SimilarityIndex, q_id, q_vec, d_id, d_vec, d_code, min_cosine: float | None, margin: float, depth: int, out: list) -> None:
    """Appends (q, d, cosine) of what a scan of these codes (each with its scale in the last four bytes) keeps, exact.

    With min_cosine every code whose approximate score comes within `margin` of it is
    reranked, else the `depth` best codes of each query.
    """
    qn, dn = _norms(q_vec), _norms(d_vec)
    scale = np.ascontiguousarray(d_code[:, -4:]).view("<f4")[:, 0]
    step = max(1, min(512, 4_000_000 // max(1, len(d_id))))
    for s in range(0, len(q_id), step):
        qs = slice(s, s + step)
        approx = ix.codes.scan(unit(q_vec[qs]), d_code[:, :-4]) * scale
        if min_cosine is not None:
            r, c = np.nonzero(approx >= min_cosine - margin)
        else:
            take = min(depth, approx.shape[1])
            c = np.argpartition(-approx, take - 1, axis=1)[:, :take].ravel()
            r = np.repeat(np.arange(len(approx)), take)
        r = r + s
        cos = _exact(q_vec, d_vec, qn, dn, r, c)
        keep = q_id[r] != d_id[c]
        if min_cosine is not None:
            keep &= cos >= min_cosine
        out.append((q_id[r[keep]], d_id[c[keep]], cos[keep]))


def neighbours(
    base: DataFrame, ix: SimilarityIndex, k: int, min_cosine: float | None = None, nprobe: float = 8, margin: float = 0.2, depth: int = 50, task_queries: int = 15_000, both_ways: bool = False
) -> DataFrame:
    """(q, d, cosine, rank): the k nearest of (id, vec, is_query) for each row that is a query, ids distinct vectors.

    Each query scans the nprobe cells nearest to it, all of them if nprobe is 1.0. A task has the cells of
    one group; groups of too many rows are cut into blocks, and the queries of a group into
    parts, so no task holds a whole crowded group. With both_ways, which asks for min_cosine
    and for every row as a query, a pair is found if either side finds it.
    """
    spark = session_of(base)
    bc = spark.sparkContext.broadcast(ix)
    every = isinstance(nprobe, float) and nprobe >= 1.0
    n_cells, n_groups = len(ix.cells), int(ix.group.max()) + 1
    probe_n = min(max(1, math.ceil(nprobe * n_cells) if nprobe < 1 else int(nprobe)), n_cells)
    block = max(2_000, 20_000_000 // (4 * ix.dim))
    narrow = np.dtype("<u4")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = bc.value
        whole = pa.StructArray.from_arrays([pa.array(np.arange(n_groups, dtype=np.int32)), pa.array([b""] * n_groups, pa.binary())], names=["g", "cells"])
        for big in batches:
            for s in range(0, len(big), 2048):
                b = big.slice(s, 2048)
                m = list_matrix(b.column("vec"), ix.dim, np.float64)
                u = unit(m)
                asks = b.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
                sc = u @ ix.cells.T
                best = sc.argmax(1).astype(np.int32)
                n_asked, groups, cells = np.zeros(len(m), np.int64), [], []
                if every:
                    n_asked[asks] = n_groups
                    routes = pa.concat_arrays([whole] * int(asks.sum())) if asks.any() else whole.slice(0, 0)
                else:
                    rows = np.nonzero(asks)[0]
                    top = np.argpartition(-sc[rows], probe_n - 1, axis=1)[:, :probe_n] if probe_n < n_cells else np.tile(np.arange(n_cells), (len(rows), 1))
                    for i, t in zip(rows, top):
                        g = ix.group[t]
                        o = np.argsort(g, kind="stable")
                        starts = np.nonzero(np.concatenate([[True], g[o][1:] != g[o][:-1]]))[0]
                        n_asked[i] = len(starts)
                        groups += g[o][starts].tolist()
                        cells += [c.astype(narrow).tobytes() for c in np.split(t[o], starts[1:])]
                    routes = pa.StructArray.from_arrays([pa.array(groups, pa.int32()), pa.array(cells, pa.binary())], names=["g", "cells"])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_asked)]).astype(np.int32)), routes)
                code = ix.codes.encode(u)
                code = np.concatenate([code, (1 / ix.codes.own_scores(u, code)).astype("<f4")[:, None].view(np.uint8)], axis=1)
                width = code.shape[1]
                codes = pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer((np.arange(len(code) + 1) * width).astype(np.int32)), pa.py_buffer(code.tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(ix.group[best]), pa.array(best), lists, pack_sparse(m, ix.pair), codes], names=["id", "g", "cell", "routes", "vec", "code"]
                )

    coded, _ = materialize(
        base.select("id", "vec", "is_query").mapInArrow(assign, "id bigint, g int, cell int, routes array<struct<g:int,cells:binary>>, vec binary, code binary"), "coded"
    )
    # sizes per group: at most n_groups rows
    sizes = {r[0]: r[1] for r in coded.groupBy("g").count().collect()}
    probes = {r[0]: r[1] for r in coded.select(F.explode("routes.g").alias("g")).groupBy("g").count().collect()}
    plan = [(g, max(1, -(-n // block)), max(1, -(-probes.get(g, 0) // task_queries))) for g, n in sizes.items()]
    n_tasks = sum(b * p for _, b, p in plan)
    plan = F.broadcast(spark.createDataFrame(plan, "g int, n_blocks int, n_parts int"))
    h = F.xxhash64("id")
    data = coded.select("id", "vec", "code", "cell", F.lit(None).cast("binary").alias("cells"), "g").join(plan, "g")
    data = data.withColumn("b", F.pmod(h, F.col("n_blocks")).cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)))
    asks = coded.select("id", "vec", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("int").alias("cell"), F.explode("routes").alias("r")).select("id", "vec", "code", "cell", "r.cells", "r.g").join(plan, "g")
    asks = asks.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).withColumn("p", F.pmod(h, F.col("n_parts")).cast("int"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ix = bc.value
        asking = pdf["code"].isna().to_numpy()
        d, q = pdf[~asking], pdf[asking]
        out: list[tuple] = []
        if len(d) and len(q):
            q_id, q_vec, d_id, d_vec = q["id"].to_numpy(), unpack_sparse(q["vec"], ix.dim, ix.pair), d["id"].to_numpy(), unpack_sparse(d["vec"], ix.dim, ix.pair)
            code = np.frombuffer(b"".join(d["code"]), np.uint8).reshape(len(d), -1)
            if every:
                _scan(ix, q_id, q_vec, d_id, d_vec, code, min_cosine, margin, depth, out)
            else:
                n = np.fromiter((len(c) for c in q["cells"]), np.int64, len(q)) // narrow.itemsize
                asked = np.frombuffer(b"".join(q["cells"]), narrow)
                who = np.repeat(np.arange(len(q)), n)
                by_ask, cell = np.argsort(asked, kind="stable"), d["cell"].to_numpy().astype(np.int64)
                by_cell = np.argsort(cell, kind="stable")
                for c in np.unique(cell):
                    i = who[by_ask[np.searchsorted(asked[by_ask], c) : np.searchsorted(asked[by_ask], c, side="right")]]
                    j = by_cell[np.searchsorted(cell[by_cell], c) : np.searchsorted(cell[by_cell], c, side="right")]
                    if len(i):
                        _scan(ix, q_id[i], q_vec[i], d_id[j], d_vec[j], code[j], min_cosine, margin, depth, out)
        if not out:
            return _best(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), k)
        a, b, cos = map(np.concatenate, zip(*out))
        if both_ways:
            a, b, cos = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([cos, cos])
            _, one = np.unique(np.stack([a, b]), axis=1, return_index=True) if len(a) else (None, np.empty(0, np.int64))
            a, b, cos = a[one], b[one], cos[one]
        return _best(a, b, cos, k)

    found = data.select("id", "vec", "code", "cell", "cells", "g", "b", "p").unionByName(asks.select("id", "vec", "code", "cell", "cells", "g", "b", "p"))
    # a number of partitions of its own: the rows are small for what is computed on them
    found = found.repartition(min(20_000, 2 * n_tasks), "g", "b", "p").groupBy("g", "b", "p").applyInPandas(search, "q bigint, d bigint, cosine double")
    if both_ways:  # a pair may have been found from both sides
        found = found.groupBy("q", "d").agg(F.max("cosine").alias("cosine"))
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "d")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _brute(reps: DataFrame, k: int, min_cosine: float | None) -> DataFrame:
    """(scope, q, d, cosine) within each small (scope, dim), by all cosines; the caller bounds a group's rows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, ids = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["vec"]]), pdf["id"].to_numpy()
        asks = np.nonzero(pdf["is_query"].to_numpy(bool))[0]
        r, c = np.repeat(asks, len(m)), np.tile(np.arange(len(m)), len(asks))
        n = _norms(m)
        cos = _exact(m, m, n, n, r, c)
        keep = (r != c) & ((cos >= min_cosine) if min_cosine is not None else True)
        out = _best(ids[r[keep]], ids[c[keep]], cos[keep], k)
        return out.assign(scope=pdf["scope"].iloc[0])[["scope", "q", "d", "cosine"]]

    picked = reps.select("scope", "dim", "id", F.transform("vec", lambda v: v.cast("double")).alias("vec"), "is_query")
    return picked.groupBy("scope", "dim").applyInPandas(run, "scope string, q bigint, d bigint, cosine double")


def _fit_index(base: DataFrame, rows: int, pair: np.dtype, sample_rows: int) -> SimilarityIndex:
    k = cell_count(rows)
    wanted = max(sample_rows, 16 * k)
    share = min(1.0, wanted / max(rows, 1))
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000))
    picked = base.where(draw <= math.ceil(share * 1_000_000)).select("id", "vec").toPandas().sort_values("id")  # about `wanted` rows: a hash decides, not the number
    picked = picked.iloc[np.random.default_rng(5).permutation(len(picked))]
    return SimilarityIndex.fit(np.stack([np.asarray(v, dtype=np.float64) for v in picked["vec"]]), k, pair)


def similar_objects(
    objects: DataFrame, k: int = 5, min_cosine: float | None = 0.93, nprobe: float = 8, margin: float = 0.2, depth: int = 50, sample_rows: int = 20_000, only_queries: str | None = None, small: int = 128
) -> DataFrame:
    """(scope, obj_id, other_id, cosine, rank): for each object the k others of its scope most alike.

    `objects` has scope, id and vec, an array of whole or fractional numbers. Vectors of a scope
    are compared with those of the same length, each length with an index of its own; lengths of up to
    `small` distinct vectors are compared in full. Unusable vectors (null, empty, all zero, with NaN
    or infinity) and rows without scope or id take no part; nulls inside count as zero.
    Cosines are rounded to 9 decimals, ties go to the smaller id, so the smallest ids of a
    group of copies stand for it. With min_cosine only partners at least that similar are
    sought and returned. Without, and where nprobe cells do not hold k others, fewer may come
    out. Cells are fitted on about max(sample_rows, 16 vectors a cell) vectors and codes on
    8,192 of them, drawn by a hash of the id; all vectors are indexed.
    """
    spark = session_of(objects)
    kind = objects.schema["vec"].dataType.elementType
    fractional = not isinstance(kind, T.IntegralType)
    if fractional:
        filled = F.transform("vec", lambda v: F.coalesce(v.cast("double"), F.lit(0.0)) + F.lit(0.0))  # -0.0 is 0.0
        sound = ~F.exists("vec", lambda v: F.isnan(v) | (F.abs(v) == float("inf")))
    else:
        filled = F.transform("vec", lambda v: F.coalesce(v, F.lit(0).cast(kind)))
        sound = F.lit(True)
    named = objects.where(F.col("scope").isNotNull() & F.col("id").isNotNull() & F.col("vec").isNotNull())
    usable = named.select(F.col("scope").cast("string").alias("scope"), F.col("id").cast("bigint").alias("id"), filled.alias("vec")).where(sound & F.exists("vec", lambda v: v != 0))
    condition = F.coalesce(F.expr(only_queries), F.lit(False)) if only_queries else F.lit(True)
    keyed = usable.select("scope", "id", "vec", F.size("vec").alias("dim"), condition.alias("is_query"), *copy_key(F.col("vec")))
    on = ["scope", "k1", "k2"]
    # a group of copies asks if any of them does
    groups = keyed.groupBy(*on).agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.max("is_query").alias("is_query"))
    groups, _ = materialize(groups, "groups")
    reps = keyed.drop("k1", "k2", "is_query").join(groups.select("scope", F.col("rep").alias("id"), "is_query"), ["scope", "id"])
    reps, _ = materialize(reps, "vectors")
    least = F.array_min("vec").cast("double")
    most = F.array_max("vec").cast("double")
    kinds = reps.groupBy("scope", "dim").agg(F.count(F.lit(1)).alias("n"), F.min(least).alias("least"), F.max(most).alias("most"))
    kinds, _ = materialize(kinds, "kinds")
    small_ones = reps.join(kinds.where(F.col("n") <= small).select("scope", "dim"), ["scope", "dim"], "left_semi")
    near = _brute(small_ones, k, min_cosine)
    for r in kinds.where(F.col("n") > small).orderBy("scope", "dim").collect():  # kinds of more than `small` vectors, one index each
        base = reps.where((F.col("scope") == r["scope"]) & (F.col("dim") == r["dim"])).select("id", "vec", "is_query")
        pair = cell_type(r["dim"], fractional, r["most"], r["least"])
        ix = _fit_index(base, r["n"], pair, sample_rows)
        found = neighbours(base, ix, k, min_cosine, nprobe, margin, depth, both_ways=min_cosine is not None and not only_queries)
        near = near.unionByName(found.select(F.lit(r["scope"]).alias("scope"), "q", "d", "cosine"))
    total = groups.agg(F.sum("copies")).first()[0] or 0
    # the k + 1 smallest ids of each group; the rank limit is applied before the shuffle
    w = Window.partitionBy(*on).orderBy("id")
    heads = keyed.select(*on, "id").withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k + 1).groupBy(*on).agg(F.collect_list("id").alias("ids"))
    labelled = groups.drop("is_query").join(heads, on)
    other = near.select("scope", "q", F.col("d").alias("rep"), "cosine").join(labelled.select("scope", "rep", "ids"), ["scope", "rep"])
    cand = other.select("scope", F.col("q").alias("rep"), F.transform("ids", lambda i: F.struct((-F.col("cosine")).alias("c"), i.alias("id"))).alias("l"))
    own = labelled.select("scope", "rep", F.transform("ids", lambda i: F.struct(F.lit(-1.0).alias("c"), i.alias("id"))).alias("l"))
    lists = cand.unionByName(own).groupBy("scope", "rep").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, k + 1).alias("l"))
    lists = lists.join(groups.select(*on, "rep"), ["scope", "rep"]).drop("rep")
    asked = keyed.where("is_query").select(*on, "id")
    wide = salted_join(asked, lists, on, groups, "id", total)
    best = wide.select("scope", F.col("id").alias("obj_id"), F.posexplode(F.slice(F.filter("l", lambda x: x["id"] != F.col("id")), 1, k)).alias("pos", "x"))
    return best.select("scope", "obj_id", F.col("x.id").alias("other_id"), (-F.col("x.c")).alias("cosine"), (F.col("pos") + 1).alias("rank"))
