"""Similarity of media objects by bags of visual or acoustic words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdex.common import session_of


def train_codebook(descriptors: DataFrame, k: int, sample_rows: int = 500_000, seed: int = 42) -> np.ndarray:
    """k centres fitted by Spark's k-means on at most about `sample_rows` descriptors (obj_id, descriptor).

    Fewer distinct descriptors than k give fewer centres; none at all give one centre of zeros.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = descriptors.where(F.col("descriptor").isNotNull())
    n = d.count()
    if not n:
        return np.zeros((1, 1))
    if n > sample_rows:
        d = d.where(F.pmod(F.xxhash64("descriptor"), F.lit(1_000_000)) < int(1_000_000 * sample_rows / n))
    if k == 1:  # k-means begins at two centres; one is the mean
        cells = d.select(F.posexplode(F.col("descriptor").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"))
        return np.array([[r["m"] for r in cells.orderBy("i").collect()]])  # as many rows as a descriptor has numbers
    model = KMeans(k=k, seed=seed, maxIter=20).fit(d.select(array_to_vector(F.col("descriptor").cast("array<double>")).alias("features")))
    return np.array(model.clusterCenters())


def quantize(descriptors: DataFrame, codebook: np.ndarray) -> DataFrame:
    """(obj_id, word) of each descriptor: its nearest centre, ties to the smaller word.

    The codebook is broadcast: k centres of the descriptor's length. Null descriptors and
    those of another length have no word.
    """
    bc = session_of(descriptors).sparkContext.broadcast(np.asarray(codebook, dtype=np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bc.value
        for b in batches:
            if not len(b):
                continue
            x = np.asarray(b.column("descriptor").flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(b), -1)
            word = np.empty(len(x), np.int32)
            for s in range(0, len(x), 1024):
                word[s : s + 1024] = ((c * c).sum(1)[None] - 2 * x[s : s + 1024] @ c.T).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column("obj_id"), pa.array(word)], names=["obj_id", "word"])

    usable = descriptors.where(F.col("descriptor").isNotNull() & (F.size("descriptor") == np.asarray(codebook).shape[1]))
    return usable.select(F.col("obj_id").cast("bigint"), "descriptor").mapInArrow(run, "obj_id bigint, word int")


def histograms(words: DataFrame) -> DataFrame:
    """(obj_id, word, tf)."""
    return words.groupBy("obj_id", "word").agg(F.count(F.lit(1)).alias("tf"))


def word_weights(hist: DataFrame, n_objects: int) -> DataFrame:
    """(obj_id, word, tf, idf, weight): idf = ln((N + 1) / (df + 1)) + 1, weight = tf * idf.

    There are at most as many words as the codebook has, so their statistics are broadcast.
    """
    df = hist.groupBy("word").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.log((F.lit(float(n_objects)) + 1) / (F.col("df") + 1)) + 1)
    return hist.join(F.broadcast(df), "word").withColumn("weight", F.col("tf") * F.col("idf")).select("obj_id", "word", "tf", "idf", "weight")


def similar(weights: DataFrame, query: dict[int, float], k: int | None, mode: str = "INDEX", objects: DataFrame | None = None) -> DataFrame:
    """(obj_id, score): cosine of each object's weights with the query's, best first, ties to the larger id.

    mode INDEX ranks objects that share a word with the query, SEQ all of `objects` (obj_id),
    score 0 where none is shared. A query without weights has no INDEX result.
    """
    norm = float(np.sqrt(sum(v * v for v in query.values())))
    q = F.create_map(*[F.lit(x) for w, v in query.items() for x in (int(w), float(v))]) if query else None
    dot = F.coalesce(F.element_at(q, F.col("word")), F.lit(0.0)) * F.col("weight") if query else F.lit(0.0)
    shared = F.max(F.col("word").isin([int(w) for w in query]).cast("int")) if query else F.max(F.lit(0))
    agg = weights.groupBy("obj_id").agg(F.sum(dot).alias("dot"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"), shared.alias("shared"))
    score = F.round(F.when((F.col("norm") > 0) & (F.lit(norm) > 0), F.col("dot") / (F.col("norm") * (norm or 1.0))).otherwise(0.0), 6)
    out = agg.withColumn("score", score)
    if mode == "SEQ":
        if objects is not None:
            out = objects.select("obj_id").join(out, "obj_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    else:
        out = out.where("shared = 1")
    ranked = out.select("obj_id", "score").orderBy(F.desc("score"), F.desc("obj_id"))
    return ranked if k is None else ranked.limit(k)
