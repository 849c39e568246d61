"""How characteristic each term is of its record.

The operator fits a parsimonious language model per record: expectation-maximisation
splits the record's term counts between a record-specific model and the background
model of its scope, until the record's probabilities stop moving; terms the background
explains well end with almost no mass. The joined background statistics also give the
plain tf-idf score of each term, in the two weightings the engine's rankings use.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdex.common import materialize


def _em(tf: np.ndarray, bg: np.ndarray, rec: np.ndarray, n: int, lam: float, tol: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Converged P(term | record) for the flattened terms of n records; rec is each term's record."""
    size = np.bincount(rec, tf, n)
    p = tf / size[rec]
    rounds = np.zeros(n, dtype=np.int32)
    live = np.ones(n, dtype=bool)
    idx = np.arange(len(tf))
    for _ in range(most):
        t, r = tf[idx], rec[idx]
        own = lam * p[idx]
        e = t * own / (own + (1 - lam) * bg[idx])
        total = np.bincount(r, e, n)
        new = e / np.where(total > 0, total, 1)[r]
        moved = np.zeros(n)
        np.maximum.at(moved, r, np.abs(new - p[idx]))
        p[idx] = new
        rounds[live] += 1
        live &= moved > tol
        idx = idx[live[r]]
        if not len(idx):
            break
    return p, rounds


def _best(rec: np.ndarray, value: np.ndarray, term: pa.Array, is_text: np.ndarray, top: int) -> np.ndarray:
    """Flat positions of each record's `top` highest values above 0.

    Ties go to the smaller term: by code points for text, by word number otherwise.
    """
    tie = np.empty(len(rec), dtype=np.int64)
    tie[pc.array_sort_indices(term).to_numpy()] = np.arange(len(rec))
    number = np.nonzero(~is_text)[0]
    if len(number):
        tie[number] = pc.cast(term.take(pa.array(number)), pa.int64()).to_numpy()
    k = np.nonzero(value > 0)[0]
    k = k[np.lexsort((tie[k], -value[k], rec[k]))]
    r = rec[k]
    first = np.concatenate([[True], r[1:] != r[:-1]]) if len(r) else np.empty(0, dtype=bool)
    place = np.arange(len(r)) - np.maximum.accumulate(np.where(first, np.arange(len(r)), 0)) if len(r) else r
    return k[place < top]


def score_records(joined: DataFrame, lam: float = 0.1, tol: float = 1e-6, max_rounds: int = 50, top: int | None = None, by: str = "score") -> DataFrame:
    """(scope, record_id, term, tf, df, n_records, probability, score) from one row per record.

    With `top`, only each record's best terms by `by` ("score" or "probability", to 9 decimals), above 0.

    `joined` has scope, record_id, n_records, total (all occurrences of the scope) and
    items: ARRAY<STRUCT<term, tf, df, cf>>. score is (1 + log10 tf) * log10(N / df) for
    scope "text" and tf * (ln((N + 1) / (df + 1)) + 1) for others, rounded to 6 decimals.
    Works on whole Arrow batches: the terms of many records are scored as flat arrays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = b.column("items")
            lens = np.diff(items.offsets.to_numpy())
            flat = items.flatten()
            tf = flat.field("tf").to_numpy(zero_copy_only=False).astype(np.float64)
            df = flat.field("df").to_numpy(zero_copy_only=False).astype(np.float64)
            cf = flat.field("cf").to_numpy(zero_copy_only=False).astype(np.float64)
            rec = np.repeat(np.arange(len(b)), lens)
            n = b.column("n_records").to_numpy(zero_copy_only=False).astype(np.float64)[rec]
            total = b.column("total").to_numpy(zero_copy_only=False).astype(np.float64)[rec]
            p, _ = _em(tf, cf / total, rec, len(b), lam, tol, max_rounds)
            is_text = np.array([s == "text" for s in b.column("scope").to_pylist()], dtype=bool)[rec]
            score = np.where(is_text, (1 + np.log10(tf)) * np.log10(n / df), tf * (np.log((n + 1) / (df + 1)) + 1))
            score = np.round(score, 6)
            keep = slice(None) if top is None else _best(rec, {"score": score, "probability": np.round(p, 9)}[by], flat.field("term"), is_text, top)
            at, kept = pa.array(rec[keep]), pa.array(np.arange(len(rec))[keep])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("scope").take(at), b.column("record_id").take(at), flat.field("term").take(kept), pa.array(tf[keep].astype(np.int64)),
                    pa.array(df[keep].astype(np.int64)), pa.array(n[keep].astype(np.int64)), pa.array(p[keep]), pa.array(score[keep]),
                ],
                names=["scope", "record_id", "term", "tf", "df", "n_records", "probability", "score"],
            )

    return joined.select("scope", "record_id", "n_records", "total", "items").mapInArrow(
        run, "scope string, record_id bigint, term string, tf bigint, df bigint, n_records bigint, probability double, score double"
    )


def distinctive_terms(
    records: DataFrame, lam: float = 0.1, hot_share: int = 5_000, tol: float = 1e-6, max_rounds: int = 50, top: int | None = None, by: str = "score"
) -> DataFrame:
    """Scores every term of every record of (scope, record_id, terms), or each record's `top` ones.

    terms is ARRAY<STRUCT<term, tf>>; records without terms (null, empty text, zero
    histogram) count in n_records where they are rows, but yield no rows. Background
    counts of terms holding more than 1 / hot_share of all (record, term) pairs of the
    collection are joined by broadcast: there are fewer than hot_share of them however
    the data grow, and they are the ones that would load single tasks of a join.
    """
    records, _ = materialize(records.select("scope", "record_id", "terms"), "records")  # texts are taken apart once
    flat = records.select("scope", "record_id", F.explode("terms").alias("t")).select("scope", "record_id", "t.term", "t.tf")
    stats = flat.groupBy("scope", "term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
    sizes = records.groupBy("scope").agg(F.count(F.lit(1)).alias("n_records"))
    totals = stats.groupBy("scope").agg(F.sum("cf").alias("total"), F.sum("df").alias("pairs"))
    scopes = sizes.join(totals, "scope")
    pairs = sum(r["pairs"] for r in totals.collect())
    hot = F.broadcast(stats.where(F.col("df") > pairs / hot_share))
    marked = flat.join(hot, ["scope", "term"], "left")
    warm = marked.where(F.col("df").isNotNull())
    cold_stats = stats.where(F.col("df") <= pairs / hot_share)
    cold = marked.where(F.col("df").isNull()).drop("df", "cf").join(cold_stats.hint("shuffle_hash"), ["scope", "term"])
    whole = warm.unionByName(cold).groupBy("scope", "record_id").agg(F.collect_list(F.struct("term", "tf", "df", "cf")).alias("items"))
    return score_records(whole.join(F.broadcast(scopes), "scope"), lam, tol, max_rounds, top, by)
