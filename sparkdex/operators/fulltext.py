"""Ranked full-text retrieval: TF-IDF over an inverted index.

A document's vector has (1 + log10 tf) weights and its norm leaves idf out; a query term
weighs (1 + log10 tf) * idf with idf = log10(N / df), and its norm keeps idf in. Scores may
therefore exceed 1.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.common import session_of
from sparkdex.functions.analyzer import Analyzer

#: Documents whose postings share a bucket of terms, about: the number of buckets follows from the collection's size.
BUCKET_DOCS = 20_000


def term_frequencies(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, term, tf, norm) of (doc_id, text): each document by itself, without a shuffle."""

    session_of(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, tfs, norms = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                c = Counter(analyzer.terms(t))
                norm = math.sqrt(sum((1 + math.log10(n)) ** 2 for n in c.values()))
                at += [i] * len(c)
                terms += c.keys()
                tfs += c.values()
                norms += [norm] * len(c)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(norms, pa.float64())],
                names=["doc_id", "term", "tf", "norm"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, term string, tf bigint, norm double")


def doc_norms(docs: DataFrame, analyzer: Analyzer) -> DataFrame:
    """(doc_id, n_terms, norm) of every document; an empty one has 0 and 0.0."""
    tf = term_frequencies(docs, analyzer).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_terms"), F.max("norm").alias("norm"))
    return docs.select(F.col("doc_id").cast("bigint")).join(tf, "doc_id", "left").fillna({"n_terms": 0, "norm": 0.0})


def document_frequencies(tf: DataFrame, n_docs: int) -> DataFrame:
    """(term, df, idf)."""
    d = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return d.withColumn("idf", F.log10(F.lit(float(max(n_docs, 1))) / F.col("df")))


def posting_weights(tf: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(term, doc_id, tf, weight): weight = (1 + log10 tf) * idf."""
    return tf.join(lexicon, "term").select("term", "doc_id", "tf", ((1 + F.log10("tf")) * F.col("idf")).alias("weight"))


@dataclass
class FtsIndex:
    """Postings and lexicons on disk, in directories of the term's hash.

    Documents indexed at different times are segments with files of their own; a search
    reads the query's buckets of each, and document frequencies are sums over them.
    """

    segments: list[dict]  # path, n_docs, buckets
    profile: str

    @property
    def n_docs(self) -> int:
        return sum(g["n_docs"] for g in self.segments)

    @classmethod
    def build(cls, docs: DataFrame, path: str, profile: str = "spanish") -> FtsIndex:
        return cls([cls.write_segment(docs, path, profile)], profile)

    @staticmethod
    def write_segment(docs: DataFrame, path: str, profile: str) -> dict:
        """Index documents (doc_id, text). Tasks get ranges of (bucket, term, document), so a term
        of very many documents is written by several."""
        spark = session_of(docs)
        n = docs.count()
        buckets = max(32, min(8192, n // BUCKET_DOCS))
        tf = term_frequencies(docs, Analyzer(profile)).withColumn("b", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
        tf.repartitionByRange(max(8, n // BUCKET_DOCS), "b", "term", "doc_id").sortWithinPartitions("b", "term", "doc_id").write.partitionBy("b").parquet(f"{path}/postings")
        written = spark.read.schema("doc_id bigint, term string, tf bigint, norm double, b int").parquet(f"{path}/postings")
        lexicon = written.groupBy("b", "term").agg(F.count(F.lit(1)).alias("df"))
        lexicon.repartition("b").sortWithinPartitions("b", "term").write.partitionBy("b").parquet(f"{path}/lexicon")
        return {"path": path, "n_docs": n, "buckets": buckets}

    def _read(self, spark: SparkSession, what: str, schema: str, terms: list[str]) -> DataFrame | None:
        out = None
        for g in self.segments:
            # hashes of literals fold to constants, so only the buckets' directories are listed
            bucket = reduce(or_, [F.col("b") == F.pmod(F.xxhash64(F.lit(t)), F.lit(g["buckets"])).cast("int") for t in terms])
            d = spark.read.schema(f"{schema}, b int").parquet(f"{g['path']}/{what}").where(bucket & F.col("term").isin(terms)).drop("b")
            out = d if out is None else out.unionByName(d)
        return out

    def search(self, spark: SparkSession, query: str, k: int | None) -> DataFrame:
        """(doc_id, score) of the k best documents holding a query term.

        Ties go to the larger id. Documents that hold only terms of every document score 0
        and stay candidates; if all query terms are such, or none is known, there is no result.
        """
        wanted = Counter(Analyzer(self.profile).terms(query))
        empty = spark.createDataFrame([], "doc_id bigint, score double")
        terms = sorted(wanted)
        lexicon = self._read(spark, "lexicon", "term string, df bigint", terms) if terms else None
        if lexicon is None:
            return empty
        known = {r["term"]: r["df"] for r in lexicon.groupBy("term").agg(F.sum("df").alias("df")).collect()}  # at most the query's terms
        weight = {t: (1 + math.log10(wanted[t])) * math.log10(self.n_docs / df) for t, df in known.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        if norm == 0:
            return empty
        factor = F.create_map(*[F.lit(v) for t, df in known.items() for v in (t, weight[t] * math.log10(self.n_docs / df))])
        postings = self._read(spark, "postings", "doc_id bigint, term string, tf bigint, norm double", sorted(known))
        part = (1 + F.log10("tf")) * F.element_at(factor, F.col("term")) / (F.col("norm") * norm)
        scored = postings.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score"))
        ranked = scored.orderBy(F.desc("score"), F.desc("doc_id"))
        return ranked if k is None else ranked.limit(k)
