"""Terms of records: texts and histograms as (scope, record, term, tf)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdex.common import session_of
from sparkdex.functions.analyzer import fold

_LETTERS = regex.compile(r"\p{L}+")


def words(text: str | None) -> list[str]:
    """The longest runs of letters of the folded text; none for null or empty texts."""
    return _LETTERS.findall(fold(text)) if text else []


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms: list[str] = []
        tfs: list[int] = []
        ends = [0]
        for t in b.column("text").to_pylist():
            c = Counter(words(t))
            terms += c.keys()
            tfs += c.values()
            ends.append(len(terms))
        cells = pa.StructArray.from_arrays([pa.array(terms, pa.string()), pa.array(tfs, pa.int64())], names=["term", "tf"])
        yield pa.RecordBatch.from_arrays([b.column("scope"), b.column("record_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), cells)], names=["scope", "record_id", "terms"])


def text_content(title: Column, body: Column) -> Column:
    """Title, one blank, body; null counts as empty."""
    return F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(body, F.lit("")))


def usable_histogram(hist: Column) -> Column:
    """A histogram that is neither null nor all zero; null counts inside are zero."""
    return hist.isNotNull() & F.exists(F.coalesce(hist, F.array()), lambda v: F.coalesce(v, F.lit(0)) > 0)


def histogram_terms(hist: Column) -> Column:
    """ARRAY<STRUCT<term, tf>> of the words a histogram counts; term is the word number as text."""
    pairs = F.transform(hist, lambda v, i: F.struct(i.cast("string").alias("term"), F.coalesce(v, F.lit(0)).cast("bigint").alias("tf")))
    return F.filter(pairs, lambda p: p["tf"] > 0)


def term_records(corpus: DataFrame, histograms: DataFrame) -> DataFrame:
    """(scope, record_id, terms) of both collections, one row per record.

    Records of `corpus` all count, also those without any term; of `histograms` only
    usable ones. scope is "text" or the object's modality.
    """
    session_of(corpus)
    text = corpus.select(F.lit("text").alias("scope"), F.col("rid").cast("bigint").alias("record_id"), text_content(F.col("title"), F.col("body")).alias("text"))
    text = text.mapInArrow(_count_batches, "scope string, record_id bigint, terms array<struct<term:string,tf:bigint>>")
    hist = histograms.where(usable_histogram(F.col("hist_tf"))).select(
        F.col("modality").alias("scope"), F.col("obj_id").alias("record_id"), histogram_terms(F.col("hist_tf")).alias("terms")
    )
    return text.unionByName(hist)


def record_counts(corpus: DataFrame, histograms: DataFrame) -> DataFrame:
    """(scope, n_records) of the records of term_records, without looking into the texts."""
    hist = histograms.where(usable_histogram(F.col("hist_tf"))).select(F.col("modality").alias("scope"))
    return corpus.select(F.lit("text").alias("scope")).unionByName(hist).groupBy("scope").agg(F.count(F.lit(1)).alias("n_records"))
