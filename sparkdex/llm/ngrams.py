"""Counts of all n-grams and the records holding them, by sorted suffixes.

Every position of a record contributes the suffix that starts there, truncated to max_n
terms. Suffixes are routed by their first term, so that all n-grams with that first term
meet in one place; sorted in reverse lexicographic order, a suffix comes before its own
prefixes, and a stack as deep as max_n aggregates the counts and the record sets of every
prefix in one pass, whatever the number of n-grams.

Record sets are kept as numbers. Among the sorted suffixes of one record each is marked with
the terms it shares with the one before it: a prefix is new to the record exactly where it is
longer than that. So a suffix that shares s terms adds its records to its prefixes longer than
s and to no others, equal suffixes of different records add up before they travel, and no list
of records is held anywhere.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdex.common import session_of
from sparkdex.llm.terms import words

SEP = "\x1f"


class _PrefixStack:
    """Open prefixes of the current suffix with their occurrences and records."""

    def __init__(self) -> None:
        self.terms: list[str] = []
        self.cf: list[int] = []
        self.df: list[int] = []

    def close(self, depth: int) -> Iterator[tuple[list[str], int, int]]:
        """Emit and drop every prefix longer than `depth`; its parent takes its counts."""
        while len(self.terms) > depth:
            cf, df = self.cf.pop(), self.df.pop()
            yield list(self.terms), cf, df
            self.terms.pop()
            if self.terms:
                self.cf[-1] += cf
                self.df[-1] += df

    def push(self, suffix: list[str], shared: int, count: int, records: int) -> Iterator[tuple[list[str], int, int]]:
        common = 0
        while common < min(len(suffix), len(self.terms)) and suffix[common] == self.terms[common]:
            common += 1
        yield from self.close(common)
        for t in suffix[common:]:
            self.terms.append(t)
            self.cf.append(0)
            self.df.append(0)
        self.cf[-1] += count
        self.df[-1] += records
        if shared:  # prefixes up to here were counted for these records
            self.df[shared - 1] -= records


def _aggregate_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (scope, suffix, shared, tf, records) in reverse order of (scope, suffix) to n-gram counts."""
    stack, scope = _PrefixStack(), None
    out: list[tuple] = []
    for b in batches:
        for sc, suffix, shared, tf, records in zip(b["scope"], b["suffix"], b["shared"].tolist(), b["tf"].tolist(), b["records"].tolist()):
            if sc != scope:
                out += [(scope, *x) for x in stack.close(0)]
                scope = sc
            out += [(scope, *x) for x in stack.push(suffix.split(SEP), shared, tf, records)]
        if len(out) > 20_000:
            yield pd.DataFrame(out, columns=["scope", "gram", "cf", "df"])
            out = []
    out += [(scope, *x) for x in stack.close(0)]
    if out:
        yield pd.DataFrame(out, columns=["scope", "gram", "cf", "df"])


def _mark_shared(suffixes: DataFrame) -> DataFrame:
    """(scope, suffix, shared, tf, records) of (scope, suffix, record_id, tf): each record's suffixes in order,
    with the leading terms each shares with the one before it."""
    each = suffixes.groupBy("scope", "record_id", "suffix").agg(F.sum("tf").alias("tf"))
    before = F.split(F.lag("suffix").over(Window.partitionBy("scope", "record_id").orderBy("suffix")), SEP)
    own = F.split("suffix", SEP)
    differs = F.filter(F.sequence(F.lit(1), F.size(own)), lambda i: F.coalesce(F.try_element_at(before, i) != F.element_at(own, i), F.lit(True)))
    shared = F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, F.size(own))
    return each.select("scope", "suffix", F.when(before.isNull(), F.lit(0)).otherwise(shared).alias("shared"), "tf", F.lit(1).alias("records"))


def count_ngrams(suffixes: DataFrame, spread: int = 1_000, least_rows: int = 100_000) -> DataFrame:
    """(scope, gram, cf, df): occurrences and records of every prefix of the suffixes.

    `suffixes` has scope, suffix (terms joined by the unit separator), tf and either the
    record_id of each row, or, where the records' suffixes have been marked as text_suffixes
    does, shared and records. df counts records, cf occurrences. Prefixes of one n-gram are
    counted as n-grams themselves. No rows for an empty table.

    Equal suffixes are added up before the shuffle. A first term with more than
    max(least_rows, rows / spread) different suffixes, of which there are fewer than `spread`, is
    split by the suffix into parts of that many rows; what the parts count for its short n-grams
    is added by one more partial aggregate.
    """
    session_of(suffixes)
    if "shared" not in suffixes.columns:
        suffixes = _mark_shared(suffixes.select("scope", "suffix", "record_id", F.col("tf").cast("bigint").alias("tf")))
    typed = suffixes.select("scope", "suffix", F.col("shared").cast("int").alias("shared"), F.col("tf").cast("bigint").alias("tf"), F.col("records").cast("bigint").alias("records"))
    merged = typed.groupBy("scope", "suffix", "shared").agg(F.sum("tf").alias("tf"), F.sum("records").alias("records"))
    merged = merged.withColumn("_route", F.substring_index("suffix", SEP, 1))
    per_term = merged.where(F.col("suffix") != F.col("_route")).groupBy("scope", "_route").agg(F.count(F.lit(1)).alias("n"))  # none where suffixes are single terms
    limit = F.greatest(F.lit(least_rows), F.floor(F.sum("n").over(Window.partitionBy()) / spread))
    hot = F.broadcast(per_term.where(F.col("n") > least_rows).withColumn("_limit", limit).where(F.col("n") > F.col("_limit")).select("scope", "_route", F.ceil(F.col("n") / F.col("_limit")).alias("_parts")))
    ordered = (
        merged.join(hot, ["scope", "_route"], "left").withColumn("_part", F.pmod(F.xxhash64("suffix"), F.coalesce("_parts", F.lit(1))))
        .repartition("scope", "_route", "_part")
        .sortWithinPartitions(F.desc("scope"), F.desc("_part"), F.desc("suffix"))
        .select("scope", "suffix", "shared", "tf", "records")
    )
    grams = ordered.mapInPandas(_aggregate_sorted, "scope string, gram array<string>, cf bigint, df bigint")
    return grams.groupBy("scope", "gram").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def text_suffixes(texts: DataFrame, max_n: int) -> DataFrame:
    """(suffix, shared, tf, records) of (record_id, text): the truncated suffixes of the texts, marked record by
    record and added up within each batch of texts."""
    session_of(texts)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            tf, records = Counter(), Counter()
            for t in b["text"]:
                w = words(t)
                own = Counter(SEP.join(w[i : i + max_n]) for i in range(len(w)))
                before: list[str] = []
                for s in sorted(own):  # the separator sorts before all letters, so prefixes come first
                    terms, shared = s.split(SEP), 0
                    while shared < min(len(terms), len(before)) and terms[shared] == before[shared]:
                        shared += 1
                    tf[s, shared] += own[s]
                    records[s, shared] += 1
                    before = terms
            yield pd.DataFrame(
                {"suffix": [s for s, _ in tf], "shared": np.array([n for _, n in tf], np.int32), "tf": np.array(list(tf.values()), np.int64), "records": np.array([records[k] for k in tf], np.int64)}
            )

    return texts.select("text").mapInPandas(cut, "suffix string, shared int, tf bigint, records bigint")


def mark_terms(counts: DataFrame, records: DataFrame, rare: int = 2, common: float = 0.4) -> DataFrame:
    """Adds n_records and mark to (scope, ..., df): "rare" in at most `rare` records,
    "common" in more than `common` of the scope's records, else null.

    `records` has one row per scope: scope, n_records. Where both hold, rare wins.
    """
    n = F.broadcast(records)  # one row per scope
    return counts.join(n, "scope").withColumn(
        "mark", F.when(F.col("df") <= rare, "rare").when(F.col("df") > F.col("n_records") * common, "common")
    )
