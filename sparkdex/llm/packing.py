"""Filling containers of fixed capacity with texts measured in tokens.

Packing is decided on counts of sizes, of which there are at most `capacity` whatever
the number of texts: items above a third of the capacity are matched greedily, at most
two to a container; smaller ones go where they leave the least room. The plan names, for
each size, which ranks go to which containers; every text finds its container from its
rank among texts of its size, so nothing but counts ever meets in one place.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkdex.common import materialize

#: The public split pattern that belongs to the byte-level vocabularies.
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """The byte-level tokenizer of a rank file; special strings are ordinary text."""
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens) of every text; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(n, pa.int32())], names=["id", "n_tokens"])

    return texts.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n_tokens int")


def plan_bins(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (size, first rank, number, first bin, per bin) and the number of bins.

    counts[s] items of size s, 1 <= s <= capacity. Rank r of a run goes to bin
    first_bin + (r - first_rank) // per_bin. A class below is a number of bins with the
    same content; each step moves whole classes, so there are at most a few per size.
    """
    left = {s: c for s, c in counts.items() if c > 0}
    classes: list[list] = []  # [bins, ((size, per bin), ...), room]
    large = sorted(s for s in left if 3 * s > capacity)
    while large:
        s = large[-1]
        fit = capacity - s
        k = bisect_left(large, fit + 1) - 1  # the largest partner that fits
        if k < 0:
            classes.append([left[s], ((s, 1),), capacity - s])
            large.pop()
        elif large[k] == s:
            n, odd = divmod(left[s], 2)
            if n:
                classes.append([n, ((s, 2),), capacity - 2 * s])
            left[s] = odd
            if odd and k > 0:
                t = large[k - 1]
                classes.append([1, ((s, 1), (t, 1)), capacity - s - t])
                left[t] -= 1
                if not left[t]:
                    large.pop(k - 1)
            elif odd:
                classes.append([1, ((s, 1),), capacity - s])
            large.pop()
        else:
            t = large[k]
            n = min(left[s], left[t])
            classes.append([n, ((s, 1), (t, 1)), capacity - s - t])
            left[s] -= n
            left[t] -= n
            if not left[s]:
                large.remove(s)
            if not left[t]:
                large.remove(t)
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(c: list) -> None:
        if c[2] not in by_room:
            by_room[c[2]] = []
            insort(rooms, c[2])
        by_room[c[2]].append(c)

    for c in classes:
        put(c)
    for s in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        n = left[s]
        while n:
            k = bisect_left(rooms, s)
            if k == len(rooms):
                per = capacity // s
                full, rest = divmod(n, per)
                if full:
                    put([full, ((s, per),), capacity - per * s])
                if rest:
                    put([1, ((s, rest),), capacity - rest * s])
                break
            room = rooms[k]
            c = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(k)
            per = room // s
            full = min(c[0], n // per)
            rest = (n - full * per) if full < c[0] else 0
            if full:
                put([full, c[1] + ((s, per),), room - per * s])
            if rest:
                put([1, c[1] + ((s, rest),), room - rest * s])
            spare = c[0] - full - (1 if rest else 0)
            if spare:
                put([spare, c[1], room])
            n -= full * per + rest
    runs, used, first = [], dict.fromkeys(counts, 0), 0
    for c in (c for room in rooms for c in by_room[room]):
        for s, per in c[1]:
            runs.append((s, used[s], c[0] * per, first, per))
            used[s] += c[0] * per
        first += c[0]
    return runs, first


def pack(sizes: DataFrame, containers: list[tuple[int, int]], spread: int = 64) -> DataFrame:
    """(container_id, id, piece, token_start, n_tokens, bin) of every text in every capacity.

    `sizes` has id (unique) and n_tokens; containers are (container_id, capacity) pairs, few.
    A text above the capacity is cut into full pieces and a rest, pieces numbered from 0;
    no other text is cut. A text of no tokens takes no room and has bin null. bin numbers
    count from 0 in each container kind. Equal sizes are told apart by rank in id order.
    """
    spark = sizes.sparkSession
    kinds = spark.createDataFrame([(int(c), int(k)) for c, k in containers], "container_id bigint, capacity int")
    if any(k < 1 for _, k in containers):
        raise ValueError("a capacity must be at least 1")
    each = sizes.join(F.broadcast(kinds))  # one row per text and capacity
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity")).cast("int"))
    items = each.select("container_id", "id", "n_tokens", "capacity", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece")).select(
        "container_id", "id", "piece", (F.col("piece") * F.col("capacity")).alias("token_start"),
        F.least(F.col("capacity"), F.col("n_tokens") - F.col("piece") * F.col("capacity")).alias("n_tokens"),
        F.pmod(F.xxhash64("id"), F.lit(spread)).cast("int").alias("part"),
    )
    per_part = items.where("n_tokens > 0").groupBy("container_id", "n_tokens", "part").agg(F.count(F.lit(1)).alias("n"))
    tallies = per_part.groupBy("container_id", "n_tokens").agg(F.sum("n").alias("n")).collect()  # at most sum of capacities
    plans = {}
    for c, capacity in containers:
        runs, _ = plan_bins({r["n_tokens"]: r["n"] for r in tallies if r["container_id"] == c}, capacity)
        a = np.array(sorted(runs), dtype=np.int64).reshape(-1, 5)
        plans[c] = (a[:, 0] * (1 << 42) + a[:, 1], a[:, 1], a[:, 3], a[:, 4])
    bc = spark.sparkContext.broadcast(plans)
    before = Window.partitionBy("container_id", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inner = Window.partitionBy("container_id", "n_tokens", "part").orderBy("id", "piece")
    ranked = items.withColumn("at", F.row_number().over(inner) - 1).join(offsets, ["container_id", "n_tokens", "part"], "left")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins = np.full(len(b), -1, dtype=np.int64)
            kind, size = b["container_id"].to_numpy(), b["n_tokens"].to_numpy()
            rank = np.where(size > 0, b["rank"].to_numpy(), 0).astype(np.int64)
            for c, (key, lo, first, per) in bc.value.items():
                k = np.nonzero((kind == c) & (size > 0))[0]
                if len(k):
                    r = np.searchsorted(key, size[k].astype(np.int64) * (1 << 42) + rank[k], side="right") - 1
                    bins[k] = first[r] + (rank[k] - lo[r]) // per[r]
            out = b.drop(columns=["rank"])
            out["bin"] = pd.array(bins, dtype="Int64")
            out.loc[bins < 0, "bin"] = pd.NA
            yield out

    ranked = ranked.select("container_id", "id", "piece", "token_start", "n_tokens", (F.col("at") + F.coalesce("before", F.lit(0))).cast("bigint").alias("rank"))
    return ranked.mapInPandas(place, "container_id bigint, id bigint, piece int, token_start int, n_tokens int, bin bigint")


def pack_texts(texts: DataFrame, id_col: str, text_col: str, containers: list[tuple[int, int]], vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """`pack` of texts measured with a public tokenizer; each text is tokenized once."""
    sizes, _ = materialize(token_counts(texts, id_col, text_col, vocabulary), "sizes")
    return pack(sizes, containers)
