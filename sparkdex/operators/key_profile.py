"""Per-key profiles that a few heavy keys cannot hold up.

Counts, extremes and distinct ids are partial aggregates, so a heavy key never reaches a
task as rows. Selections are exact and distributed: a histogram over an ordered range is
counted in bounded bins (counts merge in any order), the bins that hold what is sought are
cut into finer bins, and so on until each is a single value. For per-key quantiles the range
is that of the key's values and a bin is sought if it holds the wanted rank; for heavy keys
the range is that of the keys' hashes and a bin is sought if it holds enough rows. No value
of a heavy key is gathered, and keys that are not heavy are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sparkdex.common import materialize, remove_path, session_of

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def as_long(name: str, kind: T.DataType) -> Column:
    """A value as a long in the same order, without loss; TypeError for types that have none.

    Doubles go by the bits of their form, with NaN as null; timestamps without zone by their
    own clock, so a session zone with changing hours merges nothing.
    """
    c = F.col(f"`{name}`")
    if isinstance(kind, T.IntegralType):
        return c.cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        seconds = f"hour(`{name}`) * 3600L + minute(`{name}`) * 60L"
        return F.expr(f"unix_date(cast(`{name}` as date)) * 86400000000L + ({seconds}) * 1000000L + cast(extract(second from `{name}`) * 1000000 as bigint)")
    if isinstance(kind, T.DateType):
        return F.unix_date(c).cast("long")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (c * F.lit(10**kind.scale).cast("decimal(19, 0)")).cast("long")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bits = F.expr(f"cast(reflect('java.lang.Double', 'doubleToLongBits', cast(`{name}` as double) + 0.0D) as bigint)")
        ordered = F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)
        return F.when(c.isNotNull() & ~F.isnan(c), ordered)
    raise TypeError(f"a profile needs numbers, dates or times, not {kind.simpleString()}")


def from_long(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(value)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(_EPOCH) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (value.cast("decimal(20, 0)") / F.lit(1_000_000)).cast("decimal(18, 6)"))
    if isinstance(kind, T.DateType):
        return F.date_from_unix_date(value.cast("int"))
    if isinstance(kind, T.DecimalType):
        return (value.cast("decimal(20, 0)") / F.lit(10**kind.scale).cast("decimal(20, 0)")).cast(kind)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        bits = F.when(value < 0, value.bitwiseXOR(F.lit(2**63 - 1))).otherwise(value)
        return F.when(value.isNotNull(), F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast(kind))
    return value.cast(kind)


def exact_hot_quantiles(rows: DataFrame, hot: DataFrame, keys: Sequence[str], value: str, quantiles: Sequence[float], bins: int = 1 << 16, histogram_rows: int = 1 << 22) -> DataFrame:
    """(keys, p, value): exact quantiles of `value` (long) for the keys of `hot` by histogram refinement.

    `hot` holds one row per heavy key with columns keys, n (non-null values), lo, hi; the
    caller bounds its size, so it is broadcast. The value of quantile p is the one at rank
    ceil(p * n). A round counts, for each open (key, p), the rows of its interval in up to `bins`
    bins, as many as keep all histograms together below `histogram_rows`; the bin that holds the
    rank, shrunk to the values that occur in it, is the next interval. The state of the
    rounds is a table; the driver sees only how many intervals are open.
    """
    ps = F.array(*[F.lit(float(p)) for p in quantiles])
    state = hot.where("n > 0").select(*keys, F.explode(ps).alias("p"), "n", "lo", "hi")
    state = state.select(*keys, "p", F.greatest(F.lit(1), F.ceil(F.col("p") * F.col("n"))).cast("bigint").alias("rank"), "lo", "hi")
    state, path = materialize(state, "quantiles")
    while True:
        n_open = state.where("lo < hi").count()
        if not n_open:
            return state.select(*keys, "p", F.col("lo").alias("value"))
        n_bins = max(2, min(bins, histogram_rows // n_open))
        # widths as decimals: an interval may span more than 63 bits
        width = F.ceil((F.col("hi").cast("decimal(20, 0)") - F.col("lo").cast("decimal(20, 0)") + 1) / F.lit(n_bins)).cast("decimal(20, 0)")
        todo = state.where("lo < hi").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "p", "rank", "lo", "hi", width.alias("w"))
        on = [F.col(k) == F.col(f"_k{i}") for i, k in enumerate(keys)]
        state_key = [*[f"_k{i}" for i in range(len(keys))], "p"]
        bin_ = F.floor((F.col(value).cast("decimal(20, 0)") - F.col("lo").cast("decimal(20, 0)")) / F.col("w")).cast("bigint")
        narrow = ((F.col(value) - F.col("lo")) / F.col("w").cast("double")).cast("bigint")  # exact below 2^52
        counts = (
            rows.join(F.broadcast(todo), [*on, F.col(value) >= F.col("lo"), F.col(value) <= F.col("hi")])
            .groupBy(*state_key, "rank", F.when(F.col("hi").cast("double") - F.col("lo").cast("double") < float(1 << 52), narrow).otherwise(bin_).alias("_bin"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        )
        w = Window.partitionBy(*state_key).orderBy("_bin")
        cum = counts.withColumn("_cum", F.sum("_n").over(w))
        pick = cum.where((F.col("_cum") >= F.col("rank")) & (F.col("_cum") - F.col("_n") < F.col("rank")))
        nxt = pick.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "p", (F.col("rank") - F.col("_cum") + F.col("_n")).alias("rank"), "lo", "hi")
        nxt, nxt_path = materialize(nxt.unionByName(state.where("lo = hi").select(*nxt.columns)), "quantiles")
        remove_path(session_of(rows), path)
        state, path = nxt, nxt_path


def key_profile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    rid: str | None = None,
    quantiles: Sequence[float] = (0.5,),
    bins: int = 1 << 16,
    hot_rows: int = 10_000,
    hot_share: int = 100_000,
) -> DataFrame:
    """One row per key: entries, distinct rids, first, last and exact quantiles of `value`.

    Result columns: keys, entries, total_entries (all rows of `df`, rows without a
    key included), distinct_rids (when `rid` is given), first_value, last_value and
    q<percent> for each quantile. A key is taken as stored: case and blanks matter,
    the empty string is a key, a key with a null part is none and yields no row.
    Null values (and NaN) and null rids count as entries but not as values or rids; a key
    without any value has null first, last and quantiles. An empty table gives no rows.
    Columns of `df` beyond the named ones are ignored, so their names cannot clash.
    `value` is a whole number, a decimal of up to 18 digits, a double, a date or a
    timestamp; nothing is rounded. TypeError for others.

    A key is heavy above max(hot_rows, rows / hot_share) values, hence there are fewer than
    hot_share heavy keys however the data grow; only those are broadcast, with their extremes.
    """
    session_of(df)
    kind = df.schema[value].dataType
    names = [f"key{i}" for i in range(len(keys))]
    picked = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)], as_long(value, kind).alias("val"), *([F.col(f"`{rid}`").alias("rid")] if rid else []))
    inner = picked.groupBy(*names, *(["rid"] if rid else [])).agg(
        F.count(F.lit(1)).alias("n"), F.count("val").alias("nv"), F.min("val").alias("lo"), F.max("val").alias("hi")
    )
    aggs = [F.sum("n").alias("entries"), F.sum("nv").alias("nv"), F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    if rid:
        aggs.append(F.count("rid").alias("distinct_rids"))
    every, _ = materialize(inner.groupBy(*names).agg(*aggs), "profile")  # keys with a null part too, for the total
    total = every.agg(F.sum("entries")).first()[0] or 0
    has_key = F.lit(True)
    for n in names:
        has_key = has_key & F.col(n).isNotNull()
    out = every.where(has_key)
    labels = [f"q{p * 100:g}".replace(".", "_") for p in quantiles]
    if quantiles:
        limit = max(hot_rows, total // hot_share)
        plain = picked.where(has_key & F.col("val").isNotNull()).select(*names, "val")
        hot = out.where(F.col("nv") > limit).select(*names, F.col("nv").alias("n"), "lo", "hi")
        found = exact_hot_quantiles(plain, hot, names, "val", quantiles, bins)
        hot_vals = found.groupBy(*names).agg(*[F.max(F.when(F.col("p") == float(p), F.col("value"))).alias(f"h{i}") for i, p in enumerate(quantiles)])
        cold = plain.join(F.broadcast(hot.select(*names)), names, "left_anti")
        sorted_ = cold.groupBy(*names).agg(F.sort_array(F.collect_list("val")).alias("v"))  # at most `limit` values of a key
        cold_vals = sorted_.select(*names, *[F.expr(f"v[cast(greatest(1, ceil({p} * size(v))) as int) - 1]").alias(f"c{i}") for i, p in enumerate(quantiles)])
        out = out.join(cold_vals, names, "left").join(F.broadcast(hot_vals), names, "left")
        for i, label in enumerate(labels):
            out = out.withColumn(label, from_long(F.coalesce(F.col(f"h{i}"), F.col(f"c{i}")), kind))
    return out.select(
        *[F.col(n).alias(k) for n, k in zip(names, keys)],
        "entries",
        F.lit(total).cast("bigint").alias("total_entries"),
        *(["distinct_rids"] if rid else []),
        from_long(F.col("lo"), kind).alias("first_value"),
        from_long(F.col("hi"), kind).alias("last_value"),
        *labels,
    )


def heavy_keys(profile: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """The keys of a profile that hold more than `share` of all rows of its table."""
    return profile.where(F.col("entries") > F.col("total_entries") * share).select(*keys)


#: Bits of the key's hash a round of `heaviest_keys` adds to its bins.
_ROUND_BITS = 12


def heaviest_keys(df: DataFrame, keys: Sequence[str], share: float = 0.01) -> DataFrame:
    """(keys, entries): the keys that hold more than `share` of all rows of `df`, by refined histograms.

    The rows are counted in bins of their keys' hashes. A bin with no more than the share of
    all rows holds no heavy key and is dropped; the others, fewer than 1 / share, are cut by
    further bits of the hash in the next round, until a bin has one key, whose count is then
    exact. Only counts of bins are shuffled, 2^12 per open bin at most. Keys are taken as
    stored; a key with a null part is none, but its rows count in the total. Keys that
    cannot be told apart by 60 bits of hash are counted one by one in the last round.
    """
    if not 0 < share < 1:
        raise ValueError("share must lie between 0 and 1")
    spark = session_of(df)
    names = [f"key{i}" for i in range(len(keys))]
    picked = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)])
    one = F.struct(*names)
    has_key = F.lit(True)
    for n in names:
        has_key = has_key & F.col(n).isNotNull()
    hashed = picked.withColumn("_h", F.when(has_key, F.xxhash64(*names)))
    total, depth, done = None, 0, None
    open_: DataFrame | None = None
    while True:
        depth += _ROUND_BITS
        place = F.shiftrightunsigned("_h", 64 - depth)
        rows = hashed.withColumn("_bin", place)
        if open_ is not None:
            rows = rows.withColumn("_up", F.shiftrightunsigned("_bin", _ROUND_BITS)).join(F.broadcast(open_), "_up", "left_semi")
        last = depth + _ROUND_BITS > 64
        by = ["_bin", *(names if last else [])]
        bins = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("entries"), F.min(one).alias("least"), F.max(one).alias("most"))
        bins, _ = materialize(bins, "bins")
        if total is None:
            total = bins.agg(F.sum("entries")).first()[0] or 0
        full = bins.where(F.col("_bin").isNotNull() & (F.col("entries") > F.lit(float(total)) * F.lit(share)))
        sure = full.where("least = most")
        done = sure if done is None else done.unionByName(sure.select(*done.columns))
        open_ = full.where("least <> most").select(F.col("_bin").alias("_up"))
        if last or not open_.limit(1).count():
            return done.select(*[F.col(f"least.{n}").alias(k) for n, k in zip(names, keys)], "entries")
