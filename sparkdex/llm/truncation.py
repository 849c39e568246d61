"""Texts cut off by field limits: a backward character n-gram model of text ends.

For the final context of every value, read backward from its end at several lengths,
the model has counted over the whole collection how often texts of that column and
language end there and how often they go on. The log-odds of ending against going on, at the
longest context seen often enough, less what an end inside a word or before an open mark takes
off, and shifted by how often values that fill their limit are cut, tell whole values from cut
ones; the threshold is set per language and column where the two heaps of log-odds part.

A limit cuts equal texts at an equal place, so copies of a cut value agree that it ends there, and
the more rows there are, the more of them. Only a context met at many places of texts tells whether
texts go on after it: the longest such context bounds the log-odds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkdex.common import materialize, session_of

#: Context lengths in characters; the last stands for the whole text up to its start.
LENGTHS = (3, 5, 7, 9, 12, 15, 18, 20, 22, 24, 27, 30, 0)
#: Marks that end a sentence, also when quotes or brackets close after them.
FINAL = ".!?…»”\")"
#: Marks after which a sentence goes on.
OPEN = ",;:(«“¿¡"
_WORD = regex.compile(r"\p{L}+|\p{N}+")
#: Frequent function words that tell the languages of the tables apart.
LANGUAGE_WORDS = {
    "es": {"el", "la", "los", "las", "que", "del", "una", "con", "por", "para"},
    "en": {"the", "of", "and", "which", "with", "to", "at", "by", "for", "an"},
    "pt": {"o", "os", "do", "da", "uma", "com", "por", "ao", "na", "em"},
}
#: Private-use characters: a word that is not common, and the start of a value.
NAME, START = "\ue000", "\ue001"


def seed_language(text: str) -> str | None:
    """The language whose function words are most frequent; none where none are or two are equal."""
    seen = Counter(_WORD.findall(text.lower()))
    n = sorted(((sum(seen[w] for w in ws), lang) for lang, ws in LANGUAGE_WORDS.items()), reverse=True)
    return n[0][1] if n[0][0] > n[1][0] else None


def trigrams(text: str) -> list[str]:
    """The three-letter pieces of the words, each between blanks."""
    low = " " + " ".join(m.group() for m in _WORD.finditer(text.lower()) if not m.group()[0].isnumeric()) + " "
    return [low[i : i + 3] for i in range(len(low) - 2)]


class LanguageModel:
    """Letter trigrams of each language, counted over the values whose function words tell it."""

    def __init__(self, counts: dict[str, dict[str, int]], values: dict[str, int]):
        size = len({g for c in counts.values() for g in c}) + 1
        self.prior = {k: np.log(max(1, values.get(k, 0))) for k in counts}
        self.unseen = {k: -np.log(sum(c.values()) + size) for k, c in counts.items()}
        self.score = {k: {g: np.log(n + 1) + self.unseen[k] for g, n in c.items()} for k, c in counts.items()}

    def of(self, text: str) -> str:
        """The likeliest language; the first by name where nothing is known."""
        own = trigrams(text)
        best = [(self.prior[k] + sum(self.score[k].get(g, self.unseen[k]) for g in own), k) for k in sorted(self.score)]
        return max(best, key=lambda x: x[0])[1] if best else "und"


def masked(text: str, common: set[str], starts: set[str]) -> tuple[str, bool]:
    """Lower case, numbers as 0, words that are not common as one symbol; whether it ends in a fragment.

    The last word stays as it is where a common word starts with it: it may be cut. It is a
    fragment if it is no common word itself and not written as a name.
    """
    low = text.lower()
    fragment = False
    out, at = [], 0
    for m in _WORD.finditer(low):
        w = m.group()
        out.append(low[at : m.start()])
        if w[0].isnumeric():
            out.append("0")
        elif low[m.start() - 1 : m.start()] == "#":
            out.append(NAME)
        elif w in common:
            out.append(w)
        elif m.end() == len(low) and w in starts:
            out.append(w)
            fragment = len(text) == len(low) and (text[m.start()].islower() or text.isupper())
        else:
            out.append(NAME)
        at = m.end()
    out.append(low[at:])
    return START + "".join(out), fragment


_B = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2^64


def _mix(v: np.ndarray) -> np.ndarray:
    """A fixed 64-bit scramble of integers."""
    v = v.astype(np.uint64)
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def context_keys(texts: list[str], salts: np.ndarray, only_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """(positions x lengths) keys of the contexts that end at each position, and each row's text."""
    parts = list(keys_by_length(texts, salts, only_ends))
    return np.stack([k for k, _ in parts], axis=1), parts[0][1]


def keys_by_length(texts: list[str], salts: np.ndarray, only_ends: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each context length the keys of the contexts that end at each position, and the text of each.

    Rolling polynomial hashes of all windows at once; a window that would cross the start
    of its text has key 0. salts is one value per text (its column and language). With
    only_ends, just the last position of each text. One length is in memory at a time.
    """
    n = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    with np.errstate(over="ignore"):
        inv = pow(int(_B), -1, 1 << 64)
        k = len(codes)
        up = np.cumprod(np.full(k + 1, _B, np.uint64))
        down = np.cumprod(np.full(k + 1, np.uint64(inv), np.uint64))
        s = np.concatenate([[np.uint64(0)], np.cumsum(_mix(codes + np.uint32(1)) * down[:k], dtype=np.uint64)])
        ends = np.cumsum(n)
        first = ends - n
        if only_ends:
            of = np.nonzero(n > 0)[0]
            pos = ends[of]
        else:
            of = np.repeat(np.arange(len(texts)), n)
            pos = np.arange(k) + 1
    for j, length in enumerate(LENGTHS):
        out = np.zeros(len(pos), np.uint64)
        lo = first[of] if length == 0 else pos - length
        ok = lo >= first[of]
        p = pos[ok]
        with np.errstate(over="ignore"):
            h = (s[p] - s[lo[ok]]) * up[p]
            out[ok] = _mix(h + salts[of[ok]] + np.uint64(j + 1) * np.uint64(0xD6E8FEB86659FD93))
        yield out, of


def _salts(cols: list[str], langs: list[str]) -> np.ndarray:
    import zlib

    return np.array([zlib.crc32(f"{c}\x1f{g}".encode()) for c, g in zip(cols, langs)], np.uint64) << np.uint64(20)


def _otsu(centres: np.ndarray, n: np.ndarray, default: float) -> float:
    """The value that best parts a histogram into two heaps, or the default for thin ones and single heaps."""
    total = n.sum()
    if total < 50:
        return default
    w = np.cumsum(n)
    m = np.cumsum(n * centres)
    with np.errstate(invalid="ignore", divide="ignore"):
        between = (m[-1] * w / total - m) ** 2 / (w * (total - w))
    between[~np.isfinite(between)] = -1
    k = int(np.argmax(between))
    if between[k] < 0:  # all values alike
        return default
    same = np.nonzero(between >= between[k] * (1 - 1e-9))[0]
    return float((centres[same[0]] + centres[min(same[-1] + 1, len(centres) - 1)]) / 2)


def _count_keys(keys: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once, how often it is there, and its places modulo 64 as bits."""
    order = np.argsort(keys)
    keys, bits = keys[order], np.left_shift(np.int64(1), np.mod(place[order], 64).astype(np.int64))
    first = np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0] if len(keys) else np.zeros(0, np.int64)
    places = np.bitwise_or.reduceat(bits, first) if len(keys) else bits
    return keys[first], np.diff(np.append(first, len(keys))), places


def end_log_odds(rows: DataFrame, least: int = 4, least_places: int = 16, common_share: int = 2_000, bloom_words: int = 1 << 20) -> DataFrame:
    """(row_id, lang, columna, pool, log_odds, wide_odds, context, final, open, broken, fragment) of (row_id, columna, pool, valor).

    log_odds are those at the longest context seen more than `least` times, wide_odds those at the longest one
    met at `least_places` places of texts or more, or at the shortest. Ends in a fragment or an open mark
    count in wide_odds by places, not by rows, so that copies add nothing. pool names the columns counted together. Values that are null, empty or blank must be gone. A word is common when it is in more than one of
    `common_share` values, and in more than one, before their end, so there are at most common_share times the
    mean number of words of a value; they alone are broadcast. Contexts that end no value
    are dropped while counting by a Bloom filter of fixed size; what it lets pass is joined away.
    """
    spark = session_of(rows)
    base = rows.select("row_id", "columna", "pool", F.rtrim("valor").alias("t"))

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for t in b.column("t").to_pylist():
                low = t.lower()
                c.update({m.group() for m in _WORD.finditer(low) if m.end() < len(low)})  # what ends a value may be cut
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    def seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c: Counter = Counter()
            for t in b.column("t").to_pylist():
                lang = seed_language(t)
                if lang:
                    c[lang, ""] += 1
                    c.update((lang, g) for g in trigrams(t))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in c], pa.string()), pa.array([g for _, g in c], pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "gram", "n"])

    total = base.count()
    common = {
        r["word"] for r in base.select("t").mapInArrow(word_rows, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") * common_share > total) & (F.col("n") > 1)).collect()
    }
    starts = {w[:i] for w in common for i in range(1, len(w))}
    # trigrams in more than one of a million values of any language; what is rarer tells languages no more than the unseen
    grams = base.select("t").mapInArrow(seed_rows, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).where(F.col("n") * 1_000_000 > total)
    counts, values = {k: {} for k in LANGUAGE_WORDS}, {}
    for r in grams.collect():
        if r["gram"]:
            counts[r["lang"]][r["gram"]] = r["n"]
        else:
            values[r["lang"]] = r["n"]
    bc = spark.sparkContext.broadcast((common, starts, LanguageModel(counts, values)))

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, starts, model = bc.value
        for b in batches:
            texts = b.column("t").to_pylist()
            langs = [model.of(t) for t in texts]
            both = [masked(t, common, starts) for t in texts]
            m = [x for x, _ in both]
            yield pa.RecordBatch.from_arrays(
                [b.column("row_id"), b.column("columna"), b.column("pool"), pa.array(langs, pa.string()), pa.array(m, pa.string()), pa.array([t[-1] in FINAL for t in texts], pa.bool_()), pa.array([t[-1] in OPEN for t in texts], pa.bool_()),
                 pa.array([t[-1] == "\ufffd" for t in texts], pa.bool_()), pa.array([f for _, f in both], pa.bool_())],
                names=["row_id", "columna", "pool", "lang", "m", "final", "open", "broken", "fragment"],
            )

    prepared, _ = materialize(base.mapInArrow(mask, "row_id bigint, columna string, pool string, lang string, m string, final boolean, open boolean, broken boolean, fragment boolean"), "ends")

    def end_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            keys, of = context_keys(b.column("m").to_pylist(), _salts(b.column("pool").to_pylist(), b.column("lang").to_pylist()), True)
            r, j = np.nonzero(keys)
            at = pa.array(of[r])
            yield pa.RecordBatch.from_arrays([b.column("row_id").take(at), pa.array(j.astype(np.int32)), pa.array(keys[r, j].view(np.int64))], names=["row_id", "j", "key"])

    finals, _ = materialize(prepared.select("row_id", "pool", "lang", "m").mapInArrow(end_keys, "row_id bigint, j int, key bigint"), "keys")
    slot = F.pmod(F.shiftright("key", 6), F.lit(bloom_words))
    bits = finals.groupBy(slot.alias("slot")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(key, 64L) as int)))").alias("bits")).toPandas()  # at most bloom_words rows
    bloom = np.zeros(bloom_words, np.int64)
    bloom[bits["slot"].to_numpy(dtype=np.int64)] = bits["bits"].to_numpy(dtype=np.int64)
    bloom_bc = spark.sparkContext.broadcast(bloom)

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bloom = bloom_bc.value
        for b in batches:
            for s in range(0, len(b), 2000):
                part = b.slice(s, 2000)
                n = np.fromiter((len(t) for t in part.column("m").to_pylist()), np.int64, len(part))
                position = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                met, place = [], []
                for keys, _ in keys_by_length(part.column("m").to_pylist(), _salts(part.column("pool").to_pylist(), part.column("lang").to_pylist()), False):
                    flat = keys.view(np.int64)
                    hit = np.nonzero((flat != 0) & ((bloom[np.mod(flat >> 6, bloom_words)] >> np.mod(flat, 64)) & 1 == 1))[0]
                    met.append(flat[hit])
                    place.append(position[hit])
                k, n, places = _count_keys(np.concatenate(met), np.concatenate(place))
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64)), pa.array(places)], names=["key", "seen", "places"])

    seen = prepared.select("pool", "lang", "m").mapInArrow(all_keys, "key bigint, seen bigint, places bigint").groupBy("key")
    seen = seen.agg(F.sum("seen").alias("seen"), F.bit_count(F.bit_or("places")).alias("places"))
    ends = finals.groupBy("key").agg(F.count(F.lit(1)).alias("ends"))
    stats, _ = materialize(ends.join(seen, "key"), "stats")
    limit = max(100, total // 1000)
    heavy = F.broadcast(stats.where(F.col("ends") > limit))  # fewer than 1000 per context length
    marked = finals.join(heavy, "key", "left")
    light = marked.where(F.col("ends").isNull()).select("row_id", "j", "key").join(stats.where(F.col("ends") <= limit), "key")
    columns = ["row_id", "j", "ends", "seen", "places"]
    known = marked.where(F.col("ends").isNotNull()).select(columns).unionByName(light.select(columns))
    # the longest context seen often enough, one's own end not counted
    often = F.col("seen") > least
    enough = F.struct(often.alias("often"), F.when(often, F.col("j")).otherwise(-F.col("j")).alias("j"), "ends", "seen")
    many = F.col("places") >= least_places
    wide = F.struct(many.alias("many"), F.when(many, F.col("j")).otherwise(-F.col("j")).alias("j"), "ends", "seen", "places")
    best = known.select("row_id", enough.alias("c"), wide.alias("w")).groupBy("row_id").agg(F.max("c").alias("c"), F.max("w").alias("w"))

    def odds(c: str) -> Column:
        return F.log((F.col(f"{c}.ends") - 0.9) / (F.col(f"{c}.seen") - F.col(f"{c}.ends") + 0.5))

    each = F.col("w.places") / F.col("w.seen")  # of one row, where each place counts once; no more places than rows
    by_place = F.log(F.greatest(F.col("w.ends") * each - 0.9, F.lit(0.1)) / ((F.col("w.seen") - F.col("w.ends")) * each + 0.5))
    wide_odds = F.when(F.col("fragment") | F.col("open"), by_place).otherwise(odds("w"))
    out = prepared.drop("m").join(best, "row_id", "left").withColumns({"log_odds": odds("c"), "wide_odds": wide_odds, "context": F.abs(F.col("c.j"))})
    return out.drop("c", "w")


#: Log-odds taken off the end of a value that breaks off in a piece of a common word, or after a mark that opens something.
BROKEN_OFF = 4.0
#: Log-odds by which texts that end alike may go beyond what a context met at many places says, after a whole word where no final mark is usual.
SAME_PLACE = 4.0
#: Bytes a value may fall short of its limit and still have been cut by it: a character's other bytes, or a blank.
NEAR_LIMIT = 3
#: The most that a share of cut values may shift log-odds.
PRIOR_SHIFT = 0.5


def find_truncated(rows: DataFrame, default_threshold: float = -1.5, bounds: tuple[float, float] = (-1.2, -0.3)) -> DataFrame:
    """(row_id, source, lang, columna, log_odds, context, threshold, room, cut) of every usable value.

    `rows` has row_id, source, tabla, columna, max_bytes, valor. Null, empty and blank
    values are no values: they give no row. A column's limit missing in a row is taken
    from its other rows; a column without any has none. room is the bytes left to the limit,
    blanks at the end not counted.

    A value is cut where it ends in a broken character, or where its log-odds of ending are
    below the threshold of its language and column. They are no more than those of the longest context met
    at many places of texts, plus SAME_PLACE for whole words in columns without final marks. A piece of a common word at the end that is no
    word itself, and a comma or another mark that opens something, take BROKEN_OFF off them. The
    verdicts so far give the share of cut values of each column, for values that fill their limit
    and for others; log-odds are shifted by how these shares differ from the column's. Columns whose values mostly end in a final mark
    share their counts; in them a value that ends in one ends with its sentence and so, cut or
    not, is no case. A value that ends in a word the model cannot know (a rare name) is told
    by the context before that word: where texts may end in a name, a cut inside the name
    itself is not seen.
    """
    spark = session_of(rows)
    limits = rows.groupBy("tabla", "columna").agg(F.max("max_bytes").alias("limit"))
    usable = rows.where(F.col("valor").isNotNull() & (F.length(F.trim("valor")) > 0))
    key = F.concat_ws(".", F.coalesce("tabla", F.lit("")), F.coalesce("columna", F.lit("")))
    ending = F.substring(F.rtrim("valor"), -1, 1).isin(list(FINAL)).cast("int")
    columns = usable.groupBy(key.alias("columna")).agg((F.avg(ending) > 0.5).alias("marked"))
    limits = limits.groupBy(key.alias("columna")).agg(F.max("limit").alias("limit"))
    columns = columns.join(limits, "columna", "left").withColumn("pool", F.when(F.col("marked"), "*").otherwise(F.col("columna")))
    columns, _ = materialize(columns, "columns")
    named = usable.select("row_id", "source", key.alias("columna"), "valor").join(F.broadcast(columns), "columna")  # one row per column of the schema
    room = F.col("limit") - F.octet_length(F.rtrim("valor"))
    named = named.select("row_id", "source", "columna", "pool", "valor", room.alias("room"))
    odds, _ = materialize(end_log_odds(named), "odds")
    odds = odds.join(F.broadcast(columns.select("columna", "marked")), "columna").join(named.select("row_id", "source", "room"), "row_id")
    beyond = F.when(F.col("marked") | F.col("fragment") | F.col("open"), 0.0).otherwise(SAME_PLACE)
    odds = odds.withColumn("log_odds", F.least("log_odds", F.col("wide_odds") + beyond))
    # one row per language, column and tenth of log-odds; values that end in a final mark need no model in marked columns
    asked = ~(F.col("marked") & F.col("final"))
    heaps = odds.where(asked & F.col("log_odds").isNotNull()).groupBy("lang", "columna", F.floor(F.col("log_odds") * 10).alias("h")).agg(F.count(F.lit(1)).alias("n")).toPandas()
    table = []
    for (lang, column), g in heaps.groupby(["lang", "columna"]):
        grid = np.arange(-120, 101)
        n = np.zeros(len(grid))
        np.add.at(n, np.clip(g["h"].to_numpy(int), -120, 100) + 120, g["n"].to_numpy(float))
        table.append((lang, column, float(np.clip(_otsu((grid + 0.5) / 10, n, default_threshold), *bounds))))
    thresholds = F.broadcast(spark.createDataFrame(table, "lang string, columna string, threshold double"))  # one row per language and column
    off = F.when(F.col("fragment") | F.col("open"), BROKEN_OFF).otherwise(0.0)
    judged = odds.join(thresholds, ["lang", "columna"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(default_threshold)))
    judged = judged.withColumns({"log_odds": F.coalesce("log_odds", F.lit(0.0)) - off, "at_limit": F.coalesce(F.col("room") <= NEAR_LIMIT, F.lit(False))})
    low = (F.col("log_odds") < F.col("threshold")) & asked
    shares = judged.where(asked).groupBy("columna", "at_limit").agg(F.sum(low.cast("int")).alias("c"), F.count(F.lit(1)).alias("n")).toPandas()  # two rows per column
    shift = []
    for column, g in shares.groupby("columna"):
        whole = (g["c"].sum() + 1) / (g["n"].sum() + 2)
        for r in g.itertuples():
            own = (r.c + 1) / (r.n + 2)
            shift.append((column, bool(r.at_limit), float(np.clip(np.log(whole / (1 - whole)) - np.log(own / (1 - own)), -PRIOR_SHIFT, PRIOR_SHIFT))))
    shift = F.broadcast(spark.createDataFrame(shift, "columna string, at_limit boolean, shift double"))
    out = judged.join(shift, ["columna", "at_limit"], "left").withColumn("log_odds", F.col("log_odds") + F.coalesce("shift", F.lit(0.0)))
    cut = F.col("broken") | ((F.col("log_odds") < F.col("threshold")) & asked)
    return out.select("row_id", "source", "lang", "columna", "log_odds", "context", "threshold", "room", cut.alias("cut"))


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, n_values, n_cut, share) per source."""
    return found.groupBy("source").agg(F.count(F.lit(1)).alias("n_values"), F.sum(F.col("cut").cast("bigint")).alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_values"), 6))
