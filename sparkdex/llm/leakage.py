"""Passages of evaluation items that occur, wholly or partly, in documents.

Texts become sequences of folded words. Windows of words are embedded by the CGK random
walk, which turns edits into few differing positions; sampled positions of the embedding
are hashed in several independent repetitions, so windows that differ by an edit still
meet in some of them. Documents whose windows meet an item's windows often enough are
verified by an exact alignment of the item with that part of the document.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkdex.llm.terms import fold

#: Repetitions: the fewest that keep 0.99 of the passages repeated to the least share with one word in eight edited
#: (tests/llm/test_operators.py draws such passages and compares with aligning every pair).
REPEATS = 8

_TAG = regex.compile(r"</?[a-zA-Z][^<>]{0,80}>|&[a-zA-Z]{2,6};|&#\d{1,5};")
_HYPHEN = regex.compile(r"[-­‐]\s*\n\s*")
_MOJIBAKE = regex.compile(r"[Â-Å][\u0080-¿Œ-Ÿˆ-™]")
_WORD = re.compile(r"[^\W_]+")


def _repair(m: regex.Match) -> str:
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except UnicodeError:
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except UnicodeError:
            return m.group()


def raw_words(text: str) -> list[str]:
    """Lower-case words: markup dropped, line-break hyphens joined, twice-encoded letters repaired."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    if "\n" in text:
        text = _HYPHEN.sub("", text)
    if "Ã" in text or "Â" in text:
        text = _MOJIBAKE.sub(_repair, text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)  # accents written apart would split words
    return _WORD.findall(text.lower())


def passage_words(text: str | None) -> list[str]:
    return [fold(w) for w in raw_words(text)] if text else []


class _Ids(dict):
    """Raw word -> number of its folded form among the items' words, 0 for others; remembers what it met."""

    def __init__(self, vocabulary: dict[str, int], most: int = 200_000):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, raw: str) -> int:
        if len(self) > self.most:
            self.clear()
        v = self[raw] = self.vocabulary.get(fold(raw), 0)
        return v


@dataclass
class LeakIndex:
    """CGK keys of all item windows, and the items as word numbers."""

    item_ids: list
    vocabulary: dict[str, int]
    items: list[np.ndarray]
    window: int
    steps: int
    sampled: list[np.ndarray]
    moves: list[np.ndarray]
    keys: list[np.ndarray]
    entries: list[np.ndarray]  # (item, position) per key
    prefixes: list[list[np.ndarray]]

    @classmethod
    def build(cls, ids: list, passages: list[str | None], window: int = 9, repeats: int = REPEATS, samples: int = 6, seed: int = 11) -> LeakIndex:
        words = [passage_words(p) for p in passages]
        vocabulary: dict[str, int] = {}
        for w in words:
            for x in w:
                vocabulary.setdefault(x, len(vocabulary) + 1)
        items = [np.array([vocabulary[x] for x in w], dtype=np.int32) for w in words]
        rng = np.random.default_rng(seed)
        steps = 2 * window
        self = cls(list(ids), vocabulary, items, window, steps, [], [], [], [], [])
        for _ in range(repeats):
            # one sampled position in each stretch of the embedding, so that no part of a window goes unseen
            edges = np.linspace(0, steps, samples + 1).astype(int)
            self.sampled.append(np.array([rng.integers(a, max(a + 1, b)) for a, b in zip(edges, edges[1:])]))
            self.moves.append(rng.integers(0, 2, (steps, len(vocabulary) + 1), dtype=np.uint8))
        seq, start = self._lay_out(items)
        where = [(i, p) for i, x in enumerate(items) for p in range(max(0, len(x) - window + 1))]
        at = np.array([start[i] + p for i, p in where], dtype=np.int64)
        pairs = np.array(where, dtype=np.int32).reshape(-1, 2)
        for r in range(repeats):
            partial = self._walk(seq, at, r)
            order = np.argsort(partial[-1], kind="stable")
            self.keys.append(partial[-1][order])
            self.entries.append(pairs[order])
            tables = []
            for p in partial[:-1]:
                t = np.zeros(1 << 20, dtype=bool)
                t[(p & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
                tables.append(t)
            self.prefixes.append(tables)
        return self

    def part(self, doc: np.ndarray, item: int, lo: int, hi: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """An item and the part of a document it may be repeated in, where only one of two stretches is known."""
        reach = len(self.items[item]) * 5 // 4 + slack
        return self.items[item], doc[max(0, lo - reach) : hi + reach]

    def _lay_out(self, seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """All sequences in one array, a window of zeros after each; their starts."""
        gap = np.zeros(self.window + 1, dtype=np.int32)
        start = np.cumsum([0] + [len(s) + len(gap) for s in seqs])[:-1]
        return np.concatenate([x for s in seqs for x in (s, gap)]) if seqs else gap, start

    def _walk(self, seq: np.ndarray, at: np.ndarray, r: int, tables: list[np.ndarray] | None = None):
        """Keys after each sampled step of repetition r for the windows that start at `at`.

        With tables, positions whose partial key no item has are dropped on the way, and
        (positions, full keys) come back.
        """
        off = np.zeros(len(at), dtype=np.int64)
        key = np.full(len(at), np.uint64(r + 1), dtype=np.uint64)
        sampled, moves, partial, k = set(self.sampled[r].tolist()), self.moves[r], [], 0
        with np.errstate(over="ignore"):
            for t in range(self.steps):
                if t < self.window:  # off is t at most
                    sym = seq[at + off]
                else:
                    sym = np.where(off < self.window, seq[at + np.minimum(off, self.window)], 0)
                if t in sampled:
                    key = (key ^ sym.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                    k += 1
                    if tables is None:
                        partial.append(key.copy())
                    elif k <= len(tables):
                        keep = np.nonzero(tables[k - 1][(key & np.uint64((1 << 20) - 1)).astype(np.int64)])[0]
                        at, off, key, sym = at[keep], off[keep], key[keep], sym[keep]
                    if k == len(sampled):
                        break
                off = off + moves[t].take(sym)
        return partial if tables is None else (at, key)

    def hits(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(doc, item, offset, item position), distinct and in this order, of all windows that
        meet in some repetition; offset is document position less item position."""
        seq, start = self._lay_out(docs)
        known = np.concatenate([[0], np.cumsum(seq > 0)])
        pos = np.arange(max(0, len(seq) - self.window))
        # a window with half of its words unknown to every item cannot be part of a stretch
        pos = pos[(known[pos + self.window] - known[pos]) * 2 >= self.window]
        shift = max((len(x) for x in self.items), default=0)
        bits_i, bits_p = max(1, len(self.items).bit_length()), max(1, shift.bit_length())
        bits_o = max(1, (shift + max((len(d) for d in docs), default=0)).bit_length())
        if len(docs).bit_length() + bits_i + bits_p + bits_o > 62:
            raise ValueError("batch too large to number its hits")
        out = []
        for r in range(len(self.keys)):
            at, key = self._walk(seq, pos, r, self.prefixes[r])
            lo, hi = np.searchsorted(self.keys[r], key), np.searchsorted(self.keys[r], key, side="right")
            k = np.nonzero(hi > lo)[0]
            reps = (hi - lo)[k]
            idx = np.repeat(lo[k] - np.cumsum(reps) + reps, reps) + np.arange(reps.sum())
            at = np.repeat(at[k], reps)
            doc = np.searchsorted(start, at, side="right") - 1
            item, ip = self.entries[r][idx, 0].astype(np.int64), self.entries[r][idx, 1].astype(np.int64)
            out.append((((((doc << bits_i) | item) << bits_o) | (at - start[doc] - ip + shift)) << bits_p) | ip)
        code = np.sort(np.concatenate(out)) if out else np.empty(0, dtype=np.int64)
        code = code[np.concatenate([[True], code[1:] != code[:-1]])] if len(code) else code
        pair = code >> (bits_o + bits_p)
        return pair >> bits_i, pair & ((1 << bits_i) - 1), ((code >> bits_p) & ((1 << bits_o) - 1)) - shift, code & ((1 << bits_p) - 1)


def _runs(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    new = np.zeros(len(cols[0]), dtype=bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.nonzero(new)[0]


def regions(ix: LeakIndex, docs: list[np.ndarray], doc: np.ndarray, item: np.ndarray, off: np.ndarray, ipos: np.ndarray, slack: int, share: float, drift: int = 4, gap: int = 12, least: int = 8) -> np.ndarray:
    """(doc, item, from, to) parts of documents where met windows cover `share` of an item's words.

    Windows that meet by chance lie anywhere; those of a repeated stretch keep the offset
    between document and item, up to the words its edits add or drop. Runs of windows at
    like offsets, at most `gap` words apart, are joined; a part is kept where the joined runs
    within the item's length and `slack` of each other cover enough words together.
    """
    empty = np.empty((0, 4), dtype=np.int64)
    if not len(doc):
        return empty
    w = ix.window
    size = np.array([len(x) for x in ix.items], dtype=np.int64)
    far = np.concatenate([[False], ipos[1:] - ipos[:-1] > w + gap])
    run = _runs(doc, item, off, np.cumsum(far))
    step = np.minimum(w, np.concatenate([ipos[1:] - ipos[:-1], [w]]))
    last = np.concatenate([run[1:], [len(doc)]]) - 1
    step[last] = w
    d, i, o, p0, p1, cover = doc[run], item[run], off[run], ipos[run], ipos[last] + w, np.add.reduceat(step, run)
    pair = _runs(d, i)
    enough = np.add.reduceat(cover, pair) >= share * size[i[pair]]
    k = np.nonzero(np.repeat(enough, np.diff(np.concatenate([pair, [len(d)]]))))[0]
    d, i, o, p0, p1 = d[k], i[k], o[k], p0[k], p1[k]
    if not len(d):
        return empty
    # the words that are in fact equal along each run
    n = p1 - p0
    at = np.cumsum(n) - n
    p = np.arange(n.sum()) - np.repeat(at - p0, n)
    words, first = ix._lay_out(docs)
    theirs, start = ix._lay_out(ix.items)
    x = np.repeat(first[d] + o, n) + p
    same = (words[np.clip(x, 0, len(words) - 1)] == theirs[np.repeat(start[i], n) + p]).astype(np.int64)
    cover = np.add.reduceat(same, at)
    k = np.nonzero(cover >= 4)[0]
    d, i, o, p0, p1, cover = d[k], i[k], o[k], p0[k], p1[k], cover[k]
    found = []
    for phase in (0, drift):  # offsets in overlapping bands of 2 * drift
        if not len(d):
            return empty
        band = (o + phase) // (2 * drift)
        k = np.lexsort((p0 + o, band, i, d))
        a, b, c, s0, s1, q0, q1, n = d[k], i[k], band[k], (p0 + o)[k], (p1 + o)[k], p0[k], p1[k], cover[k]
        apart = np.concatenate([[False], s0[1:] - s1[:-1] > gap])
        g = _runs(a, b, c, np.cumsum(apart))
        lo, hi = s0[g], np.maximum.reduceat(s1, g)
        span = np.minimum(hi - lo, np.maximum.reduceat(q1, g) - np.minimum.reduceat(q0, g))
        n = np.minimum(np.add.reduceat(n, g), span)
        # fewer equal words are most often a phrase of the language
        ok = np.nonzero(n >= least)[0]
        found.append((a[g[ok]], b[g[ok]], lo[ok], hi[ok], n[ok]))
    d, i, lo, hi, cover = (np.concatenate(x) for x in zip(*found))
    if not len(d):
        return empty
    k = np.lexsort((lo, i, d))
    d, i, lo, hi, cover = d[k], i[k], lo[k], hi[k], cover[k]
    # a stretch seen in both bandings counts once
    twice = np.concatenate([[False], (d[1:] == d[:-1]) & (i[1:] == i[:-1]) & (lo[1:] < hi[:-1])])
    cover = np.where(twice, np.maximum(0, cover - np.concatenate([[0], cover[:-1]])), cover)
    # words covered from each run on, within the reach of one passage
    number = np.zeros(len(d), dtype=np.int64)
    number[_runs(d, i)[1:]] = 1
    at = (np.cumsum(number) << 32) + lo
    total = np.concatenate([[0], np.cumsum(cover)])
    end = np.searchsorted(at, at + (size[i] * 5) // 4 + slack, side="right")
    ok = np.nonzero(total[end] - total[: len(d)] >= share * size[i])[0]
    if not len(ok):
        return empty
    to = np.array([hi[a:b].max() for a, b in zip(ok, end[ok])])
    r = np.column_stack([d[ok], i[ok], lo[ok], to])
    out = [r[0].tolist()]
    for x in r[1:].tolist():
        y = out[-1]
        if x[0] == y[0] and x[1] == y[1] and x[2] <= y[3]:
            y[3] = max(y[3], x[3])
        else:
            out.append(x)
    return np.array(out, dtype=np.int64)


def align(parts: list[tuple[np.ndarray, np.ndarray]], stretch: int = 10, edit: int = 2, most_gap: int = 90) -> np.ndarray:
    """Item words matched in order, per (item, document part), in at most two stretches.

    Local alignment: a match scores 1, an edit costs `edit`, so that a stretch survives
    an edit in about every third word at worst. Each stretch has at least `stretch`
    matches; the second starts after the first in both, at most `most_gap` words later in
    the document. All parts are aligned together, one item word at a time: a cell holds
    score and matches in one integer.
    """
    n = len(parts)
    if not n:
        return np.empty(0, dtype=np.int64)
    rows, width = max(len(a) for a, _ in parts), max(len(b) for _, b in parts)
    a = np.full((n, rows), -1, dtype=np.int32)
    b = np.full((n, width), -2, dtype=np.int32)
    for i, (x, y) in enumerate(parts):
        a[i, : len(x)], b[i, : len(y)] = x, y
    # a cell holds score, matches of the first and of the second stretch (10 bits each)
    kind = np.int32 if rows + edit * (width + 2) < 2000 else np.int64
    unit, first, none = 1 << 20, 1 << 10, kind(-(1 << 30) if kind is np.int32 else -(1 << 40))
    cost = edit * unit
    ramp = (np.arange(width + 1, dtype=kind) * cost)[None]
    one = np.zeros((n, width + 1), dtype=kind)
    two = np.full((n, width + 1), none, dtype=kind)
    ended = np.full((n, width + 1), none, dtype=kind)  # best first stretch that ended in a column so far
    best = np.zeros(n, dtype=np.int64)

    def step(h: np.ndarray, eq: np.ndarray, gain: int, floor: np.ndarray | int) -> np.ndarray:
        diag = np.full_like(h, none)
        diag[:, 1:] = h[:, :-1] + np.where(eq, kind(gain), kind(-cost))
        new = np.maximum(np.maximum(diag, h - cost), floor)
        return np.maximum.accumulate(new + ramp, axis=1) - ramp

    for i in range(rows):
        eq = (b == a[:, i : i + 1]) & (a[:, i : i + 1] > 0)
        two = step(two, eq, unit + 1, _window_max(ended, most_gap))
        one = np.maximum(step(one, eq, unit + first, 0), 0)
        m1, m2 = (one >> 10) & 1023, two & 1023
        whole = m1 >= stretch
        both = np.where((two > 0) & (m2 >= stretch), ((two >> 10) & 1023) + m2, 0)
        best = np.maximum(best, np.maximum(np.where(whole, m1, 0).max(1), both.max(1)))
        ended = np.maximum(ended, np.where(whole, m1 << 10, none))  # the score restarts: a second stretch pays for itself
    return best


def longest(parts: list[tuple[np.ndarray, np.ndarray]], edit: int = 2) -> np.ndarray:
    """Item words matched in the longest single stretch of each part: `align` without a second stretch, at a fraction of its cost."""
    n = len(parts)
    rows, width = max(len(a) for a, _ in parts), max(len(b) for _, b in parts)
    a = np.full((rows, n), -1, dtype=np.int32)
    b = np.full((width, n), -2, dtype=np.int32)
    for i, (x, y) in enumerate(parts):
        a[: len(x), i], b[: len(y), i] = x, y
    a[a == 0] = -1
    # a cell holds score and matches (10 bits); parts lie side by side, so that running maxima are taken on whole rows
    cost, gain = edit << 10, (1 << 10) + 1
    ramp = (np.arange(width + 1, dtype=np.int32) * cost)[:, None]
    h, best = np.zeros((width + 1, n), dtype=np.int32), np.zeros((width + 1, n), dtype=np.int32)
    for row in a:
        new = h - cost
        np.maximum(new[1:], h[:-1] + np.where(b == row, np.int32(gain), np.int32(-cost)), out=new[1:])
        np.maximum(new, 0, out=new)
        new += ramp
        np.maximum.accumulate(new, axis=0, out=new)
        new -= ramp
        h = new
        np.maximum(best, h & 1023, out=best)
    return best.max(0)


def _window_max(v: np.ndarray, reach: int) -> np.ndarray:
    """Highest value of the last `reach` + 1 columns, by doubling."""
    out, have = v, 1
    while have < reach + 1:
        by = min(have, reach + 1 - have)
        nxt = out.copy()
        np.maximum(nxt[:, by:], out[:, :-by], out=nxt[:, by:])
        out, have = nxt, have + by
    return out


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    share: float = 0.4,
    least: int = 18,
    edits: int = 8,
    window: int = 9,
    repeats: int = REPEATS,
    samples: int = 6,
    slack: int = 90,
    cover: float = 0.15,
    block_words: int = 200_000,
) -> DataFrame:
    """(doc_id, item_id, matched, item_words) for documents that repeat an item's passage.

    documents: doc_id, text; items: item_id, passage. A document repeats a passage when at
    least `share` and `least` of its words come in order, in one stretch or two that are at
    most `slack` words apart, each of ten words or more; one word in `edits` may be missing, replaced or
    added, in a stretch of ten too. Case, accents, punctuation, spacing,
    line-break hyphens and markup do not matter. Null and empty texts and passages match
    nothing. Items are taken in blocks of about `block_words` words, each one pass over the
    documents without a shuffle; documents are read whole.
    """
    stretch = math.ceil(10 * (1 - 1 / edits))  # matches of ten words, edited
    spark = documents.sparkSession
    rows = items.select("item_id", "passage").where(F.col("passage").isNotNull()).orderBy("item_id").toLocalIterator()
    blocks, cur, size = [], [], 0
    for r in rows:
        cur.append((r["item_id"], r["passage"]))
        size += len(r["passage"]) // 5
        if size >= block_words:
            blocks.append(cur)
            cur, size = [], 0
    if cur:
        blocks.append(cur)
    doc_type = documents.schema["doc_id"].dataType.simpleString()
    item_type = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {doc_type}, item_id {item_type}, matched int, item_words int"
    out = spark.createDataFrame([], schema)
    for block in blocks:
        ix = LeakIndex.build([i for i, _ in block], [p for _, p in block], window, repeats, samples)
        bc = spark.sparkContext.broadcast(ix)

        def run(batches: Iterator[pa.RecordBatch], bc=bc) -> Iterator[pa.RecordBatch]:
            ix = bc.value
            ids = _Ids(ix.vocabulary)
            for big in batches:
                for s in range(0, len(big), 500):
                    b = big.slice(s, 500)
                    docs = [np.array(list(map(ids.__getitem__, raw_words(t))), dtype=np.int32) if t else np.empty(0, np.int32) for t in b.column("text").to_pylist()]
                    reg = regions(ix, docs, *ix.hits(docs), slack, cover)
                    reg = reg[np.argsort(reg[:, 3] - reg[:, 2], kind="stable")]  # parts of like size are aligned together
                    got = []
                    size = np.array([len(x) for x in ix.items])
                    need = np.maximum(least, share * size) * (1 - 1 / edits)
                    # of two stretches one has half of the words
                    long = [longest([ix.part(docs[d], i, lo, hi, slack) for d, i, lo, hi in reg[t : t + 64]]) for t in range(0, len(reg), 64)]
                    if long:
                        reg = reg[np.concatenate(long) >= need[reg[:, 1]] / 2]
                    for t in range(0, len(reg), 64):
                        chunk = reg[t : t + 64]
                        m = align([ix.part(docs[d], i, lo, hi, slack) for d, i, lo, hi in chunk], stretch, most_gap=slack)
                        n = size[chunk[:, 1]]
                        ok = np.nonzero(m >= need[chunk[:, 1]])[0]
                        got += [(chunk[k, 0], chunk[k, 1], m[k], n[k]) for k in ok]
                    best: dict[tuple, tuple] = {}
                    for d, i, m, n in got:
                        if m > best.get((d, i), (0,))[0]:
                            best[(d, i)] = (m, n)
                    keys = list(best)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id").take(pa.array([d for d, _ in keys], pa.int64())), pa.array([ix.item_ids[i] for _, i in keys], bc_type), pa.array([best[k][0] for k in keys], pa.int32()), pa.array([best[k][1] for k in keys], pa.int32())],
                        names=["doc_id", "item_id", "matched", "item_words"],
                    )

        from pyspark.sql.pandas.types import to_arrow_type

        bc_type = to_arrow_type(items.schema["item_id"].dataType)
        out = out.unionByName(documents.select("doc_id", "text").mapInArrow(run, schema))
    return out
