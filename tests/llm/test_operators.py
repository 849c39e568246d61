import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkdex.llm import leakage, pii, truncation
from sparkdex.llm.clusters import describe_clusters, pivot_clusters, usable_vector
from sparkdex.llm.distinctive import distinctive_terms
from sparkdex.llm.ngrams import count_ngrams, mark_terms, text_suffixes
from sparkdex.llm.packing import DEFAULT_VOCABULARY, encoder, pack, pack_texts, plan_bins, token_counts
from sparkdex.llm.similar import FourBitCodes, similar_objects, unit
from sparkdex.llm.terms import term_records, words

# --- 1 ----------------------------------------------------------------------------------


def _objects(rng, groups=12, strays=40, dim=32):
    out, i = [], 1
    for _ in range(groups):
        base = rng.poisson(2, dim) * rng.integers(0, 2, dim) * 10
        for _ in range(rng.integers(1, 9)):
            out.append(("image", i, [int(x) for x in np.maximum(0, base + rng.integers(-1, 2, dim) * (rng.random() < 0.6))]))
            i += 1
    for _ in range(strays):
        out.append(("image", i, [int(x) for x in rng.poisson(0.6, dim) * 9]))
        i += 1
    return out


def _nearest(objects, k, least):
    want = set()
    ok = [(i, np.array([x or 0 for x in v], float)) for _, i, v in objects if v and any(x for x in v)]
    for i, v in ok:
        c = sorted((-round(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), 9), j) for j, u in ok if j != i)
        want |= {(i, j, r + 1) for r, (s, j) in enumerate(c[:k]) if -s >= least}
    return want


def test_similar_objects_match_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = _objects(rng)
    copies = [("image", 5000 + i, rows[0][2]) for i in range(70)] + [("image", 7000, rows[3][2])]
    rows += copies + [("image", 9000, None), ("image", 9001, [0] * 32), ("audio", 9002, [1, 2, 3])]
    d = spark.createDataFrame(rows, "scope string, id bigint, vec array<int>").withColumn("rank", F.lit("clash"))
    got = {(r.obj_id, r.other_id, r.rank) for r in similar_objects(d, k=5, min_cosine=0.93).collect()}
    assert got == _nearest([r for r in rows if r[0] == "image"], 5, 0.93)
    got = {(r.obj_id, r.other_id) for r in similar_objects(d, k=3, min_cosine=None, nprobe=64, only_queries="id % 10 = 0").collect()}
    want = {(a, b) for a, b, _ in _nearest([r for r in rows if r[0] == "image"], 3, -1) if a % 10 == 0}
    assert len(got & want) >= 0.9 * len(want) and {a for a, _ in got} == {a for a, _ in want}
    assert similar_objects(d.limit(0)).count() == 0


def test_similar_vectors_of_every_kind_and_length(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(40, 24))
    rows = [("f", i, (base[i % 40] * (1 + i // 40) + rng.normal(scale=0.05, size=24)).tolist()) for i in range(240)]
    rows += [("f", 1000 + i, rng.normal(size=7).tolist()) for i in range(160)] + [("f", 2000, [0.5, float("nan")]), ("f", 2001, [float("inf"), 1.0]), ("f", 2002, []), ("f", 2003, [None, None])]
    rows += [("f", 3000, [0.25, 0.5]), ("f", 3001, [0.5, 1.0]), ("f", 3002, [None, 1.0]), ("f", 3003, [-0.0, 1.0])]
    d = spark.createDataFrame(rows, "scope string, id bigint, vec array<double>")
    good = {}
    for _, i, v in rows:
        x = [0.0 if u is None else u for u in v]
        if any(x) and all(math.isfinite(u) for u in x):
            good.setdefault(len(x), {})[i] = np.array(x)
    want = set()
    for part in good.values():
        for i, v in part.items():
            c = sorted((-round(float(v @ u / np.linalg.norm(v) / np.linalg.norm(u)), 9), j) for j, u in part.items() if j != i)
            want |= {(i, j, -s) for s, j in c[:3] if -s >= 0.9}
    for small in (0, 10_000):
        got = {(r.obj_id, r.other_id, r.cosine) for r in similar_objects(d, k=3, min_cosine=0.9, small=small, nprobe=64).collect()}
        assert {g[:2] for g in got} == {w[:2] for w in want} and all(abs(a[2] - b[2]) < 2e-9 for a, b in zip(sorted(got), sorted(want)))
    # where a null stands tells vectors apart, and a copy of a query's vector may carry the query
    n = spark.createDataFrame([("s", 1, [1, None, 2]), ("s", 2, [1, 2, None]), ("s", 50, [9, 9, 1]), ("s", 100, [9, 9, 1]), ("s", 51, [9, 9, 2])], "scope string, id bigint, vec array<int>")
    assert {(r.obj_id, r.other_id, r.cosine) for r in similar_objects(n, k=1, min_cosine=-1.0).collect()} >= {(100, 50, 1.0)}
    assert round({(r.obj_id, r.other_id): r.cosine for r in similar_objects(n, k=4, min_cosine=-1.0).collect()}[1, 2], 6) == 0.2
    assert [(r.obj_id, r.other_id) for r in similar_objects(n, k=2, min_cosine=None, only_queries="id % 100 = 0").orderBy("rank").collect()] == [(100, 50), (100, 51)]


def test_wide_vectors_are_packed_without_loss():
    from sparkdex.llm.vectors import cell_type, pack_sparse, unpack_sparse

    m = np.zeros((2, 70_000))
    m[0, 66_000], m[1, 3], m[1, 69_999] = 5, -(2**40), 7
    t = cell_type(70_000, False, 7, -(2**40))
    assert (unpack_sparse(pack_sparse(m, t).to_pylist(), 70_000, t) == m).all()
    assert cell_type(128, False, 200, 0).itemsize == 2 and cell_type(300, True, 1, 0).itemsize == 10


def test_score_aware_codes_lower_the_parallel_error():
    rng = np.random.default_rng(1)
    x = unit(np.abs(rng.normal(size=(1500, 32))) * (rng.random((1500, 32)) < 0.4) + 1e-3)
    aware, plain = FourBitCodes.train(x, t=0.5), FourBitCodes.train(x, t=0.0)

    def parallel(c):
        rec = c.centres[np.arange(8), c._codes(x)].reshape(len(x), -1)
        return float((((x - rec) * x).sum(1) ** 2).mean())

    assert parallel(aware) < parallel(plain)
    exact = x[:50] @ x.T
    scan = aware.scan(x[:50], aware.encode(x))
    rec = aware.centres[np.arange(8), aware._codes(x)].reshape(len(x), -1)
    assert np.allclose(scan, x[:50] @ rec.T, atol=1e-4)
    usual = FourBitCodes.train(x)
    approx = usual.scan(x[:50], usual.encode(x))
    np.fill_diagonal(exact, -1)
    np.fill_diagonal(approx, -1)
    best = np.argsort(-approx, axis=1)[:, :50]
    assert np.mean([exact[i].argmax() in best[i] for i in range(50)]) >= 0.9  # what reranking gets to see


# --- 3 ----------------------------------------------------------------------------------


def _components(pts, radius):
    ids = list(pts)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(ids, 2):
        if np.linalg.norm(pts[a] - pts[b]) <= radius:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("batch", [4096, 7])
def test_pivot_groups_match_components(spark, batch):
    rng = np.random.default_rng(2)
    pts, i = {}, 1
    for c in range(6):
        centre = rng.uniform(-40, 40, 3)
        for _ in range(int(rng.integers(1, 25))):
            pts[i] = (centre + rng.normal(0, 1.2, 3)).astype(np.float32)
            i += 1
    for k in range(25):  # a chain whose ends are far apart
        pts[i] = np.array([60 + k * 1.9, 0, 0], np.float32)
        i += 1
    for k in range(30):
        pts[500 + k] = pts[1]
    rows = [(a, [float(x) for x in v]) for a, v in pts.items()] + [(900, None), (901, [1.0]), (902, [1.0, 2.0, float("nan")]), (None, [1.0, 2.0, 3.0])]
    d = spark.createDataFrame(rows, "id bigint, vec array<float>").where(usable_vector(F.col("vec"), F.lit(3)))
    got, _ = pivot_clusters(d, 2.0, 3, batch=batch)
    got = got.collect()
    assert {r["id"]: r["group"] for r in got} == _components(pts, 2.0) and len(got) == len(pts)
    assert all(np.linalg.norm(pts[r["id"]] - pts[r["cluster"]]) <= 2.0 for r in got)
    report = describe_clusters(spark.createDataFrame([(r["id"], r["cluster"]) for r in got], "id bigint, cluster bigint"), d, least=2)
    sizes = Counter(r["cluster"] for r in got)
    assert {r["cluster"]: r["size"] for r in report.collect()} == {c: n for c, n in sizes.items() if n > 1}


def test_no_vectors(spark):
    got, _ = pivot_clusters(spark.createDataFrame([], "id bigint, vec array<float>"), 1.0, 3)
    assert got.count() == 0


def test_linked_clusters_without_a_shared_pivot(spark):
    # two dense bars whose nearest ends are within the radius although no pivot of one reaches the other
    pts = {i: np.array([i * 0.1, 0.0], np.float32) for i in range(20)} | {100 + i: np.array([3.4 + i * 0.1, 0.3], np.float32) for i in range(20)}
    d = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in pts.items()], "id bigint, vec array<float>")
    got, _ = pivot_clusters(d, 2.0, 2)
    assert {r["id"]: r["group"] for r in got.collect()} == _components(pts, 2.0)


# --- 4 and 5 -------------------------------------------------------------------------------

TEXTS = {1: "El gato, el perro. EL GATÓ", 2: "gato perro gato perro gato", 3: "", 4: None, 5: "año ﬁn 12 x9", 6: "gato"}


def test_ngrams_match_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice("a b c d e".split()) for _ in range(rng.randrange(0, 12)))) for i in range(60)] + list(TEXTS.items())
    d = spark.createDataFrame(docs, "record_id bigint, text string")
    cf, df = Counter(), Counter()
    for _, t in docs:
        w = words(t)
        grams = [tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        cf.update(grams)
        df.update(set(grams))
    got = {tuple(r.gram): (r.cf, r.df) for r in count_ngrams(text_suffixes(d, 3).withColumn("scope", F.lit("t")), spread=3).collect()}
    assert got == {g: (cf[g], df[g]) for g in cf}
    assert count_ngrams(text_suffixes(d.limit(0), 3).withColumn("scope", F.lit("t"))).count() == 0


def _collections(spark):
    corpus = spark.createDataFrame([(i, t, None) for i, t in TEXTS.items()], "rid bigint, title string, body string").withColumn("scope", F.lit("clash"))
    hist = spark.createDataFrame([(1, "image", [3, 0, None, 1]), (2, "image", [0, 0, 0, 0]), (3, "image", None), (4, "image", [1, 0, 0, 9])], "obj_id bigint, modality string, hist_tf array<int>")
    return term_records(corpus, hist)


def test_terms_and_marks(spark):
    r = _collections(spark)
    n = {x.scope: x["count"] for x in r.groupBy("scope").count().collect()}
    assert n == {"text": 6, "image": 2}
    s = r.select("scope", "record_id", F.explode("terms").alias("t")).select("scope", F.col("t.term").alias("suffix"), "record_id", F.col("t.tf").alias("tf"))
    m = mark_terms(count_ngrams(s).withColumn("term", F.col("gram")[0]), r.groupBy("scope").agg(F.count(F.lit(1)).alias("n_records")))
    got = {(x.scope, x.term): (x.cf, x["df"], x.mark) for x in m.collect()}
    assert got["text", "gato"] == (6, 3, "common") and got["text", "el"] == (3, 1, "rare") and got["text", "fin"] == (1, 1, "rare")
    assert got["image", "0"] == (4, 2, "rare") and ("image", "2") not in got


def test_scores_and_language_model(spark):
    r = _collections(spark)
    every = {(x.scope, x.record_id, x.term): x for x in distinctive_terms(r, hot_share=2).collect()}
    assert every == {(x.scope, x.record_id, x.term): x for x in distinctive_terms(r, hot_share=10**6).collect()}
    x = every["text", 1, "gato"]
    assert x.score == round((1 + math.log10(2)) * math.log10(6 / 3), 6) and every["image", 4, "3"].score == round(9 * (math.log(3 / 3) + 1), 6)
    for scope, rec in {(s, i) for s, i, _ in every}:
        p = sum(v.probability for (s, i, _), v in every.items() if (s, i) == (scope, rec))
        assert abs(p - 1) < 1e-9
    assert every["text", 1, "el"].probability > every["text", 1, "perro"].probability
    top = {(x.scope, x.record_id, x.term) for x in distinctive_terms(r, top=1).collect()}
    assert ("text", 1, "el") in top and ("image", 4, "3") in top and len(top) == 6
    assert ("text", 5, "ano") in top  # a tie goes to the smaller term


# --- 6 ----------------------------------------------------------------------------------


def test_context_keys_equal_only_for_equal_contexts():
    texts = ["abcabc", "xbcabc", "", "abc"]
    keys, of = truncation.context_keys(texts, np.array([7, 7, 7, 8], np.uint64), False)
    at = {(int(i), p): k for p, (i, k) in enumerate(zip(of, keys))}
    by = [k for (i, _), k in at.items() if i == 0]
    other = [k for (i, _), k in at.items() if i == 1]
    assert by[2][0] == by[5][0] == other[5][0]  # "abc" wherever it ends
    assert by[5][1] == other[5][1] and by[5][-1] != other[5][-1]  # same last five characters, another whole text
    ends, _ = truncation.context_keys(texts, np.array([7, 7, 7, 8], np.uint64), True)
    assert (ends[0] == by[5]).all() and ends[2][0] != by[2][0]  # another column, another key


def test_fragments_of_common_words():
    common, starts = {"semana", "la", "en"}, {"s", "se", "sem", "sema", "seman", "l", "e"}
    assert truncation.masked("En la sema", common, starts)[1] and not truncation.masked("En la semana", common, starts)[1]
    assert not truncation.masked("En la Sema", common, starts)[1] and truncation.masked("EN LA SEMA", common, starts)[1]
    assert not truncation.masked("En la sema.", common, starts)[1]


def test_cut_values_are_told_from_whole_ones(spark):
    rng = random.Random(6)
    subjects, verbs, objects = ["El gato gris", "La vecina nueva", "Un perro grande", "La biblioteca"], ["mira", "recuerda", "busca", "describe"], ["la ventana abierta", "el camino viejo", "una carta breve", "los libros usados"]
    rows, cut = [], set()
    for i in range(1200):
        s = " ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(objects)}." for _ in range(rng.randrange(1, 4)))
        if rng.random() < 0.15:
            n = rng.randrange(8, len(s) - 2)
            while s[n - 1] == "." or s[n] == "." or s[n] == " " and s[n - 1] == ".":
                n -= 1
            s = s[:n]
            cut.add(i)
        rows.append((i, rng.choice("ab"), "t", "c", 200, s))
    rows += [(5000, "a", "t", "c", None, None), (5001, "a", "t", "c", 200, ""), (5002, "a", "t", "c", 200, "   "), (5003, "a", "t", "c", 10, "La vecin�")]
    d = spark.createDataFrame(rows, "row_id bigint, source string, tabla string, columna string, max_bytes int, valor string")
    found = truncation.find_truncated(d)
    got = {r.row_id for r in found.where("cut").collect()}
    assert found.count() == 1201 and 5003 in got
    assert len(got & cut) >= 0.95 * len(cut) and len(got - cut - {5003}) <= 0.02 * len(rows)
    rates = {r.source: (r.n_values, r.n_cut) for r in truncation.truncation_rates(found).collect()}
    assert sum(n for n, _ in rates.values()) == 1201 and sum(c for _, c in rates.values()) == len(got)
    assert truncation.find_truncated(d.limit(0)).count() == 0


def test_one_heap_has_the_default_threshold():
    assert truncation._otsu(np.arange(3.0), np.array([0.0, 60.0, 0.0]), -1.5) == -1.5


def test_count_keys_gathers_places():
    k, n, places = truncation._count_keys(np.array([5, 3, 5, 5]), np.array([1, 0, 65, 63]))
    assert k.tolist() == [3, 5] and n.tolist() == [1, 3] and places.tolist() == [1, np.int64(2) | np.int64(-(2**63))]
    assert [len(x) for x in truncation._count_keys(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0, 0]


def test_copies_of_cut_values_stay_cut(spark):
    rng = random.Random(66)
    subjects, verbs, objects = ["El gato gris", "La vecina nueva", "Un perro grande", "La biblioteca"], ["mira", "recuerda", "busca", "describe"], ["la ventana abierta", "el camino viejo", "una carta breve", "los libros usados"]
    heads = [f"El {noun} {kind}" for noun in ("taller", "festival", "torneo", "concierto", "recorrido", "encuentro") for kind in ("nuevo", "abierto", "juvenil", "nocturno", "de barrio", "de primavera", "del centro viejo")]
    tails = ["durante el invierno", "hasta la medianoche", "sin cobrar entrada", "bajo una llovizna fina", "para lectores atentos"]
    rows, cut, between = [], set(), set()  # cuts inside words, and between them, where a title may end
    for i in range(2000):
        if i % 2:
            s, limit, column = f"{rng.choice(heads)} {rng.choice(tails)}", 40, "titulo"
            if len(s) > limit:
                (cut if s[limit - 1 : limit + 1].isalpha() else between).add(i)
                s = s[:limit]
        else:
            s, limit, column = " ".join(f"{rng.choice(subjects)} {rng.choice(verbs)} {rng.choice(objects)} {rng.choice(tails)}." for _ in range(rng.randrange(1, 4))), 300, "nota"
            if rng.random() < 0.15:
                n = rng.randrange(8, len(s) - 2)
                while s[n - 1] == "." or s[n] == "." or s[n] == " " and s[n - 1] == ".":
                    n -= 1
                s = s[:n]
                cut.add(i)
        rows.append((i, "a", "t", column, limit, s))
    one = spark.createDataFrame(rows, "row_id bigint, source string, tabla string, columna string, max_bytes int, valor string")
    copies = one.crossJoin(spark.range(20).withColumnRenamed("id", "copy")).withColumn("row_id", F.col("row_id") + F.col("copy") * 10_000).drop("copy")
    for d in (one, copies):
        got = {r.row_id % 10_000 for r in truncation.find_truncated(d).where("cut").collect()}
        assert len(got & cut) >= 0.95 * len(cut) and len(got - cut - between) <= 0.02 * len(rows)


# --- 8 ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_bins(seed):
    rng = random.Random(seed)
    capacity = rng.choice([5, 30, 200])
    counts = Counter(rng.randint(1, capacity) if rng.random() < 0.5 else rng.randint(1, max(1, capacity // 4)) for _ in range(rng.choice([1, 10, 600])))
    runs, bins = plan_bins(dict(counts), capacity)
    load, used = Counter(), Counter()
    for s, first, n, b, per in runs:
        assert used[s] == first
        used[s] += n
        for r in range(n):
            load[b + r // per] += s
    assert used == counts and set(load) == set(range(bins)) and max(load.values()) <= capacity
    room = sum(s * n for s, n in counts.items())
    assert bins <= max(2, 1.35 * math.ceil(room / capacity) + 1)


def test_pack_places_everything_once(spark):
    rng = random.Random(9)
    sizes = {i: rng.choice([0, 1, 7, 7, 7, 33, 99, 100, 101, 250, rng.randint(1, 60)]) for i in range(400)}
    d = spark.createDataFrame(list(sizes.items()), "id bigint, n_tokens int").withColumn("bin", F.lit(1))
    got = pack(d, [(1, 100), (2, 30)], spread=3).collect()
    for c, cap in ((1, 100), (2, 30)):
        mine = [r for r in got if r.container_id == c]
        load = Counter()
        for r in mine:
            assert (r.bin is None) == (r.n_tokens == 0)
            load[r.bin] += r.n_tokens
        assert max(n for b, n in load.items() if b is not None) <= cap
        by = {}
        for r in mine:
            by.setdefault(r.id, []).append((r.piece, r.token_start, r.n_tokens))
        assert set(by) == set(sizes)
        for i, p in by.items():
            p.sort()
            assert [x[0] for x in p] == list(range(len(p))) and sum(x[2] for x in p) == sizes[i]
            assert all(a[1] + a[2] == b[1] for a, b in zip(p, p[1:])) and (len(p) == 1 or sizes[i] > cap)
    with pytest.raises(ValueError):
        pack(d, [(1, 0)])
    assert pack(d.limit(0), [(1, 10)]).count() == 0


def test_token_counts_and_pieces_round_trip(spark):
    enc = encoder(DEFAULT_VOCABULARY)
    texts = [(1, "El gato duerme. " * 40), (2, ""), (3, None), (4, "<|endoftext|> ñandú 😀"), (5, "x")]
    d = spark.createDataFrame(texts, "doc_id bigint, text string")
    n = {r.id: r.n_tokens for r in token_counts(d, "doc_id", "text").collect()}
    assert n == {i: len(enc.encode_ordinary(t or "")) for i, t in texts}
    pieces = sorted((r.piece, r.token_start, r.n_tokens) for r in pack_texts(d, "doc_id", "text", [(1, 16)]).collect() if r.id == 1)
    ids = enc.encode_ordinary(texts[0][1])
    assert enc.decode([t for _, s, k in pieces for t in ids[s : s + k]]) == texts[0][1]


# --- 9 ----------------------------------------------------------------------------------


def _prose(rng, n):
    return [rng.choice("casa perro libro mesa puerta calle verde rojo azul viejo nuevo corre mira toma deja de la el en con sin tras hasta zona punto linea arbol raiz hoja".split()) + str(rng.randrange(40)) for _ in range(n)]


def test_leaks_are_found(spark):
    rng = random.Random(12)
    items = {i: _prose(rng, 60) for i in range(15)}
    docs, want = {}, set()
    for d in range(60):
        w = _prose(rng, 200)
        if d % 3 == 0:
            i = rng.choice(list(items))
            part = list(items[i][rng.randrange(0, 20) :][:34])
            for k in range(7, len(part), 9):
                part[k : k + 1] = [[], ["otro"], [part[k], "mas"]][rng.randrange(3)]
            w[50:50] = part
            want.add((d, i))
        elif d % 3 == 1:
            i = rng.choice(list(items))
            a = rng.randrange(0, 20)
            w[30:30] = items[i][a : a + 14] + ["y"] * 20 + items[i][a + 18 : a + 33]
            want.add((d, i))
        else:
            w[10:10] = items[rng.choice(list(items))][5:17]  # a short quotation
        docs[d] = " ".join(w)
    docs[0] = docs[0].upper().replace(" ", "  ").replace("LIBRO", "LI-\nBRO")
    docs[3] = "<p>" + docs[3].replace(" ", ", ") + "</p>"
    rows = list(docs.items()) + [(900, None), (901, "")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("item_id", F.lit("clash"))
    i = spark.createDataFrame([(k, " ".join(v)) for k, v in items.items()] + [(99, None), (98, "corto")], "item_id bigint, passage string")
    got = {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i).collect()}
    assert got == want
    assert {(r.doc_id, r.item_id) for r in leakage.find_leaks(d, i, block_words=100).collect()} == want
    assert leakage.find_leaks(d.limit(0), i).count() == 0 and leakage.find_leaks(d, i.limit(0)).count() == 0


def _edited(rng, x, extra):
    """About one word in eight missing, replaced or added."""
    out = []
    for w in x:
        out += [[], [extra], [w, extra]][rng.randrange(3)] if rng.random() < 1 / 8 else [w]
    return out


def _least_repeats(seed, n):
    """Items, and documents that repeat one to the least share, edited, half of them in two stretches."""
    rng = random.Random(seed)
    items, docs = [], []
    for i in range(n):
        x = [f"v{rng.randrange(40_000)}" if rng.random() < 0.75 else rng.choice(["de", "la", "el", "en", "que", "y"]) for _ in range(rng.randrange(45, 128))]
        k = max(20, math.ceil(0.4 * len(x)))
        s, other = rng.randrange(len(x) - k + 1), lambda m: [f"u{rng.randrange(9000)}" for _ in range(m)]
        if i % 2:
            a, g = rng.randrange(10, k - 9), rng.randrange(len(x) - k - s + 1)
            part = _edited(rng, x[s : s + a], "zz") + other(rng.randrange(5, 80)) + _edited(rng, x[s + a + g : s + k + g], "zz")
        else:
            part = _edited(rng, x[s : s + k], "zz")
        items.append(x)
        docs.append(other(100) + part + other(100))
    return items, docs


def test_leaks_against_aligning_every_pair(spark):
    items, docs = _least_repeats(5, 400)
    number: dict[str, int] = {}
    ids = [[np.array([number.setdefault(w, len(number) + 1) for w in x], np.int32) for x in y] for y in (items, docs)]
    got = {(r.doc_id, r.item_id, r.matched) for r in leakage.find_leaks(
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id bigint, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, passage string")).collect()}
    need = [max(18, 0.4 * len(x)) * 7 / 8 for x in items]
    # pairs whose words in common, in whatever order, are too few need no alignment
    bags = [Counter(x) for x in items]
    sets = [set(b) for b in docs]
    pairs = [(d, i) for d, b in enumerate(sets) for i, a in enumerate(bags) if sum(c for w, c in a.items() if w in b) >= need[i]]
    full = [leakage.align([(ids[0][i], ids[1][d]) for d, i in pairs[k : k + 64]], stretch=9) for k in range(0, len(pairs), 64)]
    want = {(d, i, int(m)) for (d, i), m in zip(pairs, np.concatenate(full)) if m >= need[i]}
    assert len(want) > 200 and len(got & want) >= 0.99 * len(want) and got <= want


def test_a_stretch_of_ten_words_may_hold_an_edit(spark):
    item = [f"v{k}" for k in range(70)]
    other = [f"u{k}" for k in range(60)]
    short = item[40:45] + ["zz"] + item[46:50]
    docs = [other + item[:20] + other[:15] + short + other, other + item[:20] + other[:15] + short[:8] + other]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id bigint, text string")
    i = spark.createDataFrame([(7, " ".join(item))], "item_id bigint, passage string")
    assert [(r.doc_id, r.matched) for r in leakage.find_leaks(d, i).collect()] == [(0, 29)]


def test_alignment_counts_words_in_order():
    a = np.arange(1, 41)
    b = np.concatenate([np.full(20, 99), a[:15], np.full(30, 98), a[20:34], np.full(10, 97)])
    far = np.concatenate([a[:15], np.full(300, 98), a[20:34]])
    edited = np.concatenate([a[:8], [77], a[8:16], a[17:30]])
    assert leakage.align([(a, b), (a, far), (a, edited), (a, a[:9]), (a, np.array([], int))]).tolist() == [29, 15, 29, 0, 0]


def test_repairs_of_texts():
    assert leakage.passage_words("El comitÃ© <b>re-\nvisó</b> la &amp; Línea") == ["el", "comite", "reviso", "la", "linea"]
    assert leakage.passage_words(None) == []


# --- 10 -----------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "text, want",
    [
        ("Contacto: Ana Pérez Sol <ana.perez+x@mail.example>.", [("name", "Ana Pérez Sol"), ("email", "ana.perez+x@mail.example")]),
        ("escriba a ana (arroba) mail.example o llame al +51 22 555 0153.", [("email", "ana (arroba) mail.example"), ("phone", "+51 22 555 0153")]),
        ("reply to ana dot b at buzon dot invalid. Thanks", [("email", "ana dot b at buzon dot invalid")]),
        ("Síguenos en @sala_x. La sección @@ 'y' devolvió 3 filas", []),
        ("El lector Mogrel Lelu, Hugo, carné de identidad 95 501 952, devolvió", [("name", "Mogrel Lelu, Hugo"), ("id_number", "95 501 952")]),
        ("Iván Gael Sinex llamó desde el (020) 7946-0590 para", [("name", "Iván Gael Sinex"), ("phone", "(020) 7946-0590")]),
        ("la paciente inés paula somund, con DNI X-9119217-L, vive en Mz. E Lt. 17, Urb. Braza.", [("name", "inés paula somund"), ("id_number", "X-9119217-L"), ("address", "Mz. E Lt. 17, Urb. Braza")]),
        ("Recoger en Avenida Braza 2295, dpto. 596, preguntar por D. Cropul Jallus.", [("address", "Avenida Braza 2295, dpto. 596"), ("name", "D. Cropul Jallus")]),
        ("Deliver the volume to Poprum, Stanley at Flat 2, 2692 Brodo Street (tel. 0195550109)", [("name", "Poprum, Stanley"), ("address", "Flat 2, 2692 Brodo Street"), ("phone", "0195550109")]),
        ("La Avenida Voxvie estará cerrada. Vive en Psje. Nurza s/n. El grupo Calle Llogrex tocó dos veces.", []),
        ("Referencia 2024-93692. El código de barras 0-93305-545-X no coincide. El RID 46418623 apunta. id = 49762691;", []),
        ("La novela Vagrie recomienda fichas. La entrada cuesta S/ 560.50 y abre a las 10:30. Versión v2.491.1", []),
        ("El  lector  IvÃ¡n  Gael  Sinex,  carnÃ© de identidad 95 501 952", [("name", "IvÃ¡n  Gael  Sinex"), ("id_number", "95 501 952")]),
        ("Contato: Rosa Claumos Natalge, rosa.c@mail.example", [("name", "Rosa Claumos Natalge"), ("email", "rosa.c@mail.example")]),
        ("Mrs Biadrert, Phebe: your result", [("name", "Biadrert, Phebe")]),
        ("a nombre de s. fluemar llesa, identificación 99709073", [("name", "s. fluemar llesa"), ("id_number", "99709073")]),
        ("Firmado: Ine\u0301s Pe\u0301rez Sol.", [("name", "Ine\u0301s Pe\u0301rez Sol")]),
        ("", []),
    ],
)
def test_personal_spans(text, want):
    assert [(s.kind, text[s.start : s.end]) for s in pii.find_spans(text)] == want


def test_checksums():
    assert pii.identity_checksum("12345678Z") and not pii.identity_checksum("12345678A") and pii.identity_checksum("X-1234567-L")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.cpf_valid("52998224725")
    text = "IBAN ES91 2100 0418 4502 0005 1332."
    assert [text[s.start : s.end] for s in pii.find_spans(text)] == ["ES91 2100 0418 4502 0005 1332"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Lo anotado fue 529.982.247-25 y nada más", ["529.982.247-25"]),
        ("Lo anotado fue 529.982.247-26 y nada más", []),
        ("pagó con 4111 1111 1111 1111 ayer", ["4111 1111 1111 1111"]),
        ("pagó con 4111 1111 1111 1112 ayer", []),
        ("pagó con 3782 822463 10005 ayer", ["3782 822463 10005"]),
        ("entró 12345678Z, salió X-1234567-L, no 12345678A", ["12345678Z", "X-1234567-L"]),
        ("DNI 12.345.678-Z", ["12.345.678-Z"]),
        ("CPF 529982247-25, mas CPF 529982247-26", ["529982247-25"]),
        ("El código de barras 4111111111111111, lote 12345678Z y 1700000000004 de reloj", []),
        ("Abonar en ES91 2100 0418 4502 0005 1332 PARA Ana", ["ES91 2100 0418 4502 0005 1332"]),
        ("AB12 3456 7890 NO93 8601 1117 947 GB82WEST12345698765432", ["NO93 8601 1117 947", "GB82WEST12345698765432"]),
        ("Abonar en ES92 2100 0418 4502 0005 1332", []),
    ],
)
def test_checksums_decide_on_numbers_without_a_label(text, want):
    assert [text[s.start : s.end] for s in pii.find_spans(text) if s.kind == "id_number"] == want
    assert [s for s in pii.find_spans("Tel. 52998224725") if s.kind == "phone"]


def test_redaction_keeps_the_rest(spark):
    rows = [(1, "Firmado: Ana Paz Sol.\nTel. 555 01 33, fin"), (2, None), (3, ""), (4, "İ nada " * 2000 + "a@b.example")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kind", F.lit(1))
    got = {r.doc_id: (r.n_found, r.text) for r in pii.redact_personal(d).collect()}
    assert got[1] == (2, "Firmado: [NAME].\nTel. [PHONE], fin") and got[2] == (0, None) and got[3] == (0, "") and got[4][1].endswith("nada [EMAIL]")
    spans = pii.find_personal(d).where("doc_id = 1").collect()
    assert all(rows[0][1][r.start : r.end] == r.found_text for r in spans) and pii.find_personal(d.limit(0)).count() == 0
