import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkdex.functions.types import RID
from sparkdex.operators.key_profile import heaviest_keys, heavy_keys, key_profile
from sparkdex.operators.layouts import SortedBase
from sparkdex.operators.spatial import SlabMap, distinct_points, known_position, pairs_within, points_in_regions, region_edges


def test_sorted_base_delta_and_tombstones(spark):
    make = lambda keys: spark.createDataFrame([(k, i) for i, k in enumerate(keys)], f"id int, {RID} bigint")
    b = SortedBase(make([5, 2, 8, 1, 10, 12, 3]), "id", capacity=3)
    get = lambda d: sorted(r.id for r in d.collect())
    assert get(b.range_search(3, 9)) == [3, 5, 8]
    b.insert(spark.createDataFrame([(4, 100), (9, 101)], f"id int, {RID} bigint"))
    b.remove(5)
    assert get(b.range_search(3, 9)) == [3, 4, 8, 9] and get(b.search(5)) == []
    b.insert(spark.createDataFrame([(20, 102)], f"id int, {RID} bigint"))
    b.insert(spark.createDataFrame([(20, 103)], f"id int, {RID} bigint"))
    assert b.rewrites == 1 and get(b.search(20)) == [20, 20]
    b.remove(20, 103)
    assert get(b.search(20)) == [20]


def test_key_profile_matches_brute_force(spark):
    rng = random.Random(3)
    t0 = datetime(2024, 1, 1)
    rows = []
    for i in range(3000):
        k = rng.choices(["hot", "warm", "", "a", "A ", None, f"r{i % 97}"], [40, 20, 5, 3, 3, 4, 25])[0]
        rows.append((rng.choice(["x", "y"]), k, rng.choice([None, rng.randrange(50)]), rng.choice([None, t0 + timedelta(microseconds=rng.randrange(10**9))]) if rng.random() < 0.9 else t0, i))
    d = spark.createDataFrame(rows, "idx string, clave string, rid bigint, at timestamp, entries int")  # one name clashes with a result column
    got = {(r["idx"], r["clave"]): r for r in key_profile(d, ["idx", "clave"], "at", "rid", (0.5, 0.9), bins=4, hot_rows=200).collect()}
    by = defaultdict(list)
    for r in rows:
        if r[1] is not None:
            by[r[0], r[1]].append(r)
    assert set(got) == set(by)
    for k, v in by.items():
        at = sorted(r[3] for r in v if r[3] is not None)
        g = got[k]
        assert g["entries"] == len(v) and g["total_entries"] == 3000
        assert g["distinct_rids"] == len({r[2] for r in v} - {None})
        assert (g["first_value"], g["last_value"]) == ((at[0], at[-1]) if at else (None, None))
        for p, c in ((0.5, "q50"), (0.9, "q90")):
            assert g[c] == (at[math.ceil(p * len(at)) - 1] if at else None), (k, p)
    heavy = {tuple(r) for r in heavy_keys(key_profile(d, ["idx", "clave"], "at", "rid", hot_rows=200), ["idx", "clave"]).collect()}
    assert heavy == {k for k, v in by.items() if len(v) > 30}
    empty = key_profile(d.limit(0), ["idx", "clave"], "at", "rid")
    assert empty.count() == 0 and "q50" in empty.columns


def test_profiles_keep_values_exact(spark):
    from decimal import Decimal

    v = [0.1, 0.4, 0.9, -0.0, -1e300, 1e300, float("-inf"), float("nan"), None, 5e-324]
    d = spark.createDataFrame([("k", x) for x in v], "k string, v double")
    for hot in (1, 1000):  # by refinement, and plainly
        r = key_profile(d, ["k"], "v", quantiles=(0.5, 1.0), hot_rows=hot, hot_share=10**9).first()
        good = sorted(x for x in v if x is not None and x == x)
        assert (r["entries"], r["first_value"], r["last_value"], r["q50"], r["q100"]) == (10, good[0], good[-1], good[3], good[-1])
    with pytest.raises(TypeError):
        key_profile(d.select(F.lit("a").alias("k"), F.lit("b").alias("v")), ["k"], "v")
    dec = spark.createDataFrame([("k", Decimal("1.05")), ("k", Decimal("1.01"))], "k string, v decimal(10,2)")
    assert key_profile(dec, ["k"], "v").first()["q50"] == Decimal("1.01")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:  # two clock times of the hour that is skipped, and of the one that comes twice
        at = [datetime(2024, 3, 31, 2, 30), datetime(2024, 3, 31, 3, 30), datetime(2024, 10, 27, 2, 30, 0, 7), datetime(1960, 5, 1, 1, 2, 3, 999999)]
        t = spark.createDataFrame([("k", x) for x in at], "k string, v timestamp_ntz")
        r = key_profile(t, ["k"], "v", quantiles=(0.25, 0.5, 0.75, 1.0), hot_rows=1, hot_share=10**9).first()
        assert [r[c] for c in ("q25", "q50", "q75", "q100")] == sorted(at) and r["first_value"] == at[3]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_heaviest_keys_match_counts(spark):
    rng = random.Random(9)
    ks = [rng.choices(["a", "b", "", None, f"r{rng.randrange(400)}"], [30, 2, 1.5, 20, 46])[0] for _ in range(6000)]
    d = spark.createDataFrame([(k, "x", 1) for k in ks], "k string, i string, entries int").repartition(5)
    count = defaultdict(int)
    for k in ks:
        count[k] += 1
    for share in (0.001, 0.01, 0.25, 0.5):
        want = {(k, "x"): n for k, n in count.items() if k is not None and n > share * 6000}
        assert {(r[0], r[1]): r[2] for r in heaviest_keys(d, ["k", "i"], share).collect()} == want
    assert heaviest_keys(d.limit(0), ["k", "i"], 0.01).count() == 0


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    pts = [(i, round(rng.gauss(0, 2), 2), round(rng.gauss(0, 2), 2)) for i in range(300)] + [(1000 + i, 1.0, 1.0) for i in range(30)] + [(2000, None, 1.0), (2001, float("nan"), 1.0)]
    d = spark.createDataFrame(pts, "id bigint, x double, y double").withColumn("salt", F.lit("clash"))
    want = {(a[0], b[0]) for a in pts[:-2] for b in pts[:-2] if a[0] < b[0] and math.hypot(a[1] - b[1], a[2] - b[2]) <= 0.3005}
    for hot in (2000, 5):
        got = [tuple(r) for r in pairs_within(d, 0.3005, hot_rows=hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert pairs_within(d.limit(0), 1.0).count() == 0


def test_positions_and_repeats(spark):
    d = spark.createDataFrame([(1, 1.0, 2.0), (1, 1.0, 2.0), (2, 0.0, 0.0), (3, None, 1.0), (4, 91.0, 0.0), (5, 0.0, 5.0), (6, 1.0, float("nan")), (None, 1.0, 1.0)], "id bigint, lat double, lon double")
    p = distinct_points(d.where(known_position(F.col("lat"), F.col("lon"))), "id", F.col("lat"), F.col("lon"))
    assert sorted(r.id for r in p.collect()) == [1, 5]


def _inside(zone, x, y):
    kind, xs, ys, r = zone
    if kind == "rect":
        return min(xs) <= x <= max(xs) and min(ys) <= y <= max(ys)
    if kind == "circulo":
        return math.hypot(x - xs[0], y - ys[0]) <= r
    odd = False
    for i in range(len(xs)):
        j = (i + 1) % len(xs)
        if (xs[i] > x) != (xs[j] > x) and y > (ys[j] - ys[i]) * (x - xs[i]) / (xs[j] - xs[i]) + ys[i]:
            odd = not odd
    return odd


def test_regions_match_brute_force(spark):
    rng = random.Random(8)
    zones = {}
    for z in range(40):
        cx, cy = rng.uniform(-3, 3), rng.uniform(-3, 3)
        kind = rng.choice(["rect", "circulo", "poligono"])
        if kind == "circulo":
            zones[z] = (kind, [cx], [cy], rng.uniform(0.1, 2))
        elif kind == "rect":
            zones[z] = (kind, [cx, cx + rng.uniform(-2, 2)], [cy, cy + rng.uniform(-2, 2)], None)
        else:
            a = sorted(rng.uniform(0, 6.28) for _ in range(7))
            s = [rng.uniform(0.3, 2) for _ in a]
            zones[z] = (kind, [cx + q * math.cos(t) for q, t in zip(s, a)], [cy + q * math.sin(t) for q, t in zip(s, a)], None)
    pts = [(i, rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(800)]
    want = {(i, z) for i, x, y in pts for z, v in zones.items() if _inside(v, x, y)}
    regions = spark.createDataFrame([(z, *v) for z, v in zones.items()] + [(98, "rect", None, None, None), (99, "other", [1.0], [1.0], None)], "zone_id bigint, forma string, xs array<double>, ys array<double>, radio double")
    points = spark.createDataFrame(pts + [(-1, None, 0.0)], "id bigint, x double, y double")
    got = [tuple(r) for r in points_in_regions(points, regions, stripes=5, part_rows=60).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert points_in_regions(points.limit(0), regions).count() == 0 and points_in_regions(points, regions.limit(0)).count() == 0
    whole = SlabMap([e for z, v in zones.items() for e in region_edges(z, *v)])
    assert {len(s) for s in whole.sets} >= {0, 1}


def test_batched_probes_match_brute_force(spark):
    from sparkdex.operators.batch import lookup_many, radius_many, ranges_many

    rng = random.Random(4)
    rows = [(i, rng.randrange(-50, 50), rng.uniform(-3, 3)) for i in range(300)] + [(900, None, 1.0)]
    d = spark.createDataFrame(rows, "i int, k int, y double")
    keys = spark.createDataFrame([(3,), (3,), (-7,), (None,), (999,)], "x bigint")
    assert sorted(r.i for r in lookup_many(d, "k", keys).collect()) == sorted(i for i, k, _ in rows if k in (3, -7))
    for spans in ([(n, a, a + 3) for n, a in enumerate(range(-50, 50, 7))], [(n, a, a) for n, a in enumerate(range(-9, 9))] + [(100, -500, 500), (101, 5, 4), (102, None, 3)], []):
        r = spark.createDataFrame(spans, "range_id int, low int, high int")
        want = sorted((n, i) for n, lo, hi in spans if lo is not None for i, k, _ in rows if k is not None and lo <= k <= hi)
        assert sorted((x.range_id, x.i) for x in ranges_many(d, "k", r, most_cells=4).collect()) == want
    c = spark.createDataFrame([(n, rng.uniform(-9, 9), rng.uniform(-3, 3)) for n in range(20)], "center_id int, x double, y double")
    want = {(x.center_id, i) for x in c.collect() for i, k, y in rows if k is not None and (k - x.x) ** 2 + (y - x.y) ** 2 <= 2.25}
    assert {(x.center_id, x.i) for x in radius_many(d, ["k", "y"], c, 1.5).collect()} == want


def test_fetch_by_record_id(engine):
    engine.sql("CREATE TABLE t (a INT); INSERT INTO t VALUES (1), (2), (3)")
    ids = engine.spark.createDataFrame([(0,), (2,), (99,)], "r int")
    assert sorted(r.a for r in engine.fetch("t", ids).collect()) == [1, 3]


def test_hash_base(spark, tmp_path):
    from pytest import raises

    from sparkdex.operators.layouts import HashBase

    rows = [(k, 100 * (i + 1)) for i, k in enumerate(["apple", "banana", "cherry", "date", "elder", "fig", "grape", "fig"])]
    b = HashBase(spark.createDataFrame(rows, f"id string, {RID} bigint"), "id", "file://" + str(tmp_path / "h"), buckets=2)
    get = lambda k: sorted(r[RID] for r in b.search(k).collect())
    assert get("fig") == [600, 800] and get("nope") == []
    b.insert(spark.createDataFrame([("fig", 900)], f"id string, {RID} bigint"))
    b.remove("fig", 600)
    assert get("fig") == [800, 900]
    b.remove("fig")
    assert get("fig") == [] and get("grape") == [700]
    with raises(NotImplementedError):
        b.range_search("a", "b")


def test_ranges_are_compared_in_the_columns_own_type(spark):
    from sparkdex.operators.batch import ranges_many

    big = 2**53
    rows = spark.createDataFrame([(big,), (big + 1,), (big + 2,), (None,), (-(2**63),), (2**63 - 1,), (5,)], "v bigint")
    one = lambda lo, hi, t="bigint": sorted(r.v for r in ranges_many(rows, "v", spark.createDataFrame([(1, lo, hi)], f"range_id int, low {t}, high {t}")).collect())
    assert one(big + 1, big + 1) == [big + 1]
    assert one(-(2**63), 2**63 - 1) == sorted([big, big + 1, big + 2, -(2**63), 2**63 - 1, 5])
    assert one(4.5, 5.5, "double") == [5] and one(float("-inf"), 5.0, "double") == [-(2**63), 5] and one(float("nan"), 5.0, "double") == []
    mixed = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate([(0, 10), (1, 1), (0, 2**40), (3, 2)])], "range_id int, low bigint, high bigint")
    got = sorted((r.range_id, r.v) for r in ranges_many(spark.range(0, 8).withColumnRenamed("id", "v"), "v", mixed).collect())
    assert got == sorted([(0, v) for v in range(8)] + [(1, 1)] + [(2, v) for v in range(8)])
    with pytest.raises(TypeError):
        ranges_many(spark.createDataFrame([("a",)], "v string"), "v", mixed)
    f = spark.createDataFrame([(0.5,), (float("nan"),), (-0.5,)], "v double")
    assert [r.v for r in ranges_many(f, "v", spark.createDataFrame([(1, 0.0, float("inf"))], "range_id int, low double, high double")).collect()] == [0.5]


def test_radius_search_splits_crowded_cells(spark):
    from sparkdex.operators.batch import radius_many

    pts = spark.createDataFrame([(i, (i % 7) / 10, (i % 5) / 10) for i in range(300)] + [(900, None, 0.0), (901, float("nan"), 0.0)], "id int, x double, y double")
    centers = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.6, 0.4), (3, None, 1.0)], "center_id int, x double, y double")
    want = sorted((c, i) for c, cx, cy in ((1, 0, 0), (2, 0.6, 0.4)) for i in range(300) if ((i % 7) / 10 - cx) ** 2 + ((i % 5) / 10 - cy) ** 2 <= 0.09)
    for hot in (10, 10_000):
        assert sorted((r.center_id, r.id) for r in radius_many(pts, ["x", "y"], centers, 0.3, hot_rows=hot).collect()) == want


def test_many_nearest_match_brute_force(spark):
    from sparkdex.operators.batch import knn_many

    rng = random.Random(4)
    pts = [(i, rng.choice([0.0, rng.uniform(0, 9), 1e6]), rng.uniform(0, 9)) for i in range(120)]
    d = spark.createDataFrame([*pts, (900, None, 1.0), (901, float("nan"), 1.0)], "id int, x double, y double")
    asked = [(1, 0.0, 0.0), (2, 1e6, 4.0), (3, -1e7, 2.0), (4, 5.0, 5.0)]
    c = spark.createDataFrame([*asked, (5, None, 0.0)], "center_id int, x double, y double")
    for k in (1, 7, 500):
        got = sorted((r.center_id, r["rank"], r.id) for r in knn_many(d, ["x", "y"], c, k, "id").collect())
        want = [(n, i + 1, p) for n, cx, cy in asked for i, (_, p) in enumerate(sorted(((x - cx) ** 2 + (y - cy) ** 2, p) for p, x, y in pts)[:k])]
        assert got == sorted(want), k
    assert knn_many(d.limit(0), ["x", "y"], c, 3, "id").count() == 0
