"""Queries of the general problems, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkdex.common import read_table
from sparkdex.functions.coords import parse_point
from sparkdex.operators.key_profile import heaviest_keys, key_profile
from sparkdex.operators.spatial import distinct_points, known_position, pairs_within, points_in_regions

KEYS = ["idx_name", "clave"]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys holding more than 1% of all rows of leaf_values."""
    return heaviest_keys(read_table(spark, sf_dir, "leaf_values"), KEYS, 0.01).select(*KEYS)


def p2_key_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries, distinct rids, first, last and median logged_at of every key."""
    return key_profile(read_table(spark, sf_dir, "leaf_values"), KEYS, "logged_at", "rid", (0.5,))


def city_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "cities")
    return distinct_points(c.where(known_position(F.col("lat"), F.col("lon"))), "id", F.col("lat"), F.col("lon"))


def coord_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "rt_coord").withColumn("p", parse_point(F.col("coord"))).where(F.col("p").isNotNull())
    return distinct_points(c, "id", F.col("p.x"), F.col("p.y"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "zonas").select("zone_id", "forma", F.col("lats").alias("xs"), F.col("lons").alias("ys"), "radio")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near cities, near coordinates, and the zones holding each city."""
    city = pairs_within(city_points(spark, sf_dir), 0.0005005)
    coord = pairs_within(coord_points(spark, sf_dir), 5.005)
    zone = points_in_regions(city_points(spark, sf_dir), zones(spark, sf_dir))
    return (
        city.select(F.lit("city").alias("kind"), "id_a", "id_b")
        .unionByName(coord.select(F.lit("coord").alias("kind"), "id_a", "id_b"))
        .unionByName(zone.select(F.lit("zone").alias("kind"), F.col("id").alias("id_a"), F.col("zone_id").alias("id_b")))
    )


QUERIES = {"p2_found": p2_found, "p2_key_profile": p2_key_profile, "p7_found": p7_found}

SQL = {
    "p2_found": """
        select idx_name, clave from leaf_values where clave is not null and idx_name is not null
        group by idx_name, clave having count(*) > 0.01 * (select count(*) from leaf_values)""",
    "p2_key_profile": """
        select idx_name, clave, count(*) as entries, (select count(*) from leaf_values) as total_entries,
               count(distinct rid) as distinct_rids, min(logged_at) as first_value, max(logged_at) as last_value,
               quantile_disc(logged_at, 0.5) as q50
        from leaf_values where clave is not null and idx_name is not null group by idx_name, clave""",
    "p7_found": r"""
        with city as (
            select distinct id, lat as x, lon as y from cities
            where lat between -90 and 90 and lon between -180 and 180 and not (lat = 0 and lon = 0)),
        t as (select id, trim(coord) as c from rt_coord),
        ok as (select distinct id, string_split(regexp_replace(c, '[()\[\]\s]', '', 'g'), ',') as v from t
               where regexp_full_match(c, '(\(\s*[+-]?[0-9]+(\.[0-9]+)?\s*,\s*[+-]?[0-9]+(\.[0-9]+)?\s*\)|\[\s*[+-]?[0-9]+(\.[0-9]+)?\s*,\s*[+-]?[0-9]+(\.[0-9]+)?\s*\]|[+-]?[0-9]+(\.[0-9]+)?\s*,\s*[+-]?[0-9]+(\.[0-9]+)?)')),
        coord as (select distinct id, v[1]::double as x, v[2]::double as y from ok),
        z as (select zone_id, forma, lats, lons, radio, len(lats) as n, unnest(range(1, len(lats) + 1)) as i from zonas where forma = 'poligono'),
        e as (select zone_id, lats[i] as x1, lons[i] as y1, lats[i % n + 1] as x2, lons[i % n + 1] as y2 from z),
        crossing as (select c.id, e.zone_id from city c join e on (e.x1 > c.x) <> (e.x2 > c.x)
                     where c.y > (e.y2 - e.y1) * (c.x - e.x1) / (e.x2 - e.x1) + e.y1)
        select 'city' as kind, a.id as id_a, b.id as id_b from city a join city b
            on a.id < b.id and b.x between a.x - 0.00051 and a.x + 0.00051 and abs(a.y - b.y) < 0.00051
            where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 0.0005005 * 0.0005005
        union all
        select 'coord', a.id, b.id from coord a join coord b
            on a.id < b.id and b.x between a.x - 5.1 and a.x + 5.1 and abs(a.y - b.y) < 5.1
            where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 5.005 * 5.005
        union all
        select 'zone', c.id, z.zone_id from city c join zonas z on forma = 'rect'
            and c.x between least(lats[1], lats[2]) and greatest(lats[1], lats[2]) and c.y between least(lons[1], lons[2]) and greatest(lons[1], lons[2])
        union all
        select 'zone', c.id, z.zone_id from city c join zonas z on forma = 'circulo'
            and (c.x - lats[1]) * (c.x - lats[1]) + (c.y - lons[1]) * (c.y - lons[1]) <= radio * radio
        union all
        select 'zone', id, zone_id from crossing group by id, zone_id having count(*) % 2 = 1""",
}
