"""Registered queries: city resolution, lane distances, route profiles, popular and undirected lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.operators import lanes, text
from cargolens.plans.catalog import query
from cargolens.plans.q_choice import hav_sql
from cargolens.plans.q_text import DIST_SQL
from cargolens.plans.sqlkit import register
from cargolens.sources import dims, views


def _pairs(spark, sf):
    return views.shipments(spark, sf, ["shipment_id", "origin", "destination"])


@query("haversine", f"""
SELECT s.shipment_id, round({hav_sql('o.latitude', 'o.longitude', 'd.latitude', 'd.longitude')}, 6) AS great_circle_km
FROM shipments s JOIN dim_city o ON o.key = s.origin JOIN dim_city d ON d.key = s.destination""")
def q_haversine(spark, sf):
    s = lanes.resolve_city(spark, lanes.resolve_city(spark, _pairs(spark, sf), "origin", "o"), "destination", "d")
    return s.where(F.col("o_key").isNotNull() & F.col("d_key").isNotNull()).select(
        "shipment_id", F.round(lanes.haversine(F.col("o_latitude"), F.col("o_longitude"), F.col("d_latitude"),
                                               F.col("d_longitude")), 6).alias("great_circle_km"))


@query("resolve_city", """
SELECT s.shipment_id, coalesce(k.key, n.key) AS city_key, coalesce(k.region, n.region) AS region,
  coalesce(k.is_metro, n.is_metro) AS is_metro, coalesce(k.state, n.state) AS state
FROM shipments s LEFT JOIN dim_city k ON lower(s.origin) = k.key LEFT JOIN dim_city n ON lower(s.origin) = lower(n.name)""")
def q_resolve_city(spark, sf):
    s = lanes.resolve_city(spark, _pairs(spark, sf), "origin", "c")
    return s.select("shipment_id", F.col("c_key").alias("city_key"), F.col("c_region").alias("region"),
                    F.col("c_is_metro").alias("is_metro"), F.col("c_state").alias("state"))


LANE_SQL = f"""
SELECT s.shipment_id, s.origin, s.destination,
  CASE WHEN f.distance_km IS NOT NULL THEN f.distance_km WHEN r.distance_km IS NOT NULL THEN r.distance_km
       WHEN o.key IS NOT NULL AND d.key IS NOT NULL
       THEN round({hav_sql('o.latitude', 'o.longitude', 'd.latitude', 'd.longitude')} * 1.3::DOUBLE, 6) END AS lane_distance_km,
  CASE WHEN f.distance_km IS NOT NULL THEN 'direct' WHEN r.distance_km IS NOT NULL THEN 'reversed'
       WHEN o.key IS NOT NULL AND d.key IS NOT NULL THEN 'haversine' END AS lane_distance_km_kind
FROM shipments s
LEFT JOIN dim_lane f ON lower(s.origin) = f.origin AND lower(s.destination) = f.destination
LEFT JOIN dim_lane r ON lower(s.origin) = r.destination AND lower(s.destination) = r.origin
LEFT JOIN dim_city o ON lower(s.origin) = o.key LEFT JOIN dim_city d ON lower(s.destination) = d.key"""


@query("lane_distance", LANE_SQL)
def q_lane_distance(spark, sf):
    return lanes.lane_distance(spark, _pairs(spark, sf)).select(
        "shipment_id", "origin", "destination", "lane_distance_km", "lane_distance_km_kind")


# Every seventh request goes to a depot that no fixed list knows.  A third of the distance-matrix payloads and a third of the
# search snippets speak of depots: of the first 20 and of the 20 after the first ten; the last ten have neither.
DEPOTS = 40
_DEPOT = f"'depot ' || CAST(shipment_id % {DEPOTS} AS VARCHAR)"
register("depot_requests", f"""
SELECT shipment_id, origin, CASE WHEN shipment_id % 7 = 0 THEN {_DEPOT} ELSE destination END AS destination FROM shipments""")
_LANE_OF = "['" + "', '".join(views.C) + "'][CAST(id % 23 AS INTEGER) + 1]"
register("depot_provider", f"""
SELECT origin, destination, min(km) AS km FROM (
  SELECT {_LANE_OF} AS origin, 'depot ' || CAST((id // 23) % 20 AS VARCHAR) AS destination,
    round(CAST(json_extract_string(payload, '$.distances[0][1]') AS DOUBLE) / 1000.0, 2) AS km FROM matrix_payloads WHERE id % 3 = 0) x
WHERE km IS NOT NULL GROUP BY ALL""")
register("depot_search", f"""
SELECT origin, destination, min(km) AS km FROM (
  SELECT {_LANE_OF} AS origin, 'depot ' || CAST(10 + (id // 23) % 20 AS VARCHAR) AS destination, {DIST_SQL} AS km
  FROM snippets WHERE id % 3 <> 0) x
WHERE km IS NOT NULL GROUP BY ALL""")


def _depot_requests(spark, sf):
    sid = F.col("shipment_id")
    return _pairs(spark, sf).withColumn("destination", F.when(
        sid % 7 == 0, F.concat(F.lit("depot "), (sid % DEPOTS).cast("string"))).otherwise(F.col("destination")))


def _depot_lanes(rows, first, km):
    """Lanes to depots that payloads or snippets speak of: the origin and the depot from the id, the distance from the text."""
    depot = F.concat(F.lit("depot "), (first + F.expr("id div 23") % 20).cast("string"))
    return rows.select(views.pick(views.C, F.col("id") % 23).alias("origin"), depot.alias("destination"), km.alias("distance_km")).where("distance_km is not null")


@query("distance_cascade", f"""
SELECT x.shipment_id, coalesce(x.lane_distance_km, p.km, w.km, 150.0::DOUBLE) AS cascade_distance_km,
  CASE WHEN x.lane_distance_km IS NOT NULL THEN 'local_routes' WHEN p.km IS NOT NULL THEN 'openrouteservice'
       WHEN w.km IS NOT NULL THEN 'web_search' ELSE 'default' END AS distance_source,
  coalesce(nullif(coalesce(x.lane_distance_km, p.km, w.km, 150.0::DOUBLE), 0), 150.0::DOUBLE) AS effective_distance_km
FROM ({LANE_SQL.replace("FROM shipments s", "FROM depot_requests s")}) x
LEFT JOIN depot_provider p ON p.origin = x.origin AND p.destination = x.destination
LEFT JOIN depot_search w ON w.origin = x.origin AND w.destination = x.destination""")
def q_distance_cascade(spark, sf):
    """Fixed lanes, then distances parsed from matrix payloads, then from search snippets, then the default."""
    matrix = F.round(F.get_json_object("payload", "$.distances[0][1]").cast("double") / 1000.0, 2)
    provider = _depot_lanes(views.matrix_payloads(spark, sf).where("id % 3 = 0"), F.lit(0), matrix)
    search = _depot_lanes(views.snippets(spark, sf).where("id % 3 <> 0"), F.lit(10), text.parse_distance(F.col("text")))
    return lanes.distance_cascade(spark, _depot_requests(spark, sf), provider, search).select(
        "shipment_id", "cascade_distance_km", "distance_source", "effective_distance_km")


@query("route_profile", """
SELECT s.shipment_id, o.region AS origin_region, d.region AS destination_region,
  CASE WHEN o.key IS NOT NULL AND d.key IS NOT NULL THEN o.is_metro AND d.is_metro ELSE false END AS is_metro_to_metro,
  CASE WHEN o.key IS NOT NULL AND d.key IS NOT NULL THEN o.region = d.region END AS same_region,
  CASE WHEN o.key IS NOT NULL AND d.key IS NOT NULL THEN o.state = d.state END AS same_state
FROM shipments s LEFT JOIN dim_city o ON lower(s.origin) = o.key LEFT JOIN dim_city d ON lower(s.destination) = d.key""")
def q_route_profile(spark, sf):
    return lanes.route_profile(spark, _pairs(spark, sf)).select(
        "shipment_id", "origin_region", "destination_region", "is_metro_to_metro", "same_region", "same_state")


_POP = ", ".join(f"('{a}', '{b}')" for a, b in dims.POPULAR_LANES)


@query("popular_lanes", f"""
SELECT p.o AS origin, p.d AS destination,
  coalesce(f.distance_km, r.distance_km) AS distance_km,
  oc.is_metro AND dc.is_metro AS is_metro_to_metro, oc.region = dc.region AS same_region, oc.state = dc.state AS same_state,
  count(*) AS shipments
FROM shipments s JOIN (VALUES {_POP}) p(o, d) ON lower(s.origin) = p.o AND lower(s.destination) = p.d
LEFT JOIN dim_lane f ON f.origin = p.o AND f.destination = p.d
LEFT JOIN dim_lane r ON r.origin = p.d AND r.destination = p.o
JOIN dim_city oc ON oc.key = p.o JOIN dim_city dc ON dc.key = p.d
GROUP BY ALL""")
def q_popular_lanes(spark, sf):
    return lanes.popular_lanes(spark, views.shipments(spark, sf, ["origin", "destination"]))


@query("symmetric_lanes", """
WITH u AS (SELECT least(origin, destination) AS lane_a, greatest(origin, destination) AS lane_b,
             first(distance_km ORDER BY pri, origin) AS distance_km
           FROM (SELECT origin, destination, distance_km, 0 AS pri FROM dim_lane
                 UNION ALL SELECT destination, origin, distance_km, 1 FROM dim_lane) x GROUP BY 1, 2),
     a AS (SELECT least(lower(origin), lower(destination)) AS lane_a, greatest(lower(origin), lower(destination)) AS lane_b,
             count(*) AS shipments, avg(package_weight_kg) AS w FROM shipments GROUP BY 1, 2)
SELECT u.lane_a, u.lane_b, u.distance_km, a.shipments, round(a.w, 6) AS avg_weight_kg FROM u JOIN a USING (lane_a, lane_b)""")
def q_symmetric_lanes(spark, sf):
    return lanes.symmetric_lanes(spark, views.shipments(spark, sf, ["origin", "destination", "package_weight_kg"]))
