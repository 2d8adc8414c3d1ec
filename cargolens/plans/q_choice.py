"""Registered queries: requests, carrier quotes, route options, route choice and the flagship.

Spark side: per-row option arrays (``operators.quotes`` / ``operators.choice``).
Oracle side: the textbook relational form — requests joined to the carrier table
on the eligibility predicates, ranked with window functions.
"""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from cargolens.functions.exprs import casp, r6, round_half_up
from cargolens.operators import carbon, choice, quotes, vendors
from cargolens.plans import pipelines
from cargolens.plans.catalog import query
from cargolens.plans.sqlkit import register
from cargolens.sources import dims, views

RAD = f"{math.pi / 180.0!r}::DOUBLE"
LATE = "CASE WHEN delayed = 'yes' THEN 1 ELSE 0 END"
AI_SERVICE = f"{choice.CARBON_SERVICE_AI_GCO2!r}::DOUBLE"


def hav_sql(lat1, lon1, lat2, lon2):
    return (f"(6371.0::DOUBLE * (2 * asin(sqrt(pow(sin(({lat2} * {RAD} - {lat1} * {RAD}) / 2), 2)"
            f" + cos({lat1} * {RAD}) * cos({lat2} * {RAD}) * pow(sin(({lon2} * {RAD} - {lon1} * {RAD}) / 2), 2)))))")


register("req_src", """
SELECT shipment_id, raw_package_type AS package_type, origin, destination, distance_km, package_weight_kg,
       delivery_mode, weather_condition FROM shipments""")
register("hist_rates", f"""
SELECT delivery_partner, weather_condition, count(*) AS n, sum({LATE}) AS late FROM deliveries GROUP BY ALL""")
register("partner_rates", "SELECT delivery_partner, sum(late) / sum(n) AS r FROM hist_rates GROUP BY 1")
register("global_rate", "SELECT sum(late) / sum(n) AS r FROM hist_rates")

_D = dims.DEFAULT_POLICY
register("req_norm", f"""
SELECT n.*,
  coalesce(p.stakes, '{_D[0]}') AS stakes, coalesce(p.tier, {_D[1]}) AS tier, coalesce(p.tier_name, '{_D[2]}') AS tier_name,
  coalesce(p.on_time_threshold, {_D[3]}::DOUBLE) AS on_time_threshold,
  coalesce(p.cold_chain_multiplier, {_D[4]}::DOUBLE) AS cold_chain_multiplier,
  coalesce(p.priority, '{_D[5]}') AS priority, coalesce(p.impact_multiplier, {_D[6]}::DOUBLE) AS impact_multiplier,
  lf.distance_km AS lf_km, lr.distance_km AS lr_km,
  coalesce(ok.key, onm.key) AS o_key, coalesce(ok.region, onm.region) AS o_region,
  coalesce(ok.is_metro, onm.is_metro) AS o_metro, coalesce(ok.state, onm.state) AS o_state,
  coalesce(ok.latitude, onm.latitude) AS o_lat, coalesce(ok.longitude, onm.longitude) AS o_lon,
  coalesce(dk.key, dnm.key) AS d_key, coalesce(dk.region, dnm.region) AS d_region,
  coalesce(dk.is_metro, dnm.is_metro) AS d_metro, coalesce(dk.state, dnm.state) AS d_state,
  coalesce(dk.latitude, dnm.latitude) AS d_lat, coalesce(dk.longitude, dnm.longitude) AS d_lon
FROM (SELECT shipment_id, lower(trim(package_type)) AS package_type, lower(trim(origin)) AS origin,
        lower(trim(destination)) AS destination, try_cast(distance_km AS DOUBLE) AS distance_km,
        try_cast(package_weight_kg AS DOUBLE) AS package_weight_kg, delivery_mode, weather_condition,
        coalesce(nullif(lower(trim(package_type)), ''), 'clothing') AS pkg
      FROM req_src) n
LEFT JOIN dim_policy p ON lower(n.pkg) = p.package_type
LEFT JOIN dim_lane lf ON lower(n.origin) = lf.origin AND lower(n.destination) = lf.destination
LEFT JOIN dim_lane lr ON lower(n.origin) = lr.destination AND lower(n.destination) = lr.origin
LEFT JOIN dim_city ok ON lower(n.origin) = ok.key
LEFT JOIN dim_city onm ON lower(n.origin) = lower(onm.name)
LEFT JOIN dim_city dk ON lower(n.destination) = dk.key
LEFT JOIN dim_city dnm ON lower(n.destination) = lower(dnm.name)""")

register("req_feat", f"""
SELECT x.*,
  coalesce(nullif(coalesce(distance_km, CASE WHEN coalesce(origin, '') <> '' AND coalesce(destination, '') <> ''
                                           THEN lane_km END), 0), 150.0::DOUBLE) AS route_distance_km,
  coalesce(nullif(package_weight_kg, 0), 25.0::DOUBLE) AS route_weight_kg,
  coalesce(o_region, 'west') AS origin_region,
  lower(coalesce(delivery_mode, '')) IN ('same day', 'express') AS is_express,
  cold_chain_multiplier > 1.0::DOUBLE AS requires_cold_chain,
  lower(coalesce(nullif(weather_condition, ''), 'clear')) AS route_weather,
  CASE WHEN lower(coalesce(nullif(weather_condition, ''), 'clear')) = 'stormy' THEN 'storm'
       ELSE lower(coalesce(nullif(weather_condition, ''), 'clear')) END AS quote_weather,
  lower(coalesce(nullif(delivery_mode, ''), 'two day')) AS route_mode,
  on_time_threshold * 100 AS threshold_pct,
  coalesce(ow.api_weather, dw.api_weather, ow.search_weather, dw.search_weather, lower(nullif(weather_condition, '')), 'clear') AS risk_weather
FROM (SELECT *,
        CASE WHEN lf_km IS NOT NULL THEN lf_km WHEN lr_km IS NOT NULL THEN lr_km
             WHEN o_key IS NOT NULL AND d_key IS NOT NULL
             THEN round({hav_sql('o_lat', 'o_lon', 'd_lat', 'd_lon')} * 1.3::DOUBLE, 6) END AS lane_km,
        CASE WHEN o_key IS NOT NULL AND d_key IS NOT NULL THEN o_metro AND d_metro ELSE false END AS is_metro_to_metro
      FROM req_norm) x
LEFT JOIN city_weather ow ON ow.city = x.origin LEFT JOIN city_weather dw ON dw.city = x.destination""")

register("req_risk", f"""
SELECT *,
  CASE WHEN risk_score > 5 THEN 'CRITICAL' WHEN risk_score > 3 THEN 'HIGH' WHEN risk_score > 1.5 THEN 'MEDIUM'
       ELSE 'LOW' END AS risk_level,
  risk_score > 5 AS alert_required,
  CASE WHEN risk_score > 5 THEN 2 WHEN risk_score > 1.5 THEN 1 ELSE 0 END AS recommended_buffer_days,
  concat_ws(', ', f_storm, f_load, f_partner) AS risk_factors_text,
  concat_ws('; ', f_storm, f_load, f_partner,
            CASE WHEN risk_score > 5 THEN '{quotes.ALERT_WARNING}' END) AS warnings_text
FROM (SELECT *,
        CASE WHEN is_partner THEN s3 * 1.2::DOUBLE ELSE s3 END AS risk_score,
        CASE WHEN is_storm THEN '{quotes.RISK_FACTOR_STORM}' END AS f_storm,
        CASE WHEN is_load THEN '{quotes.RISK_FACTOR_LOAD}' END AS f_load,
        CASE WHEN is_partner THEN 'High-risk partner: delhivery (+20% risk)' END AS f_partner
      FROM (SELECT *, CASE WHEN is_load THEN s2 * 1.3::DOUBLE ELSE s2 END AS s3
            FROM (SELECT *, CASE WHEN is_storm THEN s1 * 1.5::DOUBLE ELSE s1 END AS s2
                  FROM (SELECT f.*, coalesce(pw.late / pw.n, pr.r, g.r) AS delay_probability,
                          coalesce(pw.late / pw.n, pr.r, g.r) * f.impact_multiplier AS s1,
                          f.risk_weather = 'stormy' AS is_storm,
                          coalesce(nullif(f.distance_km, 0), 150.0::DOUBLE) > 250
                            AND coalesce(nullif(f.package_weight_kg, 0), 25.0::DOUBLE) > 40 AS is_load,
                          coalesce(pr.r > 0.15::DOUBLE, false) AS is_partner
                        FROM req_feat f
                        LEFT JOIN hist_rates pw ON pw.delivery_partner = 'delhivery' AND pw.weather_condition = f.risk_weather
                        LEFT JOIN partner_rates pr ON pr.delivery_partner = 'delhivery'
                        CROSS JOIN global_rate g) a) b) c) d""")

register("req_quote", """
SELECT *, CASE WHEN recommended_buffer_days > 0 THEN greatest(threshold_pct, 95.0::DOUBLE) ELSE threshold_pct END
  AS min_on_time_pct FROM req_risk""")

_PEN = " ".join(f"WHEN '{w}' THEN {p}::DOUBLE" for w, p in dims.WEATHER_PENALTY)
register("opt_quotes", f"""
SELECT shipment_id, seq, carrier_code, carrier_name, carrier_type, delivery_partner, vehicle_type, vgco2,
  has_cold_chain, has_ev_fleet, is_express,
  floor(greatest(CASE WHEN requires_cold_chain THEN b1 * carrier_cold_multiplier ELSE b1 END, 50.0::DOUBLE) * 100.0 + 0.5) / 100.0 AS cost_inr,
  floor(ot * 10.0 + 0.5) / 10.0 AS estimated_on_time_pct,
  floor(least(greatest(ot - on_time_variance / 2, 50.0::DOUBLE), 99.9::DOUBLE) * 10.0 + 0.5) / 10.0 AS on_time_low,
  floor(least(greatest(ot + on_time_variance / 2, 50.0::DOUBLE), 99.9::DOUBLE) * 10.0 + 0.5) / 10.0 AS on_time_high,
  floor(CASE WHEN requires_cold_chain THEN (route_distance_km * carbon_gco2_per_km) / 1000 * 1.5::DOUBLE
             ELSE (route_distance_km * carbon_gco2_per_km) / 1000 END * 100.0 + 0.5) / 100.0 AS carbon_kg
FROM (SELECT r.shipment_id, r.requires_cold_chain, r.is_express, r.route_distance_km,
        c.seq, c.code AS carrier_code, c.name AS carrier_name, c.type AS carrier_type, c.carrier_cold_multiplier,
        c.has_cold_chain, c.has_ev_fleet, c.carbon_gco2_per_km, c.on_time_variance,
        pa.delivery_partner, pa.vehicle_type, coalesce(v.gco2_per_km, 800.0::DOUBLE) AS vgco2,
        CASE WHEN r.is_express THEN r.route_distance_km * r.route_weight_kg * c.base_rate_per_kg_km * c.express_multiplier
             ELSE r.route_distance_km * r.route_weight_kg * c.base_rate_per_kg_km END AS b1,
        least(greatest(CASE WHEN r.is_metro_to_metro THEN c.avg_on_time_pct + c.metro_to_metro_bonus
                            ELSE c.avg_on_time_pct END
                       - CASE r.quote_weather {_PEN} ELSE 0.0::DOUBLE END, 50.0::DOUBLE), 99.9::DOUBLE) AS ot
      FROM req_quote r
      JOIN dim_carrier c
        ON r.route_weight_kg <= c.max_weight_kg AND (NOT r.requires_cold_chain OR c.has_cold_chain)
       AND list_contains(c.coverage_regions, r.origin_region)
       AND c.avg_on_time_pct - c.on_time_variance >= (r.min_on_time_pct - 5) - 5
      JOIN dim_partner pa ON pa.code = c.code
      LEFT JOIN dim_vehicle v ON v.vehicle_type = pa.vehicle_type) q""")

register("opt_eval", """
SELECT *, transport_carbon_gco2 + ai_carbon_gco2 AS total_carbon_gco2,
  predicted_on_time_pct >= threshold_pct AS meets_sla
FROM (SELECT q.*, r.stakes, r.threshold_pct, r.cold_chain_multiplier, r.route_distance_km, r.route_weight_kg,
        row_number() OVER (PARTITION BY q.shipment_id ORDER BY q.cost_inr, q.seq) AS rank,
        count(*) OVER (PARTITION BY q.shipment_id) AS n_opts,
        (100 + 3 * r.route_distance_km) + 5 * r.route_weight_kg AS predicted_cost,
        100 * (1 - coalesce(pw.late / pw.n, pr.r, g.r)) AS predicted_on_time_pct,
        r.route_distance_km * q.vgco2 AS predicted_carbon_gco2,
        r.route_distance_km * q.vgco2 * r.cold_chain_multiplier AS transport_carbon_gco2,
        ((1e-5 * (count(*) OVER (PARTITION BY q.shipment_id) * 3)) / 1000 * 708.0::DOUBLE)
          / count(*) OVER (PARTITION BY q.shipment_id) AS ai_carbon_gco2
      FROM opt_quotes q JOIN req_quote r USING (shipment_id)
      LEFT JOIN hist_rates pw ON pw.delivery_partner = q.delivery_partner AND pw.weather_condition = r.route_weather
      LEFT JOIN partner_rates pr ON pr.delivery_partner = q.delivery_partner
      CROSS JOIN global_rate g) x""")

register("opt_best", """
SELECT * EXCLUDE (pick) FROM (
  SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY (NOT meets_sla),
    CASE WHEN meets_sla THEN CASE WHEN stakes = 'standard' THEN total_carbon_gco2 ELSE predicted_cost END
         ELSE -predicted_on_time_pct END, rank) AS pick FROM opt_eval) x WHERE pick = 1""")
register("opt_fast", """
SELECT * EXCLUDE (pick) FROM (
  SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY predicted_on_time_pct, rank) AS pick
  FROM opt_eval) x WHERE pick = 1""")
register("opt_green", """
SELECT * EXCLUDE (pick, any_meets) FROM (
  SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY
    CASE WHEN any_meets THEN NOT meets_sla ELSE false END, predicted_carbon_gco2, rank) AS pick
  FROM (SELECT *, bool_or(meets_sla) OVER (PARTITION BY shipment_id) AS any_meets FROM opt_eval) y) x
WHERE pick = 1""")
register("opt_bench", """
SELECT shipment_id, avg(round(cost_inr * 100)) FILTER (WHERE cost_inr > 0) / 100 AS bench FROM opt_eval GROUP BY shipment_id""")


def _requests(spark, sf):
    return pipelines.flagship_requests(views.shipments(spark, sf))


def _history(spark, sf):
    return views.deliveries(spark, sf, ["delivery_partner", "weather_condition", "delayed"])


def _city_weather(spark, sf):
    from cargolens.plans import q_text

    return q_text.city_weather(spark, sf)


def _options(spark, sf):
    return quotes.carrier_options(spark, _requests(spark, sf), _history(spark, sf), city_weather=_city_weather(spark, sf))


def _decided(spark, sf, carry=None):
    return choice.decide(spark, _options(spark, sf), carry=carry)


def _exploded(spark, sf, keep=("shipment_id",), fields=None):
    return quotes.explode_options(spark, _options(spark, sf), list(keep), fields)


@query("normalize_shipments", """
SELECT shipment_id, lower(trim(package_type)) AS package_type, lower(trim(origin)) AS origin,
  lower(trim(destination)) AS destination, try_cast(distance_km AS DOUBLE) AS distance_km,
  try_cast(package_weight_kg AS DOUBLE) AS package_weight_kg FROM req_src""")
def q_normalize_shipments(spark, sf):
    return quotes.normalize_shipments(_requests(spark, sf)).select(
        "shipment_id", "package_type", "origin", "destination", "distance_km", "package_weight_kg")


@query("join_policy", """
SELECT shipment_id, pkg AS package_type, stakes, tier, tier_name, on_time_threshold, cold_chain_multiplier, priority,
  impact_multiplier FROM req_norm""")
def q_join_policy(spark, sf):
    from cargolens.functions.exprs import POLICY_COLUMNS, with_policy
    r = quotes.normalize_shipments(_requests(spark, sf)).withColumn(
        "pkg", F.coalesce(F.when(F.col("package_type") != "", F.col("package_type")), F.lit("clothing")))
    return with_policy(r, spark, "pkg").select("shipment_id", F.col("pkg").alias("package_type"), *POLICY_COLUMNS)


@query("carrier_eligibility", "SELECT shipment_id, carrier_code, seq FROM opt_quotes")
def q_carrier_eligibility(spark, sf):
    return _exploded(spark, sf, fields=["carrier_code", "seq"])


@query("quote_price", "SELECT shipment_id, carrier_code, cost_inr FROM opt_quotes")
def q_quote_price(spark, sf):
    return _exploded(spark, sf, fields=["carrier_code", "cost_inr"])


@query("quote_on_time", """
SELECT shipment_id, carrier_code, estimated_on_time_pct, on_time_low, on_time_high FROM opt_quotes""")
def q_quote_on_time(spark, sf):
    return _exploded(spark, sf, fields=["carrier_code", "estimated_on_time_pct", "on_time_low", "on_time_high"])


@query("quote_carbon", "SELECT shipment_id, carrier_code, carbon_kg FROM opt_quotes")
def q_quote_carbon(spark, sf):
    return _exploded(spark, sf, fields=["carrier_code", "carbon_kg"])


QUOTE_COLS = ["shipment_id", "rank", "carrier_code", "carrier_name", "cost_inr", "estimated_on_time_pct", "carbon_kg",
              "has_cold_chain", "has_ev_fleet", "is_express"]


@query("shipment_carrier_quotes", f"SELECT {', '.join(QUOTE_COLS)} FROM opt_eval")
def q_shipment_carrier_quotes(spark, sf):
    return _exploded(spark, sf, fields=QUOTE_COLS[1:]).withColumn("rank", F.col("rank").cast("long"))


@query("route_options", """
SELECT e.shipment_id, e.carrier_code AS route_id, e.rank, r.route_distance_km AS distance_km,
  r.route_weight_kg AS package_weight_kg, 4 AS delivery_rating, e.vehicle_type, e.delivery_partner,
  r.route_mode AS delivery_mode, r.origin_region AS region, r.route_weather AS weather_condition,
  r.pkg AS package_type
FROM opt_eval e JOIN req_quote r USING (shipment_id)""")
def q_route_options(spark, sf):
    e = _exploded(spark, sf, ["shipment_id", "route_distance_km", "route_weight_kg", "route_mode", "origin_region",
                              "route_weather", "pkg"], ["carrier_code", "rank", "vehicle_type", "delivery_partner"])
    return e.select("shipment_id", F.col("carrier_code").alias("route_id"), F.col("rank").cast("long").alias("rank"),
                    F.col("route_distance_km").alias("distance_km"), F.col("route_weight_kg").alias("package_weight_kg"),
                    F.lit(quotes.ROUTE_RATING).alias("delivery_rating"), "vehicle_type", "delivery_partner",
                    F.col("route_mode").alias("delivery_mode"), F.col("origin_region").alias("region"),
                    F.col("route_weather").alias("weather_condition"), F.col("pkg").alias("package_type"))


register("partner_cluster", f"""
SELECT delivery_partner, cluster, type AS cluster_type FROM (
  SELECT v.delivery_partner, v.cluster,
    CASE WHEN avg(on_time_pct) OVER w > 90 AND avg(avg_rating) OVER w > 4.0 THEN 'Premium/Reliable'
         WHEN avg(avg_cost) OVER w < (SELECT median(avg_cost) FROM vendor_stats_cte) THEN 'Budget/Cheap'
         WHEN avg(on_time_pct) OVER w < 85 THEN 'Unreliable' ELSE 'Balanced' END AS type
  FROM (SELECT *, CASE WHEN reliability_score >= 90 THEN 0 WHEN reliability_score >= 85 THEN 1
                       WHEN reliability_score >= 80 THEN 2 ELSE 3 END AS cluster FROM vendor_stats_cte) v
  WINDOW w AS (PARTITION BY cluster)) z""")


@query("carrier_options", """
SELECT e.shipment_id, e.rank, e.carrier_code, e.carrier_name AS carrier, e.delivery_partner,
  round(e.predicted_cost, 6) AS predicted_cost, round(e.predicted_on_time_pct, 6) AS predicted_on_time_pct,
  round(e.predicted_carbon_gco2, 6) AS predicted_carbon_gco2, e.meets_sla, e.cost_inr, e.carbon_kg,
  pc.cluster, pc.cluster_type
FROM opt_eval e LEFT JOIN partner_cluster pc ON pc.delivery_partner = e.delivery_partner""")
def q_carrier_options(spark, sf):
    e = _exploded(spark, sf, fields=["rank", "carrier_code", "carrier_name", "delivery_partner", "predicted_cost",
                                     "predicted_on_time_pct", "predicted_carbon_gco2", "meets_sla", "cost_inr", "carbon_kg"])
    stats = vendors.vendor_stats(views.deliveries(spark, sf, ["delivery_partner", "delivery_cost", "distance_km",
                                                              "delayed", "delivery_rating"]))
    clusters = option_clusters(stats)
    return (e.join(F.broadcast(clusters), "delivery_partner", "left")
            .select("shipment_id", F.col("rank").cast("long").alias("rank"), "carrier_code",
                    F.col("carrier_name").alias("carrier"), "delivery_partner", r6("predicted_cost").alias("predicted_cost"),
                    r6("predicted_on_time_pct").alias("predicted_on_time_pct"),
                    r6("predicted_carbon_gco2").alias("predicted_carbon_gco2"), "meets_sla", "cost_inr", "carbon_kg",
                    "cluster", "cluster_type"))


def option_clusters(stats):
    """Partner -> (cluster id, cluster type): the fixed-rule clusters of ``vendors.cluster_profiles``."""
    with_c = vendors.cluster_rule(stats)
    prof = vendors.cluster_profiles(with_c).select("cluster", F.col("type").alias("cluster_type"))
    return with_c.select("delivery_partner", "cluster").join(prof, "cluster")


@query("option_cluster_join", """
SELECT e.shipment_id, e.carrier_code, e.delivery_partner, pc.cluster, pc.cluster_type
FROM opt_eval e LEFT JOIN partner_cluster pc ON pc.delivery_partner = e.delivery_partner""")
def q_option_cluster_join(spark, sf):
    e = _exploded(spark, sf, fields=["carrier_code", "delivery_partner"])
    stats = vendors.vendor_stats(views.deliveries(spark, sf, ["delivery_partner", "delivery_cost", "distance_km",
                                                              "delayed", "delivery_rating"]))
    return (e.join(F.broadcast(option_clusters(stats)), "delivery_partner", "left")
            .select("shipment_id", "carrier_code", "delivery_partner", "cluster", "cluster_type"))


@query("sla_filter", """
SELECT shipment_id, carrier_code, round(predicted_on_time_pct, 6) AS predicted_on_time_pct, threshold_pct
FROM opt_eval WHERE predicted_on_time_pct >= threshold_pct""")
def q_sla_filter(spark, sf):
    e = _exploded(spark, sf, ["shipment_id", "threshold_pct"], ["carrier_code", "predicted_on_time_pct", "meets_sla"]).where(F.col("meets_sla"))
    return e.select("shipment_id", "carrier_code", r6("predicted_on_time_pct").alias("predicted_on_time_pct"),
                    "threshold_pct")


@query("shipments_without_options", """
SELECT r.shipment_id, r.pkg AS package_type, r.origin, r.destination, r.route_weight_kg, r.origin_region
FROM req_quote r ANTI JOIN opt_quotes q USING (shipment_id)""")
def q_shipments_without_options(spark, sf):
    o = _decided(spark, sf)
    return o.where(F.col("num_options") == 0).select("shipment_id", F.col("pkg").alias("package_type"), "origin",
                                                   "destination", "route_weight_kg", "origin_region")


@query("route_choice", """
SELECT shipment_id, carrier_code, delivery_partner, vehicle_type, round(predicted_cost, 6) AS cost,
  round(predicted_on_time_pct, 6) AS predicted_on_time, round(transport_carbon_gco2, 6) AS transport_carbon_gco2,
  round(ai_carbon_gco2, 12) AS ai_carbon_gco2, round(total_carbon_gco2, 6) AS total_carbon_gco2,
  meets_sla AS meets_constraint,
  round(CASE WHEN stakes = 'standard' THEN total_carbon_gco2 ELSE predicted_cost END, 6) AS objective_value
FROM opt_best""")
def q_route_choice(spark, sf):
    d = _decided(spark, sf, carry=[]).where(F.col("num_options") > 0)
    b = F.col("best")
    return d.select("shipment_id", b["carrier_code"].alias("carrier_code"), b["delivery_partner"].alias("delivery_partner"),
                    b["vehicle_type"].alias("vehicle_type"), r6(b["predicted_cost"]).alias("cost"),
                    r6(b["predicted_on_time_pct"]).alias("predicted_on_time"),
                    r6(b["transport_carbon_gco2"]).alias("transport_carbon_gco2"),
                    F.round(b["ai_carbon_gco2"], 12).alias("ai_carbon_gco2"),
                    r6(b["total_carbon_gco2"]).alias("total_carbon_gco2"), b["meets_sla"].alias("meets_constraint"),
                    r6(F.when(F.col("stakes") == "standard", b["total_carbon_gco2"]).otherwise(b["predicted_cost"]))
                    .alias("objective_value"))


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in dims.STAKES_AGENT_LABEL)


@query("stakes_decision", f"""
SELECT b.shipment_id, CASE b.stakes {_LABELS} ELSE 'low_stakes' END AS agent_type, b.threshold_pct AS on_time_threshold,
  CASE WHEN b.stakes = 'standard' THEN 'carbon' ELSE r.priority END AS priority,
  CASE WHEN b.stakes = 'standard' THEN false ELSE r.cold_chain_multiplier > 1.0::DOUBLE END AS cold_chain_required,
  round(CASE WHEN b.total_carbon_gco2 > 0 THEN b.predicted_on_time_pct / b.total_carbon_gco2 ELSE 0.0 END * 1e6, 6) AS casp_e6
FROM opt_best b JOIN req_quote r USING (shipment_id)""")
def q_stakes_decision(spark, sf):
    d = _decided(spark, sf).where(F.col("num_options") > 0)
    return d.select("shipment_id", "agent_type", F.col("threshold_pct").alias("on_time_threshold"),
                    F.col("decision_priority").alias("priority"), "cold_chain_required",
                    r6(F.col("casp_score") * 1e6).alias("casp_e6"))


@query("carbon_savings", """
SELECT b.shipment_id, f.carrier_code AS baseline_lowest_on_time_carrier,
  round((f.total_carbon_gco2 - b.total_carbon_gco2) / f.total_carbon_gco2 * 100, 6) AS carbon_savings_pct
FROM opt_best b JOIN opt_fast f USING (shipment_id)
WHERE b.stakes = 'standard' AND f.total_carbon_gco2 > 0""")
def q_carbon_savings(spark, sf):
    d = _decided(spark, sf).where((F.col("num_options") > 0) & (F.col("stakes") == "standard"))  # carbon of an option is positive
    return d.select("shipment_id", "baseline_lowest_on_time_carrier", r6("carbon_savings_pct").alias("carbon_savings_pct"))


@query("greenest_viable", f"""
SELECT shipment_id, carrier_name AS greenest_viable, round(predicted_carbon_gco2, 6) AS transport_carbon_gco2,
  {AI_SERVICE} AS ai_carbon_gco2, round(predicted_carbon_gco2 + {AI_SERVICE}, 6) AS total_carbon_gco2
FROM opt_green""")
def q_greenest_viable(spark, sf):
    d = _decided(spark, sf).where(F.col("num_options") > 0)
    g = F.col("greenest_carbon_gco2")
    return d.select("shipment_id", "greenest_viable", r6(g).alias("transport_carbon_gco2"),
                    F.lit(choice.CARBON_SERVICE_AI_GCO2).alias("ai_carbon_gco2"),
                    r6(g + F.lit(choice.CARBON_SERVICE_AI_GCO2)).alias("total_carbon_gco2"))


@query("constraint_warning", """
SELECT shipment_id, carrier_code, meets_sla,
  CASE WHEN meets_sla THEN '' ELSE printf('On-time %.1f%% below threshold %.0f%%.', round(predicted_on_time_pct, 1),
                                          round(threshold_pct, 0)) END AS warning
FROM opt_eval""")
def q_constraint_warning(spark, sf):
    e = _exploded(spark, sf, ["shipment_id", "threshold_pct"], ["carrier_code", "predicted_on_time_pct", "meets_sla"])
    return e.select("shipment_id", "carrier_code", "meets_sla",
                    choice.constraint_warning(F.col("predicted_on_time_pct"), F.col("threshold_pct"),
                                              F.col("meets_sla")).alias("warning"))


@query("cost_vs_benchmark", """
SELECT b.shipment_id, floor(bb.bench * 100 + 0.5) / 100 AS industry_benchmark, round(b.predicted_cost, 6) AS cost,
  round((bb.bench - b.predicted_cost) / bb.bench * 100, 6) AS benchmark_pct,
  CASE WHEN b.predicted_cost < bb.bench THEN 'Below benchmark' ELSE 'Above benchmark' END AS efficiency
FROM opt_best b JOIN opt_bench bb USING (shipment_id) WHERE bb.bench > 0""")
def q_cost_vs_benchmark(spark, sf):
    d = _decided(spark, sf).where(F.col("num_options") > 0)  # no quote is below the minimum price
    bench, cost = F.col("industry_benchmark_raw"), F.col("best")["predicted_cost"]
    return d.select("shipment_id", round_half_up(bench, 2).alias("industry_benchmark"), r6(cost).alias("cost"),
                    r6("benchmark_pct").alias("benchmark_pct"),
                    F.when(cost < bench, "Below benchmark").otherwise("Above benchmark").alias("efficiency"))


@query("casp_score", """
SELECT shipment_id, carrier_code,
  round(CASE WHEN total_carbon_gco2 > 0 THEN predicted_on_time_pct / total_carbon_gco2 ELSE 0.0 END * 1e6, 6) AS casp_e6
FROM opt_eval""")
def q_casp_score(spark, sf):
    e = _exploded(spark, sf)
    return e.select("shipment_id", "carrier_code",
                    r6(casp(F.col("predicted_on_time_pct"), F.col("total_carbon_gco2")) * 1e6).alias("casp_e6"))


_ML_WH = f"{dict(dims.MODEL_ENERGY_WH)[carbon.ML_MODEL]!r}::DOUBLE"
_LLM_G = f"{carbon.inference_carbon_value(carbon.LLM_MODEL, 'india', carbon.LLM_CALLS)!r}::DOUBLE"


@query("optimization_ai_carbon", f"""
SELECT shipment_id, num_routes, num_routes * 3 AS ml_inferences,
  round(({_ML_WH} * (num_routes * 3)) / 1000 * 708.0::DOUBLE, 12) AS ml_carbon_gco2,
  round({_LLM_G}, 12) AS llm_carbon_gco2,
  round(({_ML_WH} * (num_routes * 3)) / 1000 * 708.0::DOUBLE + {_LLM_G}, 12) AS total_ai_carbon_gco2
FROM (SELECT shipment_id, CAST(count(*) AS INTEGER) AS num_routes FROM opt_quotes GROUP BY shipment_id) x""")
def q_optimization_ai_carbon(spark, sf):
    o = _decided(spark, sf).where(F.col("num_options") > 0).select("shipment_id", F.col("num_options").alias("num_routes"))
    r = carbon.optimization_ai_carbon(spark, o)
    return r.select("shipment_id", "num_routes", "ml_inferences",
                    *[F.round(c, 12).alias(c) for c in ("ml_carbon_gco2", "llm_carbon_gco2", "total_ai_carbon_gco2")])


@query("ai_carbon_roi", """
WITH base AS (SELECT shipment_id, avg(round(transport_carbon_gco2 * 1e6)) / 1e6 AS without_ai, any_value(n_opts) AS n
              FROM opt_eval GROUP BY 1),
     t AS (SELECT b.shipment_id, base.without_ai AS w0, b.transport_carbon_gco2 AS w1,
             ((1e-5 * (base.n * 3)) / 1000 * 708.0::DOUBLE) AS ai
           FROM opt_best b JOIN base USING (shipment_id))
SELECT shipment_id, floor(w0 * 1e6 + 0.5) / 1e6 AS baseline_transport_gco2, floor(w1 * 1e6 + 0.5) / 1e6 AS optimized_transport_gco2,
  floor((w0 - w1) * 1e6 + 0.5) / 1e6 + 0.0 AS transport_savings_gco2, round(ai, 12) AS ai_compute_carbon_gco2,
  floor((w0 - (w1 + ai)) * 1e6 + 0.5) / 1e6 + 0.0 AS net_carbon_savings_gco2,
  round(CASE WHEN ai > 0 THEN (w0 - w1) / ai END, 3) + 0.0 AS carbon_roi,
  w0 - (w1 + ai) > 0 AS ai_worth_it,
  round(CASE WHEN w0 > 0 THEN (w0 - (w1 + ai)) / w0 * 100 ELSE 0 END, 6) + 0.0 AS savings_percentage,
  CASE WHEN w0 - (w1 + ai) < 0 THEN 'AI adds more carbon than it saves'
       WHEN (w0 - w1) / ai > 100 THEN 'Excellent ROI' WHEN (w0 - w1) / ai > 10 THEN 'Good ROI'
       WHEN (w0 - w1) / ai > 1 THEN 'Positive ROI' ELSE 'Marginal benefit' END AS interpretation
FROM t""")
def q_ai_carbon_roi(spark, sf):
    d = _decided(spark, sf).where(F.col("num_options") > 0)
    n = F.col("num_options")
    w0 = F.col("mean_option_transport_gco2")
    w1 = F.col("best")["transport_carbon_gco2"]
    ai = (F.lit(1e-5) * (n * 3)) / 1000 * F.lit(708.0)
    c = carbon.ai_carbon_roi(w0, w1, ai)
    return d.select("shipment_id", (round_half_up(c["baseline_transport_gco2"], 6) + F.lit(0.0)).alias("baseline_transport_gco2"),
                    (round_half_up(c["optimized_transport_gco2"], 6) + F.lit(0.0)).alias("optimized_transport_gco2"),
                    (round_half_up(c["transport_savings_gco2"], 6) + F.lit(0.0)).alias("transport_savings_gco2"),
                    F.round(c["ai_compute_carbon_gco2"], 12).alias("ai_compute_carbon_gco2"),
                    (round_half_up(c["net_carbon_savings_gco2"], 6) + F.lit(0.0)).alias("net_carbon_savings_gco2"),
                    (F.round(c["carbon_roi"], 3) + F.lit(0.0)).alias("carbon_roi"), c["ai_worth_it"].alias("ai_worth_it"),
                    r6(c["savings_percentage"]).alias("savings_percentage"),
                    c["interpretation"].alias("interpretation"))


FLAGSHIP_SQL = f"""
SELECT r.shipment_id, r.pkg AS package_type, r.origin, r.destination, round(r.route_distance_km, 6) AS distance_km,
  CAST(coalesce(bb.n, 0) AS INTEGER) AS num_options,
  b.delivery_partner AS recommendation, b.carrier_code,
  round(b.predicted_cost, 6) AS cost, round(b.predicted_on_time_pct, 6) AS on_time_probability,
  round(b.transport_carbon_gco2, 6) AS transport_carbon_gco2, round(b.total_carbon_gco2, 6) AS total_carbon_gco2,
  CASE WHEN b.shipment_id IS NOT NULL THEN {AI_SERVICE} END AS ai_carbon_gco2,
  CASE WHEN b.shipment_id IS NOT NULL THEN round(CASE WHEN b.total_carbon_gco2 > 0 THEN b.predicted_on_time_pct / b.total_carbon_gco2 ELSE 0.0 END * 1e6, 6) END AS casp_e6,
  b.meets_sla AS meets_constraint,
  CASE WHEN b.shipment_id IS NULL THEN NULL WHEN b.meets_sla THEN ''
       ELSE printf('On-time %.1f%% below threshold %.0f%%.', round(b.predicted_on_time_pct, 1), round(r.threshold_pct, 0)) END AS warning,
  r.risk_level, round(r.risk_score, 6) AS risk_score, r.risk_factors_text AS risk_factors, r.warnings_text AS warnings,
  r.recommended_buffer_days,
  g.carrier_name AS greenest_viable,
  floor(bb.bench * 100 + 0.5) / 100 AS industry_benchmark,
  CASE WHEN bb.bench > 0 THEN CASE WHEN b.predicted_cost < bb.bench THEN 'Below benchmark' ELSE 'Above benchmark' END END AS efficiency,
  CASE WHEN bb.bench > 0 THEN printf('%.1f%% %s benchmark', round((bb.bench - b.predicted_cost) / bb.bench * 100, 1) + 0.0,
       CASE WHEN (bb.bench - b.predicted_cost) / bb.bench * 100 > 0 THEN 'below' ELSE 'above' END) END AS efficiency_percentage,
  CASE WHEN b.shipment_id IS NULL THEN 'No carrier options found for this shipment' END AS error
FROM req_quote r
LEFT JOIN opt_best b USING (shipment_id)
LEFT JOIN opt_green g USING (shipment_id)
LEFT JOIN (SELECT shipment_id, avg(round(cost_inr * 100)) FILTER (WHERE cost_inr > 0) / 100 AS bench, count(*) AS n
           FROM opt_eval GROUP BY shipment_id) bb USING (shipment_id)"""


@query("integrated_recommendation", FLAGSHIP_SQL)
def q_integrated_recommendation(spark, sf):
    return pipelines.integrated_recommendation(spark, _requests(spark, sf), _history(spark, sf), city_weather=_city_weather(spark, sf))
