"""Registered queries: grid lookup chain, carbon analysis and optimize-delivery composites."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.exprs import r6
from cargolens.operators import choice, quotes
from cargolens.plans import q_choice
from cargolens.plans.catalog import query
from cargolens.sources import dims, views


@query("join_region_country_grid", f"""
SELECT d.delivery_id, d.region, coalesce(rc.country, '{dims.DEFAULT_COUNTRY}') AS country,
  coalesce(g.gco2_kwh, {dims.DEFAULT_GRID_GCO2_PER_KWH!r}::DOUBLE) AS grid_gco2_kwh
FROM deliveries d LEFT JOIN dim_region_country rc ON lower(d.region) = rc.region
LEFT JOIN dim_grid g ON coalesce(rc.country, '{dims.DEFAULT_COUNTRY}') = g.country""")
def q_join_region_country_grid(spark, sf):
    d = views.deliveries(spark, sf, ["delivery_id", "region"])
    country = F.coalesce(dims.lookup("dim_region_country", F.lower("region"))["country"], F.lit(dims.DEFAULT_COUNTRY))
    grid = F.coalesce(dims.lookup("dim_grid", country)["gco2_kwh"], F.lit(dims.DEFAULT_GRID_GCO2_PER_KWH))
    return d.select("delivery_id", "region", country.alias("country"), grid.alias("grid_gco2_kwh"))


_INDIA = dict(dims.GRID_GCO2_PER_KWH)["india"]


@query("carbon_analysis", f"""
SELECT g.shipment_id, r.stakes AS stakes_level, g.carrier_name AS greenest_viable,
  round(g.predicted_carbon_gco2, 6) AS transport_carbon_gco2, {q_choice.AI_SERVICE} AS ai_carbon_gco2,
  round(g.predicted_carbon_gco2 + {q_choice.AI_SERVICE}, 6) AS total_carbon_gco2,
  {_INDIA!r}::DOUBLE AS grid_intensity_gco2_kwh
FROM opt_green g JOIN req_quote r USING (shipment_id)""")
def q_carbon_analysis(spark, sf):
    d = q_choice._decided(spark, sf).where(F.col("num_options") > 0)
    g = F.col("greenest_carbon_gco2")
    return d.select("shipment_id", F.col("stakes").alias("stakes_level"), "greenest_viable",
                    r6(g).alias("transport_carbon_gco2"), F.lit(choice.CARBON_SERVICE_AI_GCO2).alias("ai_carbon_gco2"),
                    r6(g + F.lit(choice.CARBON_SERVICE_AI_GCO2)).alias("total_carbon_gco2"),
                    F.lit(_INDIA).alias("grid_intensity_gco2_kwh"))


@query("optimize_delivery", f"""
WITH b AS (
  SELECT b.shipment_id, b.carrier_code, b.delivery_partner, b.predicted_cost, b.predicted_on_time_pct, b.total_carbon_gco2,
    r.stakes, r.route_weather, r.route_distance_km, r.route_weight_kg, r.impact_multiplier,
    coalesce(pw.late / pw.n, pr.r, g.r) AS p, pr.r AS prate
  FROM opt_best b JOIN req_quote r USING (shipment_id)
  LEFT JOIN hist_rates pw ON pw.delivery_partner = b.delivery_partner AND pw.weather_condition = r.route_weather
  LEFT JOIN partner_rates pr ON pr.delivery_partner = b.delivery_partner CROSS JOIN global_rate g),
s AS (SELECT *, p * impact_multiplier AS s1 FROM b),
s2 AS (SELECT *, CASE WHEN route_weather = 'stormy' THEN s1 * 1.5::DOUBLE ELSE s1 END AS s2 FROM s),
s3 AS (SELECT *, CASE WHEN route_distance_km > 250 AND route_weight_kg > 40 THEN s2 * 1.3::DOUBLE ELSE s2 END AS s3 FROM s2),
s4 AS (SELECT *, CASE WHEN coalesce(prate > 0.15::DOUBLE, false) THEN s3 * 1.2::DOUBLE ELSE s3 END AS score FROM s3)
SELECT shipment_id, carrier_code, stakes, round(predicted_cost, 6) AS cost, round(predicted_on_time_pct, 6) AS service_level,
  round(total_carbon_gco2, 6) AS carbon_gco2,
  round(CASE WHEN total_carbon_gco2 > 0 THEN predicted_on_time_pct / total_carbon_gco2 ELSE 0.0 END * 1e6, 6) AS casp_e6,
  round(score, 6) AS route_risk_score,
  CASE WHEN score > 5 THEN 'CRITICAL' WHEN score > 3 THEN 'HIGH' WHEN score > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS route_risk_level
FROM s4""")
def q_optimize_delivery(spark, sf):
    """Route choice + early warning on the chosen route + stakes (governance key) + frontier point."""
    d = q_choice._decided(spark, sf, carry=["impact_multiplier", "route_weather", "route_distance_km", "route_weight_kg",
                                            "route_rates", "partner_rates"]).where(F.col("num_options") > 0)
    b = F.col("best")
    place = F.array_position(F.lit(quotes.CARRIER_PARTNERS), b["delivery_partner"]).cast("int")
    partner_rate, p_partner = F.element_at("route_rates", place), F.element_at("partner_rates", place)
    cols = quotes.risk_columns(partner_rate, F.col("impact_multiplier"), F.col("route_weather"),
                               F.col("route_distance_km"), F.col("route_weight_kg"), b["delivery_partner"], p_partner)
    return d.select("shipment_id", b["carrier_code"].alias("carrier_code"), "stakes",
                    r6(b["predicted_cost"]).alias("cost"), r6(b["predicted_on_time_pct"]).alias("service_level"),
                    r6(b["total_carbon_gco2"]).alias("carbon_gco2"), r6(F.col("casp_score") * 1e6).alias("casp_e6"),
                    r6(cols["risk_score"]).alias("route_risk_score"), cols["risk_level"].alias("route_risk_level"))
