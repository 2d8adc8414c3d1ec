"""Registered queries: transport carbon, AI-compute carbon, countries and the inference ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.operators import carbon
from cargolens.plans.catalog import query
from cargolens.plans.sqlkit import register
from cargolens.sources import dims, views


def _d(spark, sf, *cols):
    return views.deliveries(spark, sf, list(cols) if cols else None)


@query("transport_carbon", """
SELECT d.delivery_id, d.package_type, d.vehicle_type, d.distance_km,
  coalesce(v.gco2_per_km, 800.0::DOUBLE) AS gco2_per_km,
  coalesce(p.cold_chain_multiplier, 1.0::DOUBLE) AS cold_chain_multiplier,
  d.distance_km * coalesce(v.gco2_per_km, 800.0::DOUBLE) * coalesce(p.cold_chain_multiplier, 1.0::DOUBLE)
    AS transport_carbon_gco2
FROM deliveries d
LEFT JOIN dim_vehicle v ON lower(d.vehicle_type) = v.vehicle_type
LEFT JOIN dim_policy p ON lower(d.package_type) = p.package_type""")
def q_transport_carbon(spark, sf):
    return carbon.transport_carbon(spark, _d(spark, sf, "delivery_id", "package_type", "vehicle_type", "distance_km"))


register("inf_carbon", """
SELECT l.inference_id, l.model, l.country, l.num_inferences,
  coalesce(m.energy_wh, 0.001::DOUBLE) AS energy_per_inference_wh,
  coalesce(m.energy_wh, 0.001::DOUBLE) * l.num_inferences AS total_energy_wh,
  (coalesce(m.energy_wh, 0.001::DOUBLE) * l.num_inferences) / 1000 AS total_energy_kwh,
  coalesce(g.gco2_kwh, 400.0::DOUBLE) AS grid_intensity_gco2_kwh,
  (coalesce(m.energy_wh, 0.001::DOUBLE) * l.num_inferences) / 1000 * coalesce(g.gco2_kwh, 400.0::DOUBLE) AS carbon_gco2,
  (coalesce(m.energy_wh, 0.001::DOUBLE) * l.num_inferences) / 1000 * coalesce(g.gco2_kwh, 400.0::DOUBLE) / 1000 AS carbon_kg
FROM inference_log l
LEFT JOIN dim_model m ON lower(l.model) = m.model
LEFT JOIN dim_grid g ON lower(l.country) = g.country""")


@query("inference_carbon", "SELECT * FROM inf_carbon")
def q_inference_carbon(spark, sf):
    return carbon.inference_carbon(spark, views.inference_log(spark, sf))


_SCALED = ", ".join(f"'{m}'" for m in dims.TOKEN_SCALED_MODELS)


@query("token_scaled_carbon", f"""
SELECT inference_id, model, country, tokens, base_wh, scaled_wh, scaled_wh / 1000 * grid AS carbon_gco2
FROM (SELECT l.inference_id, l.model, l.country, l.tokens, coalesce(m.energy_wh, 0.001::DOUBLE) AS base_wh,
        CASE WHEN lower(l.model) IN ({_SCALED})
             THEN coalesce(m.energy_wh, 0.001::DOUBLE) * sqrt(l.tokens / 500.0::DOUBLE)
             ELSE coalesce(m.energy_wh, 0.001::DOUBLE) END AS scaled_wh,
        coalesce(g.gco2_kwh, 400.0::DOUBLE) AS grid
      FROM inference_log l LEFT JOIN dim_model m ON lower(l.model) = m.model
      LEFT JOIN dim_grid g ON lower(l.country) = g.country) x""")
def q_token_scaled_carbon(spark, sf):
    return carbon.token_scaled_carbon(spark, views.inference_log(spark, sf))


@query("energy_to_carbon", """
SELECT inference_id, country, energy_wh, energy_joules, kwh AS energy_kwh, grid AS grid_gco2_kwh,
  kwh * grid AS carbon_gco2, kwh IS NULL AS error
FROM (SELECT l.*, CASE WHEN energy_wh IS NOT NULL THEN energy_wh / 1000
                       WHEN energy_joules IS NOT NULL THEN energy_joules / 3600000.0::DOUBLE END AS kwh,
        coalesce(g.gco2_kwh, 400.0::DOUBLE) AS grid
      FROM inference_log l LEFT JOIN dim_grid g ON lower(l.country) = g.country) x""")
def q_energy_to_carbon(spark, sf):
    return carbon.energy_to_carbon(spark, views.inference_log(spark, sf))


_AI3 = f"{carbon.optimization_ai_carbon_value(3, 'india', True)!r}::DOUBLE"


@query("carbon_by_package", f"""
SELECT k.package_type, k.display_name,
  coalesce(CAST(round_even(a.avg_transport + {_AI3}, 0) AS BIGINT), 350000) AS carbon_gco2,
  CAST(round(p.on_time_threshold * 100, 0) AS INTEGER) AS service_pct, k.ypos
FROM (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in carbon.DISPLAY_YPOS)}) k(package_type, display_name, ypos)
JOIN dim_policy p ON p.package_type = k.package_type
LEFT JOIN (SELECT lower(d.package_type) AS package_type,
             avg(d.distance_km * coalesce(v.gco2_per_km, 800.0::DOUBLE) * coalesce(q.cold_chain_multiplier, 1.0::DOUBLE)) AS avg_transport
           FROM deliveries d LEFT JOIN dim_vehicle v ON lower(d.vehicle_type) = v.vehicle_type
           LEFT JOIN dim_policy q ON lower(d.package_type) = q.package_type GROUP BY 1) a
  ON a.package_type = k.package_type""")
def q_carbon_by_package(spark, sf):
    return carbon.carbon_by_package(spark, _d(spark, sf, "package_type", "vehicle_type", "distance_km"))


@query("casp_by_country", f"""
SELECT c.country, round(CASE WHEN a.t + c.ai > 0 THEN 0.99::DOUBLE / (a.t + c.ai) ELSE 0 END * 1e6, 2) AS casp_e6
FROM (VALUES {", ".join(f"('{n}', {carbon.optimization_ai_carbon_value(3, code, True)!r}::DOUBLE)" for n, code in carbon.CASP_COUNTRIES)}) c(country, ai)
CROSS JOIN (SELECT avg(d.distance_km * coalesce(v.gco2_per_km, 800.0::DOUBLE) * 2.5::DOUBLE) AS t
            FROM deliveries d LEFT JOIN dim_vehicle v ON lower(d.vehicle_type) = v.vehicle_type
            WHERE lower(d.package_type) = 'pharmacy') a""")
def q_casp_by_country(spark, sf):
    return carbon.casp_by_country(spark, _d(spark, sf, "package_type", "vehicle_type", "distance_km"))


_CC = ", ".join(f"('{c}', {i}, {dict(dims.GRID_GCO2_PER_KWH)[c]!r}::DOUBLE)" for i, c in enumerate(carbon.COMPARE_COUNTRIES))


@query("country_extremes", f"""
WITH w AS (SELECT l.model, sum(l.num_inferences) AS total_inferences FROM inference_log l GROUP BY l.model),
     p AS (SELECT w.model, w.total_inferences, c.country, c.seq,
             (coalesce(m.energy_wh, 0.001::DOUBLE) * w.total_inferences) / 1000 * c.grid AS g
           FROM w LEFT JOIN dim_model m ON lower(w.model) = m.model
           CROSS JOIN (VALUES {_CC}) c(country, seq, grid))
SELECT model, CAST(total_inferences AS BIGINT) AS total_inferences,
  first(country ORDER BY g, seq) AS cleanest_country, round(first(g ORDER BY g, seq) * 1000, 6) AS cleanest_mg,
  first(country ORDER BY g DESC, seq DESC) AS dirtiest_country, round(first(g ORDER BY g DESC, seq DESC) * 1000, 6) AS dirtiest_mg,
  round(CASE WHEN min(g) > 0 THEN max(g) / min(g) ELSE 'inf'::DOUBLE END, 6) AS ratio
FROM p GROUP BY model, total_inferences""")
def q_country_extremes(spark, sf):
    return carbon.country_extremes(spark, views.inference_log(spark, sf))


PIVOT_MODELS = list(views.M)


@query("model_country_pivot", "SELECT country, " + ", ".join(
    f"round(coalesce(sum(CASE WHEN model = '{m}' THEN carbon_gco2 * 1000 END), 0.0), 2) AS {carbon._safe(m)}"
    for m in PIVOT_MODELS) + ", round(coalesce(sum(CASE WHEN model IN (" + ", ".join(f"'{m}'" for m in PIVOT_MODELS)
    + ") THEN NULL ELSE carbon_gco2 * 1000 END), 0.0), 2) AS other FROM inf_carbon GROUP BY country")
def q_model_country_pivot(spark, sf):
    return carbon.model_country_pivot(spark, views.inference_log(spark, sf), PIVOT_MODELS)


@query("inference_ledger_totals", """
WITH per AS (SELECT model, country, sum(num_inferences) AS n, sum(carbon_gco2) AS g FROM inf_carbon GROUP BY ALL),
     u AS (SELECT 'model_country' AS scope, model, country, n, g FROM per
           UNION ALL SELECT 'overall', NULL, NULL, sum(n), sum(g) FROM per)
SELECT scope, model, country, CAST(n AS BIGINT) AS total_inferences, round(g, 9) AS total_carbon_gco2,
  round(g / 1000, 12) AS total_carbon_kg,
  round(CASE WHEN n > 0 THEN g / n ELSE 0 END, 12) AS avg_carbon_per_inference_gco2
FROM u""")
def q_inference_ledger_totals(spark, sf):
    return carbon.inference_ledger_totals(spark, views.inference_log(spark, sf))


_GRID_SEQ = ", ".join(f"('{c}', {i}, {g!r}::DOUBLE)" for i, (c, g) in enumerate(dims.GRID_GCO2_PER_KWH))


@query("country_ai_carbon_sorted", f"""
WITH j AS (SELECT model, sum(energy_joules) AS energy_joules FROM inference_log GROUP BY model),
     p AS (SELECT j.model, c.country, c.seq, c.grid AS grid_intensity_gco2_kwh, j.energy_joules,
             j.energy_joules / 3600000.0::DOUBLE * c.grid AS carbon
           FROM j CROSS JOIN (VALUES {_GRID_SEQ}) c(country, seq, grid))
SELECT model, country, grid_intensity_gco2_kwh, energy_joules, round(carbon, 6) AS ai_compute_carbon_gco2,
  row_number() OVER (PARTITION BY model ORDER BY carbon, seq) AS carbon_rank
FROM p""")
def q_country_ai_carbon_sorted(spark, sf):
    return carbon.country_ai_carbon_sorted(spark, views.inference_log(spark, sf)).withColumn(
        "carbon_rank", F.col("carbon_rank").cast("long"))
