"""Registered queries: delivery risk, alerts, governance, frontiers, forecast failures, consistency."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cargolens.functions.exprs import checked_broadcast, late_flag, r6, with_policy
from cargolens.operators import carbon, frontier, governance, quotes, risk, vendors
from cargolens.plans import q_choice
from cargolens.plans.catalog import query
from cargolens.plans.sqlkit import register
from cargolens.sources import views

LATE = "CASE WHEN delayed = 'yes' THEN 1 ELSE 0 END"
SCORE_COLS = ["delivery_id", "package_type", "delivery_partner", "weather_condition", "distance_km",
              "package_weight_kg", "delayed"]
RISK_COLS = [*SCORE_COLS, "delivery_cost", "vehicle_type", "region"]  # the last needs the supplier join


def _scored(spark, sf):
    d = views.deliveries(spark, sf, SCORE_COLS)
    return risk.score(risk.with_history(d, d), spark)


register("del_risk", f"""
SELECT *,
  CASE WHEN risk_score > 5 THEN 'CRITICAL' WHEN risk_score > 3 THEN 'HIGH' WHEN risk_score > 1.5 THEN 'MEDIUM'
       ELSE 'LOW' END AS risk_level,
  risk_score > 5 AS alert_required,
  concat_ws(', ', f_storm, f_load, f_partner) AS risk_factors
FROM (SELECT *, CASE WHEN is_partner THEN s3 * 1.2::DOUBLE ELSE s3 END AS risk_score,
        CASE WHEN is_storm THEN '{quotes.RISK_FACTOR_STORM}' END AS f_storm,
        CASE WHEN is_load THEN '{quotes.RISK_FACTOR_LOAD}' END AS f_load,
        CASE WHEN is_partner THEN 'High-risk partner: ' || delivery_partner || ' (+20% risk)' END AS f_partner
      FROM (SELECT *, CASE WHEN is_load THEN s2 * 1.3::DOUBLE ELSE s2 END AS s3
            FROM (SELECT *, CASE WHEN is_storm THEN s1 * 1.5::DOUBLE ELSE s1 END AS s2
                  FROM (SELECT d.delivery_id, d.package_type, d.delivery_partner, d.weather_condition,
                          coalesce(pw.late / pw.n, pr.r, g.r) AS delay_probability, pr.r AS partner_delay_rate,
                          coalesce(pw.late / pw.n, pr.r, g.r) * coalesce(p.impact_multiplier, 1.5::DOUBLE) AS s1,
                          d.weather_condition = 'stormy' AS is_storm,
                          coalesce(d.distance_km, 0) > 250 AND coalesce(d.package_weight_kg, 0) > 40 AS is_load,
                          coalesce(pr.r > 0.15::DOUBLE, false) AND coalesce(d.delivery_partner, '') <> '' AS is_partner
                        FROM deliveries d
                        LEFT JOIN hist_rates pw ON pw.delivery_partner = d.delivery_partner
                                               AND pw.weather_condition = d.weather_condition
                        LEFT JOIN partner_rates pr ON pr.delivery_partner = d.delivery_partner
                        CROSS JOIN global_rate g
                        LEFT JOIN dim_policy p ON lower(d.package_type) = p.package_type) a) b) c) e""")


@query("risk_score", """
SELECT delivery_id, round(delay_probability, 6) AS delay_probability, round(risk_score, 6) AS risk_score,
  risk_level, alert_required, risk_factors FROM del_risk""")
def q_risk_score(spark, sf):
    s = _scored(spark, sf)
    return s.select("delivery_id", r6("delay_probability").alias("delay_probability"),
                    r6("risk_score").alias("risk_score"), "risk_level", "alert_required",
                    F.array_join("risk_factors", ", ").alias("risk_factors"))


@query("risk_buffer_warnings", f"""
SELECT delivery_id, risk_level,
  CASE risk_level WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 1 ELSE 0 END AS recommended_buffer_days,
  concat_ws('; ', f_storm, f_load, f_partner, CASE WHEN alert_required THEN '{quotes.ALERT_WARNING}' END) AS warnings
FROM del_risk""")
def q_risk_buffer_warnings(spark, sf):
    s = _scored(spark, sf)
    return s.select("delivery_id", "risk_level", "recommended_buffer_days",
                    F.array_join("warnings", "; ").alias("warnings"))


@query("alert_filter", """
SELECT package_type, risk_level, count(*) AS alerts FROM del_risk WHERE alert_required GROUP BY ALL""")
def q_alert_filter(spark, sf):
    s = _scored(spark, sf).where(F.col("alert_required"))
    return s.groupBy("package_type", "risk_level").agg(F.count(F.lit(1)).alias("alerts"))


@query("partner_delay_rate_join", """
SELECT delivery_id, delivery_partner, round(partner_delay_rate, 6) AS partner_delay_rate,
  coalesce(partner_delay_rate > 0.15::DOUBLE, false) AS high_risk_partner FROM del_risk""")
def q_partner_delay_rate_join(spark, sf):
    d = views.deliveries(spark, sf, RISK_COLS)
    j = risk.with_history(d, d)
    return j.select("delivery_id", "delivery_partner", r6("partner_delay_rate").alias("partner_delay_rate"),
                    F.coalesce(F.col("partner_delay_rate") > 0.15, F.lit(False)).alias("high_risk_partner"))


@query("high_risk_routes", f"""
WITH o AS (
  SELECT e.shipment_id, e.carrier_code, e.rank, e.delivery_partner, r.route_weather AS weather_condition,
    r.route_distance_km AS distance_km, r.route_weight_kg AS package_weight_kg, r.impact_multiplier,
    coalesce(pw.late / pw.n, pr.r, g.r) AS p, pr.r AS prate
  FROM opt_eval e JOIN req_quote r USING (shipment_id)
  LEFT JOIN hist_rates pw ON pw.delivery_partner = e.delivery_partner AND pw.weather_condition = r.route_weather
  LEFT JOIN partner_rates pr ON pr.delivery_partner = e.delivery_partner
  CROSS JOIN global_rate g),
s AS (SELECT *, weather_condition = 'stormy' AS st, distance_km > 250 AND package_weight_kg > 40 AS ld,
        coalesce(prate > 0.15::DOUBLE, false) AS pt FROM o),
t AS (SELECT *, CASE WHEN pt THEN (CASE WHEN ld THEN (CASE WHEN st THEN p * impact_multiplier * 1.5::DOUBLE
        ELSE p * impact_multiplier END) * 1.3::DOUBLE ELSE (CASE WHEN st THEN p * impact_multiplier * 1.5::DOUBLE
        ELSE p * impact_multiplier END) END) * 1.2::DOUBLE
      ELSE (CASE WHEN ld THEN (CASE WHEN st THEN p * impact_multiplier * 1.5::DOUBLE ELSE p * impact_multiplier END)
            * 1.3::DOUBLE ELSE (CASE WHEN st THEN p * impact_multiplier * 1.5::DOUBLE ELSE p * impact_multiplier END) END)
      END AS score FROM s)
SELECT shipment_id, carrier_code, round(score, 6) AS risk_score,
  CASE WHEN score > 5 THEN 'CRITICAL' WHEN score > 3 THEN 'HIGH' WHEN score > 1.5 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  score > 5 AS alert_required,
  concat_ws(', ', CASE WHEN st THEN '{quotes.RISK_FACTOR_STORM}' END, CASE WHEN ld THEN '{quotes.RISK_FACTOR_LOAD}' END,
            CASE WHEN pt THEN 'High-risk partner: ' || delivery_partner || ' (+20% risk)' END) AS risk_factors,
  row_number() OVER (PARTITION BY shipment_id ORDER BY score DESC, rank) AS risk_rank
FROM t""")
def q_high_risk_routes(spark, sf):
    e = q_choice._exploded(spark, sf, ["shipment_id", "pkg", "route_weather", "route_distance_km", "route_weight_kg"])
    e = e.select("shipment_id", "carrier_code", "rank", "delivery_partner", F.col("pkg").alias("package_type"),
                 F.col("route_weather").alias("weather_condition"), F.col("route_distance_km").alias("distance_km"),
                 F.col("route_weight_kg").alias("package_weight_kg"))
    hist = q_choice._history(spark, sf)
    s = risk.score(risk.with_history(e, hist), spark)
    w = Window.partitionBy("shipment_id").orderBy(F.col("risk_score").desc(), F.col("rank"))
    return s.select("shipment_id", "carrier_code", r6("risk_score").alias("risk_score"), "risk_level",
                    "alert_required", F.array_join("risk_factors", ", ").alias("risk_factors"),
                    F.row_number().over(w).cast("long").alias("risk_rank"))


@query("risk_assessment", """
SELECT shipment_id, pkg AS package_type, risk_weather, round(delay_probability, 6) AS delay_probability,
  round(risk_score, 6) AS risk_score, risk_level, risk_factors_text AS risk_factors, warnings_text AS warnings,
  recommended_buffer_days FROM req_quote""")
def q_risk_assessment(spark, sf):
    o = q_choice._options(spark, sf)
    return o.select("shipment_id", F.col("pkg").alias("package_type"), "risk_weather",
                    r6("delay_probability").alias("delay_probability"), r6("risk_score").alias("risk_score"),
                    "risk_level", F.array_join("risk_factors", ", ").alias("risk_factors"),
                    F.array_join("warnings", "; ").alias("warnings"), "recommended_buffer_days")


@query("merge_risk_factors", """
WITH obs AS (SELECT city, max_by(snippet, (ts, obs_id)) AS snippet FROM weather_obs GROUP BY city)
SELECT r.shipment_id, concat_ws(', ', nullif(r.risk_factors_text, ''),
  CASE WHEN obs.snippet <> 'no data' AND trim(obs.snippet) <> '' THEN obs.snippet END) AS risk_factors
FROM req_risk r LEFT JOIN obs ON obs.city = r.origin""")
def q_merge_risk_factors(spark, sf):
    """Model factors of each request merged with observed weather text at its origin (non-empty, new)."""
    o = q_choice._options(spark, sf).select("shipment_id", "origin", "risk_factors")
    obs = views.weather_obs(spark, sf).groupBy("city").agg(
        F.max_by("snippet", F.struct("ts", "obs_id")).alias("latest_snippet"))
    j = o.join(checked_broadcast(obs), F.col("origin") == F.col("city"), "left")
    ext = F.array(F.when(F.col("latest_snippet") != "no data", F.col("latest_snippet")))
    return j.select("shipment_id", F.array_join(risk.merge_risk_factors(F.col("risk_factors"), ext), ", ")
                    .alias("risk_factors"))


@query("governance_recommendations", """
SELECT g.stakes, g.seq, g.category, g.recommendation, g.rationale, s.shipments
FROM dim_governance g JOIN (SELECT stakes, count(*) AS shipments FROM req_norm GROUP BY stakes) s USING (stakes)""")
def q_governance_recommendations(spark, sf):
    r = quotes.normalize_shipments(q_choice._requests(spark, sf)).withColumn(
        "pkg", F.coalesce(F.when(F.col("package_type") != "", F.col("package_type")), F.lit("clothing")))
    return governance.governance_recommendations(spark, r, "pkg")


@query("portfolio_compliance", f"""
WITH rel AS (SELECT delivery_partner, 1 - sum({LATE}) / count(*) AS reliability FROM deliveries GROUP BY 1),
     ac AS (SELECT package_type, avg(delivery_cost) AS avg_cost FROM deliveries GROUP BY 1),
     j AS (SELECT d.package_type, d.vehicle_type, d.delivery_cost, rel.reliability, ac.avg_cost,
             CASE WHEN pk.scope IS NOT NULL THEN pk.vehicles ELSE st.vehicles END AS vehicles,
             CASE WHEN pk.scope IS NOT NULL THEN pk.min_reliability ELSE st.min_reliability END AS min_rel,
             CASE WHEN pk.scope IS NOT NULL THEN pk.max_cost_premium ELSE st.max_cost_premium END AS max_prem,
             CASE WHEN pk.scope IS NOT NULL THEN pk.buffer_percentage ELSE st.buffer_percentage END AS buf,
             pk.scope IS NOT NULL OR st.scope IS NOT NULL AS has_rule
           FROM deliveries d LEFT JOIN dim_policy p ON lower(d.package_type) = p.package_type
           LEFT JOIN rel ON rel.delivery_partner = d.delivery_partner LEFT JOIN ac ON ac.package_type = d.package_type
           LEFT JOIN dim_portfolio pk ON lower(d.package_type) = pk.scope
           LEFT JOIN dim_portfolio st ON coalesce(p.stakes, 'high_value') = st.scope)
SELECT package_type, count(*) AS deliveries,
  CAST(sum(CASE WHEN has_rule AND NOT list_contains(vehicles, vehicle_type) THEN 1 ELSE 0 END) AS BIGINT) AS vehicle_violations,
  CAST(sum(CASE WHEN has_rule AND reliability < min_rel THEN 1 ELSE 0 END) AS BIGINT) AS reliability_violations,
  CAST(sum(CASE WHEN has_rule AND delivery_cost / avg_cost > max_prem THEN 1 ELSE 0 END) AS BIGINT) AS cost_violations,
  max(buf) AS buffer_percentage
FROM j GROUP BY package_type""")
def q_portfolio_compliance(spark, sf):
    return governance.portfolio_compliance(spark, views.deliveries(spark, sf, RISK_COLS))


register("frontier_points", """
SELECT b.shipment_id, r.pkg AS package_type, round(b.total_carbon_gco2, 6) AS carbon_gco2,
  round(b.predicted_on_time_pct, 6) AS service_level, round(b.predicted_cost, 6) AS cost
FROM opt_best b JOIN req_quote r USING (shipment_id)""")


def _points(spark, sf):
    return frontier.decision_points(q_choice._decided(spark, sf, carry=["pkg"]))


@query("pareto_frontier", """
WITH a AS (SELECT package_type, service_level, min(carbon_gco2) AS carbon_gco2, count(*) AS points
           FROM frontier_points GROUP BY ALL)
SELECT package_type, service_level, carbon_gco2, points FROM (
  SELECT *, min(carbon_gco2) OVER (PARTITION BY package_type ORDER BY service_level DESC
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb FROM a) x
WHERE bb IS NULL OR carbon_gco2 < bb""")
def q_pareto_frontier(spark, sf):
    return frontier.pareto_frontier(_points(spark, sf))


def _frontier_sql(group: bool, dim: str) -> str:
    by, over = ("package_type, ", "PARTITION BY package_type ") if group else ("", "")
    return f"""
SELECT {by}service_level, {dim}, points FROM (
  SELECT *, min({dim}) OVER ({over}ORDER BY service_level DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb
  FROM (SELECT {by}service_level, min({dim}) AS {dim}, count(*) AS points FROM frontier_points GROUP BY ALL) a) x
WHERE bb IS NULL OR {dim} < bb"""


@query("pareto_frontier_cost", _frontier_sql(True, "cost"))
def q_pareto_frontier_cost(spark, sf):
    return frontier.pareto_frontier(_points(spark, sf), dim="cost")


@query("pareto_frontier_global", _frontier_sql(False, "carbon_gco2"))
def q_pareto_frontier_global(spark, sf):
    return frontier.pareto_frontier(_points(spark, sf), group=None)


@query("pareto_frontier_global_cost", _frontier_sql(False, "cost"))
def q_pareto_frontier_global_cost(spark, sf):
    return frontier.pareto_frontier(_points(spark, sf), group=None, dim="cost")


@query("pareto_frontier_points", f"""
SELECT shipment_id, package_type, carbon_gco2, service_level, cost FROM frontier_points
SEMI JOIN ({_frontier_sql(True, "carbon_gco2")}) USING (package_type, service_level, carbon_gco2)""")
def q_pareto_frontier_points(spark, sf):
    return frontier.frontier_points(_points(spark, sf)).select("shipment_id", "package_type", "carbon_gco2", "service_level", "cost")


@query("casp_ranking", """
SELECT *, row_number() OVER (PARTITION BY package_type ORDER BY casp_score DESC, shipment_id) AS casp_rank
FROM (SELECT *, CASE WHEN carbon_gco2 > 0 THEN service_level / carbon_gco2 ELSE 0.0 END AS casp_score
      FROM frontier_points) x""")
def q_casp_ranking(spark, sf):
    return frontier.casp_ranking(_points(spark, sf))


@query("tradeoff_extremes", """
WITH p AS (SELECT *, CASE WHEN carbon_gco2 > 0 THEN service_level / carbon_gco2 ELSE 0.0 END AS casp FROM frontier_points)
SELECT package_type, 'best_casp' AS criterion, first(shipment_id ORDER BY casp DESC, shipment_id) AS shipment_id,
       round(max(casp), 9) AS value FROM p GROUP BY 1
UNION ALL SELECT package_type, 'lowest_carbon', first(shipment_id ORDER BY carbon_gco2, shipment_id), round(min(carbon_gco2), 9) FROM p GROUP BY 1
UNION ALL SELECT package_type, 'highest_service', first(shipment_id ORDER BY service_level DESC, shipment_id), round(max(service_level), 9) FROM p GROUP BY 1
UNION ALL SELECT package_type, 'lowest_cost', first(shipment_id ORDER BY cost, shipment_id), round(min(cost), 9) FROM p GROUP BY 1""")
def q_tradeoff_extremes(spark, sf):
    return frontier.tradeoff_extremes(_points(spark, sf))


FAIL_FEATURES = ["weather_condition", "delivery_partner", "region", "vehicle_type"]


def _baseline_errors(spark, sf):
    d = views.deliveries(spark, sf, RISK_COLS)
    j = risk.with_history(d, d)
    pred_cost = (100 + 3 * F.col("distance_km")) + 5 * F.col("package_weight_kg")
    actual = F.when(F.col("delayed") == "no", 100.0).otherwise(0.0)
    return j.withColumns({"cost_error": F.abs(F.col("delivery_cost") - pred_cost),
                          "on_time_error": F.abs(actual - 100 * (1 - F.col("delay_probability")))})


register("fail_err", f"""
SELECT d.*, abs(d.delivery_cost - ((100 + 3 * d.distance_km) + 5 * d.package_weight_kg)) AS cost_error,
  abs(CASE WHEN d.delayed = 'no' THEN 100.0 ELSE 0.0 END::DOUBLE - 100 * (1 - coalesce(pw.late / pw.n, pr.r, g.r))) AS on_time_error,
  {LATE} AS late
FROM deliveries d
LEFT JOIN hist_rates pw ON pw.delivery_partner = d.delivery_partner AND pw.weather_condition = d.weather_condition
LEFT JOIN partner_rates pr ON pr.delivery_partner = d.delivery_partner CROSS JOIN global_rate g""")
register("fail_agg", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, CAST({f} AS VARCHAR) AS value, avg(cost_error) AS ce, avg(on_time_error) AS oe, "
    f"CAST(sum(late) AS BIGINT) AS delayed_count, count(*) AS n FROM fail_err GROUP BY 2" for f in FAIL_FEATURES))
register("fail_ranked", """
SELECT feature, value, round(ce, 6) AS cost_error, round(oe, 6) AS on_time_error, delayed_count, n,
  row_number() OVER (PARTITION BY feature ORDER BY oe DESC, value) AS failure_rank FROM fail_agg""")


@query("forecast_failures", "SELECT * FROM fail_ranked")
def q_forecast_failures(spark, sf):
    return risk.forecast_failures(_baseline_errors(spark, sf), FAIL_FEATURES)


@query("top_failure_segments", "SELECT * FROM fail_ranked WHERE failure_rank <= 3")
def q_top_failure_segments(spark, sf):
    return risk.forecast_failures(_baseline_errors(spark, sf), FAIL_FEATURES).where(F.col("failure_rank") <= 3)


def holdout_flag(id_col: str = "delivery_id"):
    """20 % holdout by an arithmetic hash of the id (re-runnable, engine-independent)."""
    return ((F.col(id_col) % 1000003) * 7919 + 13) % 100 < 20


HOLDOUT_SQL = "((delivery_id % 1000003) * 7919 + 13) % 100 < 20"


@query("failure_mae_union", f"""
SELECT weather_condition AS category, round(avg(on_time_error), 2) AS mae, 'weather' AS "group"
FROM fail_err WHERE {HOLDOUT_SQL} GROUP BY 1
UNION ALL
SELECT delivery_partner, round(avg(on_time_error), 2), 'partner' FROM fail_err WHERE {HOLDOUT_SQL} GROUP BY 1""")
def q_failure_mae_union(spark, sf):
    e = _baseline_errors(spark, sf).where(holdout_flag())
    w = e.groupBy(F.col("weather_condition").alias("category")).agg(F.round(F.avg("on_time_error"), 2).alias("mae")) \
        .withColumn("group", F.lit("weather"))
    p = e.groupBy(F.col("delivery_partner").alias("category")).agg(F.round(F.avg("on_time_error"), 2).alias("mae")) \
        .withColumn("group", F.lit("partner"))
    return w.unionByName(p)


@query("consistency_check", f"""
WITH t AS (SELECT d.package_type, d.vehicle_type, d.distance_km,
             d.distance_km * coalesce(v.gco2_per_km, 800.0::DOUBLE) * coalesce(p.cold_chain_multiplier, 1.0::DOUBLE) AS c,
             coalesce(p.on_time_threshold, 0.95::DOUBLE) AS thr
           FROM deliveries d LEFT JOIN dim_vehicle v ON lower(d.vehicle_type) = v.vehicle_type
           LEFT JOIN dim_policy p ON lower(d.package_type) = p.package_type),
     a AS (SELECT package_type, avg(c) AS ca, any_value(thr) AS thr FROM t GROUP BY 1),
     b AS (SELECT package_type, sum(s) / sum(n) AS cb FROM
             (SELECT package_type, vehicle_type, distance_km, sum(c) AS s, count(*) AS n FROM t GROUP BY ALL) x GROUP BY 1)
SELECT package_type, round(ca, 6) AS carbon_row_mean, round(cb, 6) AS carbon_lane_mean,
  round(thr / (ca + {carbon.optimization_ai_carbon_value(3)!r}::DOUBLE) * 1e6, 6) AS casp_row,
  round(thr / (cb + {carbon.optimization_ai_carbon_value(3)!r}::DOUBLE) * 1e6, 6) AS casp_lane,
  abs(ca - cb) < 1 AS carbon_match,
  abs(thr / (ca + {carbon.optimization_ai_carbon_value(3)!r}::DOUBLE) * 1e6 - thr / (cb + {carbon.optimization_ai_carbon_value(3)!r}::DOUBLE) * 1e6) < 0.1 AS casp_match
FROM a JOIN b USING (package_type)""")
def q_consistency_check(spark, sf):
    tc = carbon.transport_carbon(spark, views.deliveries(spark, sf, ["package_type", "vehicle_type", "distance_km"]))
    tc = with_policy(tc.drop("cold_chain_multiplier"), spark)
    a = tc.groupBy("package_type").agg(F.avg("transport_carbon_gco2").alias("ca"),
                                       F.first("on_time_threshold").alias("thr"))
    lane = tc.groupBy("package_type", "vehicle_type", "distance_km").agg(
        F.sum("transport_carbon_gco2").alias("s"), F.count(F.lit(1)).alias("n"))
    b = lane.groupBy("package_type").agg((F.sum("s") / F.sum("n")).alias("cb"))
    ai = carbon.optimization_ai_carbon_value(3)
    casp_a = F.col("thr") / (F.col("ca") + ai) * 1e6
    casp_b = F.col("thr") / (F.col("cb") + ai) * 1e6
    return a.join(b, "package_type").select(
        "package_type", r6("ca").alias("carbon_row_mean"), r6("cb").alias("carbon_lane_mean"),
        r6(casp_a).alias("casp_row"), r6(casp_b).alias("casp_lane"),
        (F.abs(F.col("ca") - F.col("cb")) < 1).alias("carbon_match"), (F.abs(casp_a - casp_b) < 0.1).alias("casp_match"))


COMPARE_TYPES = ["pharmacy", "clothing", "electronics", "fragile items"]


@query("compare_package_types")
def q_compare_package_types(spark, sf):
    """The same requests re-planned as each of four package types: mean CASP, carbon, service, cost, risk."""
    from cargolens.operators import choice
    from cargolens.sources import dims

    req = q_choice._requests(spark, sf).drop("package_type")
    types = F.broadcast(dims.local_table(spark, [(t,) for t in COMPARE_TYPES], "package_type string"))
    fanned = req.crossJoin(types).withColumn(
        "shipment_id", F.col("shipment_id") * len(COMPARE_TYPES)
        + F.expr("array_position(array(" + ", ".join(f"'{t}'" for t in COMPARE_TYPES) + "), package_type) - 1"))
    d = choice.decide(spark, quotes.carrier_options(spark, fanned, q_choice._history(spark, sf), city_weather=q_choice._city_weather(spark, sf)))
    b = F.col("best")
    return d.groupBy(F.col("pkg").alias("package_type")).agg(
        r6(F.avg(F.col("casp_score") * 1e6)).alias("avg_casp_e6"), r6(F.avg(b["total_carbon_gco2"])).alias("avg_total_carbon"),
        r6(F.avg(b["predicted_on_time_pct"])).alias("avg_service_level"), r6(F.avg(b["predicted_cost"])).alias("avg_cost"),
        r6(F.avg("risk_score")).alias("avg_risk_score"), F.count(F.lit(1)).alias("requests"))


def _routes(spark, sf):
    s = views.shipments(spark, sf).withColumn("package_type", F.col("raw_package_type"))
    return quotes.prepare_requests(spark, s).select("shipment_id", F.col("route_distance_km").alias("distance_km"), "vehicle_type")


_GRID_ROWS = ", ".join(f"('{c}', {g!r}::DOUBLE)" for c, g in __import__("cargolens.sources.dims", fromlist=["x"]).GRID_GCO2_PER_KWH)
_AI_PER_KWH = carbon._wh(carbon.CARBON_SERVICE_MODEL) * 1.0


@query("country_scenarios", f"""
WITH r AS (SELECT q.shipment_id, q.route_distance_km * coalesce(v.gco2_per_km, 800.0::DOUBLE) AS t
           FROM req_quote q JOIN shipments s USING (shipment_id)
           LEFT JOIN dim_vehicle v ON lower(s.vehicle_type) = v.vehicle_type),
     c AS (SELECT country, g, ({_AI_PER_KWH!r}::DOUBLE) / 1000 * g AS ai FROM (VALUES {_GRID_ROWS}) x(country, g))
SELECT r.shipment_id, c.country, r.t AS transport_carbon_gco2, c.ai AS ai_compute_carbon_gco2,
  r.t + c.ai AS total_carbon_gco2, CASE WHEN r.t + c.ai > 0 THEN c.ai / (r.t + c.ai) * 100 ELSE 0 END AS ai_carbon_pct
FROM r CROSS JOIN c""")
def q_country_scenarios(spark, sf):
    return carbon.country_scenarios(spark, _routes(spark, sf))


@query("optimal_country", f"""
WITH r AS (SELECT q.shipment_id, q.route_distance_km * coalesce(v.gco2_per_km, 800.0::DOUBLE) AS t
           FROM req_quote q JOIN shipments s USING (shipment_id)
           LEFT JOIN dim_vehicle v ON lower(s.vehicle_type) = v.vehicle_type),
     c AS (SELECT country, ({_AI_PER_KWH!r}::DOUBLE) / 1000 * g AS ai, row_number() OVER () AS seq
           FROM (VALUES {_GRID_ROWS}) x(country, g)),
     best AS (SELECT first(country ORDER BY ai, seq) AS country, min(ai) AS ai FROM c),
     ind AS (SELECT ai FROM c WHERE country = 'india')
SELECT r.shipment_id, best.country AS optimal_country, r.t + best.ai AS total_carbon_gco2, best.ai AS ai_carbon_gco2,
  r.t AS transport_carbon_gco2, (r.t + ind.ai) - (r.t + best.ai) AS savings_vs_india
FROM r CROSS JOIN best CROSS JOIN ind""")
def q_optimal_country(spark, sf):
    return carbon.optimal_country(spark, _routes(spark, sf))


__all__ = ["late_flag", "vendors"]
