"""Transport and AI-compute carbon, country scenarios and the inference ledger.

Lookups against vehicle, grid and model tables are broadcast joins of fixed
tiny dims; every aggregate is a partial (map-side) hash aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.exprs import casp, grid_intensity, model_energy, r6, vehicle_factor, with_policy
from cargolens.sources import dims

# FIXED VALUES — predictions per route, LLM calls per optimization and their models.
PREDICTIONS_PER_ROUTE = 3
LLM_CALLS = 3
ML_MODEL = "gradient-boosting"
LLM_MODEL = "claude-3-sonnet"
CARBON_SERVICE_MODEL = "gemini-flash"
SCENARIO_TOKENS = 500
COMPARE_COUNTRIES = ["india", "china", "usa", "germany", "uk", "france", "norway"]
CASP_COUNTRIES = [("Norway", "norway"), ("France", "france"), ("UK", "uk"), ("USA", "usa"),
                  ("Germany", "germany"), ("India", "india")]
NO_DATA_CARBON = 350000
DISPLAY_YPOS = [("cosmetics", "Cosmetics", 1), ("clothing", "Clothing", 2), ("furniture", "Furniture", 3),
                ("automobile parts", "Automobile parts", 4), ("fragile items", "Fragile items", 5),
                ("documents", "Documents", 6), ("electronics", "Electronics", 7),
                ("groceries", "Groceries", 8), ("pharmacy", "Pharmacy", 9)]


def _wh(model: str) -> float:
    return dict(dims.MODEL_ENERGY_WH).get(model, dims.DEFAULT_MODEL_WH)


def _grid(country: str) -> float:
    return dict(dims.GRID_GCO2_PER_KWH).get(country, dims.DEFAULT_GRID_GCO2_PER_KWH)


def inference_carbon_value(model: str, country: str, n: int) -> float:
    """Carbon (g) of ``n`` inferences of ``model`` in ``country`` (driver-side constant)."""
    return (_wh(model) * n) / 1000 * _grid(country)


def optimization_ai_carbon_value(num_routes: int, country: str = "india", include_llm: bool = True) -> float:
    ml = inference_carbon_value(ML_MODEL, country, num_routes * PREDICTIONS_PER_ROUTE)
    return ml + (inference_carbon_value(LLM_MODEL, country, LLM_CALLS) if include_llm else 0.0)


def transport_carbon(spark, deliveries: DataFrame) -> DataFrame:
    """distance x vehicle factor (unknown -> 800) x the package's cold-chain multiplier."""
    d = vehicle_factor(spark, deliveries)
    d = with_policy(d, spark).select(*deliveries.columns, "gco2_per_km", "cold_chain_multiplier")
    return d.withColumn("transport_carbon_gco2",
                        F.col("distance_km") * F.col("gco2_per_km") * F.col("cold_chain_multiplier"))


def inference_carbon(spark, log: DataFrame) -> DataFrame:
    """Per logged call: energy per inference, totals in Wh/kWh, grid intensity, gCO2 and kg."""
    d = model_energy(spark, log)
    d = grid_intensity(spark, d)
    e, n = F.col("energy_per_inference_wh"), F.col("num_inferences")
    kwh = (e * n) / 1000
    return d.select("inference_id", "model", "country", "num_inferences", "energy_per_inference_wh",
                    (e * n).alias("total_energy_wh"), kwh.alias("total_energy_kwh"),
                    F.col("grid_gco2_kwh").alias("grid_intensity_gco2_kwh"),
                    (kwh * F.col("grid_gco2_kwh")).alias("carbon_gco2"),
                    (kwh * F.col("grid_gco2_kwh") / 1000).alias("carbon_kg"))


def token_scaled_carbon(spark, log: DataFrame) -> DataFrame:
    """LLM energy x sqrt(tokens / 500) for the listed LLMs, others unscaled; per call, in gCO2."""
    d = grid_intensity(spark, model_energy(spark, log, out="base_wh"))
    scaled = F.when(F.lower("model").isin(*dims.TOKEN_SCALED_MODELS),
                    F.col("base_wh") * F.sqrt(F.col("tokens") / 500.0)).otherwise(F.col("base_wh"))
    return d.select("inference_id", "model", "country", "tokens", "base_wh", scaled.alias("scaled_wh"),
                    (scaled / 1000 * F.col("grid_gco2_kwh")).alias("carbon_gco2"))


def energy_to_carbon(spark, log: DataFrame) -> DataFrame:
    """Wh preferred, else joules / 3.6e6 kWh; neither -> null carbon and an error flag."""
    d = grid_intensity(spark, log)
    kwh = F.when(F.col("energy_wh").isNotNull(), F.col("energy_wh") / 1000) \
        .when(F.col("energy_joules").isNotNull(), F.col("energy_joules") / 3600000.0)
    return d.select("inference_id", "country", "energy_wh", "energy_joules", kwh.alias("energy_kwh"),
                    F.col("grid_gco2_kwh"), (kwh * F.col("grid_gco2_kwh")).alias("carbon_gco2"),
                    kwh.isNull().alias("error"))


def optimization_ai_carbon(spark, num_routes: DataFrame, country: str = "india",
                           include_llm: bool = True) -> DataFrame:
    """Per optimization with ``num_routes`` routes: ML (3 per route) + optional 3 LLM calls."""
    grid = _grid(country)
    ml = (F.lit(_wh(ML_MODEL)) * (F.col("num_routes") * PREDICTIONS_PER_ROUTE)) / 1000 * grid
    llm = F.lit(inference_carbon_value(LLM_MODEL, country, LLM_CALLS) if include_llm else 0.0)
    return num_routes.select("*", (F.col("num_routes") * PREDICTIONS_PER_ROUTE).alias("ml_inferences"),
                             ml.alias("ml_carbon_gco2"), llm.alias("llm_carbon_gco2"),
                             (ml + llm).alias("total_ai_carbon_gco2"))


def ai_carbon_roi(without: F.Column, with_ai: F.Column, ai: F.Column) -> dict[str, F.Column]:
    """Is the AI worth its carbon: savings, net, ROI (inf when ai = 0) and a label."""
    saved = without - with_ai
    total = with_ai + ai
    net = without - total
    roi = F.when(ai > 0, saved / ai).otherwise(F.lit(float("inf")))
    label = (F.when(net < 0, "AI adds more carbon than it saves").when(roi > 100, "Excellent ROI")
             .when(roi > 10, "Good ROI").when(roi > 1, "Positive ROI").otherwise("Marginal benefit"))
    return {
        "baseline_transport_gco2": without, "optimized_transport_gco2": with_ai,
        "transport_savings_gco2": saved, "ai_compute_carbon_gco2": ai, "total_with_ai_gco2": total,
        "net_carbon_savings_gco2": net, "carbon_roi": roi, "ai_worth_it": net > 0,
        "savings_percentage": F.when(without > 0, net / without * 100).otherwise(F.lit(0.0)),
        "interpretation": label,
    }


def carbon_by_package(spark, deliveries: DataFrame) -> DataFrame:
    """Per package type: mean transport carbon (cold chain applied) + AI carbon of one optimization
    (3 routes + LLM, India), integer-rounded; service % from the policy; 350000 when no rows."""
    tc = transport_carbon(spark, deliveries.select("package_type", "vehicle_type", "distance_km"))
    per = tc.groupBy(F.lower("package_type").alias("package_type")).agg(
        F.avg("transport_carbon_gco2").alias("avg_transport"))
    keys = dims.local_table(spark, DISPLAY_YPOS, "package_type string, display_name string, ypos int")
    keys = with_policy(keys, spark)
    ai = optimization_ai_carbon_value(3, "india", True)
    j = F.broadcast(keys).join(per, "package_type", "left")
    total = F.bround(F.col("avg_transport") + F.lit(ai), 0).cast("long")
    return j.select("package_type", "display_name",
                    F.coalesce(total, F.lit(NO_DATA_CARBON).cast("long")).alias("carbon_gco2"),
                    F.round(F.col("on_time_threshold") * 100, 0).cast("int").alias("service_pct"), "ypos")


def casp_by_country(spark, deliveries: DataFrame) -> DataFrame:
    """Pharmacy: service (0.99) / (mean pharmacy transport carbon + AI carbon per country) x 1e6."""
    pol = dict((p[0], p) for p in dims.POLICY)["pharmacy"]
    threshold, cold = pol[4], pol[5]
    ph = vehicle_factor(spark, deliveries.where(F.lower("package_type") == "pharmacy")
                        .select("vehicle_type", "distance_km"))
    avg = ph.agg(F.avg(F.col("distance_km") * F.col("gco2_per_km") * F.lit(cold)).alias("avg_transport"))
    rows = [(name, code, optimization_ai_carbon_value(3, code, True)) for name, code in CASP_COUNTRIES]
    countries = dims.local_table(spark, rows, "country string, country_code string, ai_carbon double")
    total = F.col("avg_transport") + F.col("ai_carbon")
    service = (threshold * 100) / 100
    return (F.broadcast(countries).crossJoin(avg)
            .select("country", F.round(F.when(total > 0, F.lit(service) / total).otherwise(0.0) * 1e6, 2)
                    .alias("casp_e6")))


def country_extremes(spark, log: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """Per model: its logged workload priced in each country -> cleanest, dirtiest and their ratio."""
    countries = countries or COMPARE_COUNTRIES
    work = model_energy(spark, log.groupBy("model").agg(F.sum("num_inferences").alias("total_inferences")))
    cdim = dims.local_table(spark, [(c, i, _grid(c)) for i, c in enumerate(countries)],
                                 "country string, country_seq int, grid double")
    priced = work.crossJoin(F.broadcast(cdim)).withColumn(
        "carbon_gco2", (F.col("energy_per_inference_wh") * F.col("total_inferences")) / 1000 * F.col("grid"))
    agg = priced.groupBy("model", "total_inferences").agg(
        F.min_by(F.struct("country", "carbon_gco2"), F.struct("carbon_gco2", "country_seq")).alias("lo"),
        F.min_by(F.struct("country", "carbon_gco2"), F.struct(-F.col("carbon_gco2"), -F.col("country_seq"))
                 ).alias("hi"))
    return agg.select("model", "total_inferences",
                      F.col("lo.country").alias("cleanest_country"), r6(F.col("lo.carbon_gco2") * 1000).alias("cleanest_mg"),
                      F.col("hi.country").alias("dirtiest_country"), r6(F.col("hi.carbon_gco2") * 1000).alias("dirtiest_mg"),
                      F.round(F.when(F.col("lo.carbon_gco2") > 0, F.col("hi.carbon_gco2") / F.col("lo.carbon_gco2"))
                              .otherwise(F.lit(float("inf"))), 6).alias("ratio"))


def _safe(name: str) -> str:
    return "".join(ch if ch.isalnum() else "_" for ch in name)


def model_country_pivot(spark, log: DataFrame, models: list[str]) -> DataFrame:
    """Logged carbon per country, one column per listed model and ``other`` for all the rest, in mg (round 2)."""
    c = inference_carbon(spark, log)
    mg = F.col("carbon_gco2") * 1000
    listed = F.coalesce(F.col("model").isin(*models), F.lit(False))
    sums = {_safe(m): F.sum(F.when(F.col("model") == m, mg)) for m in models} | {"other": F.sum(F.when(~listed, mg))}
    return c.groupBy("country").agg(*[F.round(F.coalesce(v, F.lit(0.0)), 2).alias(k) for k, v in sums.items()])


def inference_ledger_totals(spark, log: DataFrame) -> DataFrame:
    """Totals per (model, country) and overall: inferences, gCO2, kg, mean per inference."""
    c = inference_carbon(spark, log)
    per = c.groupBy("model", "country").agg(F.sum("num_inferences").alias("total_inferences"),
                                            F.sum("carbon_gco2").alias("g"))
    overall = per.agg(F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("country"),
                      F.sum("total_inferences").alias("total_inferences"), F.sum("g").alias("g"))
    both = (per.withColumn("scope", F.lit("model_country"))
            .unionByName(overall.withColumn("scope", F.lit("overall"))))
    return both.select("scope", "model", "country", F.col("total_inferences").cast("long").alias("total_inferences"),
                       F.round("g", 9).alias("total_carbon_gco2"), F.round(F.col("g") / 1000, 12).alias("total_carbon_kg"),
                       F.round(F.when(F.col("total_inferences") > 0, F.col("g") / F.col("total_inferences"))
                               .otherwise(0.0), 12).alias("avg_carbon_per_inference_gco2"))


def country_ai_carbon_sorted(spark, log: DataFrame) -> DataFrame:
    """Total logged joules per model priced in every grid country, ranked by ascending carbon."""
    j = log.groupBy("model").agg(F.sum("energy_joules").alias("energy_joules"))
    cdim = dims.local_table(spark, [(c, i, g) for i, (c, g) in enumerate(dims.GRID_GCO2_PER_KWH)],
                                 "country string, country_seq int, grid_intensity_gco2_kwh double")
    priced = j.crossJoin(F.broadcast(cdim)).withColumn(
        "ai_compute_carbon_gco2", F.col("energy_joules") / 3600000.0 * F.col("grid_intensity_gco2_kwh"))
    w = Window.partitionBy("model").orderBy("ai_compute_carbon_gco2", "country_seq")
    return priced.select("model", "country", "grid_intensity_gco2_kwh", "energy_joules",
                         r6("ai_compute_carbon_gco2").alias("ai_compute_carbon_gco2"),
                         F.row_number().over(w).alias("carbon_rank"))


def country_scenarios(spark, routes: DataFrame, model: str = CARBON_SERVICE_MODEL,
                      tokens: int = SCENARIO_TOKENS) -> DataFrame:
    """Each route priced in every grid country ('default' included): transport + AI carbon, AI %."""
    base = _wh(model)
    scale = (tokens / 500) ** 0.5 if model in dims.TOKEN_SCALED_MODELS else 1.0
    cdim = dims.local_table(spark, 
        [(c, g, (base * scale) / 1000 * g) for c, g in dims.GRID_GCO2_PER_KWH],
        "country string, grid_intensity_gco2_kwh double, ai_compute_carbon_gco2 double")
    r = vehicle_factor(spark, routes).withColumn(
        "transport_carbon_gco2", F.col("distance_km") * F.col("gco2_per_km"))
    total = F.col("transport_carbon_gco2") + F.col("ai_compute_carbon_gco2")
    return (r.crossJoin(F.broadcast(cdim))
            .select("shipment_id", "country", "transport_carbon_gco2", "ai_compute_carbon_gco2",
                    total.alias("total_carbon_gco2"),
                    F.when(total > 0, F.col("ai_compute_carbon_gco2") / total * 100).otherwise(0.0)
                    .alias("ai_carbon_pct")))


def optimal_country(spark, routes: DataFrame, model: str = CARBON_SERVICE_MODEL,
                    tokens: int = SCENARIO_TOKENS) -> DataFrame:
    """Per route: the country with the lowest total carbon and the saving versus India.

    Transport carbon does not depend on the country, so the arg-min is the country with the
    lowest AI carbon (first in grid order on ties): one broadcast row, no per-route fan-out.
    """
    base = _wh(model)
    scale = (tokens / 500) ** 0.5 if model in dims.TOKEN_SCALED_MODELS else 1.0
    priced = [(c, (base * scale) / 1000 * g) for c, g in dims.GRID_GCO2_PER_KWH]
    best_country, best_ai = min(priced, key=lambda t: t[1])
    india_ai = dict(priced)["india"]
    r = vehicle_factor(spark, routes).withColumn(
        "transport_carbon_gco2", F.col("distance_km") * F.col("gco2_per_km"))
    best_total = F.col("transport_carbon_gco2") + F.lit(best_ai)
    return r.select("shipment_id", F.lit(best_country).alias("optimal_country"),
                    best_total.alias("total_carbon_gco2"), F.lit(best_ai).alias("ai_carbon_gco2"),
                    "transport_carbon_gco2",
                    ((F.col("transport_carbon_gco2") + F.lit(india_ai)) - best_total).alias("savings_vs_india"))


__all__ = [n for n in dir() if not n.startswith("_")] + ["casp"]
