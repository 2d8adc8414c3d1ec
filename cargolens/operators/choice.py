"""Route choice and the decisions derived from it, as minima over the ten carriers of a request's row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.exprs import casp
from cargolens.operators import carbon, quotes
from cargolens.sources import dims

# FIXED VALUES — agent labels per stakes level and the carbon-service AI call.
AGENT_LABEL = dict(dims.STAKES_AGENT_LABEL)
CARBON_SERVICE_AI_GCO2 = carbon.inference_carbon_value(carbon.CARBON_SERVICE_MODEL, "india", 1)


def constraint_warning(on_time: Column, threshold_pct: Column, meets: Column) -> Column:
    """'' when met, else 'On-time x.x% below threshold y%.' (values rounded before formatting)."""
    return F.when(meets, F.lit("")).otherwise(
        F.format_string("On-time %.1f%% below threshold %.0f%%.", F.round(on_time, 1), F.round(threshold_pct, 0)))


BEST_FIELDS = ["carrier_code", "carrier_name", "delivery_partner", "vehicle_type", "cost_inr", "estimated_on_time_pct",
               "carbon_kg", "predicted_cost", "predicted_on_time_pct", "predicted_carbon_gco2", "transport_carbon_gco2",
               "ai_carbon_gco2", "total_carbon_gco2", "meets_sla"]


def decide(spark, requests: DataFrame, carry: list[str] | None = None, predictor=None) -> DataFrame:
    """Route choice plus stakes decision, carbon savings, greenest option and cost benchmark.

    Input: ``quotes.carrier_options`` (one row per request).  Each rule is the smallest of the offers' structs
    (rule's key, quote, carrier order) in the request's own row; the wide fields are looked up
    once, for the offer that was chosen.  Ties resolve by quote rank like the reference's first
    minimum.  No exchange, no window.
    """
    q = quotes.with_carriers(requests, "min_on_time_pct", predictor)
    q = q.withColumn("_any_meets", F.exists("offers", lambda o: o["meets"])).withColumn("_ai", quotes.ai_carbon())

    def pick(key) -> Column:
        """The offer with the smallest key, quote and place."""
        return F.array_min(F.transform("offers", lambda o: F.struct(
            *[k.alias(f"k{n}") for n, k in enumerate(key(o))], o["cost"].alias("cost"), o["seq"].alias("seq"), o.alias("offer"))))["offer"]

    def best_key(o: Column) -> list[Column]:
        primary = F.when(o["meets"], F.when(F.col("stakes") == "standard", quotes.transport_carbon(o) + F.col("_ai")).otherwise(o["p_cost"])).otherwise(
            -o["p_on_time"])
        return [~o["meets"], primary]

    def green_key(o: Column) -> list[Column]:
        return [F.when(F.col("_any_meets"), ~o["meets"]).otherwise(F.lit(False)), o["p_carbon"]]

    def mean(value, counts) -> Column:
        """Mean over the offers of whole numbers, so that it doesn't depend on order."""
        on = F.filter("offers", counts)
        return F.when(F.size(on) > 0, F.aggregate(on, F.lit(0.0), lambda total, o: total + F.round(value(o))) / F.size(on))

    q = q.withColumns({"_best": pick(best_key), "_fast": pick(lambda o: [o["p_on_time"]]), "_green": pick(green_key),
                       "industry_benchmark_raw": mean(lambda o: o["cost"] * 100, lambda o: o["cost"] > 0) / 100,
                       "mean_option_transport_gco2": mean(lambda o: quotes.transport_carbon(o) * 1e6, lambda o: F.lit(True)) / 1e6})
    req_cols = [c for c in requests.columns if c not in ("shipment_id", "route_rates", "partner_rates")]
    if carry is not None:
        req_cols = [c for c in requests.columns if c in set(carry) | {"threshold_pct", "cold_chain_multiplier", "stakes", "priority"}]

    def chosen(pick: Column, names: list[str]) -> Column:
        fields = quotes.option_fields(pick)
        return F.when(pick.isNotNull(), F.struct(*[fields[n].alias(n) for n in names]))

    d = q.select("shipment_id", *req_cols, "num_options", "industry_benchmark_raw", "mean_option_transport_gco2",
                 chosen(F.col("_best"), BEST_FIELDS).alias("best"), chosen(F.col("_fast"), ["carrier_code", "total_carbon_gco2"]).alias("_fast"),
                 chosen(F.col("_green"), ["carrier_name", "predicted_carbon_gco2"]).alias("_green"))
    stakes = F.col("stakes")
    standard = stakes == "standard"
    b = F.col("best")
    pct = F.when(F.col("industry_benchmark_raw") > 0,
                 (F.col("industry_benchmark_raw") - b["predicted_cost"]) / F.col("industry_benchmark_raw") * 100)
    return d.withColumns({
        "agent_type": F.coalesce(*[F.when(stakes == k, F.lit(v)) for k, v in AGENT_LABEL.items()],
                                 F.lit("low_stakes")),
        "decision_priority": F.when(standard, F.lit("carbon")).otherwise(F.col("priority")),
        "cold_chain_required": F.when(standard, F.lit(False)).otherwise(F.col("cold_chain_multiplier") > 1.0),
        "casp_score": F.when(b.isNotNull(), casp(b["predicted_on_time_pct"], b["total_carbon_gco2"])),
        "carbon_savings_pct": F.when(
            standard & (F.col("_fast")["total_carbon_gco2"] > 0),
            (F.col("_fast")["total_carbon_gco2"] - b["total_carbon_gco2"]) / F.col("_fast")["total_carbon_gco2"] * 100),
        "baseline_lowest_on_time_carrier": F.col("_fast")["carrier_code"],
        "warning": F.when(b.isNotNull(), constraint_warning(b["predicted_on_time_pct"], F.col("threshold_pct"),
                                                            b["meets_sla"])),
        "greenest_viable": F.col("_green")["carrier_name"],
        "greenest_carbon_gco2": F.col("_green")["predicted_carbon_gco2"],
        "benchmark_pct": pct,
    }).drop("_fast", "_green")
