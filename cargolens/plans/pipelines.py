"""Composite jobs: risk assessment, carrier options, carbon analysis and the integrated recommendation.

The flagship plan reads two facts: the delivery history (one partial
aggregation to a partner x weather rate table, size-checked and broadcast)
and the shipment requests (a map-only scan).  Everything else is broadcast
lookups against fixed dims and per-row array expressions, so the plan has no
shuffle of request-sized data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.exprs import r6, round_half_up
from cargolens.operators import choice, quotes


def flagship_requests(shipments: DataFrame) -> DataFrame:
    """Requests as a user would send them: the raw package text, origin, destination and options."""
    return shipments.select("shipment_id", F.col("raw_package_type").alias("package_type"), "origin",
                            "destination", "distance_km", "package_weight_kg", "delivery_mode",
                            "weather_condition")


def decided_requests(spark, requests: DataFrame, deliveries: DataFrame, rates=None,
                     city_weather: DataFrame | None = None) -> DataFrame:
    r = quotes.carrier_options(spark, requests, deliveries, rates, city_weather)
    return choice.decide(spark, r, carry=FLAGSHIP_COLUMNS)


FLAGSHIP_COLUMNS = ["pkg", "origin", "destination", "route_distance_km", "risk_level", "risk_score", "risk_factors",
                    "warnings", "recommended_buffer_days"]


def integrated_recommendation(spark, requests: DataFrame, deliveries: DataFrame, rates=None,
                              city_weather: DataFrame | None = None) -> DataFrame:
    """One recommendation row per request: risk -> quotes -> route choice -> carbon -> benchmark.

    Requests without any eligible carrier keep their risk columns and get ``error``.
    """
    d = decided_requests(spark, requests, deliveries, rates, city_weather)
    b = F.col("best")
    has = F.col("num_options") > 0
    bench = F.col("industry_benchmark_raw")
    pct1 = F.round(F.col("benchmark_pct"), 1) + F.lit(0.0)  # -0.0 prints as 0.0
    return d.select(
        "shipment_id", F.col("pkg").alias("package_type"), "origin", "destination",
        r6("route_distance_km").alias("distance_km"), "num_options",
        b["delivery_partner"].alias("recommendation"), b["carrier_code"].alias("carrier_code"),
        r6(b["predicted_cost"]).alias("cost"),
        r6(b["predicted_on_time_pct"]).alias("on_time_probability"),
        r6(b["transport_carbon_gco2"]).alias("transport_carbon_gco2"),
        r6(b["total_carbon_gco2"]).alias("total_carbon_gco2"),
        F.when(has, F.lit(choice.CARBON_SERVICE_AI_GCO2)).alias("ai_carbon_gco2"),
        r6(F.col("casp_score") * 1e6).alias("casp_e6"),
        b["meets_sla"].alias("meets_constraint"), "warning",
        "risk_level", r6("risk_score").alias("risk_score"),
        F.array_join("risk_factors", ", ").alias("risk_factors"),
        F.array_join("warnings", "; ").alias("warnings"),
        "recommended_buffer_days",
        "greenest_viable",
        F.when(has, round_half_up(bench, 2)).alias("industry_benchmark"),
        F.when(has & (bench > 0), F.when(b["predicted_cost"] < bench, "Below benchmark")
               .otherwise("Above benchmark")).alias("efficiency"),
        F.when(has & (bench > 0), F.format_string("%.1f%% %s benchmark", pct1,
                                                    F.when(F.col("benchmark_pct") > 0, "below").otherwise("above")))
        .alias("efficiency_percentage"),
        F.when(~has, F.lit("No carrier options found for this shipment")).alias("error"),
    )
