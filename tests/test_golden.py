"""Golden cases that need no dataset (from the reference's own demo outputs), run through Spark."""

import pytest
from pyspark.sql import functions as F

from cargolens.operators import carbon, choice, frontier, lanes, quotes
from cargolens.sources import dims


def _requests(spark, rows):
    schema = ("shipment_id long, package_type string, origin string, destination string, distance_km double, "
              "package_weight_kg double, delivery_mode string, weather_condition string")
    return dims.local_table(spark, rows, schema)


def _history(spark):
    rows = [("delhivery", "clear", "no")] * 9 + [("delhivery", "clear", "yes")]
    return dims.local_table(spark, rows, "delivery_partner string, weather_condition string, delayed string")


def test_lane_mumbai_delhi_reversed(spark):
    df = dims.local_table(spark, [("mumbai", "delhi")], "origin string, destination string")
    r = lanes.lane_distance(spark, df).collect()[0]
    assert r["lane_distance_km"] == 1400.0 and r["lane_distance_km_kind"] == "reversed"


def test_pharmacy_quotes_three_carriers(spark):
    req = _requests(spark, [(1, "pharmacy", "mumbai", "delhi", 1400.0, 5.0, None, None)])
    r = quotes.carrier_options(spark, req, _history(spark))
    q = quotes.explode_options(spark, r, ["shipment_id"]).orderBy("rank").collect()
    assert [x["carrier_code"] for x in q] == ["DEL-EXP", "BLU-EXP", "DHL-EXP"]
    assert [x["cost_inr"] for x in q] == [1120.0, 1848.0, 3150.0]
    assert [x["carbon_kg"] for x in q] == [945.0, 1260.0, 1155.0]


def test_clothing_ten_carriers(spark):
    req = _requests(spark, [(1, "clothing", "mumbai", "delhi", 1400.0, 20.0, None, None)])
    r = quotes.carrier_options(spark, req, _history(spark))
    assert quotes.explode_options(spark, r, ["shipment_id"]).count() == 10


def test_transport_carbon_golden(spark):
    rows = [(1, "pharmacy", "ev van", 1400.0), (2, "clothing", "bike", 1400.0)]
    df = dims.local_table(spark, rows, "delivery_id long, package_type string, vehicle_type string, distance_km double")
    out = {r["delivery_id"]: r["transport_carbon_gco2"] for r in carbon.transport_carbon(spark, df).collect()}
    assert out == {1: 525000.0, 2: 70000.0}


def test_ai_carbon_three_routes_llm():
    assert carbon.optimization_ai_carbon_value(3, "india", True) == pytest.approx(0.00324972, rel=1e-9)


def test_pareto_drops_dominated(spark):
    pts = [("x", 96.0, 150000.0), ("x", 95.0, 100000.0), ("x", 94.0, 120000.0), ("x", 88.0, 50000.0),
           ("x", 85.0, 40000.0)]
    df = dims.local_table(spark, pts, "package_type string, service_level double, carbon_gco2 double")
    got = sorted(r["service_level"] for r in frontier.pareto_frontier(df).collect())
    assert got == [85.0, 88.0, 95.0, 96.0]


def test_roi_demo(spark):
    df = spark.range(1).select(F.lit(150000.0).alias("a"), F.lit(120000.0).alias("b"), F.lit(0.001).alias("c"))
    c = carbon.ai_carbon_roi(F.col("a"), F.col("b"), F.col("c"))
    r = df.select(c["net_carbon_savings_gco2"].alias("net"), c["carbon_roi"].alias("roi"),
                  c["ai_worth_it"].alias("ok"), c["interpretation"].alias("label")).collect()[0]
    assert r["net"] == pytest.approx(29999.999) and r["roi"] == pytest.approx(3e7) and r["ok"]
    assert r["label"] == "Excellent ROI"


def test_weather_and_cost_text(spark):
    from cargolens.operators import text
    df = dims.local_table(spark, [("thunder and rain", "Rs 1,500")], "w string, c string")
    r = df.select(text.classify_weather(F.col("w")).alias("w"), text.parse_cost(F.col("c")).alias("c")).collect()[0]
    assert r["w"] == "stormy" and r["c"] == 1500.0


def test_route_choice_standard_min_carbon(spark):
    req = _requests(spark, [(1, "clothing", "mumbai", "delhi", 1400.0, 20.0, None, "clear")])
    d = choice.decide(spark, quotes.carrier_options(spark, req, _history(spark))).collect()[0]
    # every partner falls back to the 90 % history rate; shadowfax (bike) has the lowest carbon
    assert d["best"]["delivery_partner"] == "shadowfax"
