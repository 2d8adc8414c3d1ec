"""Shipment requests -> eligible carrier quotes -> route options with predictions.

Scale design: the carriers are a fixed list of ten, and everything about a request's options
depends on that request alone.  So a request's offers are an array in its own row, worked out by array
functions over the constant list of carriers (``with_carriers``): counting and choosing are
functions of that array, and nothing of the size of the requests is shuffled.  Array functions keep the
plan, and the code generated for it, as small for ten carriers as for one.  ``explode_options`` makes one row per
option out of the array sorted by quote.

Predictions come from a predictor: a function of the requests and the carriers that adds the arrays ``p_cost``,
``p_on_time`` and ``p_carbon``, one entry for each carrier (or columns ``p_cost_i`` ... for each carrier i).  The default is the
historical baseline (cost = 100 + 3 km + 5 kg, on-time = 100 x (1 - delay rate) of past deliveries by partner and
weather, falling back to the partner and then the global rate); ``batch_predictor`` wraps a function of whole batches of
routes, ``fitted_predictor`` fitted pipelines.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.exprs import POLICY_COLUMNS, blank_as, checked_broadcast, clamp, late_flag, missing_as, round_half_up
from cargolens.operators import lanes
from cargolens.session import ensure_checkpoint_dir, keep_methods_compiled
from cargolens.sources import dims

# FIXED VALUES — request defaults used by the sourcing step.
DEFAULT_PACKAGE = "clothing"
DEFAULT_WEIGHT_KG = 25.0
DEFAULT_REGION = "west"
DEFAULT_WEATHER = "clear"
DEFAULT_MODE = "two day"
DEFAULT_PARTNER = "delhivery"
STRICT_MIN_ON_TIME = 95.0
MIN_QUOTE_COST = 50.0
QUOTE_COLD_CARBON_FACTOR = 1.5
ROUTE_RATING = 4
RISK_VEHICLE, RISK_MODE, RISK_REGION = "van", "express", "west"
RISK_FACTOR_STORM = "Stormy weather (+50% risk)"
RISK_FACTOR_LOAD = "Long distance + heavy weight (+30% risk)"
ALERT_WARNING = "Alert required: high disruption risk"


# ---------------------------------------------------------------------------
# History (baseline predictor)
# ---------------------------------------------------------------------------

CARRIER_PARTNERS = list(dict.fromkeys(p for _, p in dims.CARRIER_PARTNER))
#: Rows (one a kind of weather) up to which the rates are broadcast; beyond that they are joined by a shuffle.
MAX_WEATHERS = 10_000


def history_rates(deliveries: DataFrame, partners: list[str] | None = None, max_rows: int = MAX_WEATHERS) -> dict:
    """Delay rates of past deliveries for the baseline predictor, as arrays with an entry for each partner.

    One partial aggregation of the fact by weather, with conditional counts for each of the fixed partners, cut off
    and counted before it may be broadcast.  ``by_weather`` has one row per weather with ``w_rates`` (the rate under that
    weather, else the partner's, else the global one); ``overall`` is one row with ``partner_rates`` (null for a partner
    without deliveries), ``default_rates`` and ``g``.
    """
    partners = partners or CARRIER_PARTNERS
    late = late_flag()
    own = [F.col("delivery_partner") == p for p in partners]
    counts = deliveries.groupBy("weather_condition").agg(
        F.array(*[F.count(F.when(o, 1)) for o in own]).alias("n"), F.array(*[F.sum(F.when(o, late).otherwise(0)) for o in own]).alias("late"),
        F.count(F.lit(1)).alias("all_n"), F.sum(late).alias("all_late"))
    ensure_checkpoint_dir(deliveries.sparkSession)
    counts = counts.checkpoint()
    k = range(len(partners))
    overall = counts.agg(F.array(*[F.try_divide(F.sum(F.col("late")[i]), F.sum(F.col("n")[i])) for i in k]).alias("partner_rates"),
                         F.try_divide(F.sum("all_late"), F.sum("all_n")).alias("g"))
    overall = overall.withColumn("default_rates", F.transform("partner_rates", lambda x: F.coalesce(x, F.col("g"))))
    by_weather = counts.crossJoin(F.broadcast(overall)).select(  # one row on the right
        "weather_condition", F.array(*[F.coalesce(F.try_divide(F.col("late")[i], F.col("n")[i]), F.col("default_rates")[i]) for i in k]).alias("w_rates"))
    if counts.count() <= max_rows:
        by_weather = F.broadcast(by_weather)
    return {"by_weather": by_weather, "overall": F.broadcast(overall), "partners": partners}


def attach_rates(df: DataFrame, rates: dict, weather_col: str, out: str) -> DataFrame:
    """Add ``out``: the partners' delay rates under the row's weather, else the partner's, else the global one."""
    bw = rates["by_weather"].withColumnRenamed("weather_condition", "_rw")
    if "default_rates" not in df.columns:
        df = df.crossJoin(rates["overall"])
    return df.join(bw, F.col(weather_col) == F.col("_rw"), "left").withColumn(out, F.coalesce("w_rates", "default_rates")).drop("_rw", "w_rates")


def rate_of(rates: Column, partner: str) -> Column:
    """A partner's entry of an array of rates."""
    return rates[CARRIER_PARTNERS.index(partner)]


# ---------------------------------------------------------------------------
# Requests
# ---------------------------------------------------------------------------

def normalize_shipments(df: DataFrame) -> DataFrame:
    """lower/trim package type, origin, destination; numerics cast (null when the cast fails)."""
    out = {c: F.lower(F.trim(F.col(c))) for c in ("package_type", "origin", "destination") if c in df.columns}
    for c in ("distance_km", "package_weight_kg"):
        if c in df.columns:
            out[c] = F.expr(f"try_cast({c} AS double)")
    return df.withColumns(out)


def city_of(name: Column) -> Column:
    """The city struct for a key or (lower-case) display name; key wins; null when unknown."""
    return F.coalesce(dims.lookup("dim_city", name), dims.lookup("dim_city", name, key_fmt="{1}"))


def prepare_requests(spark, shipments: DataFrame) -> DataFrame:
    """Per request: package policy, resolved distance, origin region, express/cold/metro flags.

    Expects shipment_id, package_type, origin, destination, distance_km, package_weight_kg,
    delivery_mode, weather_condition (region optional).  Every fixed dim (policy, cities, lanes)
    is a constant-map probe, so this is a single projection over the request scan.
    """
    s = normalize_shipments(shipments)
    if "region" not in s.columns:
        s = s.withColumn("region", F.lit(None).cast("string"))
    pkg = blank_as(F.col("package_type"), DEFAULT_PACKAGE)
    pol = dims.lookup("dim_policy", F.lower(pkg))
    policy = {c: F.coalesce(pol[c], F.lit(v)) for c, v in zip(POLICY_COLUMNS, dims.DEFAULT_POLICY)}
    o_city, d_city = city_of(F.lower(F.col("origin"))), city_of(F.lower(F.col("destination")))
    s = s.withColumns({"pkg": pkg, **policy, "_oc": o_city, "_dc": d_city})
    o, d = F.lower(F.col("origin")), F.lower(F.col("destination"))
    lane_key = lambda a, b: F.concat(a, F.lit("|"), b)
    lane_map = lambda k: dims.lookup("dim_lane", k, key_fmt="{0}|{1}")
    both = F.col("_oc").isNotNull() & F.col("_dc").isNotNull()
    hav = lanes.haversine(F.col("_oc.latitude"), F.col("_oc.longitude"), F.col("_dc.latitude"), F.col("_dc.longitude"))
    lane_km = F.coalesce(lane_map(lane_key(o, d))["distance_km"], lane_map(lane_key(d, o))["distance_km"],
                         F.when(both, F.round(hav * lanes.ROAD_FACTOR, lanes.HAVERSINE_DECIMALS)))
    has_ends = (blank_as(F.col("origin"), "") != "") & (blank_as(F.col("destination"), "") != "")
    region = F.coalesce(F.when(blank_as(F.col("region"), "") != "", F.lower("region")),
                        F.col("_oc.region"), F.lit(DEFAULT_REGION))
    weather = F.lower(blank_as(F.col("weather_condition"), DEFAULT_WEATHER))
    out = s.withColumns({
        "route_distance_km": missing_as(F.coalesce(F.col("distance_km"), F.when(has_ends, lane_km)),
                                        lanes.DEFAULT_DISTANCE_KM),
        "route_weight_kg": missing_as(F.col("package_weight_kg"), DEFAULT_WEIGHT_KG),
        "origin_region": region,
        "is_metro_to_metro": F.when(both, F.col("_oc.is_metro") & F.col("_dc.is_metro")).otherwise(F.lit(False)),
        "is_express": F.lower(F.coalesce(F.col("delivery_mode"), F.lit(""))).isin("same day", "express"),
        "requires_cold_chain": F.col("cold_chain_multiplier") > 1.0,
        "quote_weather": F.when(weather == "stormy", "storm").otherwise(weather),
        "route_weather": weather,
        "route_mode": F.lower(blank_as(F.col("delivery_mode"), DEFAULT_MODE)),
        "threshold_pct": F.col("on_time_threshold") * 100,
    })
    return out.drop("_oc", "_dc")


# ---------------------------------------------------------------------------
# Risk of a request (needed before quoting: a buffer tightens the SLA)
# ---------------------------------------------------------------------------

def risk_level(score: Column) -> Column:
    return (F.when(score > 5, "CRITICAL").when(score > 3, "HIGH").when(score > 1.5, "MEDIUM").otherwise("LOW"))


def buffer_days(level: Column) -> Column:
    return F.when(level == "CRITICAL", 2).when(level.isin("HIGH", "MEDIUM"), 1).otherwise(0)


def risk_columns(p_delay: Column, impact: Column, weather: Column, distance: Column, weight: Column,
                 partner: Column, partner_rate: Column) -> dict[str, Column]:
    """Risk = P(delay) x impact, x1.5 stormy, x1.3 long+heavy, x1.2 partner history rate > 0.15."""
    storm = weather == "stormy"
    load = (distance > 250) & (weight > 40)
    risky_partner = F.coalesce(partner_rate > 0.15, F.lit(False)) & (F.coalesce(partner, F.lit("")) != "")
    score = p_delay * impact
    score = F.when(storm, score * 1.5).otherwise(score)
    score = F.when(load, score * 1.3).otherwise(score)
    score = F.when(risky_partner, score * 1.2).otherwise(score)
    factors = F.filter(F.array(
        F.when(storm, F.lit(RISK_FACTOR_STORM)), F.when(load, F.lit(RISK_FACTOR_LOAD)),
        F.when(risky_partner, F.concat(F.lit("High-risk partner: "), partner, F.lit(" (+20% risk)")))),
        lambda x: x.isNotNull())
    level = risk_level(score)
    return {"risk_score": score, "risk_level": level, "risk_factors": factors, "alert_required": score > 5,
            "recommended_buffer_days": buffer_days(level)}


def request_risk(df: DataFrame, delay_scorer=None) -> DataFrame:
    """Risk of the representative route (delhivery, van, express, west) for each request.

    P(delay) is the delay rate under the risk weather (``risk_rates``), or what ``delay_scorer``, a function of a batch of
    routes (``ml.tree_scorer`` of a fitted classifier, for one), gives for that route.
    """
    partner = F.lit(DEFAULT_PARTNER)
    km = missing_as(F.col("distance_km"), lanes.DEFAULT_DISTANCE_KM)
    kg = missing_as(F.col("package_weight_kg"), DEFAULT_WEIGHT_KG)
    p = rate_of(F.col("risk_rates"), DEFAULT_PARTNER)
    if delay_scorer is not None:
        p = _scored_route(delay_scorer)(km, kg, F.col("pkg"), F.col("risk_weather"))
    cols = risk_columns(F.col("delay_probability"), F.col("impact_multiplier"), F.col("risk_weather"), km, kg, partner,
                        rate_of(F.col("partner_rates"), DEFAULT_PARTNER))
    out = df.withColumn("delay_probability", p).withColumns(cols)
    return out.withColumn("warnings", F.when(F.col("alert_required"),
                                             F.array_append(F.col("risk_factors"), F.lit(ALERT_WARNING)))
                          .otherwise(F.col("risk_factors")))


def _scored_route(score):
    """The representative route's score as a column, batch by batch."""
    fixed = {"delivery_rating": float(ROUTE_RATING), "vehicle_type": RISK_VEHICLE, "delivery_partner": DEFAULT_PARTNER,
             "delivery_mode": RISK_MODE, "region": RISK_REGION}

    @F.pandas_udf("double")
    def scored(km: pd.Series, kg: pd.Series, package: pd.Series, weather: pd.Series) -> pd.Series:
        import pandas as pd

        routes = pd.DataFrame({"distance_km": km, "package_weight_kg": kg, "package_type": package, "weather_condition": weather}).assign(**fixed)
        return pd.Series(score(routes))

    return scored


# ---------------------------------------------------------------------------
# Options
# ---------------------------------------------------------------------------

def _weather_penalty(w: Column) -> Column:
    expr = None
    for name, pen in dims.WEATHER_PENALTY:
        expr = F.when(w == name, F.lit(pen)) if expr is None else expr.when(w == name, F.lit(pen))
    return expr.otherwise(F.lit(0.0))


def carriers() -> list[dict]:
    """The ten carriers with their partner, vehicle and vehicle factor (fixed)."""
    veh, part, fac = dict(dims.PARTNER_VEHICLE), dict(dims.CARRIER_PARTNER), dict(dims.VEHICLE_GCO2_PER_KM)
    names = [f.split()[0] for f in dims.SCHEMAS["dim_carrier"].split(", ")][:15]
    out = []
    for seq, row in enumerate(dims.CARRIERS):
        partner = part.get(row[0], DEFAULT_PARTNER)
        vehicle = veh.get(partner, "van")
        out.append(dict(zip(names, row)) | {"seq": seq, "partner": partner, "vehicle": vehicle,
                                            "factor": float(fac.get(vehicle, dims.DEFAULT_VEHICLE_GCO2_PER_KM))})
    return out


def baseline_predictor(requests: DataFrame, cs: list[dict]) -> DataFrame:
    """Historical baseline: cost = 100 + 3 km + 5 kg; on-time = 100 x (1 - delay rate of the partner
    under the route weather); carbon = km x vehicle factor."""
    d, w = F.col("route_distance_km"), F.col("route_weight_kg")
    partner = F.lit([CARRIER_PARTNERS.index(c["partner"]) + 1 for c in cs])
    return requests.withColumns({
        "p_cost": F.array_repeat((100 + 3 * d) + 5 * w, len(cs)),
        "p_on_time": F.transform(partner, lambda i: 100 * (1 - F.element_at("route_rates", i))),
        "p_carbon": F.transform(F.lit([c["factor"] for c in cs]), lambda f: d * f)})


def batch_predictor(score, rating: int = ROUTE_RATING):
    """A predictor from a function of a batch of routes (pandas frame of the delivery features).

    ``score`` returns a frame with ``predicted_cost`` and ``predicted_on_time`` and, if it likes, ``predicted_carbon``
    (else km x vehicle factor).  All carriers of a batch of requests are one call: a request's routes leave its row as
    nothing but its six own features, and come back as three arrays.
    """
    def predict(requests: DataFrame, cs: list[dict]) -> DataFrame:
        k = len(cs)
        partners, vehicles, factors = ([c[n] for c in cs] for n in ("partner", "vehicle", "factor"))

        @F.pandas_udf("cost array<double>, on_time array<double>, carbon array<double>")
        def scored(km: pd.Series, kg: pd.Series, package: pd.Series, mode: pd.Series, region: pd.Series, weather: pd.Series) -> pd.DataFrame:
            import numpy as np
            import pandas as pd

            n = len(km)
            routes = pd.DataFrame({name: np.repeat(x.to_numpy(), k) for name, x in (
                ("distance_km", km), ("package_weight_kg", kg), ("package_type", package), ("delivery_mode", mode),
                ("region", region), ("weather_condition", weather))})
            routes = routes.assign(delivery_rating=float(rating), delivery_partner=partners * n, vehicle_type=vehicles * n)
            out = score(routes)
            carbon = out["predicted_carbon"] if "predicted_carbon" in out else routes["distance_km"] * np.tile(factors, n)
            return pd.DataFrame({name: list(np.asarray(x, float).reshape(n, k)) for name, x in (
                ("cost", out["predicted_cost"]), ("on_time", out["predicted_on_time"]), ("carbon", carbon))})

        p = scored("route_distance_km", "route_weight_kg", "pkg", "route_mode", "origin_region", "route_weather")
        return requests.withColumn("_p", p).withColumns({"p_" + n: F.col("_p")[n] for n in ("cost", "on_time", "carbon")}).drop("_p")

    return predict


def fitted_predictor(cost_model, on_time_model, rating: int = ROUTE_RATING):
    """A predictor from two fitted pipelines (``ml.fit_regressor``): their trees score all carriers' routes batch by batch."""
    from cargolens.operators import ml

    cost, on_time = ml.tree_scorer(cost_model), ml.tree_scorer(on_time_model)

    def score(routes):
        import pandas as pd

        return pd.DataFrame({"predicted_cost": cost(routes), "predicted_on_time": on_time(routes)})

    return batch_predictor(score, rating)


OPTION_FIELDS = ["cost_inr", "seq", "rank", "carrier_code", "carrier_name", "carrier_type", "estimated_on_time_pct",
                 "on_time_low", "on_time_high", "carbon_kg", "has_cold_chain", "has_ev_fleet", "is_express",
                 "delivery_partner", "vehicle_type", "predicted_cost", "predicted_on_time_pct",
                 "predicted_carbon_gco2", "transport_carbon_gco2", "ai_carbon_gco2", "total_carbon_gco2", "meets_sla"]


def with_carriers(requests: DataFrame, min_on_time_col: str = "min_on_time_pct", predictor=None) -> DataFrame:
    """Adds ``offers``, the eligible carriers' (cost, seq, predictions, ...) in the carriers' order, and ``num_options``.

    Eligible: weight <= carrier max, cold chain available when required, origin region covered,
    avg - variance >= min on-time - 10.
    """
    cs = carriers()
    d, w = F.col("route_distance_km"), F.col("route_weight_kg")
    cold, express, region = F.col("requires_cold_chain"), F.col("is_express"), F.col("origin_region")
    floor = (F.col(min_on_time_col) - 5) - 5
    every = F.array(*[F.struct(
        F.lit(c["seq"]).alias("seq"), F.lit(c["max_weight_kg"]).alias("max_kg"), F.lit(list(c["coverage_regions"])).alias("regions"),
        F.lit(c["avg_on_time_pct"] - c["on_time_variance"]).alias("sure"), F.lit(c["has_cold_chain"]).alias("cold"),
        F.lit(c["base_rate_per_kg_km"]).alias("rate"), F.lit(c["express_multiplier"]).alias("express_x"),
        F.lit(c["carrier_cold_multiplier"]).alias("cold_x"), F.lit(c["factor"]).alias("factor")) for c in cs])
    q = (predictor or baseline_predictor)(requests, cs)
    for name in ("p_cost", "p_on_time", "p_carbon"):
        if name not in q.columns:
            q = q.withColumn(name, F.array(*[F.col(f"{name}_{c['seq']}") for c in cs]))
    eligible = F.filter(every, lambda c: (w <= c["max_kg"]) & F.array_contains(c["regions"], region) & (c["sure"] >= floor) & (c["cold"] | ~cold))

    def offer(c: Column) -> Column:
        base = d * w * c["rate"]
        base = F.when(express, base * c["express_x"]).otherwise(base)
        base = F.when(cold, base * c["cold_x"]).otherwise(base)
        at, on_time = c["seq"] + 1, F.element_at("p_on_time", c["seq"] + 1)
        return F.struct(round_half_up(F.greatest(base, F.lit(MIN_QUOTE_COST)), 2).alias("cost"), c["seq"].alias("seq"),
                        F.element_at("p_cost", at).alias("p_cost"), on_time.alias("p_on_time"), F.element_at("p_carbon", at).alias("p_carbon"),
                        (on_time >= F.col("threshold_pct")).alias("meets"), c["factor"].alias("factor"))

    # Out of a generator, so that neither a filter on their number nor a later use works the offers out a second time.
    every = F.explode_outer(F.array(F.struct(F.transform(eligible, offer).alias("offers")))).alias("_o")
    q = q.select(*[c for c in q.columns if c not in ("p_cost", "p_on_time", "p_carbon")], every).withColumn("offers", F.col("_o")["offers"]).drop("_o")
    return q.withColumn("num_options", F.size("offers"))


def ai_carbon() -> Column:
    """AI emissions of evaluating a request's options, shared evenly by them."""
    n = F.col("num_options").cast("long")
    return F.when(n > 0, ((F.lit(dims.dict_value(dims.MODEL_ENERGY_WH, "gradient-boosting")) * (n * 3)) / 1000
                          * F.lit(dims.dict_value(dims.GRID_GCO2_PER_KWH, "india"))) / n)


def transport_carbon(offer: Column) -> Column:
    return F.col("route_distance_km") * offer["factor"] * F.col("cold_chain_multiplier")


def option_fields(offer: Column, rural_col: str | None = None) -> dict[str, Column]:
    """The fields (``rank`` excepted) of the option that ``offer`` (an entry of ``offers``) is.

    What a carrier has is one lookup by number in a constant array.
    """
    cs, pick = carriers(), offer["seq"]

    def has(name: str) -> Column:
        return F.element_at(F.lit([c[name] for c in cs]), pick + 1)

    d, cold = F.col("route_distance_km"), F.col("requires_cold_chain")
    ot = F.when(F.col("is_metro_to_metro"), has("avg_on_time_pct") + has("metro_to_metro_bonus")).otherwise(has("avg_on_time_pct"))
    if rural_col is not None:
        ot = F.when(F.col(rural_col), ot - has("rural_penalty")).otherwise(ot)
    ot = clamp(ot - _weather_penalty(F.col("quote_weather")), 50.0, 99.9)
    half = has("on_time_variance") / 2
    carbon_kg = (d * has("carbon_gco2_per_km")) / 1000
    carbon_kg = F.when(cold, carbon_kg * QUOTE_COLD_CARBON_FACTOR).otherwise(carbon_kg)
    transport = transport_carbon(offer)
    return {
        "cost_inr": offer["cost"], "seq": pick, "carrier_code": has("code"), "carrier_name": has("name"),
        "carrier_type": has("type"), "estimated_on_time_pct": round_half_up(ot, 1),
        "on_time_low": round_half_up(clamp(ot - half, 50.0, 99.9), 1),
        "on_time_high": round_half_up(clamp(ot + half, 50.0, 99.9), 1), "carbon_kg": round_half_up(carbon_kg, 2),
        "has_cold_chain": has("has_cold_chain"), "has_ev_fleet": has("has_ev_fleet"), "is_express": F.col("is_express"),
        "delivery_partner": has("partner"), "vehicle_type": has("vehicle"),
        "predicted_cost": offer["p_cost"], "predicted_on_time_pct": offer["p_on_time"],
        "predicted_carbon_gco2": offer["p_carbon"], "transport_carbon_gco2": transport,
        "ai_carbon_gco2": ai_carbon(), "total_carbon_gco2": transport + ai_carbon(), "meets_sla": offer["meets"]}


def carrier_options(spark, shipments: DataFrame, deliveries: DataFrame, rates: dict | None = None,
                    city_weather: DataFrame | None = None, delay_scorer=None) -> DataFrame:
    """Requests with risk, the SLA actually quoted and the partners' delay rates (``route_rates`` under the
    route's weather, ``partner_rates`` overall); ``explode_options`` / ``choice.decide`` take it from here.

    ``city_weather`` (city, api_weather, search_weather) is the latest observed weather by city; the risk takes the origin's and
    then the destination's first source, then their second one, then the request's own weather.
    """
    keep_methods_compiled(spark)
    rates = rates or history_rates(deliveries)
    r = prepare_requests(spark, shipments)
    if city_weather is not None:
        small = checked_broadcast(city_weather)
        for end, p in (("origin", "_o"), ("destination", "_d")):
            names = [F.col("city").alias(p + "c"), F.col("api_weather").alias(p + "a"), F.col("search_weather").alias(p + "s")]
            r = r.join(small.select(*names), F.col(end) == F.col(p + "c"), "left").drop(p + "c")
        observed = F.coalesce("_oa", "_da", "_os", "_ds")
    else:
        observed = F.lit(None).cast("string")
    r = r.withColumn("risk_weather", F.coalesce(observed,
                                                F.lower(F.when(F.col("weather_condition") != "", F.col("weather_condition"))),
                                                F.lit(DEFAULT_WEATHER))).drop("_oa", "_da", "_os", "_ds")
    r = attach_rates(r, rates, "risk_weather", "risk_rates")
    r = request_risk(r, delay_scorer)
    min_on_time = F.when(F.col("recommended_buffer_days") > 0,
                         F.greatest(F.col("threshold_pct"), F.lit(STRICT_MIN_ON_TIME))).otherwise(F.col("threshold_pct"))
    r = r.withColumn("min_on_time_pct", min_on_time)
    # Predictions use the route's weather (request weather or 'clear'), not the risk weather.
    return attach_rates(r, rates, "route_weather", "route_rates").drop("risk_rates", "default_rates", "g")


def explode_options(spark, requests: DataFrame, keep: list[str], fields: list[str] | None = None, predictor=None,
                    rural_col: str | None = None) -> DataFrame:
    """One row per eligible option: ``keep`` request columns plus the option fields, ``rank`` by quote.

    The options of a request are sorted in its row (cost, then carrier order); their fields are looked up
    after that.
    """
    q = with_carriers(requests, "min_on_time_pct", predictor)
    # The outer form and a filter after it: otherwise the whole array would be worked out twice, once to filter.
    out = q.select("*", F.posexplode_outer(F.sort_array("offers")).alias("_at", "_o")).where(F.col("_o").isNotNull())
    per = option_fields(F.col("_o"), rural_col) | {"rank": F.col("_at") + 1}
    return out.select(*keep, *[per[f].alias(f) for f in (fields or OPTION_FIELDS)])
