"""Adapter views: the library's fact and request tables over the driver's parquet.

The reference reads one delivery CSV; here the same columns are derived from
the TPC-H-like tables with integer arithmetic on keys (see FIXTURES.md), so a
Spark plan and the DuckDB oracle produce identical rows.

Each builder reads only the parquet columns it needs and performs only the
joins its requested columns require (Catalyst cannot drop an unused join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.sources import dims

# FIXED VALUES — label lists indexed by key arithmetic (FIXTURES.md).
P = ["pharmacy", "groceries", "automobile parts", "furniture", "documents",
     "fragile items", "electronics", "clothing", "cosmetics"]
D = ["amazon logistics", "blue dart", "delhivery", "dhl", "ecom express", "ekart",
     "fedex", "shadowfax", "xpressbees"]
V = ["bike", "ev bike", "scooter", "ev van", "van", "truck"]
W = ["clear", "cold", "rainy", "foggy", "hot", "stormy"]
R = ["west", "central", "east", "north", "south"]
C = [c[0] for c in dims.CITIES]
S = ["insulin", "grocery", "auto parts", "furniture", "docs", "breakable", "electronic",
     "fashion", "cosmetics"]
M = [m for m, _ in dims.MODEL_ENERGY_WH if m not in ("claude-3-haiku", "default")] + ["mystery-model"]
K = ["india", "china", "japan", "usa", "canada", "germany", "uk", "france", "norway",
     "poland", "brazil", "australia", "atlantis"]
OWM_MAIN = ["Clear", "Clouds", "Rain", "Thunderstorm", "Mist", "Snow", "Drizzle", "Extreme", "Volcano"]
SNIPPET_WORDS = ["heavy rain and thunder", "light drizzle today", "dense fog over the city",
                 "extreme heat warning", "cold wave, snow likely", "sunny and clear", "no data"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], idx: Column) -> Column:
    """``values[idx]`` for a 0-based integral column."""
    return F.array(*[F.lit(v) for v in values])[idx.cast("int")]


def _sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


DELIVERY_COLUMNS = [
    "delivery_id", "vendor_id", "package_type", "delivery_partner", "region", "vehicle_type",
    "delivery_mode", "weather_condition", "distance_km", "package_weight_kg", "delayed",
    "delivery_status", "delivery_rating", "expected_time_hours", "delivery_time_hours",
    "delivery_cost",
]
_NEEDS_ORDERS = {"delivery_mode", "expected_time_hours", "delivery_time_hours"}
_NEEDS_SUPPLIER = {"region"}


def _mode_from_priority(prio: Column, null_for_5: bool) -> Column:
    ch = F.substring(prio, 1, 1)
    out = (F.when(ch == "1", "same day").when(ch == "2", "express").when(ch == "3", "two day"))
    if null_for_5:
        return out.when(ch == "4", "standard")
    return out.otherwise("standard")


def _delivery_id(ok: Column, ln: Column, pk: Column, sk: Column) -> Column:
    """((ok * 8 + ln) * 10^6 + pk) * 10^5 + sk, modulo 2^63 where that is no long any more (from 11.5 million orders on).

    No step overflows on the way: 10^11 is 5^11 * 2^11, so of a * 5^11 only the lowest 52 bits count, taken in two halves.
    """
    high, low, top = ok * 8 + ln, pk * 100000 + sk, F.lit(2 ** 63 - 1)
    half, bits = F.lit(2 ** 26 - 1), F.lit(2 ** 52 - 1)
    upper = F.shiftleft((F.shiftright(high, 26).bitwiseAND(half) * 5 ** 11).bitwiseAND(half), 26)
    wrapped = F.shiftleft((upper + high.bitwiseAND(half) * 5 ** 11).bitwiseAND(bits), 11)
    fits = high.between(-92 * 10 ** 6, 92 * 10 ** 6) & low.between(-2 * 10 ** 16, 2 * 10 ** 16)
    return F.when(fits, high * 10 ** 11 + low).when(low > top - wrapped, low - (top - wrapped) - 1).otherwise(wrapped + low)


def deliveries(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """One row per lineitem: the delivery fact table of the reference."""
    cols = list(columns or DELIVERY_COLUMNS)
    need = set(cols)
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    df = li
    if need & _NEEDS_ORDERS:
        orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
        df = df.join(orders, df.l_orderkey == orders.o_orderkey, "left")
    if need & _NEEDS_SUPPLIER:
        nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
        sup = (read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
               .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
               .select("s_suppkey", "n_regionkey"))
        df = df.join(sup, df.l_suppkey == sup.s_suppkey, "left")

    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    package = pick(P, pk % 9)
    partner = F.when((package == "pharmacy") & (ok % 2 == 0), F.lit("blue dart")).otherwise(pick(D, sk % 9))
    vehicle = pick(V, (pk + ln) % 6)
    weather = pick(W, ok % 6)
    distance = (F.lit(5) + (ok * 7 + pk * 13 + ln * 29) % 296).cast("double")
    noise = (ok * 31 + pk * 17 + sk * 7 + ln) % 10
    pts = (noise
           + F.when(weather == "stormy", 4).when(weather.isin("rainy", "foggy"), 2).otherwise(0)
           + F.when(vehicle == "truck", 1).otherwise(0)
           + F.when(partner == "xpressbees", 1).when(partner == "blue dart", -2).otherwise(0))
    is_late = pts >= 9
    exprs: dict[str, Column] = {
        "delivery_id": _delivery_id(ok, ln, pk, sk),
        "vendor_id": sk,
        "package_type": package,
        "delivery_partner": partner,
        "vehicle_type": vehicle,
        "weather_condition": weather,
        "distance_km": distance,
        "package_weight_kg": F.col("l_quantity"),
        "delayed": F.when(is_late, "yes").otherwise("no"),
        "delivery_status": F.when(is_late, "delayed").otherwise("delivered"),
        "delivery_rating": F.when(is_late, 1 + noise % 4).otherwise(4 + noise % 2).cast("int"),
        "delivery_cost": (F.lit(100.0) + 3 * distance + 5 * F.col("l_quantity") + 20 * (sk % 9)).cast("double"),
    }
    if need & _NEEDS_ORDERS:
        mode = _mode_from_priority(F.col("o_orderpriority"), null_for_5=False)
        expected = (F.when(mode == "same day", 24.0).when(mode == "express", 48.0)
                    .when(mode == "two day", 72.0).otherwise(120.0))
        exprs["delivery_mode"] = mode
        exprs["expected_time_hours"] = expected
        exprs["delivery_time_hours"] = expected + 2 * (pts - 8)
    if need & _NEEDS_SUPPLIER:
        exprs["region"] = (F.when((package == "groceries") & (ok % 10 < 6), F.lit("west"))
                           .otherwise(pick(R, F.col("n_regionkey"))))
    return df.select(*[exprs[c].alias(c) for c in cols])


SHIPMENT_COLUMNS = [
    "shipment_id", "package_type", "raw_package_type", "origin", "destination", "distance_km",
    "package_weight_kg", "delivery_mode", "weather_condition", "vehicle_type", "delivery_partner",
    "request_text",
]


def shipments(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    """One shipment request per order."""
    cols = list(columns or SHIPMENT_COLUMNS)
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    package = pick(P, ok % 9)
    origin = pick(C, ck % 23)
    destination = pick(C, (ck + 1 + F.expr("o_orderkey div 9") % 24) % 23)
    distance = F.when(ok % 5 == 0, (F.lit(50) + (ok * 13) % 1500).cast("double"))
    weight = F.when(ok % 11 != 0, (F.lit(1) + (ok * 17) % 600).cast("double"))
    exprs: dict[str, Column] = {
        "shipment_id": ok,
        "package_type": package,
        "raw_package_type": (F.when(ok % 29 == 0, F.lit("unknown thing"))
                             .when(ok % 7 == 0, pick(S, ok % 9))
                             .when(ok % 2 == 0, F.concat(F.lit(" "), F.upper(package)))
                             .otherwise(package)),
        "origin": origin,
        "destination": destination,
        "distance_km": distance,
        "package_weight_kg": weight,
        "delivery_mode": _mode_from_priority(F.col("o_orderpriority"), null_for_5=True),
        "weather_condition": F.when(ok % 13 != 0, pick(W, ok % 6)),
        "vehicle_type": pick(V, ok % 6),
        "delivery_partner": pick(D, ck % 9),
        "request_text": F.concat(
            F.lit("Ship "), pick(S, ok % 9), F.lit(" from "), origin, F.lit(" to "), destination,
            F.coalesce(F.concat(F.lit(", "), distance.cast("int").cast("string"), F.lit(" km")), F.lit("")),
            F.coalesce(F.concat(F.lit(", "), weight.cast("int").cast("string"), F.lit(" kg")), F.lit(""))),
    }
    return o.select(*[exprs[c].alias(c) for c in cols])


def inference_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AI inference events: model, country, count, tokens and measured energy."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    eid = F.col("event_id")
    both_null = eid % 30 == 29
    return e.select(
        eid.alias("inference_id"), "ts",
        pick(M, eid % 15).alias("model"),
        pick(K, F.col("user_id") % 13).alias("country"),
        (1 + eid % 5).alias("num_inferences"),
        (100 + 50 * (eid % 40)).alias("tokens"),
        F.when(~both_null & (eid % 3 != 0), (eid % 7) / F.lit(1000.0)).alias("energy_wh"),
        F.when(~both_null & (eid % 3 != 1), (100 * (eid % 11)).cast("double")).alias("energy_joules"),
    )


def weather_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weather observations per city from three sources (api, search, news)."""
    e = read_table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    eid, et = F.col("event_id"), F.col("event_type")
    main = pick(OWM_MAIN, eid % 9)
    temp = eid % 46 - 2
    payload = F.concat(F.lit('{"weather":[{"main":"'), main, F.lit('"}],"main":{"temp":'),
                       temp.cast("string"), F.lit("}}"))
    return e.select(
        eid.alias("obs_id"), "ts",
        pick(C, F.col("user_id") % 23).alias("city"),
        F.when(et.isin("click", "error"), "api").when(et.isin("view", "signup"), "search")
        .when(et == "purchase", "news").alias("source"),
        F.when(et == "error", F.lit("{}")).otherwise(payload).alias("payload"),
        pick(SNIPPET_WORDS, eid % 7).alias("snippet"),
    )


def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    n = (100 + eid % 5000).cast("string")
    k = eid % 6
    text = (F.when(k == 0, F.concat(n, F.lit(" km by road")))
            .when(k == 1, F.concat(F.lit("about 1,"), ((100 + eid % 5000) % 900 + 100).cast("string"), F.lit(" kms")))
            .when(k == 2, F.concat(F.lit("₹"), n, F.lit(" per parcel")))
            .when(k == 3, F.concat(F.lit("Rs. "), n, F.lit(" onwards")))
            .when(k == 4, F.concat(F.lit("rate: "), n))
            .otherwise(F.lit("call us")))
    return e.select(eid.alias("id"), text.alias("text"))


def news_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    full = F.concat(F.lit('{"articles":[{"title":"t'), eid.cast("string"),
                    F.lit('","description":"d","url":"u"},{"title":null,"description":"x","url":"y"}]}'))
    return e.select(eid.alias("id"),
                    F.when(eid % 4 == 0, F.lit('{"articles":[]}')).otherwise(full).alias("payload"))


def matrix_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    return e.select(eid.alias("id"),
                    F.concat(F.lit('{"distances":[[0,'), (1000 * (eid % 700) + 37).cast("string"),
                             F.lit("],[1,0]]}")).alias("payload"))


def llm_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events").select("event_id")
    eid = F.col("event_id")
    obj = F.concat(F.lit('{"package_type": "'), pick(P, eid % 9), F.lit('"}'))
    text = (F.when(eid % 3 == 0, F.concat(F.lit("Here is the result:\n```json\n"), obj, F.lit("\n```")))
            .when(eid % 3 == 1, F.concat(F.lit("The shipment is "), obj, F.lit(" as requested.")))
            .otherwise(F.lit("No structured answer available.")))
    return e.select(eid.alias("id"), text.alias("text"))


# ---------------------------------------------------------------------------
# The same views as DuckDB SQL (oracle side)
# ---------------------------------------------------------------------------

def _pick_sql(values: list[str], idx: str) -> str:
    return f"{_sql_list(values)}[({idx}) + 1]"


VIEW_SQL: dict[str, str] = {}

VIEW_SQL["deliveries"] = f"""
SELECT
  ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 100000 + l_suppkey AS delivery_id,
  l_suppkey AS vendor_id,
  package_type,
  delivery_partner,
  CASE WHEN package_type = 'groceries' AND l_orderkey % 10 < 6 THEN 'west'
       ELSE {_pick_sql(R, 'n_regionkey')} END AS region,
  vehicle_type,
  delivery_mode,
  weather_condition,
  distance_km,
  l_quantity AS package_weight_kg,
  CASE WHEN pts >= 9 THEN 'yes' ELSE 'no' END AS delayed,
  CASE WHEN pts >= 9 THEN 'delayed' ELSE 'delivered' END AS delivery_status,
  CAST(CASE WHEN pts >= 9 THEN 1 + noise % 4 ELSE 4 + noise % 2 END AS INTEGER) AS delivery_rating,
  expected_time_hours,
  expected_time_hours + 2 * (pts - 8) AS delivery_time_hours,
  CAST(100.0 + 3 * distance_km + 5 * l_quantity + 20 * (l_suppkey % 9) AS DOUBLE) AS delivery_cost
FROM (
  SELECT *,
    noise
      + CASE WHEN weather_condition = 'stormy' THEN 4 WHEN weather_condition IN ('rainy', 'foggy') THEN 2 ELSE 0 END
      + CASE WHEN vehicle_type = 'truck' THEN 1 ELSE 0 END
      + CASE WHEN delivery_partner = 'xpressbees' THEN 1 WHEN delivery_partner = 'blue dart' THEN -2 ELSE 0 END AS pts,
    CASE delivery_mode WHEN 'same day' THEN 24.0 WHEN 'express' THEN 48.0 WHEN 'two day' THEN 72.0
         ELSE 120.0 END::DOUBLE AS expected_time_hours
  FROM (
    SELECT l.l_orderkey, l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, sn.n_regionkey,
      pk AS package_type,
      CASE WHEN pk = 'pharmacy' AND l.l_orderkey % 2 = 0 THEN 'blue dart'
           ELSE {_pick_sql(D, 'l.l_suppkey % 9')} END AS delivery_partner,
      {_pick_sql(V, '(l.l_partkey + l.l_linenumber) % 6')} AS vehicle_type,
      CASE substr(o.o_orderpriority, 1, 1) WHEN '1' THEN 'same day' WHEN '2' THEN 'express'
           WHEN '3' THEN 'two day' ELSE 'standard' END AS delivery_mode,
      {_pick_sql(W, 'l.l_orderkey % 6')} AS weather_condition,
      CAST(5 + (l.l_orderkey * 7 + l.l_partkey * 13 + l.l_linenumber * 29) % 296 AS DOUBLE) AS distance_km,
      (l.l_orderkey * 31 + l.l_partkey * 17 + l.l_suppkey * 7 + l.l_linenumber) % 10 AS noise
    FROM (SELECT *, {_pick_sql(P, 'l_partkey % 9')} AS pk FROM lineitem) l
    LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
    LEFT JOIN (SELECT s.s_suppkey, n.n_regionkey FROM supplier s
               LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey) sn ON l.l_suppkey = sn.s_suppkey
  ) b
) c
"""

VIEW_SQL["shipments"] = f"""
SELECT
  o_orderkey AS shipment_id,
  package_type,
  CASE WHEN o_orderkey % 29 = 0 THEN 'unknown thing'
       WHEN o_orderkey % 7 = 0 THEN {_pick_sql(S, 'o_orderkey % 9')}
       WHEN o_orderkey % 2 = 0 THEN ' ' || upper(package_type)
       ELSE package_type END AS raw_package_type,
  origin, destination, distance_km, package_weight_kg,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'same day' WHEN '2' THEN 'express'
       WHEN '3' THEN 'two day' WHEN '4' THEN 'standard' END AS delivery_mode,
  CASE WHEN o_orderkey % 13 <> 0 THEN {_pick_sql(W, 'o_orderkey % 6')} END AS weather_condition,
  {_pick_sql(V, 'o_orderkey % 6')} AS vehicle_type,
  {_pick_sql(D, 'o_custkey % 9')} AS delivery_partner,
  'Ship ' || {_pick_sql(S, 'o_orderkey % 9')} || ' from ' || origin || ' to ' || destination
    || coalesce(', ' || CAST(CAST(distance_km AS INTEGER) AS VARCHAR) || ' km', '')
    || coalesce(', ' || CAST(CAST(package_weight_kg AS INTEGER) AS VARCHAR) || ' kg', '') AS request_text
FROM (
  SELECT o_orderkey, o_custkey, o_orderpriority,
    {_pick_sql(P, 'o_orderkey % 9')} AS package_type,
    {_pick_sql(C, 'o_custkey % 23')} AS origin,
    {_pick_sql(C, '(o_custkey + 1 + (o_orderkey // 9) % 24) % 23')} AS destination,
    CASE WHEN o_orderkey % 5 = 0 THEN CAST(50 + (o_orderkey * 13) % 1500 AS DOUBLE) END AS distance_km,
    CASE WHEN o_orderkey % 11 <> 0 THEN CAST(1 + (o_orderkey * 17) % 600 AS DOUBLE) END AS package_weight_kg
  FROM orders
) o
"""

VIEW_SQL["inference_log"] = f"""
SELECT event_id AS inference_id, ts,
  {_pick_sql(M, 'event_id % 15')} AS model,
  {_pick_sql(K, 'user_id % 13')} AS country,
  1 + event_id % 5 AS num_inferences,
  100 + 50 * (event_id % 40) AS tokens,
  CASE WHEN event_id % 30 <> 29 AND event_id % 3 <> 0 THEN (event_id % 7) / 1000.0 END::DOUBLE AS energy_wh,
  CASE WHEN event_id % 30 <> 29 AND event_id % 3 <> 1 THEN CAST(100 * (event_id % 11) AS DOUBLE) END AS energy_joules
FROM events
"""

VIEW_SQL["weather_obs"] = f"""
SELECT event_id AS obs_id, ts,
  {_pick_sql(C, 'user_id % 23')} AS city,
  CASE WHEN event_type IN ('click', 'error') THEN 'api' WHEN event_type IN ('view', 'signup') THEN 'search'
       WHEN event_type = 'purchase' THEN 'news' END AS source,
  CASE WHEN event_type = 'error' THEN '{{}}'
       ELSE '{{"weather":[{{"main":"' || {_pick_sql(OWM_MAIN, 'event_id % 9')} || '"}}],"main":{{"temp":'
            || CAST(event_id % 46 - 2 AS VARCHAR) || '}}}}' END AS payload,
  {_pick_sql(SNIPPET_WORDS, 'event_id % 7')} AS snippet
FROM events
"""

VIEW_SQL["snippets"] = """
SELECT event_id AS id,
  CASE event_id % 6
    WHEN 0 THEN CAST(100 + event_id % 5000 AS VARCHAR) || ' km by road'
    WHEN 1 THEN 'about 1,' || CAST((100 + event_id % 5000) % 900 + 100 AS VARCHAR) || ' kms'
    WHEN 2 THEN '₹' || CAST(100 + event_id % 5000 AS VARCHAR) || ' per parcel'
    WHEN 3 THEN 'Rs. ' || CAST(100 + event_id % 5000 AS VARCHAR) || ' onwards'
    WHEN 4 THEN 'rate: ' || CAST(100 + event_id % 5000 AS VARCHAR)
    ELSE 'call us' END AS text
FROM events
"""

VIEW_SQL["news_payloads"] = """
SELECT event_id AS id,
  CASE WHEN event_id % 4 = 0 THEN '{"articles":[]}'
       ELSE '{"articles":[{"title":"t' || CAST(event_id AS VARCHAR)
            || '","description":"d","url":"u"},{"title":null,"description":"x","url":"y"}]}' END AS payload
FROM events
"""

VIEW_SQL["matrix_payloads"] = """
SELECT event_id AS id,
  '{"distances":[[0,' || CAST(1000 * (event_id % 700) + 37 AS VARCHAR) || '],[1,0]]}' AS payload
FROM events
"""

VIEW_SQL["llm_responses"] = f"""
SELECT event_id AS id,
  CASE event_id % 3
    WHEN 0 THEN 'Here is the result:' || chr(10) || '```json' || chr(10) || '{{"package_type": "'
                || {_pick_sql(P, 'event_id % 9')} || '"}}' || chr(10) || '```'
    WHEN 1 THEN 'The shipment is {{"package_type": "' || {_pick_sql(P, 'event_id % 9')} || '"}} as requested.'
    ELSE 'No structured answer available.' END AS text
FROM events
"""
