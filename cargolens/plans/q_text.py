"""Registered queries: text / JSON parsing, request extraction, defaults and weather fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.operators import text, vendors
from cargolens.plans.catalog import query
from cargolens.plans.sqlkit import register
from cargolens.sources import dims, views


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _num_sql(e: str) -> str:
    return f"CASE WHEN {e} <> '' THEN CAST({e} AS DOUBLE) END"


def _rx(col: str, pat: str, g: int) -> str:
    return f"regexp_extract({col}, {_q(pat)}, {g})"


_FIRST_KM = "replace(" + _rx("replace(text, ',', '')", text.DISTANCE_KM_PATTERN, 1) + ", ',', '')"
DIST_SQL = f"coalesce({_num_sql(_FIRST_KM)}, {_num_sql(_rx('text', text.DISTANCE_WORD_PATTERN, 1))})"


@query("parse_distance_text", f"SELECT id, {DIST_SQL} AS distance_km FROM snippets")
def q_parse_distance_text(spark, sf):
    s = views.snippets(spark, sf)
    return s.select("id", text.parse_distance(F.col("text")).alias("distance_km"))


def _cost_sql() -> str:
    vals = [_num_sql(_rx("replace(text, ',', '')", p, 1)) for p in text.COST_PATTERNS]
    return "coalesce(" + ", ".join(f"CASE WHEN ({v}) > 0 AND ({v}) < 1e7 THEN {v} END" for v in vals) + ")"


@query("parse_cost_text", f"SELECT id, {_cost_sql()} AS cost_inr FROM snippets")
def q_parse_cost_text(spark, sf):
    return views.snippets(spark, sf).select("id", text.parse_cost(F.col("text")).alias("cost_inr"))


_RATE = _num_sql(_rx("replace(text, ',', '')", text.RATE_PATTERN, 0))


@query("parse_rate_text", f"SELECT id, CASE WHEN ({_RATE}) > 0 AND ({_RATE}) < 1e6 THEN {_RATE} END AS rate FROM snippets")
def q_parse_rate_text(spark, sf):
    return views.snippets(spark, sf).select("id", text.parse_rate(F.col("text")).alias("rate"))


def weather_text_sql(col: str) -> str:
    parts = []
    for label, toks in text.WEATHER_TOKENS:
        cond = " OR ".join(f"contains(lower({col}), {_q(t)})" for t in toks)
        parts.append(f"WHEN {cond} THEN {_q(label)}")
    return "CASE " + " ".join(parts) + " END"


@query("classify_weather_text", f"SELECT obs_id, city, {weather_text_sql('snippet')} AS weather_condition FROM weather_obs")
def q_classify_weather_text(spark, sf):
    w = views.weather_obs(spark, sf)
    return w.select("obs_id", "city", text.classify_weather(F.col("snippet")).alias("weather_condition"))


_OWM = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in dims.OWM_CONDITION)
PAYLOAD_SQL = (f"CASE WHEN TRY_CAST(json_extract_string(payload, '$.main.temp') AS DOUBLE) >= 35 THEN 'hot' "
               f"WHEN TRY_CAST(json_extract_string(payload, '$.main.temp') AS DOUBLE) <= 10 THEN 'cold' "
               f"ELSE CASE lower(coalesce(json_extract_string(payload, '$.weather[0].main'), '')) {_OWM} ELSE 'clear' END END")


@query("normalize_weather_payload", f"SELECT obs_id, city, {PAYLOAD_SQL} AS weather_condition FROM weather_obs WHERE source = 'api'")
def q_normalize_weather_payload(spark, sf):
    w = views.weather_obs(spark, sf).where(F.col("source") == "api")
    return w.select("obs_id", "city", text.weather_from_payload(F.col("payload")).alias("weather_condition"))


@query("explode_news_payload", """
SELECT id, a.title, a.description, a.url FROM (
  SELECT id, unnest(from_json(payload, '{"articles":[{"title":"VARCHAR","description":"VARCHAR","url":"VARCHAR"}]}').articles) AS a
  FROM news_payloads) x WHERE a.title IS NOT NULL""")
def q_explode_news_payload(spark, sf):
    n = views.news_payloads(spark, sf)
    parsed = F.from_json("payload", "struct<articles: array<struct<title: string, description: string, url: string>>>")
    e = n.select("id", F.explode(parsed["articles"]).alias("a"))
    return e.where(F.col("a.title").isNotNull()).select("id", "a.title", "a.description", "a.url")


@query("distance_matrix_payload", """
SELECT id, round(CAST(json_extract_string(payload, '$.distances[0][1]') AS DOUBLE) / 1000.0, 2) AS distance_km
FROM matrix_payloads""")
def q_distance_matrix_payload(spark, sf):
    m = views.matrix_payloads(spark, sf)
    return m.select("id", F.round(F.get_json_object("payload", "$.distances[0][1]").cast("double") / 1000.0, 2)
                    .alias("distance_km"))


_VALID = ", ".join(_q(p) for p in dims.VALID_PACKAGE_TYPES)
BLOCK_SQL = (f"coalesce(CASE WHEN {_rx('text', text.FENCED_JSON_PATTERN, 1)} <> '' THEN {_rx('text', text.FENCED_JSON_PATTERN, 1)} END, "
             f"CASE WHEN {_rx('text', text.BARE_JSON_PATTERN, 0)} <> '' THEN {_rx('text', text.BARE_JSON_PATTERN, 0)} END)")


@query("extract_json_block", f"""
SELECT id, block, CASE WHEN lower(trim(json_extract_string(block, '$.package_type'))) IN ({_VALID})
                       THEN lower(trim(json_extract_string(block, '$.package_type'))) END AS package_type
FROM (SELECT id, {BLOCK_SQL} AS block FROM llm_responses) x""")
def q_extract_json_block(spark, sf):
    r = views.llm_responses(spark, sf).select("id", text.json_block(F.col("text")).alias("block"))
    pt = F.lower(F.trim(F.get_json_object("block", "$.package_type")))
    return r.select("id", "block", F.when(pt.isin(*dims.VALID_PACKAGE_TYPES), pt).alias("package_type"))


def _pkg_sql(col: str) -> str:
    parts = " ".join(f"WHEN contains(lower(trim({col})), {_q(ph)}) THEN {_q(c)}" for ph, c in text._ordered_phrases())
    return f"CASE {parts} ELSE 'clothing' END"


_CITIES = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(request_text), {_q(c)}) THEN {_q(c)} END"
                                         for c in dims.EXTRACTION_CITIES) + ")"
register("extracted", f"""
SELECT shipment_id, request_text, {_pkg_sql('request_text')} AS package_type,
  {_num_sql(_rx('lower(trim(request_text))', text.REQUEST_KM_PATTERN, 1))} AS distance_km,
  {_num_sql(_rx('lower(trim(request_text))', text.REQUEST_KG_PATTERN, 1))} AS package_weight_kg,
  CASE WHEN len(str_split(cities, ',')) >= 2 AND cities <> '' THEN str_split(cities, ',')[1] END AS origin,
  CASE WHEN cities = '' THEN NULL WHEN len(str_split(cities, ',')) >= 2 THEN str_split(cities, ',')[2]
       ELSE str_split(cities, ',')[1] END AS destination
FROM (SELECT shipment_id, request_text, {_CITIES} AS cities FROM shipments) s""")


def extracted(spark, sf):
    s = views.shipments(spark, sf, ["shipment_id", "request_text"])
    q = F.lower(F.trim("request_text"))
    cities = text.cities_in_text(F.col("request_text"))
    parts = F.split(cities, ",")
    return s.select(
        "shipment_id", "request_text", text.package_from_text(F.col("request_text")).alias("package_type"),
        text._num(F.regexp_extract(q, text.REQUEST_KM_PATTERN, 1)).alias("distance_km"),
        text._num(F.regexp_extract(q, text.REQUEST_KG_PATTERN, 1)).alias("package_weight_kg"),
        F.when((F.size(parts) >= 2) & (cities != ""), parts[0]).alias("origin"),
        F.when(cities == "", None).when(F.size(parts) >= 2, parts[1]).otherwise(parts[0]).alias("destination"))


@query("extract_requests", "SELECT * FROM extracted")
def q_extract_requests(spark, sf):
    return extracted(spark, sf)


def _region_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN contains(lower({col}), {_q(s)}) THEN {_q(r)}" for s, r in dims.STATE_REGION_HINTS) + " END"


@query("infer_region_from_state", f"""
SELECT e.shipment_id, coalesce(c.region, c2.region, {_region_sql('e.origin')}) AS region
FROM extracted e LEFT JOIN dim_city c ON c.key = e.origin LEFT JOIN dim_city c2 ON c2.key = e.destination""")
def q_infer_region_from_state(spark, sf):
    """The origin city's region, else the destination city's, else a state named in the origin."""
    e = extracted(spark, sf)
    origin, destination = (dims.lookup("dim_city", F.col(c)) for c in ("origin", "destination"))
    return e.select("shipment_id", F.coalesce(origin["region"], destination["region"],
                                              text.region_from_text(F.col("origin"))).alias("region"))


def _valid_sql(col: str, values: list[str], default: str) -> str:
    return f"CASE WHEN lower(trim({col})) IN ({', '.join(_q(v) for v in values)}) THEN lower(trim({col})) ELSE {_q(default)} END"


_SYN = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in dims.PACKAGE_SYNONYMS)
register("validated", f"""
SELECT shipment_id,
  CASE WHEN p IN ({_VALID}) THEN p ELSE 'clothing' END AS package_type,
  {_valid_sql('vehicle_type', dims.VALID_VEHICLE_TYPES, 'van')} AS vehicle_type,
  {_valid_sql('delivery_mode', dims.VALID_DELIVERY_MODES, 'standard')} AS delivery_mode,
  {_valid_sql('delivery_partner', dims.VALID_PARTNERS, 'delhivery')} AS delivery_partner,
  {_valid_sql('weather_condition', dims.VALID_WEATHER, 'clear')} AS weather_condition,
  'north' AS region, coalesce(distance_km, 500.0::DOUBLE) AS distance_km,
  coalesce(package_weight_kg, 10.0::DOUBLE) AS package_weight_kg,
  'no' AS delayed, 'delivered' AS delivery_status, 4 AS delivery_rating
FROM (SELECT *, CASE lower(trim(raw_package_type)) {_SYN} ELSE lower(trim(raw_package_type)) END AS p FROM shipments) s""")


def validated(spark, sf):
    s = views.shipments(spark, sf)
    p0 = F.lower(F.trim("raw_package_type"))
    syn = None
    for k, v in dims.PACKAGE_SYNONYMS:
        syn = F.when(p0 == k, v) if syn is None else syn.when(p0 == k, v)
    p = syn.otherwise(p0)

    def valid(c, values, default):
        x = F.lower(F.trim(c))
        return F.when(x.isin(*values), x).otherwise(default)
    return s.select(
        "shipment_id", F.when(p.isin(*dims.VALID_PACKAGE_TYPES), p).otherwise("clothing").alias("package_type"),
        valid("vehicle_type", dims.VALID_VEHICLE_TYPES, "van").alias("vehicle_type"),
        valid("delivery_mode", dims.VALID_DELIVERY_MODES, "standard").alias("delivery_mode"),
        valid("delivery_partner", dims.VALID_PARTNERS, "delhivery").alias("delivery_partner"),
        valid("weather_condition", dims.VALID_WEATHER, "clear").alias("weather_condition"),
        F.lit("north").alias("region"), F.coalesce("distance_km", F.lit(500.0)).alias("distance_km"),
        F.coalesce("package_weight_kg", F.lit(10.0)).alias("package_weight_kg"),
        F.lit("no").alias("delayed"), F.lit("delivered").alias("delivery_status"), F.lit(4).alias("delivery_rating"))


@query("validate_features", "SELECT * FROM validated")
def q_validate_features(spark, sf):
    return validated(spark, sf)


@query("vehicle_upgrade", """
SELECT shipment_id, vehicle_type AS vehicle_before,
  CASE WHEN distance_km > 1000 AND vehicle_type = 'van' THEN 'truck'
       WHEN distance_km > 500 AND vehicle_type IN ('bike', 'ev bike', 'scooter') THEN 'van'
       ELSE vehicle_type END AS vehicle_type
FROM validated""")
def q_vehicle_upgrade(spark, sf):
    v = validated(spark, sf)
    d, vt = F.col("distance_km"), F.col("vehicle_type")
    return v.select("shipment_id", vt.alias("vehicle_before"),
                    F.when((d > 1000) & (vt == "van"), "truck")
                    .when((d > 500) & vt.isin("bike", "ev bike", "scooter"), "van").otherwise(vt).alias("vehicle_type"))


_FB = dims.FALLBACK_DEFAULTS


@query("merge_defaults", f"""
WITH dfl AS (
  SELECT a.package_type, m1.delivery_partner, m2.vehicle_type, m3.delivery_mode, m4.region, m5.weather_condition,
         a.distance_km, a.package_weight_kg
  FROM (SELECT lower(trim(package_type)) AS package_type, round(avg(distance_km), 2) AS distance_km,
          round(avg(package_weight_kg), 2) AS package_weight_kg FROM deliveries GROUP BY 1) a
  JOIN (SELECT package_type, first(delivery_partner ORDER BY c DESC, delivery_partner) AS delivery_partner FROM (SELECT lower(trim(package_type)) AS package_type, delivery_partner, count(*) c FROM deliveries GROUP BY ALL) GROUP BY 1) m1 USING (package_type)
  JOIN (SELECT package_type, first(vehicle_type ORDER BY c DESC, vehicle_type) AS vehicle_type FROM (SELECT lower(trim(package_type)) AS package_type, vehicle_type, count(*) c FROM deliveries GROUP BY ALL) GROUP BY 1) m2 USING (package_type)
  JOIN (SELECT package_type, first(delivery_mode ORDER BY c DESC, delivery_mode) AS delivery_mode FROM (SELECT lower(trim(package_type)) AS package_type, delivery_mode, count(*) c FROM deliveries GROUP BY ALL) GROUP BY 1) m3 USING (package_type)
  JOIN (SELECT package_type, first(region ORDER BY c DESC, region) AS region FROM (SELECT lower(trim(package_type)) AS package_type, region, count(*) c FROM deliveries GROUP BY ALL) GROUP BY 1) m4 USING (package_type)
  JOIN (SELECT package_type, first(weather_condition ORDER BY c DESC, weather_condition) AS weather_condition FROM (SELECT lower(trim(package_type)) AS package_type, weather_condition, count(*) c FROM deliveries GROUP BY ALL) GROUP BY 1) m5 USING (package_type))
SELECT e.shipment_id, e.package_type,
  coalesce(e.origin, 'mumbai') AS origin, coalesce(e.destination, 'delhi') AS destination,
  coalesce(e.distance_km, d.distance_km, {_FB['distance_km']!r}::DOUBLE) AS distance_km,
  coalesce(e.package_weight_kg, d.package_weight_kg, {_FB['package_weight_kg']!r}::DOUBLE) AS package_weight_kg,
  coalesce(d.delivery_partner, '{_FB['delivery_partner']}') AS delivery_partner,
  coalesce(d.vehicle_type, '{_FB['vehicle_type']}') AS vehicle_type,
  coalesce(d.delivery_mode, '{_FB['delivery_mode']}') AS delivery_mode,
  coalesce(d.region, '{_FB['region']}') AS region,
  coalesce(d.weather_condition, '{_FB['weather_condition']}') AS weather_condition,
  concat_ws(',', CASE WHEN e.origin IS NULL THEN 'origin' END, CASE WHEN e.destination IS NULL THEN 'destination' END,
            CASE WHEN e.distance_km IS NULL THEN 'distance_km' END,
            CASE WHEN e.package_weight_kg IS NULL THEN 'package_weight_kg' END,
            'delivery_partner', 'vehicle_type', 'delivery_mode', 'region', 'weather_condition',
            'delivery_rating') AS defaults_used
FROM extracted e LEFT JOIN dfl d ON d.package_type = e.package_type""")
def q_merge_defaults(spark, sf):
    e = extracted(spark, sf)
    dfl = vendors.defaults_by_package(views.deliveries(spark, sf, ["package_type", *vendors.DEFAULT_CATEGORICALS,
                                                                   "distance_km", "package_weight_kg",
                                                                   "delivery_rating"]))
    j = e.join(F.broadcast(dfl.withColumnsRenamed({"distance_km": "d_km", "package_weight_kg": "d_kg"})),
               "package_type", "left")
    flags = F.concat_ws(",", F.when(F.col("origin").isNull(), "origin"), F.when(F.col("destination").isNull(), "destination"),
                        F.when(F.col("distance_km").isNull(), "distance_km"),
                        F.when(F.col("package_weight_kg").isNull(), "package_weight_kg"),
                        *[F.lit(c) for c in ["delivery_partner", "vehicle_type", "delivery_mode", "region",
                                             "weather_condition", "delivery_rating"]])
    return j.select(
        "shipment_id", "package_type", F.coalesce("origin", F.lit("mumbai")).alias("origin"),
        F.coalesce("destination", F.lit("delhi")).alias("destination"),
        F.coalesce("distance_km", "d_km", F.lit(_FB["distance_km"])).alias("distance_km"),
        F.coalesce("package_weight_kg", "d_kg", F.lit(_FB["package_weight_kg"])).alias("package_weight_kg"),
        *[F.coalesce(c, F.lit(_FB[c])).alias(c) for c in vendors.DEFAULT_CATEGORICALS],
        flags.alias("defaults_used"))


_EXPL_PKG = " OR ".join(f"contains(q, {_q(p)})" for p in dims.VALID_PACKAGE_TYPES + [k for k, _ in dims.PACKAGE_SYNONYMS])
_EXPL_CITY = " OR ".join(f"contains(q, {_q(c)})" for c in text.EXPLICIT_CITIES)
_ALL_KEYS = ["package_type", "origin", "destination", "distance_km", "package_weight_kg", "vehicle_type",
             "delivery_mode", "delivery_partner", "weather_condition", "region"]


@query("defaulted_keys", f"""
SELECT shipment_id, concat_ws(',', {', '.join(
    f"CASE WHEN NOT ({cond}) THEN {_q(k)} END" for k, cond in [
        ('package_type', _EXPL_PKG), ('origin', _EXPL_CITY), ('destination', _EXPL_CITY),
        ('distance_km', f"regexp_matches(q, {_q(text.EXPLICIT_KM_PATTERN)})"),
        ('package_weight_kg', f"regexp_matches(q, {_q(text.EXPLICIT_KG_PATTERN)})")])},
  'vehicle_type', 'delivery_mode', 'delivery_partner', 'weather_condition', 'region') AS defaulted_keys
FROM (SELECT shipment_id, lower(request_text) AS q FROM shipments) s""")
def q_defaulted_keys(spark, sf):
    s = views.shipments(spark, sf, ["shipment_id", "request_text"]).select("shipment_id", F.lower("request_text").alias("q"))
    q = F.col("q")
    any_of = lambda words: F.greatest(*[q.contains(w) for w in words])
    explicit = {"package_type": any_of(dims.VALID_PACKAGE_TYPES + [k for k, _ in dims.PACKAGE_SYNONYMS]),
                "origin": any_of(text.EXPLICIT_CITIES), "destination": any_of(text.EXPLICIT_CITIES),
                "distance_km": q.rlike(text.EXPLICIT_KM_PATTERN), "package_weight_kg": q.rlike(text.EXPLICIT_KG_PATTERN)}
    cols = [F.when(~explicit[k], F.lit(k)) for k in ["package_type", "origin", "destination", "distance_km",
                                                      "package_weight_kg"]]
    cols += [F.lit(k) for k in ["vehicle_type", "delivery_mode", "delivery_partner", "weather_condition", "region"]]
    return s.select("shipment_id", F.concat_ws(",", *cols).alias("defaulted_keys"))


register("latest_obs", f"""
SELECT city, source, max_by(payload, (ts, obs_id)) AS payload, max_by(snippet, (ts, obs_id)) AS snippet
FROM weather_obs GROUP BY ALL""")
register("city_weather", f"""
SELECT city,
  max(CASE WHEN source = 'api' THEN {PAYLOAD_SQL} END) AS api_weather,
  max(CASE WHEN source = 'search' THEN {weather_text_sql('snippet')} END) AS search_weather
FROM latest_obs GROUP BY city""")


def city_weather(spark, sf):
    """Latest observation per (city, source) -> API condition and search condition per city."""
    w = views.weather_obs(spark, sf)
    latest = w.groupBy("city", "source").agg(
        F.max_by("payload", F.struct("ts", "obs_id")).alias("payload"),
        F.max_by("snippet", F.struct("ts", "obs_id")).alias("snippet"))
    return latest.groupBy("city").agg(
        F.max(F.when(F.col("source") == "api", text.weather_from_payload(F.col("payload")))).alias("api_weather"),
        F.max(F.when(F.col("source") == "search", text.classify_weather(F.col("snippet")))).alias("search_weather"))


@query("weather_cascade", """
SELECT s.shipment_id, coalesce(o.api_weather, d.api_weather, o.search_weather, d.search_weather, 'clear') AS weather_condition,
  CASE WHEN o.api_weather IS NOT NULL OR d.api_weather IS NOT NULL THEN 'api'
       WHEN o.search_weather IS NOT NULL OR d.search_weather IS NOT NULL THEN 'search' ELSE 'default' END AS weather_source
FROM shipments s LEFT JOIN city_weather o ON o.city = s.origin LEFT JOIN city_weather d ON d.city = s.destination""")
def q_weather_cascade(spark, sf):
    cw = F.broadcast(city_weather(spark, sf))
    s = views.shipments(spark, sf, ["shipment_id", "origin", "destination"])
    o = cw.select(F.col("city").alias("oc"), F.col("api_weather").alias("oa"), F.col("search_weather").alias("os"))
    d = cw.select(F.col("city").alias("dc"), F.col("api_weather").alias("da"), F.col("search_weather").alias("ds"))
    j = s.join(o, s.origin == o.oc, "left").join(d, s.destination == d.dc, "left")
    return j.select("shipment_id", F.coalesce("oa", "da", "os", "ds", F.lit("clear")).alias("weather_condition"),
                    F.when(F.col("oa").isNotNull() | F.col("da").isNotNull(), "api")
                    .when(F.col("os").isNotNull() | F.col("ds").isNotNull(), "search").otherwise("default")
                    .alias("weather_source"))


@query("source_conflicts", """
SELECT city, api_weather, search_weather,
  CASE WHEN api_weather IS NOT NULL AND search_weather IS NOT NULL AND api_weather = search_weather THEN 'agree'
       WHEN api_weather IS NOT NULL AND search_weather IS NOT NULL THEN 'conflict'
       WHEN api_weather IS NOT NULL THEN 'only_api' WHEN search_weather IS NOT NULL THEN 'only_search'
       ELSE 'none' END AS status
FROM city_weather""")
def q_source_conflicts(spark, sf):
    cw = city_weather(spark, sf)
    a, s = F.col("api_weather"), F.col("search_weather")
    both = a.isNotNull() & s.isNotNull()
    return cw.select("city", "api_weather", "search_weather",
                     F.when(both & (a == s), "agree").when(both, "conflict").when(a.isNotNull(), "only_api")
                     .when(s.isNotNull(), "only_search").otherwise("none").alias("status"))
