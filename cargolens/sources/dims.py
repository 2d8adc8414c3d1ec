"""Reference dimensions as small DataFrames with explicit schemas.

Every table here is a fixed list of at most a few dozen rows, so it is
always safe to broadcast: its size does not grow with the fact tables.
The same Python lists also render as SQL ``VALUES`` text for the DuckDB
oracle, so both sides read one source of truth.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES — these must equal the reference's published constants.
# ---------------------------------------------------------------------------

# Vehicle emission factor, gCO2 per km (unknown vehicle -> 800).
VEHICLE_GCO2_PER_KM = [
    ("bike", 50.0),
    ("ev bike", 20.0),
    ("scooter", 60.0),
    ("ev van", 150.0),
    ("van", 800.0),
    ("truck", 1200.0),
]
DEFAULT_VEHICLE_GCO2_PER_KM = 800.0

# Grid carbon intensity, gCO2 per kWh ("default" is used for unknown countries).
GRID_GCO2_PER_KWH = [
    ("india", 708.0),
    ("china", 555.0),
    ("japan", 465.0),
    ("usa", 386.0),
    ("canada", 110.0),
    ("germany", 350.0),
    ("uk", 193.0),
    ("france", 56.0),
    ("norway", 20.0),
    ("poland", 635.0),
    ("brazil", 85.0),
    ("australia", 520.0),
    ("default", 400.0),
]
DEFAULT_GRID_GCO2_PER_KWH = 400.0

# Region -> country (unknown region -> india).
REGION_COUNTRY = [
    ("west", "india"),
    ("central", "india"),
    ("east", "india"),
    ("north", "india"),
    ("south", "india"),
]
DEFAULT_COUNTRY = "india"

# Energy per inference, Wh ("default" is used for unknown models).
MODEL_ENERGY_WH = [
    ("gpt-4", 0.0029),
    ("gpt-4-turbo", 0.0023),
    ("gpt-3.5-turbo", 0.0004),
    ("gpt-3.5", 0.0004),
    ("claude-3-opus", 0.0027),
    ("claude-3-sonnet", 0.0015),
    ("claude-3", 0.0015),
    ("gemini-pro", 0.0018),
    ("gemini-flash", 0.0006),
    ("gemini-2.5-flash", 0.0006),
    ("gradient-boosting", 0.00001),
    ("random-forest", 0.00001),
    ("xgboost", 0.00002),
    ("neural-net-small", 0.0001),
    ("claude-3-haiku", 0.0006),
    ("default", 0.001),
]
DEFAULT_MODEL_WH = 0.001

# Models whose energy scales with sqrt(tokens / 500).
TOKEN_SCALED_MODELS = [
    "gpt-4", "gpt-4-turbo", "gpt-3.5-turbo", "gpt-3.5",
    "claude-3-opus", "claude-3-sonnet", "claude-3",
    "gemini-pro", "gemini-flash", "gemini-2.5-flash",
]

# Package policy: package_type, stakes, tier, tier_name, on_time_threshold,
# cold_chain_multiplier, priority, impact_multiplier.
POLICY = [
    ("pharmacy", "critical", 1, "CRITICAL", 0.99, 2.5, "safety", 10.0),
    ("groceries", "critical", 1, "CRITICAL", 0.99, 2.0, "safety", 3.0),
    ("automobile parts", "high_value", 2, "HIGH_VALUE", 0.95, 1.0, "reliability", 3.0),
    ("furniture", "high_value", 2, "HIGH_VALUE", 0.95, 1.0, "cost", 2.0),
    ("documents", "high_value", 2, "HIGH_VALUE", 0.95, 1.0, "speed", 2.5),
    ("fragile items", "high_value", 2, "HIGH_VALUE", 0.95, 1.0, "safety", 2.0),
    ("electronics", "high_value", 2, "HIGH_VALUE", 0.95, 1.0, "value", 5.0),
    ("clothing", "standard", 3, "STANDARD", 0.85, 1.0, "carbon", 1.0),
    ("cosmetics", "standard", 3, "STANDARD", 0.85, 1.0, "carbon", 1.0),
]
DEFAULT_POLICY = ("high_value", 2, "HIGH_VALUE", 0.95, 1.0, "reliability", 1.5)

# Stakes -> agent label used in optimizer output.
STAKES_AGENT_LABEL = [
    ("critical", "high_stakes"),
    ("high_value", "medium_stakes"),
    ("standard", "low_stakes"),
]

# Carriers in file order: code, name, type, avg_on_time_pct, on_time_variance,
# base_rate_per_kg_km, express_multiplier, cold_chain_multiplier, has_cold_chain,
# has_ev_fleet, max_weight_kg, coverage_regions, carbon_gco2_per_km,
# metro_to_metro_bonus, rural_penalty.
_ALL_REGIONS = ["north", "west", "south", "east", "central"]
CARRIERS = [
    ("DEL-EXP", "Delhivery Express", "express", 94.5, 3.0, 0.08, 1.5, 2.0, True, True, 500.0, _ALL_REGIONS, 450.0, 3.0, 8.0),
    ("DEL-STD", "Delhivery Standard", "standard", 89.0, 5.0, 0.05, 1.3, 1.8, True, True, 1000.0, _ALL_REGIONS, 500.0, 2.0, 10.0),
    ("BLU-EXP", "BlueDart Express", "express", 96.0, 2.5, 0.12, 1.6, 2.2, True, False, 300.0, _ALL_REGIONS, 600.0, 4.0, 5.0),
    ("DTDC-STD", "DTDC Standard", "standard", 85.0, 7.0, 0.04, 1.4, 0.0, False, False, 2000.0, _ALL_REGIONS, 700.0, 1.0, 12.0),
    ("ECOM", "Ecom Express", "standard", 88.0, 6.0, 0.045, 1.35, 0.0, False, False, 500.0, ["north", "west", "south", "east"], 650.0, 2.5, 15.0),
    ("XBEES", "XpressBees", "express", 91.0, 4.5, 0.06, 1.4, 1.9, True, True, 400.0, _ALL_REGIONS, 480.0, 3.5, 9.0),
    ("SHDW", "Shadowfax", "express", 92.0, 4.0, 0.055, 1.3, 2.1, True, True, 200.0, ["north", "west", "south"], 420.0, 4.0, 7.0),
    ("EKART", "Ekart (Flipkart)", "standard", 90.0, 5.0, 0.05, 1.25, 0.0, False, True, 800.0, _ALL_REGIONS, 520.0, 3.0, 8.0),
    ("DHL-EXP", "DHL Express India", "express", 97.5, 1.5, 0.18, 1.8, 2.5, True, False, 500.0, _ALL_REGIONS, 550.0, 5.0, 3.0),
    ("GATI", "Gati Express", "express", 87.0, 6.0, 0.055, 1.35, 1.7, True, False, 5000.0, _ALL_REGIONS, 750.0, 1.5, 6.0),
]

# Carrier code -> delivery partner; partner -> vehicle.
CARRIER_PARTNER = [
    ("DEL-EXP", "delhivery"),
    ("DEL-STD", "delhivery"),
    ("BLU-EXP", "blue dart"),
    ("DHL-EXP", "dhl"),
    ("SHDW", "shadowfax"),
    ("ECOM", "ecom express"),
    ("XBEES", "xpressbees"),
    ("EKART", "ekart"),
    ("DTDC-STD", "dtdc"),
    ("GATI", "gati"),
]
PARTNER_VEHICLE = [
    ("delhivery", "ev van"),
    ("blue dart", "van"),
    ("dhl", "truck"),
    ("shadowfax", "bike"),
    ("ecom express", "van"),
    ("xpressbees", "van"),
    ("ekart", "ev van"),
    ("dtdc", "van"),
    ("gati", "truck"),
]

# Quote on-time penalty by weather ("stormy" is renamed "storm" before lookup).
WEATHER_PENALTY = [("clear", 0.0), ("cloudy", 1.0), ("rainy", 5.0), ("foggy", 8.0), ("storm", 15.0)]

# Cities in file order: key, name, code, region, is_metro, state, latitude, longitude.
CITIES = [
    ("delhi", "Delhi", "DEL", "north", True, "Delhi", 28.6139, 77.2090),
    ("noida", "Noida", "NOI", "north", True, "Uttar Pradesh", 28.5355, 77.3910),
    ("gurgaon", "Gurgaon", "GGN", "north", True, "Haryana", 28.4595, 77.0266),
    ("chandigarh", "Chandigarh", "CHD", "north", False, "Chandigarh", 30.7333, 76.7794),
    ("lucknow", "Lucknow", "LKO", "north", False, "Uttar Pradesh", 26.8467, 80.9462),
    ("jaipur", "Jaipur", "JAI", "north", False, "Rajasthan", 26.9124, 75.7873),
    ("mumbai", "Mumbai", "MUM", "west", True, "Maharashtra", 19.0760, 72.8777),
    ("pune", "Pune", "PNQ", "west", True, "Maharashtra", 18.5204, 73.8567),
    ("ahmedabad", "Ahmedabad", "AMD", "west", True, "Gujarat", 23.0225, 72.5714),
    ("surat", "Surat", "STV", "west", False, "Gujarat", 21.1702, 72.8311),
    ("nagpur", "Nagpur", "NAG", "central", False, "Maharashtra", 21.1458, 79.0882),
    ("bangalore", "Bangalore", "BLR", "south", True, "Karnataka", 12.9716, 77.5946),
    ("chennai", "Chennai", "MAA", "south", True, "Tamil Nadu", 13.0827, 80.2707),
    ("hyderabad", "Hyderabad", "HYD", "south", True, "Telangana", 17.3850, 78.4867),
    ("kochi", "Kochi", "COK", "south", False, "Kerala", 9.9312, 76.2673),
    ("coimbatore", "Coimbatore", "CJB", "south", False, "Tamil Nadu", 11.0168, 76.9558),
    ("kolkata", "Kolkata", "CCU", "east", True, "West Bengal", 22.5726, 88.3639),
    ("bhubaneswar", "Bhubaneswar", "BBI", "east", False, "Odisha", 20.2961, 85.8245),
    ("patna", "Patna", "PAT", "east", False, "Bihar", 25.5941, 85.1376),
    ("guwahati", "Guwahati", "GAU", "east", False, "Assam", 26.1445, 91.7362),
    ("indore", "Indore", "IDR", "central", False, "Madhya Pradesh", 22.7196, 75.8577),
    ("bhopal", "Bhopal", "BHO", "central", False, "Madhya Pradesh", 23.2599, 77.4126),
    ("goa", "Goa", "GOI", "west", False, "Goa", 15.2993, 74.1240),
]

# Lane distances in file order: origin, destination, km.
LANES = [
    ("delhi", "mumbai", 1400.0),
    ("delhi", "bangalore", 2150.0),
    ("delhi", "chennai", 2200.0),
    ("delhi", "kolkata", 1500.0),
    ("delhi", "hyderabad", 1550.0),
    ("delhi", "ahmedabad", 950.0),
    ("delhi", "jaipur", 280.0),
    ("delhi", "lucknow", 550.0),
    ("delhi", "chandigarh", 250.0),
    ("delhi", "pune", 1450.0),
    ("mumbai", "bangalore", 980.0),
    ("mumbai", "chennai", 1340.0),
    ("mumbai", "hyderabad", 710.0),
    ("mumbai", "pune", 150.0),
    ("mumbai", "ahmedabad", 530.0),
    ("mumbai", "kolkata", 2050.0),
    ("mumbai", "nagpur", 840.0),
    ("mumbai", "surat", 290.0),
    ("bangalore", "chennai", 350.0),
    ("bangalore", "hyderabad", 570.0),
    ("bangalore", "kochi", 560.0),
    ("bangalore", "coimbatore", 360.0),
    ("bangalore", "pune", 840.0),
    ("chennai", "hyderabad", 630.0),
    ("chennai", "kolkata", 1670.0),
    ("kolkata", "patna", 590.0),
    ("kolkata", "bhubaneswar", 470.0),
    ("hyderabad", "nagpur", 500.0),
    ("ahmedabad", "indore", 400.0),
    ("jaipur", "ahmedabad", 670.0),
    ("delhi", "noida", 25.0),
    ("delhi", "gurgaon", 30.0),
    ("noida", "gurgaon", 45.0),
]

# Popular lanes (directed, as listed).
POPULAR_LANES = [
    ("delhi", "mumbai"), ("delhi", "bangalore"), ("mumbai", "bangalore"),
    ("mumbai", "chennai"), ("delhi", "kolkata"), ("bangalore", "chennai"),
    ("delhi", "hyderabad"), ("mumbai", "hyderabad"), ("delhi", "ahmedabad"),
    ("mumbai", "pune"),
]

# Governance recommendations per stakes level: stakes, seq, category, recommendation, rationale.
GOVERNANCE = [
    ("critical", 1, "Vehicle Selection", "Use EV Van (minimize carbon within safety constraints)",
     "High-stakes packages require reliable transport with carbon optimization"),
    ("critical", 2, "Inventory Buffer", "+20% safety stock buffer",
     "High-stakes packages require safety stock to meet ≥99% on-time"),
    ("critical", 3, "Carrier Selection", "Premium partners only (≥98% reliability)",
     "High-stakes packages require maximum reliability"),
    ("critical", 4, "AI Compute Policy", "Use Gemini Flash (lowest AI carbon)",
     "Minimize AI compute carbon while maintaining safety"),
    ("critical", 5, "Sourcing Location", "Flexible location (optimize for cost)",
     "Lower-stakes packages prioritize cost over carbon location"),
    ("high_value", 1, "Vehicle Selection", "Use EV Van or Van (balanced approach)",
     "Medium-stakes packages balance cost and carbon"),
    ("high_value", 2, "Inventory Buffer", "+10% standard buffer",
     "Medium-stakes packages need moderate buffer"),
    ("high_value", 3, "Carrier Selection", "Standard carriers (≥95% reliability)",
     "Medium-stakes packages need reliable but cost-effective options"),
    ("high_value", 4, "AI Compute Policy", "Use Gemini Flash with moderate query frequency",
     "Balance AI optimization benefits with carbon cost"),
    ("high_value", 5, "Sourcing Location", "Flexible location (optimize for cost)",
     "Lower-stakes packages prioritize cost over carbon location"),
    ("standard", 1, "Vehicle Selection", "Use Bike/Scooter (maximize carbon savings)",
     "Low-stakes packages can use low-carbon vehicles without penalty"),
    ("standard", 2, "Inventory Buffer", "-10% lean inventory (reduce waste)",
     "Low-stakes packages can operate with lean inventory"),
    ("standard", 3, "Carrier Selection", "Budget carriers OK (≥85% reliability)",
     "Low-stakes packages can use cost-effective carriers"),
    ("standard", 4, "AI Compute Policy", "Batch queries (reduce AI calls)",
     "Low-stakes packages can batch optimizations to reduce AI carbon"),
    ("standard", 5, "Sourcing Location", "Flexible location (optimize for cost)",
     "Lower-stakes packages prioritize cost over carbon location"),
]

# Portfolio rules: scope (package type or stakes), min_reliability, max_cost_premium,
# vehicles, vehicle_rule ('required' or 'allowed'), buffer_percentage.
PORTFOLIO = [
    ("pharmacy", 0.98, 1.5, ["ev van", "van"], "required", 0.20),
    ("electronics", 0.95, 1.3, ["ev van", "van"], "required", 0.15),
    ("groceries", 0.95, 1.4, ["ev van", "truck"], "required", 0.20),
    ("high_value", 0.90, 1.2, ["ev van", "van", "truck"], "allowed", 0.10),
    ("standard", 0.85, 1.0, ["bike", "ev bike", "scooter", "ev van"], "allowed", -0.10),
]

# Weather-API main -> condition (unknown main -> clear; temp >= 35 hot, <= 10 cold).
OWM_CONDITION = [
    ("clear", "clear"), ("clouds", "clear"), ("drizzle", "rainy"), ("rain", "rainy"),
    ("thunderstorm", "stormy"), ("snow", "cold"), ("mist", "foggy"), ("fog", "foggy"),
    ("haze", "foggy"), ("extreme", "stormy"),
]

# Valid value domains and extraction word lists.
VALID_PACKAGE_TYPES = ["pharmacy", "clothing", "electronics", "groceries", "automobile parts",
                       "fragile items", "documents", "furniture", "cosmetics"]
VALID_VEHICLE_TYPES = ["bike", "ev bike", "scooter", "ev van", "van", "truck"]
VALID_DELIVERY_MODES = ["same day", "express", "two day", "standard"]
VALID_WEATHER = ["clear", "cold", "rainy", "foggy", "hot", "stormy"]
VALID_REGIONS = ["west", "central", "east", "north", "south"]
VALID_PARTNERS = ["delhivery", "xpressbees", "shadowfax", "dhl", "amazon logistics", "blue dart",
                  "fedex", "ecom express", "ekart", "dtdc", "gati"]
PACKAGE_SYNONYMS = [
    ("fashion", "clothing"), ("apparel", "clothing"), ("clothes", "clothing"),
    ("medicine", "pharmacy"), ("medical", "pharmacy"), ("pharma", "pharmacy"),
    ("insulin", "pharmacy"), ("vaccine", "pharmacy"), ("vaccines", "pharmacy"),
    ("drugs", "pharmacy"), ("medication", "pharmacy"), ("prescription", "pharmacy"),
    ("food", "groceries"), ("perishables", "groceries"), ("grocery", "groceries"),
    ("fragile", "fragile items"), ("breakable", "fragile items"), ("glass", "fragile items"),
    ("car parts", "automobile parts"), ("auto", "automobile parts"), ("auto parts", "automobile parts"),
    ("electronic", "electronics"), ("docs", "documents"),
]
EXTRACTION_CITIES = ["mumbai", "delhi", "bangalore", "chennai", "kolkata", "hyderabad",
                     "pune", "ahmedabad", "jaipur", "lucknow", "surat", "nagpur"]
STATE_REGION_HINTS = [
    ("west bengal", "east"), ("bengal", "east"), ("odisha", "east"), ("orissa", "east"),
    ("bihar", "east"), ("jharkhand", "east"), ("assam", "east"), ("tripura", "east"),
    ("maharashtra", "west"), ("gujarat", "west"), ("goa", "west"), ("rajasthan", "west"),
    ("karnataka", "south"), ("tamil nadu", "south"), ("kerala", "south"), ("andhra", "south"),
    ("telangana", "south"), ("puducherry", "south"),
    ("punjab", "north"), ("haryana", "north"), ("himachal", "north"), ("uttarakhand", "north"),
    ("uttar pradesh", "north"), ("delhi", "north"), ("jammu", "north"), ("kashmir", "north"),
    ("madhya pradesh", "central"), ("chhattisgarh", "central"),
]
# Domain defaults used by feature validation, and the data-free fallback defaults.
VALIDATION_DEFAULTS = {"package_type": "clothing", "vehicle_type": "van", "delivery_mode": "standard",
                       "delivery_partner": "delhivery", "weather_condition": "clear", "region": "north",
                       "distance_km": 500.0, "package_weight_kg": 10.0}
FALLBACK_DEFAULTS = {"delivery_partner": "delhivery", "vehicle_type": "van", "delivery_mode": "two day",
                     "region": "west", "weather_condition": "clear", "distance_km": 150.0,
                     "package_weight_kg": 25.0, "delivery_rating": 4.0}

# Risk level cut-offs and buffer days.
RISK_BUFFER_DAYS = [("CRITICAL", 2), ("HIGH", 1), ("MEDIUM", 1), ("LOW", 0)]

def dict_value(pairs: list[tuple], key: str):
    return dict(pairs)[key]


# ---------------------------------------------------------------------------
# Schemas and DataFrame builders
# ---------------------------------------------------------------------------

SCHEMAS: dict[str, str] = {
    "dim_vehicle": "vehicle_type string, gco2_per_km double",
    "dim_grid": "country string, gco2_kwh double",
    "dim_region_country": "region string, country string",
    "dim_model": "model string, energy_wh double",
    "dim_policy": ("package_type string, stakes string, tier int, tier_name string, "
                   "on_time_threshold double, cold_chain_multiplier double, priority string, "
                   "impact_multiplier double"),
    "dim_carrier": ("code string, name string, type string, avg_on_time_pct double, "
                    "on_time_variance double, base_rate_per_kg_km double, express_multiplier double, "
                    "carrier_cold_multiplier double, has_cold_chain boolean, has_ev_fleet boolean, "
                    "max_weight_kg double, coverage_regions array<string>, carbon_gco2_per_km double, "
                    "metro_to_metro_bonus double, rural_penalty double, seq int"),
    "dim_partner": "code string, delivery_partner string, vehicle_type string",
    "dim_city": ("key string, name string, code string, region string, is_metro boolean, "
                 "state string, latitude double, longitude double"),
    "dim_lane": "origin string, destination string, distance_km double",
    "dim_governance": "stakes string, seq int, category string, recommendation string, rationale string",
    "dim_portfolio": ("scope string, min_reliability double, max_cost_premium double, "
                      "vehicles array<string>, vehicle_rule string, buffer_percentage double"),
}


def _rows(name: str) -> list[tuple]:
    if name == "dim_vehicle":
        return list(VEHICLE_GCO2_PER_KM)
    if name == "dim_grid":
        return list(GRID_GCO2_PER_KWH)
    if name == "dim_region_country":
        return list(REGION_COUNTRY)
    if name == "dim_model":
        return list(MODEL_ENERGY_WH)
    if name == "dim_policy":
        return list(POLICY)
    if name == "dim_carrier":
        return [c + (i,) for i, c in enumerate(CARRIERS)]
    if name == "dim_partner":
        veh = dict(PARTNER_VEHICLE)
        return [(code, p, veh[p]) for code, p in CARRIER_PARTNER]
    if name == "dim_city":
        return list(CITIES)
    if name == "dim_lane":
        return list(LANES)
    if name == "dim_governance":
        return list(GOVERNANCE)
    if name == "dim_portfolio":
        return list(PORTFOLIO)
    raise KeyError(name)


def _spark_lit(v, ctype: str) -> str:
    if v is None:
        return f"CAST(NULL AS {ctype.upper()})"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, list):
        return "array(" + ", ".join(_spark_lit(x, "string") for x in v) + ")"
    if ctype == "double":
        return repr(float(v)) + "D"
    if isinstance(v, int):
        return str(v)
    return "'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'"


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small constant table as an inline ``VALUES`` relation.

    Unlike ``createDataFrame`` on a Python list (an RDD scanned by Python workers), an inline
    table is a local relation: it is broadcast straight from the driver, with no job.
    """
    cols = [part.split(" ", 1) for part in schema.split(", ")]
    names = ", ".join(c for c, _ in cols)
    values = ",\n".join("(" + ", ".join(_spark_lit(v, t) for v, (_, t) in zip(r, cols)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in cols)
    return spark.sql(f"SELECT {casts} FROM VALUES {values} AS t({names})")


def dim(spark: SparkSession, name: str) -> DataFrame:
    """A fixed reference table, marked for broadcast (bounded, tiny)."""
    return F.broadcast(local_table(spark, _rows(name), SCHEMAS[name]))


# ---------------------------------------------------------------------------
# SQL rendering for the DuckDB oracle
# ---------------------------------------------------------------------------

_SQL_TYPES = {"string": "VARCHAR", "double": "DOUBLE", "int": "INTEGER", "boolean": "BOOLEAN",
              "array<string>": "VARCHAR[]", "bigint": "BIGINT"}


def _sql_lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(v)
    if isinstance(v, list):
        return "[" + ", ".join(_sql_lit(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def dim_sql(name: str) -> str:
    """``SELECT ... FROM (VALUES ...)`` with columns cast to the Spark types."""
    cols = []
    for part in SCHEMAS[name].split(", "):
        cname, ctype = part.split(" ", 1)
        cols.append((cname, _SQL_TYPES[ctype]))
    rows = ",\n    ".join("(" + ", ".join(_sql_lit(v) for v in r) + ")" for r in _rows(name))
    names = ", ".join(c for c, _ in cols)
    casts = ", ".join(f"CAST({c} AS {t}) AS {c}" for c, t in cols)
    return f"SELECT {casts} FROM (VALUES\n    {rows}) AS v({names})"


# ---------------------------------------------------------------------------
# Fixed dims as constant maps: a lookup is a hash probe inside generated code,
# with no join, no exchange and no extra plan node.
# ---------------------------------------------------------------------------

@functools.lru_cache(maxsize=None)
def const_map_sql(name: str, key_index: int = 0, key_fmt: str | None = None) -> str:
    """SQL text of a ``map<key, struct>`` literal over a fixed dim.

    The key is column ``key_index`` or ``key_fmt.format(*row)`` lower-cased.
    Built as text so the whole literal crosses to the JVM in one call.
    """
    cols = [part.split(" ", 1) for part in SCHEMAS[name].split(", ")]
    items = []
    seen = set()
    for r in _rows(name):
        k = r[key_index] if key_fmt is None else key_fmt.format(*r).lower()
        if k in seen:
            continue
        seen.add(k)
        fields = ", ".join(f"'{c}', {_spark_lit(v, t)}" for v, (c, t) in zip(r, cols))
        items.append(f"{_spark_lit(k, 'string')}, named_struct({fields})")
    return "map(" + ", ".join(items) + ")"


def lookup(name: str, key, key_index: int = 0, key_fmt: str | None = None):
    """The dim row for ``key`` (a Column) as a struct, null when absent (constant-map probe)."""
    return F.try_element_at(F.expr(const_map_sql(name, key_index, key_fmt)), key)
