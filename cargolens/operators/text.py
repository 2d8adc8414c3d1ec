"""Text and JSON parsing as column expressions over tables of texts and payloads.

Every rule is a built-in regex / JSON / string function (JVM-side); the
ordered pattern cascades of the reference become ``coalesce`` chains.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cargolens.sources import dims

# FIXED VALUES — regular expressions of the reference's parsers.
DISTANCE_KM_PATTERN = r"(?i)\b(\d+(?:,\d{3})*(?:\.\d+)?)\s*km\b"
DISTANCE_WORD_PATTERN = r"(?i)\b(\d+(?:\.\d+)?)\s*(?:kilometers?|kms?)\b"
COST_PATTERNS = [r"(?i)₹\s*(\d+(?:,\d{3})*(?:\.\d+)?)", r"(?i)Rs?\.?\s*(\d+(?:,\d{3})*(?:\.\d+)?)",
                 r"(?i)INR\s*(\d+(?:,\d{3})*(?:\.\d+)?)", r"(?i)(?:cost|rate|price)[:\s]*(\d+(?:,\d{3})*(?:\.\d+)?)"]
RATE_PATTERN = r"[\d,]+(?:\.\d+)?"
REQUEST_KM_PATTERN = r"(?i)\b(\d+(?:\.\d+)?)\s*km\b"
REQUEST_KG_PATTERN = r"(?i)\b(\d+(?:\.\d+)?)\s*kg\b"
EXPLICIT_KM_PATTERN = r"\d+\s*km"
EXPLICIT_KG_PATTERN = r"\d+\s*kg"
FENCED_JSON_PATTERN = r"```(?:json)?\s*(\{[\s\S]*?\})\s*```"
BARE_JSON_PATTERN = r"\{[^{}]*\}"
WEATHER_TOKENS = [("stormy", ["storm", "thunder", "cyclone"]), ("rainy", ["rain", "drizzle", "shower"]),
                  ("foggy", ["fog", "mist", "haze"]), ("hot", ["hot", "heat", "40", "45"]),
                  ("cold", ["cold", "snow", "freez"]), ("clear", ["clear", "sunny", "partly"])]
EXPLICIT_CITIES = ["mumbai", "delhi", "bangalore", "chennai", "kolkata", "hyderabad", "pune", "ahmedabad",
                   "jaipur", "lucknow"]


def _num(c: Column) -> Column:
    """'' (no match) -> null, else the number."""
    return F.when(c != "", c.cast("double"))


def parse_distance(text: Column) -> Column:
    """First '<n> km' on the text without commas, else '<n> kilometers/kms' on the original text."""
    first = F.regexp_extract(F.regexp_replace(text, ",", ""), DISTANCE_KM_PATTERN, 1)
    second = F.regexp_extract(text, DISTANCE_WORD_PATTERN, 1)
    return F.coalesce(_num(F.regexp_replace(first, ",", "")), _num(second))


def parse_cost(text: Column) -> Column:
    """Rupee-sign, Rs, INR, cost/rate/price patterns in order; first value in (0, 1e7)."""
    t = F.regexp_replace(text, ",", "")
    vals = [_num(F.regexp_extract(t, p, 1)) for p in COST_PATTERNS]
    return F.coalesce(*[F.when((v > 0) & (v < 1e7), v) for v in vals])


def parse_rate(text: Column) -> Column:
    """First bare number (commas dropped), accepted in (0, 1e6)."""
    v = _num(F.regexp_extract(F.regexp_replace(text, ",", ""), RATE_PATTERN, 0))
    return F.when((v > 0) & (v < 1e6), v)


def classify_weather(text: Column) -> Column:
    """Token lists in precedence order (substring match, like the reference); else null."""
    t = F.lower(text)
    out = None
    for label, toks in WEATHER_TOKENS:
        cond = None
        for tok in toks:
            c = t.contains(tok)
            cond = c if cond is None else (cond | c)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def weather_from_payload(payload: Column) -> Column:
    """Weather-API payload -> condition: main mapped (default clear); temp >= 35 hot, <= 10 cold."""
    main = F.lower(F.coalesce(F.get_json_object(payload, "$.weather[0].main"), F.lit("")))
    temp = F.get_json_object(payload, "$.main.temp").cast("double")
    mapped = None
    for k, v in dims.OWM_CONDITION:
        mapped = F.when(main == k, v) if mapped is None else mapped.when(main == k, v)
    base = mapped.otherwise("clear")
    return F.when(temp >= 35, "hot").when(temp <= 10, "cold").otherwise(base)


def json_block(text: Column) -> Column:
    """First fenced JSON object, else the first flat braced object; null when none."""
    fenced = F.regexp_extract(text, FENCED_JSON_PATTERN, 1)
    bare = F.regexp_extract(text, BARE_JSON_PATTERN, 0)
    return F.coalesce(F.when(fenced != "", fenced), F.when(bare != "", bare))


def _ordered_phrases() -> list[tuple[str, str]]:
    syn = sorted(dims.PACKAGE_SYNONYMS, key=lambda kv: -len(kv[0]))
    canon = [(p, p) for p in sorted(dims.VALID_PACKAGE_TYPES, key=lambda p: -len(p))]
    return syn + canon


def package_from_text(text: Column, strict: bool = False) -> Column:
    """Longest synonym contained wins (listed order on ties); canonical names after unless strict."""
    q = F.lower(F.trim(text))
    phrases = sorted(dims.PACKAGE_SYNONYMS, key=lambda kv: -len(kv[0])) if strict else _ordered_phrases()
    out = None
    for phrase, canonical in phrases:
        out = F.when(q.contains(phrase), canonical) if out is None else out.when(q.contains(phrase), canonical)
    return out.otherwise("clothing")


def cities_in_text(text: Column) -> Column:
    """The listed cities contained in the text, in list order (comma-joined, '' when none)."""
    q = F.lower(text)
    return F.concat_ws(",", *[F.when(q.contains(c), F.lit(c)) for c in dims.EXTRACTION_CITIES])


def region_from_text(text: Column) -> Column:
    q = F.lower(text)
    out = None
    for state, region in dims.STATE_REGION_HINTS:
        out = F.when(q.contains(state), region) if out is None else out.when(q.contains(state), region)
    return out
