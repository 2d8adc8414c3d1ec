"""Cities, lane distances and route profiles.

Every lookup is an equi left join against a fixed broadcast dim (23 cities,
33 lanes); "by key, else by name" and "this direction, else reversed" are
two left joins and a ``coalesce`` rather than an OR join condition, so the
planner keeps hash joins.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.functions.exprs import checked_broadcast
from cargolens.sources import dims

EARTH_RADIUS_KM = 6371.0
ROAD_FACTOR = 1.3
DEFAULT_DISTANCE_KM = 150.0
DEG_TO_RAD = math.pi / 180.0
# Road distances estimated from coordinates are kept to the millimetre (6 decimals), so engines
# whose trigonometric functions differ in the last bit still agree.
HAVERSINE_DECIMALS = 6


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km (R = 6371)."""
    rad = F.lit(DEG_TO_RAD)
    p1, p2 = lat1 * rad, lat2 * rad
    dlat = p2 - p1
    dlon = lon2 * rad - lon1 * rad
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(dlon / 2), 2)
    return F.lit(EARTH_RADIUS_KM) * (2 * F.asin(F.sqrt(a)))


CITY_FIELDS = ["key", "name", "code", "region", "is_metro", "state", "latitude", "longitude"]


def resolve_city(spark, df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Attach the city for ``col`` matched by key, else by lower-case name (key wins)."""
    city = dims.dim(spark, "dim_city")
    by_key = city.select(*[F.col(c).alias(f"{prefix}_k_{c}") for c in CITY_FIELDS])
    by_name = city.select(F.lower("name").alias(f"{prefix}_n_lname"),
                          *[F.col(c).alias(f"{prefix}_n_{c}") for c in CITY_FIELDS])
    probe = F.lower(F.col(col))
    j = (df.join(by_key, probe == F.col(f"{prefix}_k_key"), "left")
         .join(by_name, probe == F.col(f"{prefix}_n_lname"), "left"))
    found = F.col(f"{prefix}_k_key").isNotNull()
    out = {f"{prefix}_{c}": F.when(found, F.col(f"{prefix}_k_{c}")).otherwise(F.col(f"{prefix}_n_{c}"))
           for c in CITY_FIELDS}
    drop = [f"{prefix}_k_{c}" for c in CITY_FIELDS] + [f"{prefix}_n_{c}" for c in CITY_FIELDS] + [f"{prefix}_n_lname"]
    return j.withColumns(out).drop(*drop)


def lane_distance(spark, df: DataFrame, origin: str = "origin", destination: str = "destination",
                  out: str = "lane_distance_km") -> DataFrame:
    """Lane km in either direction, else haversine x 1.3 when both cities resolve, else null.

    Adds ``{out}`` and ``{out}_kind`` ('direct', 'reversed', 'haversine' or null).
    """
    lanes = dims.dim(spark, "dim_lane")
    fwd = lanes.select(F.col("origin").alias("_lf_o"), F.col("destination").alias("_lf_d"),
                       F.col("distance_km").alias("_lf_km"))
    rev = lanes.select(F.col("destination").alias("_lr_o"), F.col("origin").alias("_lr_d"),
                       F.col("distance_km").alias("_lr_km"))
    o, d = F.lower(F.col(origin)), F.lower(F.col(destination))
    j = (df.join(fwd, (o == F.col("_lf_o")) & (d == F.col("_lf_d")), "left")
         .join(rev, (o == F.col("_lr_o")) & (d == F.col("_lr_d")), "left"))
    j = resolve_city(spark, j, origin, "_lo")
    j = resolve_city(spark, j, destination, "_ld")
    both = F.col("_lo_key").isNotNull() & F.col("_ld_key").isNotNull()
    hav = haversine(F.col("_lo_latitude"), F.col("_lo_longitude"), F.col("_ld_latitude"), F.col("_ld_longitude"))
    km = (F.when(F.col("_lf_km").isNotNull(), F.col("_lf_km")).when(F.col("_lr_km").isNotNull(), F.col("_lr_km"))
          .when(both, F.round(hav * ROAD_FACTOR, HAVERSINE_DECIMALS)))
    kind = (F.when(F.col("_lf_km").isNotNull(), "direct").when(F.col("_lr_km").isNotNull(), "reversed")
            .when(both, "haversine"))
    tmp = [c for c in j.columns if c.startswith("_lo_") or c.startswith("_ld_")]
    return (j.withColumns({out: km, f"{out}_kind": kind})
            .drop("_lf_o", "_lf_d", "_lf_km", "_lr_o", "_lr_d", "_lr_km", *tmp))


def _one_per_lane(table: DataFrame, origin: str, destination: str, km: str) -> DataFrame:
    """One distance for each lane (the shortest that is given), so that a join never repeats a request.

    Broadcast only if there are few lanes: then a lane that many requests take needs no shuffle.  Beyond that the join
    shuffles by lane, and the session's adaptive skew join splits a hot one.
    """
    return checked_broadcast(table.groupBy(F.lower("origin").alias(origin), F.lower("destination").alias(destination)).agg(
        F.min("distance_km").alias(km)))


def distance_cascade(spark, df: DataFrame, provider: DataFrame | None = None, search: DataFrame | None = None,
                     origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Lane/haversine distance, else an external provider table, else a text-search table, else 150 km.

    ``provider`` / ``search`` are optional tables ``(origin, destination, distance_km)``.  Adds
    ``cascade_distance_km`` (0 km kept, as the reference does), ``distance_source`` and
    ``effective_distance_km`` where 0 and null mean missing -> 150.
    """
    j = lane_distance(spark, df, origin, destination, out="_lane_km")
    sources = [(F.col("_lane_km"), "local_routes")]
    if provider is not None:
        p = _one_per_lane(provider, "_po", "_pd", "_prov_km")
        j = j.join(p, (F.lower(F.col(origin)) == F.col("_po")) & (F.lower(F.col(destination)) == F.col("_pd")), "left")
        sources.append((F.col("_prov_km"), "openrouteservice"))
    if search is not None:
        s = _one_per_lane(search, "_so", "_sd", "_srch_km")
        j = j.join(s, (F.lower(F.col(origin)) == F.col("_so")) & (F.lower(F.col(destination)) == F.col("_sd")), "left")
        sources.append((F.col("_srch_km"), "web_search"))
    km = F.coalesce(*[c for c, _ in sources], F.lit(DEFAULT_DISTANCE_KM))
    label = None
    for c, name in sources:
        label = F.when(c.isNotNull(), name) if label is None else label.when(c.isNotNull(), name)
    label = label.otherwise("default")
    drop = [c for c in j.columns if c.startswith("_lane_km") or c in ("_po", "_pd", "_prov_km", "_so", "_sd", "_srch_km")]
    return (j.withColumns({"cascade_distance_km": km, "distance_source": label,
                           "effective_distance_km": F.coalesce(F.when(km != 0, km), F.lit(DEFAULT_DISTANCE_KM))})
            .drop(*drop))


def route_profile(spark, df: DataFrame, origin: str = "origin", destination: str = "destination") -> DataFrame:
    """Both ends joined to the city dim: regions, metro-to-metro, same region, same state."""
    j = resolve_city(spark, df, origin, "_po")
    j = resolve_city(spark, j, destination, "_pd")
    both = F.col("_po_key").isNotNull() & F.col("_pd_key").isNotNull()
    out = {
        "origin_region": F.col("_po_region"),
        "destination_region": F.col("_pd_region"),
        "is_metro_to_metro": F.when(both, F.col("_po_is_metro") & F.col("_pd_is_metro")).otherwise(F.lit(False)),
        "same_region": F.when(both, F.col("_po_region") == F.col("_pd_region")),
        "same_state": F.when(both, F.col("_po_state") == F.col("_pd_state")),
    }
    tmp = [c for c in j.columns if c.startswith("_po_") or c.startswith("_pd_")]
    return j.withColumns(out).drop(*tmp)


def popular_lanes(spark, shipments: DataFrame) -> DataFrame:
    """Shipment volume on the ten popular (directed) lanes, with their route profile."""
    pop = F.broadcast(dims.local_table(spark, dims.POPULAR_LANES, "p_origin string, p_destination string"))
    vol = (shipments.join(pop, (F.lower("origin") == F.col("p_origin")) & (F.lower("destination") == F.col("p_destination")),
                          "inner")
           .groupBy("p_origin", "p_destination").agg(F.count(F.lit(1)).alias("shipments")))
    prof = route_profile(spark, vol.withColumnsRenamed({"p_origin": "origin", "p_destination": "destination"}))
    prof = lane_distance(spark, prof, out="distance_km")
    return prof.select("origin", "destination", "distance_km", "is_metro_to_metro", "same_region", "same_state",
                       "shipments")


def symmetric_lanes(spark, shipments: DataFrame) -> DataFrame:
    """Undirected lane table (lanes u reversed lanes, the listed direction wins) with shipment volume
    and mean weight per undirected lane."""
    lanes = dims.dim(spark, "dim_lane")
    both = (lanes.select("origin", "destination", "distance_km", F.lit(0).alias("pri"))
            .unionByName(lanes.select(F.col("destination").alias("origin"), F.col("origin").alias("destination"),
                                      "distance_km", F.lit(1).alias("pri"))))
    und = (both.groupBy(F.least("origin", "destination").alias("lane_a"),
                        F.greatest("origin", "destination").alias("lane_b"))
           .agg(F.min_by("distance_km", F.struct("pri", "origin")).alias("distance_km")))
    s = shipments.select(F.least(F.lower("origin"), F.lower("destination")).alias("lane_a"),
                         F.greatest(F.lower("origin"), F.lower("destination")).alias("lane_b"), "package_weight_kg")
    agg = s.groupBy("lane_a", "lane_b").agg(F.count(F.lit(1)).alias("shipments"),
                                            F.avg("package_weight_kg").alias("avg_weight"))
    return (F.broadcast(und).join(agg, ["lane_a", "lane_b"], "inner")
            .select("lane_a", "lane_b", "distance_km", "shipments", F.round("avg_weight", 6).alias("avg_weight_kg")))
