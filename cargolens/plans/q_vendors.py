"""Registered queries: delivery fact, labels, vendor statistics and early-warning indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.exprs import late_flag
from cargolens.operators import vendors
from cargolens.plans.catalog import query
from cargolens.plans.sqlkit import register
from cargolens.session import ensure_checkpoint_dir
from cargolens.sources import views

LATE = "CASE WHEN delayed = 'yes' THEN 1 ELSE 0 END"


def _d(spark, sf, *cols):
    return views.deliveries(spark, sf, list(cols) if cols else None)


@query("src_deliveries", "SELECT * FROM deliveries")
def q_src_deliveries(spark, sf):
    return _d(spark, sf)


@query("on_time_label", f"""
SELECT delivery_id, CAST(CASE WHEN delayed = 'no' THEN 100 ELSE 0 END AS INTEGER) AS on_time_pct,
       delayed = 'yes' AS is_delayed
FROM deliveries""")
def q_on_time_label(spark, sf):
    d = _d(spark, sf, "delivery_id", "delayed")
    return d.select("delivery_id", F.when(F.col("delayed") == "no", 100).otherwise(0).cast("int").alias("on_time_pct"),
                    (F.col("delayed") == "yes").alias("is_delayed"))


@query("model_feature_projection", """
SELECT delivery_partner, package_type, vehicle_type, delivery_mode, region, weather_condition,
       distance_km, package_weight_kg, delivery_rating
FROM deliveries""")
def q_model_feature_projection(spark, sf):
    from cargolens.operators.ml import FEATURES
    return _d(spark, sf).select(*FEATURES)


VENDOR_STATS_SQL = f"""
SELECT delivery_partner, round(avg_cost, 6) AS avg_cost, round(avg_distance, 6) AS avg_distance,
  round(late / volume, 6) AS delay_rate, round(avg_rating, 6) AS avg_rating, volume,
  round((1 - late / volume) * 100, 6) AS on_time_pct, round(avg_cost / avg_distance, 6) AS cost_per_km,
  round((1 - late / volume) * 100 * 0.6::DOUBLE + avg_rating * 20 * 0.4::DOUBLE, 6) AS reliability_score
FROM (SELECT delivery_partner, avg(delivery_cost) AS avg_cost, avg(distance_km) AS avg_distance,
        sum({LATE}) AS late, avg(delivery_rating) AS avg_rating, count(*) AS volume
      FROM deliveries GROUP BY delivery_partner) s
"""
register("vendor_stats_cte", VENDOR_STATS_SQL)


@query("vendor_stats", "SELECT * FROM vendor_stats_cte")
def q_vendor_stats(spark, sf):
    return vendors.vendor_stats(_d(spark, sf, "delivery_partner", "delivery_cost", "distance_km", "delayed",
                                   "delivery_rating"))


@query("vendor_stats_by_package", f"""
SELECT package_type, delivery_partner, round(late / n, 6) AS delay_rate, round(avg_cost, 6) AS avg_cost,
  round(avg_rating, 6) AS avg_rating, round((1 - late / n) * 100, 6) AS on_time_pct, n
FROM (SELECT package_type, delivery_partner, sum({LATE}) AS late, count(*) AS n,
        avg(delivery_cost) AS avg_cost, avg(delivery_rating) AS avg_rating
      FROM deliveries GROUP BY ALL) s""")
def q_vendor_stats_by_package(spark, sf):
    return vendors.vendor_stats_by_package(_d(spark, sf, "package_type", "delivery_partner", "delayed",
                                              "delivery_cost", "delivery_rating"))


@query("best_vendor", f"""
WITH s AS (
  SELECT package_type, delivery_partner, round((1 - late / n) * 100, 6) AS on_time_pct,
         round(avg_cost, 6) AS avg_cost, round(avg_rating, 6) AS avg_rating
  FROM (SELECT package_type, delivery_partner, sum({LATE}) AS late, count(*) AS n,
          avg(delivery_cost) AS avg_cost, avg(delivery_rating) AS avg_rating
        FROM deliveries GROUP BY ALL) x)
SELECT package_type, 'reliability' AS priority, first(delivery_partner ORDER BY on_time_pct DESC, delivery_partner) AS best_vendor FROM s GROUP BY package_type
UNION ALL
SELECT package_type, 'cost', first(delivery_partner ORDER BY avg_cost, delivery_partner) FROM s GROUP BY package_type
UNION ALL
SELECT package_type, 'speed', first(delivery_partner ORDER BY avg_rating DESC, delivery_partner) FROM s GROUP BY package_type
""")
def q_best_vendor(spark, sf):
    return vendors.best_vendor(_d(spark, sf, "package_type", "delivery_partner", "delayed", "delivery_cost",
                                  "delivery_rating"))


@query("delay_rate_by_package", f"""
SELECT package_type, round(n_delayed / n_total, 4) AS delay_rate, n_delayed, n_total
FROM (SELECT package_type, CAST(sum({LATE}) AS BIGINT) AS n_delayed, count(*) AS n_total
      FROM deliveries GROUP BY package_type) s""")
def q_delay_rate_by_package(spark, sf):
    return vendors.delay_rate_by_package(_d(spark, sf, "package_type", "delayed"))


def _mode_sql(col: str) -> str:
    return (f"(SELECT package_type, first({col} ORDER BY c DESC, {col}) AS {col} FROM "
            f"(SELECT lower(trim(package_type)) AS package_type, {col}, count(*) AS c FROM deliveries GROUP BY ALL) x "
            f"GROUP BY package_type) AS m_{col}")


@query("defaults_by_package", f"""
SELECT a.package_type,
  lower(trim(m_delivery_partner.delivery_partner)) AS delivery_partner,
  lower(trim(m_vehicle_type.vehicle_type)) AS vehicle_type,
  lower(trim(m_delivery_mode.delivery_mode)) AS delivery_mode,
  lower(trim(m_region.region)) AS region,
  lower(trim(m_weather_condition.weather_condition)) AS weather_condition,
  a.distance_km, a.package_weight_kg, a.delivery_rating
FROM (SELECT lower(trim(package_type)) AS package_type, round(avg(distance_km), 2) AS distance_km,
        round(avg(package_weight_kg), 2) AS package_weight_kg,
        least(greatest(round_even(avg(delivery_rating), 0), 1), 5)::DOUBLE AS delivery_rating
      FROM deliveries GROUP BY 1) a
JOIN {_mode_sql('delivery_partner')} USING (package_type)
JOIN {_mode_sql('vehicle_type')} USING (package_type)
JOIN {_mode_sql('delivery_mode')} USING (package_type)
JOIN {_mode_sql('region')} USING (package_type)
JOIN {_mode_sql('weather_condition')} USING (package_type)
""")
def q_defaults_by_package(spark, sf):
    return vendors.defaults_by_package(_d(spark, sf, "package_type", *vendors.DEFAULT_CATEGORICALS,
                                          "distance_km", "package_weight_kg", "delivery_rating"))


def _top_share_sql(col: str, threshold: float, prefix: str, keys: str = "pkg_keys") -> str:
    return f"""
(SELECT k.package_type,
   round(coalesce(t.top_count, g.g_top) / coalesce(t.n, g.g_n) * 100, 2) AS {prefix}_value_pct,
   {threshold}::DOUBLE AS {prefix}_threshold_pct,
   coalesce(t.top_count, g.g_top) * 100 > coalesce(t.n, g.g_n) * {threshold} AS {prefix}_exceeds,
   CASE WHEN t.top_count IS NOT NULL THEN t.top_value ELSE g.g_value END AS {prefix}_dominant,
   CASE WHEN coalesce(t.top_count, g.g_top) * 100 > coalesce(t.n, g.g_n) * {threshold}
        THEN least(greatest((coalesce(t.top_count, g.g_top) / coalesce(t.n, g.g_n) * 100 - {threshold})
                            / (100 - {threshold}), 0.0::DOUBLE), 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS {prefix}_amp_raw
 FROM {keys} k
 LEFT JOIN (SELECT package_type, sum(c) AS n, max(c) AS top_count,
              first({col} ORDER BY c DESC, {col}) AS top_value
            FROM (SELECT lower(package_type) AS package_type, {col}, count(*) AS c FROM deliveries GROUP BY ALL) x
            GROUP BY package_type) t ON k.package_type = t.package_type
 CROSS JOIN (SELECT sum(c) AS g_n, max(c) AS g_top, first({col} ORDER BY c DESC, {col}) AS g_value
             FROM (SELECT {col}, count(*) AS c FROM deliveries GROUP BY ALL) y) g)"""


register("pkg_keys", "SELECT package_type FROM dim_policy")
register("supplier_conc", f"SELECT *, round(supplier_amp_raw, 3) AS supplier_amplification_risk FROM "
                          f"{_top_share_sql('delivery_partner', 40.0, 'supplier')} s")
register("region_delay", f"""
SELECT k.package_type,
  CASE WHEN CASE WHEN p.overall IS NOT NULL THEN p.overall ELSE g.overall END > 0
        AND CASE WHEN p.overall IS NOT NULL THEN p.worst ELSE g.worst END IS NOT NULL
       THEN round(CASE WHEN p.overall IS NOT NULL THEN p.worst ELSE g.worst END
                  - CASE WHEN p.overall IS NOT NULL THEN p.overall ELSE g.overall END, 4) END AS weather_delay_correlation
FROM pkg_keys k
LEFT JOIN (SELECT package_type, sum(late) / sum(n) AS overall, max(CASE WHEN n >= 10 THEN late / n END) AS worst
           FROM (SELECT lower(package_type) AS package_type, region, count(*) AS n, sum({LATE}) AS late
                 FROM deliveries GROUP BY ALL) x GROUP BY package_type) p ON k.package_type = p.package_type
CROSS JOIN (SELECT sum(late) / sum(n) AS overall, max(CASE WHEN n >= 10 THEN late / n END) AS worst
            FROM (SELECT region, count(*) AS n, sum({LATE}) AS late FROM deliveries GROUP BY ALL) y) g
""")
register("geo_cluster", f"SELECT s.*, round(region_amp_raw, 3) AS region_amplification_risk, r.weather_delay_correlation FROM "
                        f"{_top_share_sql('region', 60.0, 'region')} s JOIN region_delay r USING (package_type)")
register("cold_frag", """
SELECT package_type, is_fragile, cold_chain_multiplier, tier_name AS tier,
  CASE WHEN is_fragile THEN 'Critical/cold-chain (e.g. pharmacy): limited temperature buffer'
       WHEN cold_chain_multiplier > 1.0 THEN 'Cold chain present' ELSE 'Ambient only' END AS reason,
  CASE WHEN is_fragile THEN 0.5 WHEN cold_chain_multiplier > 1.0 THEN 0.2 ELSE 0.0 END::DOUBLE AS cold_amp_raw,
  round(CASE WHEN is_fragile THEN 0.5 WHEN cold_chain_multiplier > 1.0 THEN 0.2 ELSE 0.0 END::DOUBLE, 3) AS cold_amplification_risk
FROM (SELECT k.package_type, coalesce(p.cold_chain_multiplier, 1.0::DOUBLE) AS cold_chain_multiplier,
        coalesce(p.tier_name, 'HIGH_VALUE') AS tier_name,
        coalesce(p.cold_chain_multiplier, 1.0::DOUBLE) > 1.0 AND coalesce(p.stakes, 'high_value') IN ('critical', 'high_value') AS is_fragile
      FROM pkg_keys k LEFT JOIN dim_policy p USING (package_type)) x
""")
register("ew_indicators", """
SELECT s.package_type, s.supplier_value_pct, s.supplier_threshold_pct, s.supplier_exceeds, s.supplier_dominant,
  s.supplier_amplification_risk, g.region_value_pct, g.region_threshold_pct, g.region_exceeds, g.region_dominant,
  g.region_amplification_risk, g.weather_delay_correlation, c.is_fragile, c.cold_chain_multiplier, c.tier, c.reason,
  c.cold_amplification_risk,
  round((s.supplier_amp_raw + g.region_amp_raw + c.cold_amp_raw) / 3.0, 3) AS amplification_score,
  CASE WHEN (s.supplier_amp_raw + g.region_amp_raw + c.cold_amp_raw) / 3.0 >= 0.6 THEN 'HIGH'
       WHEN (s.supplier_amp_raw + g.region_amp_raw + c.cold_amp_raw) / 3.0 >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS amplification_label
FROM supplier_conc s JOIN geo_cluster g USING (package_type) JOIN cold_frag c USING (package_type)
""")


@query("supplier_concentration", "SELECT * EXCLUDE (supplier_amp_raw) FROM supplier_conc")
def q_supplier_concentration(spark, sf):
    return vendors.supplier_concentration(spark, _d(spark, sf, "package_type", "delivery_partner")).drop(
        "supplier_amp_raw")


@query("region_delay_having", "SELECT * FROM region_delay")
def q_region_delay_having(spark, sf):
    return vendors.region_delay_having(spark, _d(spark, sf, "package_type", "region", "delayed"))


@query("geographic_clustering", "SELECT * EXCLUDE (region_amp_raw) FROM geo_cluster")
def q_geographic_clustering(spark, sf):
    return vendors.geographic_clustering(spark, _d(spark, sf, "package_type", "region", "delayed")).drop(
        "region_amp_raw")


@query("cold_chain_fragility", """
SELECT f.* EXCLUDE (cold_amp_raw), x.deliveries
FROM cold_frag f JOIN (SELECT lower(package_type) AS package_type, count(*) AS deliveries FROM deliveries GROUP BY 1) x USING (package_type)""")
def q_cold_chain_fragility(spark, sf):
    keys = _d(spark, sf, "package_type").groupBy(F.lower("package_type").alias("package_type")).agg(F.count(F.lit(1)).alias("deliveries"))
    return vendors.cold_chain_fragility(spark, keys).drop("cold_amp_raw").join(keys, "package_type")


@query("amplification_risk", """
SELECT package_type, 'Supplier concentration' AS indicator, supplier_value_pct AS value_pct,
       supplier_threshold_pct AS threshold_pct, supplier_amplification_risk AS amplification_risk FROM ew_indicators
UNION ALL SELECT package_type, 'Geographic clustering', region_value_pct, region_threshold_pct, region_amplification_risk FROM ew_indicators
UNION ALL SELECT package_type, 'Cold-chain fragility', 0.0::DOUBLE, 0.0::DOUBLE, cold_amplification_risk FROM ew_indicators
UNION ALL SELECT package_type, 'Overall', NULL::DOUBLE, NULL::DOUBLE, amplification_score FROM ew_indicators
""")
def q_amplification_risk(spark, sf):
    ind = vendors.early_warning_indicators(
        spark, _d(spark, sf, "package_type", "delivery_partner", "region", "delayed"))
    return vendors.amplification_risk_long(ind)


@query("early_warning_indicators", "SELECT * FROM ew_indicators")
def q_early_warning_indicators(spark, sf):
    return vendors.early_warning_indicators(
        spark, _d(spark, sf, "package_type", "delivery_partner", "region", "delayed"))


@query("portfolio_filter", """
SELECT * FROM deliveries
WHERE lower(trim(package_type)) = 'pharmacy'
   OR NOT EXISTS (SELECT 1 FROM deliveries WHERE lower(trim(package_type)) = 'pharmacy')""")
def q_portfolio_filter(spark, sf):
    return vendors.portfolio_filter(spark, _d(spark, sf), "pharmacy")


def _stored(df):
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


@query("cluster_profiles", """
WITH c AS (SELECT *, CASE WHEN reliability_score >= 90 THEN 0 WHEN reliability_score >= 85 THEN 1
                          WHEN reliability_score >= 80 THEN 2 ELSE 3 END AS cluster FROM vendor_stats_cte),
     med AS (SELECT median(avg_cost) AS m FROM c)
SELECT cluster,
  CASE WHEN avg(on_time_pct) > 90 AND avg(avg_rating) > 4.0 THEN 'Premium/Reliable'
       WHEN avg(avg_cost) < any_value(med.m) THEN 'Budget/Cheap'
       WHEN avg(on_time_pct) < 85 THEN 'Unreliable' ELSE 'Balanced' END AS type,
  array_to_string(list_sort(list(delivery_partner)), ', ') AS vendors,
  round(avg(avg_cost), 6) AS avg_cost, round(avg(on_time_pct), 6) AS avg_on_time,
  round(avg(avg_rating), 6) AS avg_rating, round(avg(reliability_score), 6) AS avg_reliability,
  count(*) AS count
FROM c CROSS JOIN med GROUP BY cluster""")
def q_cluster_profiles(spark, sf):
    stats = vendors.vendor_stats(_d(spark, sf, "delivery_partner", "delivery_cost", "distance_km", "delayed",
                                    "delivery_rating"))
    clustered = _stored(vendors.cluster_rule(stats))
    # The list of a cluster's vendors is for the nine partners; other keys have ``cluster_members``.
    names = clustered.groupBy("cluster").agg(F.array_join(F.sort_array(F.collect_list("delivery_partner")), ", ").alias("vendors"))
    return vendors.cluster_profiles(clustered).join(names, "cluster").select(
        "cluster", "type", "vendors", "avg_cost", "avg_on_time", "avg_rating", "avg_reliability", "count")


register("vendor_id_stats", VENDOR_STATS_SQL.replace("delivery_partner", "vendor_id"))
register("vendor_id_clusters", """
SELECT *, CASE WHEN reliability_score >= 90 THEN 0 WHEN reliability_score >= 85 THEN 1 WHEN reliability_score >= 80 THEN 2 ELSE 3 END AS cluster
FROM (SELECT vendor_id, avg_cost, avg_rating, on_time_pct, reliability_score FROM vendor_id_stats)""")
register("vendor_id_profiles", """
SELECT cluster, CASE WHEN avg(on_time_pct) > 90 AND avg(avg_rating) > 4.0 THEN 'Premium/Reliable'
    WHEN avg(avg_cost) < (SELECT median(avg_cost) FROM vendor_id_clusters) THEN 'Budget/Cheap'
    WHEN avg(on_time_pct) < 85 THEN 'Unreliable' ELSE 'Balanced' END AS type,
  round(avg(avg_cost), 6) AS avg_cost, round(avg(on_time_pct), 6) AS avg_on_time, round(avg(avg_rating), 6) AS avg_rating,
  round(avg(reliability_score), 6) AS avg_reliability, count(*) AS count
FROM vendor_id_clusters GROUP BY cluster""")


def _by_vendor_id(spark, sf):
    stats = vendors.vendor_stats(_d(spark, sf, "vendor_id", "delivery_cost", "distance_km", "delayed", "delivery_rating"), key="vendor_id")
    return _stored(vendors.cluster_rule(stats))


@query("cluster_profiles_by_vendor_id", "SELECT * FROM vendor_id_profiles")
def q_cluster_profiles_by_vendor_id(spark, sf):
    return vendors.cluster_profiles(_by_vendor_id(spark, sf))


@query("cluster_members_by_vendor_id", """
SELECT c.cluster, c.vendor_id, p.type FROM vendor_id_clusters c JOIN vendor_id_profiles p USING (cluster)""")
def q_cluster_members_by_vendor_id(spark, sf):
    return vendors.cluster_members(_by_vendor_id(spark, sf), "vendor_id")


__all__ = ["late_flag"]
