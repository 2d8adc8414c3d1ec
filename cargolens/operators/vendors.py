"""Vendor statistics, portfolio concentration indicators and per-package defaults.

All of these are hash aggregations over the delivery fact with map-side
partial aggregation; any ranking happens afterwards on the small aggregated
table, never as a window over the fact (a hot package type or partner would
otherwise land in one task).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.exprs import clamp, late_flag, r6, with_policy
from cargolens.functions.ranking import exact_median


def vendor_stats(deliveries: DataFrame, key: str = "delivery_partner") -> DataFrame:
    """Per vendor: mean cost, distance, rating, delay rate, volume, on-time %, cost/km, reliability."""
    agg = deliveries.groupBy(key).agg(
        F.avg("delivery_cost").alias("avg_cost"),
        F.avg("distance_km").alias("avg_distance"),
        F.sum(late_flag()).alias("_late"),
        F.avg("delivery_rating").alias("avg_rating"),
        F.count(F.lit(1)).alias("volume"),
    )
    rate = F.col("_late") / F.col("volume")
    on_time = (F.lit(1.0) - rate) * 100
    return agg.select(
        key,
        r6("avg_cost").alias("avg_cost"),
        r6("avg_distance").alias("avg_distance"),
        r6(rate).alias("delay_rate"),
        r6("avg_rating").alias("avg_rating"),
        "volume",
        r6(on_time).alias("on_time_pct"),
        r6(F.col("avg_cost") / F.col("avg_distance")).alias("cost_per_km"),
        r6(on_time * 0.6 + F.col("avg_rating") * 20 * 0.4).alias("reliability_score"),
    )


def vendor_stats_by_package(deliveries: DataFrame) -> DataFrame:
    """Per package type x partner: delay rate, mean cost, mean rating, on-time %, volume."""
    agg = deliveries.groupBy("package_type", "delivery_partner").agg(
        F.sum(late_flag()).alias("_late"), F.count(F.lit(1)).alias("n"),
        F.avg("delivery_cost").alias("avg_cost"), F.avg("delivery_rating").alias("avg_rating"))
    rate = F.col("_late") / F.col("n")
    return agg.select(
        "package_type", "delivery_partner", r6(rate).alias("delay_rate"),
        r6("avg_cost").alias("avg_cost"), r6("avg_rating").alias("avg_rating"),
        r6((F.lit(1.0) - rate) * 100).alias("on_time_pct"), "n")


def best_vendor(deliveries: DataFrame) -> DataFrame:
    """Per package type and priority: best partner (reliability: max on-time, cost: min cost,
    speed: max rating); ties go to the smallest partner name (first in sorted index)."""
    s = vendor_stats_by_package(deliveries)
    rows = s.groupBy("package_type").agg(
        F.min_by("delivery_partner", F.struct(-F.col("on_time_pct"), F.col("delivery_partner"))).alias("reliability"),
        F.min_by("delivery_partner", F.struct(F.col("avg_cost"), F.col("delivery_partner"))).alias("cost"),
        F.min_by("delivery_partner", F.struct(-F.col("avg_rating"), F.col("delivery_partner"))).alias("speed"),
    )
    return rows.select("package_type", F.expr(
        "stack(3, 'reliability', reliability, 'cost', cost, 'speed', speed) AS (priority, best_vendor)"))


def delay_rate_by_package(deliveries: DataFrame) -> DataFrame:
    agg = deliveries.groupBy("package_type").agg(
        F.sum(late_flag()).cast("long").alias("n_delayed"), F.count(F.lit(1)).alias("n_total"))
    return agg.select("package_type", F.round(F.col("n_delayed") / F.col("n_total"), 4).alias("delay_rate"),
                      "n_delayed", "n_total")


DEFAULT_CATEGORICALS = ["delivery_partner", "vehicle_type", "delivery_mode", "region", "weather_condition"]


def defaults_by_package(deliveries: DataFrame) -> DataFrame:
    """Per package type: mode of five categoricals (smallest value on ties) and rounded means."""
    aggs = [F.lower(F.trim(F.mode(c, True))).alias(c) for c in DEFAULT_CATEGORICALS]
    aggs += [F.round(F.avg("distance_km"), 2).alias("distance_km"),
             F.round(F.avg("package_weight_kg"), 2).alias("package_weight_kg"),
             clamp(F.bround(F.avg("delivery_rating"), 0), 1, 5).alias("delivery_rating")]
    return (deliveries.groupBy(F.lower(F.trim("package_type")).alias("package_type")).agg(*aggs))


def _top_share(deliveries: DataFrame, value_col: str, threshold: float, out_prefix: str,
               package_keys: DataFrame) -> DataFrame:
    """Share of the most frequent value per package portfolio (fallback: all rows)."""
    counts = deliveries.groupBy("package_type", value_col).agg(F.count(F.lit(1)).alias("c"))
    per_pkg = counts.groupBy("package_type").agg(
        F.sum("c").alias("n"),
        F.min_by(F.col(value_col), F.struct(-F.col("c"), F.col(value_col))).alias("top_value"),
        F.max("c").alias("top_count"))
    glob = counts.groupBy(value_col).agg(F.sum("c").alias("c"))
    glob_row = glob.agg(F.sum("c").alias("g_n"),
                        F.min_by(F.col(value_col), F.struct(-F.col("c"), F.col(value_col))).alias("g_top_value"),
                        F.max("c").alias("g_top_count"))
    joined = package_keys.join(per_pkg, "package_type", "left").crossJoin(F.broadcast(glob_row))
    n = F.coalesce("n", "g_n")
    top = F.coalesce("top_count", "g_top_count")
    share = top / n
    exceeds = top * 100 > n * threshold
    amp = F.when(exceeds, clamp((share * 100 - threshold) / (100 - threshold), 0.0, 1.0)).otherwise(F.lit(0.0))
    return joined.select(
        "package_type",
        F.round(share * 100, 2).alias(f"{out_prefix}_value_pct"),
        F.lit(float(threshold)).alias(f"{out_prefix}_threshold_pct"),
        exceeds.alias(f"{out_prefix}_exceeds"),
        F.when(F.col("top_count").isNotNull(), F.col("top_value")).otherwise(F.col("g_top_value")).alias(
            f"{out_prefix}_dominant"),
        amp.alias(f"{out_prefix}_amp_raw"),
    )


def package_keys(spark, deliveries: DataFrame | None = None, extra: DataFrame | None = None) -> DataFrame:
    """The package types to report on: the policy's nine types plus any observed ones."""
    from cargolens.sources import dims

    keys = dims.local_table(spark, [(p[0],) for p in dims.POLICY], "package_type string")
    if extra is not None:
        keys = keys.unionByName(extra.select(F.lower(F.trim("package_type")).alias("package_type")))
    return keys.distinct()


def supplier_concentration(spark, deliveries: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Top partner share per package portfolio; exceeds above 40 %, amplification scaled on 40..100."""
    keys = keys if keys is not None else package_keys(spark)
    t = _top_share(deliveries.select(F.lower("package_type").alias("package_type"), "delivery_partner"),
                   "delivery_partner", 40.0, "supplier", keys)
    return t.withColumn("supplier_amplification_risk", F.round("supplier_amp_raw", 3))


def region_delay_having(spark, deliveries: DataFrame, keys: DataFrame | None = None,
                        min_rows: int = 10) -> DataFrame:
    """Per package: worst region delay rate among regions with >= min_rows rows minus overall rate."""
    keys = keys if keys is not None else package_keys(spark)
    d = deliveries.select(F.lower("package_type").alias("package_type"), "region", late_flag().alias("late"))
    by = d.groupBy("package_type", "region").agg(F.count(F.lit(1)).alias("n"), F.sum("late").alias("late"))
    glob_by = by.groupBy("region").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))

    def summarize(t):
        return t.agg(
            (F.sum("late") / F.sum("n")).alias("overall"),
            F.max(F.when(F.col("n") >= min_rows, F.col("late") / F.col("n"))).alias("worst"))

    per = by.groupBy("package_type").agg(
        (F.sum("late") / F.sum("n")).alias("overall"),
        F.max(F.when(F.col("n") >= min_rows, F.col("late") / F.col("n"))).alias("worst"))
    g = summarize(glob_by).select(F.col("overall").alias("g_overall"), F.col("worst").alias("g_worst"))
    j = keys.join(per, "package_type", "left").crossJoin(g)
    has = F.col("overall").isNotNull()
    overall = F.when(has, F.col("overall")).otherwise(F.col("g_overall"))
    worst = F.when(has, F.col("worst")).otherwise(F.col("g_worst"))
    return j.select("package_type",
                    F.when((overall > 0) & worst.isNotNull(), F.round(worst - overall, 4))
                    .alias("weather_delay_correlation"))


def geographic_clustering(spark, deliveries: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Top region share per package portfolio; exceeds above 60 %, plus the region delay spread."""
    keys = keys if keys is not None else package_keys(spark)
    t = _top_share(deliveries.select(F.lower("package_type").alias("package_type"), "region"),
                   "region", 60.0, "region", keys)
    corr = region_delay_having(spark, deliveries, keys)
    return (t.withColumn("region_amplification_risk", F.round("region_amp_raw", 3))
            .join(corr, "package_type", "left"))


def cold_chain_fragility(spark, keys: DataFrame) -> DataFrame:
    """Policy-based fragility: cold chain when multiplier > 1, fragile when also critical/high value."""
    p = with_policy(keys, spark)
    cold = F.col("cold_chain_multiplier") > 1.0
    fragile = cold & F.col("stakes").isin("critical", "high_value")
    return p.select(
        "package_type",
        fragile.alias("is_fragile"),
        F.col("cold_chain_multiplier"),
        F.col("tier_name").alias("tier"),
        F.when(fragile, "Critical/cold-chain (e.g. pharmacy): limited temperature buffer")
        .when(cold, "Cold chain present").otherwise("Ambient only").alias("reason"),
        F.when(fragile, 0.5).when(cold, 0.2).otherwise(0.0).alias("cold_amp_raw"),
    ).withColumn("cold_amplification_risk", F.round("cold_amp_raw", 3))


def early_warning_indicators(spark, deliveries: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The three indicators plus the quantified amplification score per package portfolio (wide)."""
    keys = keys if keys is not None else package_keys(spark)
    sc = supplier_concentration(spark, deliveries, keys)
    gc = geographic_clustering(spark, deliveries, keys)
    cc = cold_chain_fragility(spark, keys)
    j = sc.join(gc, "package_type").join(cc, "package_type")
    overall = (F.col("supplier_amp_raw") + F.col("region_amp_raw") + F.col("cold_amp_raw")) / 3.0
    return (j.withColumn("amplification_score", F.round(overall, 3))
            .withColumn("amplification_label",
                        F.when(overall >= 0.6, "HIGH").when(overall >= 0.3, "MEDIUM").otherwise("LOW"))
            .drop("supplier_amp_raw", "region_amp_raw", "cold_amp_raw"))


def amplification_risk_long(indicators: DataFrame) -> DataFrame:
    """Long form: one row per (package_type, indicator) like the reference's figure table."""
    return indicators.select("package_type", F.expr(
        "stack(4,"
        " 'Supplier concentration', supplier_value_pct, supplier_threshold_pct, supplier_amplification_risk,"
        " 'Geographic clustering', region_value_pct, region_threshold_pct, region_amplification_risk,"
        " 'Cold-chain fragility', 0.0D, 0.0D, cold_amplification_risk,"
        " 'Overall', CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), amplification_score)"
        " AS (indicator, value_pct, threshold_pct, amplification_risk)"))


def portfolio_filter(spark, deliveries: DataFrame, package_type: str) -> DataFrame:
    """Deliveries of one package type; all deliveries when that type has none.

    Written as a join to the per-type count so no driver round-trip decides the branch.
    """
    key = package_type.lower().strip()
    tagged = deliveries.withColumn("_match", F.lower(F.trim("package_type")) == F.lit(key))
    any_match = tagged.agg(F.max(F.col("_match").cast("int")).alias("_any"))
    return (tagged.crossJoin(F.broadcast(any_match))
            .where(F.col("_match") | (F.coalesce(F.col("_any"), F.lit(0)) == 0))
            .drop("_match", "_any"))


def cluster_rule(stats: DataFrame) -> DataFrame:
    """Deterministic cluster id from reliability bands, used where no fitted model is given."""
    r = F.col("reliability_score")
    return stats.withColumn("cluster", F.when(r >= 90, 0).when(r >= 85, 1).when(r >= 80, 2).otherwise(3))


def cluster_profiles(stats_with_cluster: DataFrame) -> DataFrame:
    """Per cluster: mean cost / on-time / rating / reliability, size and type (``cluster_members`` has the vendors).

    FIXED VALUES — type rule: on-time > 90 and rating > 4 -> Premium/Reliable; mean cost below the median vendor
    cost -> Budget/Cheap; on-time < 85 -> Unreliable; else Balanced.  The median is exact and found without
    gathering the vendors.
    """
    med = exact_median(stats_with_cluster, "avg_cost", "_median_cost")
    agg = stats_with_cluster.groupBy("cluster").agg(
        F.avg("avg_cost").alias("avg_cost"), F.avg("on_time_pct").alias("avg_on_time"),
        F.avg("avg_rating").alias("avg_rating"), F.avg("reliability_score").alias("avg_reliability"), F.count(F.lit(1)).alias("count"))
    j = agg.crossJoin(F.broadcast(med))  # one row
    ctype = (F.when((F.col("avg_on_time") > 90) & (F.col("avg_rating") > 4.0), "Premium/Reliable")
             .when(F.col("avg_cost") < F.col("_median_cost"), "Budget/Cheap")
             .when(F.col("avg_on_time") < 85, "Unreliable").otherwise("Balanced"))
    return j.select("cluster", ctype.alias("type"), r6("avg_cost").alias("avg_cost"), r6("avg_on_time").alias("avg_on_time"),
                    r6("avg_rating").alias("avg_rating"), r6("avg_reliability").alias("avg_reliability"), "count")


def cluster_members(stats_with_cluster: DataFrame, key: str = "delivery_partner") -> DataFrame:
    """The vendors of each cluster, a row each, with the cluster's type."""
    types = cluster_profiles(stats_with_cluster).select("cluster", "type")  # as many rows as clusters
    return stats_with_cluster.select("cluster", key).join(F.broadcast(types), "cluster")
