"""Carbon-service-cost trade-off frontiers, CASP ranking and extreme points.

The reference scans rows in order keeping those that beat the best carbon so
far.  Re-expressed: (1) partial aggregation to the minimum carbon per
(group, service level) -- at most one point per level can be on the frontier;
(2) a distributed prefix minimum over higher service levels: the levels are range-partitioned by (group, service), each
partition's minimum is scanned in order of partitions, and a partition adds what came before it to its own running minimum,
so no task holds a group; (3) keep levels strictly below it, and join them back to the points they are.
Ranking uses the skew-safe grouped rank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.exprs import casp, r6
from cargolens.functions.ranking import grouped_row_number, prefix_min
from cargolens.session import ensure_checkpoint_dir


def pareto_frontier(points: DataFrame, group: str | None = "package_type", service: str = "service_level",
                    dim: str = "carbon_gco2") -> DataFrame:
    """Frontier levels per group (or of all points): (service desc) levels whose least ``dim`` beats every higher level."""
    key = [group] if group else []
    agg = points.groupBy(*key, service).agg(F.min(dim).alias(dim), F.count(F.lit(1)).alias("points"))
    best_before = prefix_min(agg, group, F.col(service).desc(), dim, "_best_before")
    return best_before.where(F.col("_best_before").isNull() | (F.col(dim) < F.col("_best_before"))).drop("_best_before")


def frontier_points(points: DataFrame, group: str | None = "package_type", service: str = "service_level", dim: str = "carbon_gco2") -> DataFrame:
    """The points that lie on the frontier, with all their columns; equal points are all on it.

    The points are stored: the frontier and the join back to it both read them.
    """
    ensure_checkpoint_dir(points.sparkSession)
    points = points.checkpoint()
    key = [*([group] if group else []), service, dim]
    return points.join(pareto_frontier(points, group, service, dim).select(*key), key, "left_semi")


def casp_ranking(points: DataFrame, group: str = "package_type", key: str = "shipment_id") -> DataFrame:
    """Points ranked by CASP (service / carbon) descending within each group; ties by key."""
    p = points.withColumn("casp_score", casp(F.col("service_level"), F.col("carbon_gco2")))
    return grouped_row_number(p, group, [F.col("casp_score").desc(), F.col(key)], out="casp_rank")


def tradeoff_extremes(points: DataFrame, group: str = "package_type", key: str = "shipment_id") -> DataFrame:
    """Per group: best CASP, lowest carbon, highest service, lowest cost (first key on ties)."""
    p = points.withColumn("casp_score", casp(F.col("service_level"), F.col("carbon_gco2")))
    k = F.col(key)
    agg = p.groupBy(group).agg(
        F.min_by(F.struct(k.alias("k"), F.col("casp_score").alias("v")), F.struct(-F.col("casp_score"), k)).alias("a"),
        F.min_by(F.struct(k.alias("k"), F.col("carbon_gco2").alias("v")), F.struct(F.col("carbon_gco2"), k)).alias("b"),
        F.min_by(F.struct(k.alias("k"), F.col("service_level").alias("v")), F.struct(-F.col("service_level"), k)).alias("c"),
        F.min_by(F.struct(k.alias("k"), F.col("cost").alias("v")), F.struct(F.col("cost"), k)).alias("d"))
    long = agg.select(group, F.expr("stack(4, 'best_casp', a, 'lowest_carbon', b, 'highest_service', c, "
                                    "'lowest_cost', d) AS (criterion, w)"))
    return long.select(group, "criterion", F.col("w.k").alias(key), F.round(F.col("w.v"), 9).alias("value"))


def decision_points(decided: DataFrame) -> DataFrame:
    """Frontier points from route choices: (package, shipment, total carbon, on-time, cost)."""
    b = F.col("best")
    return decided.where(F.col("num_options") > 0).select(
        F.col("pkg").alias("package_type"), "shipment_id", r6(b["total_carbon_gco2"]).alias("carbon_gco2"),
        r6(b["predicted_on_time_pct"]).alias("service_level"), r6(b["predicted_cost"]).alias("cost"))
