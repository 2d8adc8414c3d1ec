"""Policy recommendations and portfolio rule compliance.

Recommendations fan out per stakes level, so shipments are first counted per
stakes level (partial aggregation) and only the 3-row count table meets the
15-row rule dim -- no per-shipment fan-out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargolens.functions.exprs import late_flag, with_policy
from cargolens.sources import dims


def governance_recommendations(spark, requests: DataFrame, package_col: str = "package_type") -> DataFrame:
    """Stakes -> five (category, recommendation, rationale) rows with the shipment volume behind each."""
    per = with_policy(requests.select(package_col), spark, package_col).groupBy("stakes").agg(
        F.count(F.lit(1)).alias("shipments"))
    rules = dims.dim(spark, "dim_governance")
    return rules.join(per, "stakes", "inner").select("stakes", "seq", "category", "recommendation", "rationale",
                                                     "shipments")


def portfolio_compliance(spark, deliveries: DataFrame) -> DataFrame:
    """Deliveries checked against portfolio rules (package rule, else stakes rule).

    vehicle in the rule's list; partner reliability (1 - historical delay rate) >= minimum;
    cost / mean cost of the package type <= maximum premium.  Violation counts per package.
    """
    rel = deliveries.groupBy("delivery_partner").agg((1 - F.sum(late_flag()) / F.count(F.lit(1))).alias("reliability"))
    avg_cost = deliveries.groupBy("package_type").agg(F.avg("delivery_cost").alias("avg_cost"))
    d = with_policy(deliveries, spark)
    rules = dims.dim(spark, "dim_portfolio")
    by_pkg = rules.select(*[F.col(c).alias("pk_" + c) for c in rules.columns])
    by_stk = rules.select(*[F.col(c).alias("st_" + c) for c in rules.columns])
    j = (d.join(F.broadcast(rel), "delivery_partner", "left").join(F.broadcast(avg_cost), "package_type", "left")
         .join(by_pkg, F.lower("package_type") == F.col("pk_scope"), "left")
         .join(by_stk, F.col("stakes") == F.col("st_scope"), "left"))
    rule = lambda c: F.when(F.col("pk_scope").isNotNull(), F.col("pk_" + c)).otherwise(F.col("st_" + c))
    has_rule = F.col("pk_scope").isNotNull() | F.col("st_scope").isNotNull()
    veh_bad = has_rule & ~F.array_contains(rule("vehicles"), F.col("vehicle_type"))
    rel_bad = has_rule & (F.col("reliability") < rule("min_reliability"))
    cost_bad = has_rule & (F.col("delivery_cost") / F.col("avg_cost") > rule("max_cost_premium"))
    return j.groupBy("package_type").agg(
        F.count(F.lit(1)).alias("deliveries"),
        F.sum(veh_bad.cast("int")).cast("long").alias("vehicle_violations"),
        F.sum(rel_bad.cast("int")).cast("long").alias("reliability_violations"),
        F.sum(cost_bad.cast("int")).cast("long").alias("cost_violations"),
        F.max(rule("buffer_percentage")).alias("buffer_percentage"))
