"""Delay-risk scoring of deliveries and route options, alerts and forecast-failure tables.

P(delay) comes from the historical delay rate of the (partner, weather) group
(baseline predictor) or from a fitted classifier's probability column.  The
history tables are small partial aggregates, size-checked before broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.exprs import late_flag, r6, with_policy
from cargolens.operators import quotes
from cargolens.session import ensure_checkpoint_dir

#: Rows (partner and weather) of the history up to which it is broadcast.
MAX_HISTORY = 200_000


def history_tables(deliveries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(partner, weather) rates, partner rates and the global rate; the first two are broadcast only if they are small."""
    ensure_checkpoint_dir(deliveries.sparkSession)
    hist = deliveries.groupBy("delivery_partner", "weather_condition").agg(
        F.count(F.lit(1)).alias("n"), F.sum(late_flag()).alias("late")).checkpoint()
    may = F.broadcast if hist.count() <= MAX_HISTORY else (lambda df: df)
    pw = hist.select("delivery_partner", "weather_condition", (F.col("late") / F.col("n")).alias("pw_rate"))
    p = hist.groupBy("delivery_partner").agg((F.sum("late") / F.sum("n")).alias("partner_delay_rate"))
    g = hist.agg((F.sum("late") / F.sum("n")).alias("global_rate"))
    return may(pw), may(p), F.broadcast(g)  # the last is one row


def with_history(df: DataFrame, deliveries: DataFrame, partner: str = "delivery_partner",
                 weather: str = "weather_condition") -> DataFrame:
    """Attach ``delay_probability`` (group rate with partner/global fallback) and ``partner_delay_rate``."""
    pw, p, g = history_tables(deliveries)
    j = (df.join(pw.withColumnsRenamed({"delivery_partner": "_hp", "weather_condition": "_hw"}),
                 (F.col(partner) == F.col("_hp")) & (F.col(weather) == F.col("_hw")), "left")
         .join(p.withColumnRenamed("delivery_partner", "_pp"), F.col(partner) == F.col("_pp"), "left")
         .crossJoin(g))
    return (j.withColumn("delay_probability", F.coalesce("pw_rate", "partner_delay_rate", "global_rate"))
            .drop("_hp", "_hw", "_pp", "pw_rate", "global_rate"))


def score(df: DataFrame, spark, p_col: str = "delay_probability") -> DataFrame:
    """Risk score, level, alert flag, factor list, buffer days and warnings per row."""
    d = with_policy(df, spark)
    cols = quotes.risk_columns(F.col(p_col), F.col("impact_multiplier"), F.col("weather_condition"),
                               F.coalesce(F.col("distance_km"), F.lit(0.0)),
                               F.coalesce(F.col("package_weight_kg"), F.lit(0.0)),
                               F.col("delivery_partner"), F.col("partner_delay_rate"))
    out = d.withColumns(cols)
    return out.withColumn("warnings", F.when(F.col("alert_required"),
                                             F.array_append("risk_factors", F.lit(quotes.ALERT_WARNING)))
                          .otherwise(F.col("risk_factors")))


def merge_risk_factors(model: Column, external: Column) -> Column:
    """Model factors followed by external ones that are non-empty and not among the model's; repeats stay."""
    return F.concat(model, F.filter(external, lambda x: x.isNotNull() & (F.trim(x) != "") & ~F.array_contains(model, x)))


def forecast_failures(scored: DataFrame, features: list[str]) -> DataFrame:
    """Per feature value: mean absolute cost error, mean absolute on-time error, delayed count.

    One unpivot (``stack``) and one aggregation; the small result is ranked per feature by
    on-time error (descending).
    """
    stack = ", ".join(f"'{f}', CAST({f} AS STRING)" for f in features)
    long = scored.select("cost_error", "on_time_error", late_flag().alias("late"),
                         F.expr(f"stack({len(features)}, {stack}) AS (feature, value)"))
    agg = long.groupBy("feature", "value").agg(
        F.avg("cost_error").alias("cost_error"), F.avg("on_time_error").alias("on_time_error"),
        F.sum("late").cast("long").alias("delayed_count"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("feature").orderBy(F.col("on_time_error").desc(), F.col("value"))
    return agg.select("feature", "value", r6("cost_error").alias("cost_error"),
                      r6("on_time_error").alias("on_time_error"), "delayed_count", "n",
                      F.row_number().over(w).cast("long").alias("failure_rank"))
