"""Small Column helpers shared by the operators (all built-in, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargolens.sources import dims


def r6(c: Column | str) -> Column:
    """Round computed doubles to 6 places so summation order cannot matter."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)  # + 0.0 turns -0.0 into 0.0


def late_flag(delayed: str = "delayed") -> Column:
    """1 when the delivery was late (``delayed = 'yes'``), else 0."""
    return F.when(F.col(delayed) == "yes", 1).otherwise(0)


def on_time_pct(delayed: str = "delayed") -> Column:
    """Per-row on-time percentage label: 100 when not delayed."""
    return F.when(F.col(delayed) == "no", 100).otherwise(0).cast("int")


def missing_as(c: Column, default) -> Column:
    """``x or default``: the reference treats both null and 0 as missing."""
    return F.coalesce(F.when(c != 0, c), F.lit(default))


def blank_as(c: Column, default: str) -> Column:
    """String ``x or default``: null and '' are missing."""
    return F.coalesce(F.when(c != "", c), F.lit(default))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def casp(service: Column, carbon: Column) -> Column:
    """Carbon-adjusted service performance: service / carbon, 0 when carbon <= 0."""
    return F.when(carbon > 0, service / carbon).otherwise(F.lit(0.0))


POLICY_COLUMNS = ["stakes", "tier", "tier_name", "on_time_threshold", "cold_chain_multiplier",
                  "priority", "impact_multiplier"]


def with_policy(df: DataFrame, spark, package_col: str = "package_type") -> DataFrame:
    """Left-join the package policy (broadcast, 9 rows); unknown types get the default row."""
    pol = dims.dim(spark, "dim_policy").select(
        F.col("package_type").alias("_pol_key"), *[F.col(c).alias("_pol_" + c) for c in POLICY_COLUMNS])
    joined = df.join(pol, F.lower(F.col(package_col)) == F.col("_pol_key"), "left")
    filled = {c: F.coalesce(F.col("_pol_" + c), F.lit(v)) for c, v in zip(POLICY_COLUMNS, dims.DEFAULT_POLICY)}
    return joined.withColumns(filled).drop("_pol_key", *["_pol_" + c for c in POLICY_COLUMNS])


def vehicle_factor(spark, df: DataFrame, vehicle_col: str = "vehicle_type", out: str = "gco2_per_km") -> DataFrame:
    """Left-join vehicle emission factors (broadcast, 6 rows); unknown vehicle -> 800."""
    veh = dims.dim(spark, "dim_vehicle").withColumnRenamed("vehicle_type", "_veh_key") \
        .withColumnRenamed("gco2_per_km", "_veh_f")
    return (df.join(veh, F.lower(F.col(vehicle_col)) == F.col("_veh_key"), "left")
            .withColumn(out, F.coalesce(F.col("_veh_f"), F.lit(dims.DEFAULT_VEHICLE_GCO2_PER_KM)))
            .drop("_veh_key", "_veh_f"))


def grid_intensity(spark, df: DataFrame, country_col: str = "country", out: str = "grid_gco2_kwh") -> DataFrame:
    """Left-join grid intensity (broadcast, 13 rows); unknown country -> 400."""
    grid = dims.dim(spark, "dim_grid").withColumnRenamed("country", "_grid_key") \
        .withColumnRenamed("gco2_kwh", "_grid_v")
    return (df.join(grid, F.lower(F.col(country_col)) == F.col("_grid_key"), "left")
            .withColumn(out, F.coalesce(F.col("_grid_v"), F.lit(dims.DEFAULT_GRID_GCO2_PER_KWH)))
            .drop("_grid_key", "_grid_v"))


def model_energy(spark, df: DataFrame, model_col: str = "model", out: str = "energy_per_inference_wh") -> DataFrame:
    """Left-join model energy (broadcast, 16 rows); unknown model -> 0.001 Wh."""
    m = dims.dim(spark, "dim_model").withColumnRenamed("model", "_m_key").withColumnRenamed("energy_wh", "_m_v")
    return (df.join(m, F.lower(F.col(model_col)) == F.col("_m_key"), "left")
            .withColumn(out, F.coalesce(F.col("_m_v"), F.lit(dims.DEFAULT_MODEL_WH)))
            .drop("_m_key", "_m_v"))


def checked_broadcast(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """A derived table cut off and counted: marked for broadcast up to ``max_rows`` rows, else left to a shuffle join.

    The cut (a checkpoint in the shared folder) lets the count and the later join reuse one computation.
    """
    from cargolens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    small = df.checkpoint()
    return F.broadcast(small) if small.count() <= max_rows else small


def round_half_up(c: Column, digits: int) -> Column:
    """floor(x * 10^d + 0.5) / 10^d: plain IEEE steps, so every engine rounds the same way."""
    scale = float(10 ** digits)
    return F.floor(c * scale + 0.5) / scale
