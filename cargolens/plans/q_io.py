"""Registered queries: file round trips (write, read back) over data derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.operators import carbon
from cargolens.plans import q_vendors
from cargolens.plans.catalog import query
from cargolens.sources import files, views

VENDOR_SCHEMA = ("delivery_partner string, avg_cost double, avg_distance double, delay_rate double, avg_rating double, "
                 "volume bigint, on_time_pct double, cost_per_km double, reliability_score double")


def _vendor_stats(spark, sf):
    return q_vendors.q_vendor_stats(spark, sf)


@query("sink_csv", "SELECT * FROM vendor_stats_cte")
def q_sink_csv(spark, sf):
    path = files.sink_csv(_vendor_stats(spark, sf), files.scratch_path(spark, "vendor_stats_csv"))
    return spark.read.option("header", True).schema(VENDOR_SCHEMA).csv(path)


@query("src_csv_dim", """
SELECT lower(trim(package_type)) AS package_type, lower(trim(delivery_partner)) AS delivery_partner, delay_rate,
  avg_cost, avg_rating, on_time_pct, n FROM (
SELECT package_type, delivery_partner, round(late / n, 6) AS delay_rate, round(avg_cost, 6) AS avg_cost,
  round(avg_rating, 6) AS avg_rating, round((1 - late / n) * 100, 6) AS on_time_pct, n
FROM (SELECT package_type, delivery_partner, sum(CASE WHEN delayed = 'yes' THEN 1 ELSE 0 END) AS late, count(*) AS n,
        avg(delivery_cost) AS avg_cost, avg(delivery_rating) AS avg_rating
      FROM deliveries GROUP BY ALL) s) t""")
def q_src_csv_dim(spark, sf):
    t = q_vendors.q_vendor_stats_by_package(spark, sf).withColumn("package_type", F.upper("package_type"))
    path = files.sink_csv(t, files.scratch_path(spark, "by_package_csv"))
    return files.src_csv_dim(spark, path, "package_type string, delivery_partner string, delay_rate double, "
                             "avg_cost double, avg_rating double, on_time_pct double, n bigint",
                             ["package_type", "delivery_partner"])


@query("src_json_map_dim", "SELECT * FROM vendor_stats_cte")
def q_src_json_map_dim(spark, sf):
    stats = _vendor_stats(spark, sf)
    path = files.write_json_map(stats, "delivery_partner", files.scratch_path(spark, "vendor_map_json"))
    value = "struct<" + ", ".join(f"{c}: {t}" for c, t in [x.split(" ") for x in VENDOR_SCHEMA.split(", ")][1:]) + ">"
    return files.src_json_map_dim(spark, path, value, "delivery_partner")


@query("sink_json", "SELECT * FROM ew_indicators")
def q_sink_json(spark, sf):
    ind = q_vendors.q_early_warning_indicators(spark, sf)
    path = files.sink_json(ind, files.scratch_path(spark, "indicators_json"))
    return spark.read.schema(ind.schema).json(path)


@query("ledger_append", "SELECT * FROM inf_carbon")
def q_ledger_append(spark, sf):
    rows = carbon.inference_carbon(spark, views.inference_log(spark, sf))
    path = files.scratch_path(spark, "ledger")
    # Two runs (even / odd ids) land in one ledger, the second one twice; reading it back returns every row once.
    files.ledger_append(rows.where(F.col("inference_id") % 2 == 0), path, "even")
    for _ in range(2):
        files.ledger_append(rows.where(F.col("inference_id") % 2 == 1), path, "odd")
    back = spark.read.parquet(path)
    return back.select(*rows.columns)


@query("json_safe_export")
def q_json_safe_export(spark, sf):
    return files.json_safe_export(_vendor_stats(spark, sf))

