"""Registered queries: the two streaming jobs, run to completion (availableNow) and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.exprs import r6
from cargolens.plans import q_risk
from cargolens.plans.catalog import query
from cargolens.sources import files, views
from cargolens.streaming import jobs


@query("stream_inference_ledger", """
SELECT model, country, CAST(sum(num_inferences) AS BIGINT) AS total_inferences, round(sum(carbon_gco2), 9) AS total_carbon_gco2
FROM inf_carbon GROUP BY ALL""")
def q_stream_inference_ledger(spark, sf):
    log = views.inference_log(spark, sf)
    src = jobs.stage_files(log, spark, "inference_events")
    out, ck = files.scratch_path(spark, "ledger_totals"), files.scratch_path(spark, "ledger_ckpt")
    jobs.inference_ledger_stream(spark, src, out, ck, log.schema)
    t = files.read_version(spark, out)
    return t.select("model", "country", F.col("total_inferences").cast("long").alias("total_inferences"),
                    F.round("total_carbon_gco2", 9).alias("total_carbon_gco2"))


@query("stream_risk_alerts", """
SELECT delivery_id, package_type, delivery_partner, round(risk_score, 6) AS risk_score, risk_level, risk_factors
FROM del_risk WHERE alert_required""")
def q_stream_risk_alerts(spark, sf):
    d = views.deliveries(spark, sf, q_risk.SCORE_COLS)
    src = jobs.stage_files(d, spark, "delivery_events")
    out, ck = files.scratch_path(spark, "alerts"), files.scratch_path(spark, "alerts_ckpt")
    jobs.risk_alert_stream(spark, src, d, out, ck, d.schema)
    a = spark.read.parquet(out)
    return a.select("delivery_id", "package_type", "delivery_partner", r6("risk_score").alias("risk_score"),
                    "risk_level", "risk_factors")
