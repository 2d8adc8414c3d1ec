"""Structured Streaming jobs: a running inference ledger and delivery risk alerts.

Both read a folder of parquet files as a stream (new files = new events),
keep their state in the checkpoint folder under the shared
``spark.checkpoint.dir`` (so a restarted driver or lost executor resumes), and
run with ``availableNow`` so a batch scheduler can drive them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.operators import carbon, risk
from cargolens.sources import files


def inference_ledger_stream(spark: SparkSession, events_dir: str, out_dir: str, checkpoint: str,
                            schema) -> None:
    """Running totals per (model, country), a version of ``out_dir`` for each micro-batch (``files.read_version``).

    A batch that is run again after a crash writes its own version again, and until that is complete
    readers see the one before.
    """
    stream = spark.readStream.schema(schema).parquet(events_dir)
    totals = carbon.inference_carbon(spark, stream).groupBy("model", "country").agg(
        F.sum("num_inferences").alias("total_inferences"), F.sum("carbon_gco2").alias("total_carbon_gco2"))

    def write(batch: DataFrame, epoch: int) -> None:
        files.write_version(batch, out_dir, epoch)

    q = (totals.writeStream.outputMode("complete").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def risk_alert_stream(spark: SparkSession, deliveries_dir: str, history: DataFrame, out_dir: str,
                      checkpoint: str, schema) -> None:
    """Score arriving deliveries against static history (broadcast) and append alert rows."""
    stream = spark.readStream.schema(schema).parquet(deliveries_dir)
    scored = risk.score(risk.with_history(stream, history), spark)
    alerts = scored.where(F.col("alert_required")).select(
        "delivery_id", "package_type", "delivery_partner", "risk_score", "risk_level",
        F.array_join("risk_factors", ", ").alias("risk_factors"))
    q = (alerts.writeStream.outputMode("append").format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def stage_files(df: DataFrame, spark: SparkSession, name: str) -> str:
    """Write ``df`` as a replayable event folder for the stream jobs, a file for each of its partitions."""
    path = files.scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return path
