"""Session helpers: a local session for tests/bench and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "cargolens") -> SparkSession:
    """A local session configured like the tests and bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.ui.retainedExecutions", "20")
        .config("spark.ui.retainedJobs", "50")
        .config("spark.ui.retainedStages", "50")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Bytes of a method beyond which the JVM never compiles it.
JIT_LIMIT = 8000


def keep_methods_compiled(spark: SparkSession) -> None:
    """Stages whose generated method the JVM would leave to its bytecode interpreter run operator by operator instead.

    A stage over Spark's own limit (65,535 bytes) does so anyway; between that and the JVM's limit it would run
    uncompiled, many times slower.
    """
    if int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) > JIT_LIMIT:
        spark.conf.set("spark.sql.codegen.hugeMethodLimit", str(JIT_LIMIT))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    On a cluster the setting names a shared file system; it is only filled in
    here when unset (local tests), with a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all machines share")
    path = tempfile.mkdtemp(prefix="cargolens-ckpt-", dir=os.environ.get("CARGOLENS_SCRATCH", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path
