"""File sources and sinks: header CSV, JSON lines, JSON documents keyed by id, an append-only ledger.

Paths live under the session's shared ``spark.checkpoint.dir`` unless given,
so every executor sees them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cargolens.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/exports/{name}-{uuid.uuid4().hex}"


def sink_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def sink_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def src_csv_dim(spark: SparkSession, path: str, schema: str, lower: list[str]) -> DataFrame:
    """Header CSV with an explicit schema; key columns lower-cased."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.withColumns({c: F.lower(F.trim(c)) for c in lower})


def write_json_map(df: DataFrame, key: str, path: str) -> str:
    """One JSON document ``{"_metadata": {...}, "<key>": {fields...}, ...}`` (a keyed reference file).

    Meant for small reference tables (one row per key); the document is written as one file.
    """
    value = F.struct(*[c for c in df.columns if c != key])
    doc = df.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col(key).cast("string"), value))))
                 .alias("m"))
    body = F.concat(F.lit('{"_metadata": {"source": "derived"}, '), F.expr("substring(m, 2)"))
    doc.select(body.alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def src_json_map_dim(spark: SparkSession, path: str, value_schema: str, key: str) -> DataFrame:
    """Read a JSON object keyed by id: one row per key, ``_``-prefixed metadata keys dropped."""
    raw = spark.read.option("wholetext", True).text(path)
    m = raw.select(F.explode(F.from_json("value", f"map<string, {value_schema}>")).alias(key, "v"))
    return m.where(~F.col(key).startswith("_")).select(key, "v.*")


def ledger_append(df: DataFrame, path: str, run: str, partition_by: str = "country") -> str:
    """Append one run's rows to a parquet audit ledger partitioned by run and ``partition_by``.

    A run owns its folder: a rerun after a failure, or by mistake, replaces its own rows and no others, so no row counts twice.
    """
    df.write.mode("overwrite").partitionBy(partition_by).parquet(f"{path}/run={run}")
    return path


def _versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions under ``path``, oldest first."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().startswith("version=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def write_version(df: DataFrame, path: str, version: int, keep: int = 2) -> None:
    """Write a whole table as version ``version``: the same version again replaces itself, readers see the last complete one.

    The writer's ``_SUCCESS`` file completes a version; older ones than the last ``keep`` are removed afterwards.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path}/version={version}")
    jvm = spark._jvm
    for old in _versions(spark, path)[:-keep]:
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/version={old}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_version(spark: SparkSession, path: str) -> DataFrame:
    """The last complete version."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"{path} has no complete version")
    return spark.read.parquet(f"{path}/version={versions[-1]}")


def json_safe(c: Column, kind: T.DataType) -> Column:
    """The column with every NaN, also inside arrays, maps and structs, as null."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: json_safe(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: json_safe(v, kind.valueType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[json_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    return c


def json_safe_export(df: DataFrame) -> DataFrame:
    """One JSON text per row; NaN becomes null at any depth and null keys are written."""
    row = F.struct(*[json_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])
    return df.select(F.to_json(row, {"ignoreNullFields": "false"}).alias("json"))
