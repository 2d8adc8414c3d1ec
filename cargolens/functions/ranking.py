"""Ranking within groups without funnelling a hot group into one task.

A window ``rank() OVER (PARTITION BY g ORDER BY x)`` sends every row of a group
to one task; if one group holds a third of the table that task holds a third
of the table.  Here the rows are range-partitioned on (group, order keys) so a
large group spans many partitions, each partition is sorted, and the rank is
rebuilt from per-(partition, group) counts: offset of the partition within the
group plus the row's position inside the partition.  Only the tiny
(partition x group) count table is windowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _ranged(df: DataFrame, keys: list[Column], num_partitions: int | None) -> DataFrame:
    """The table range-partitioned and sorted by ``keys`` with partition number ``_pid`` and row number ``_mid``, stored.

    Partition numbers must be the same in all uses: the lineage is cut with a reliable checkpoint (in the cluster's
    shared spark.checkpoint.dir).  Without a number of partitions Spark chooses one by size.
    """
    from cargolens.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    s = ranged.sortWithinPartitions(*keys).withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    return s.checkpoint(eager=True)


def prefix_min(df: DataFrame, group: str | None, order: Column, value: str, out: str, num_partitions: int | None = None) -> DataFrame:
    """``out``: the least ``value`` among the rows before this one in its group by ``order`` (null for the first).

    The window runs inside (partition, group); what partitions before hold of the group is one row each.
    """
    key = [group] if group else []
    s = _ranged(df, [*map(F.col, key), order], num_partitions).drop("_mid")
    stats = s.groupBy("_pid", *key).agg(F.min(value).alias("_least"))
    before = Window.partitionBy(*key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_carried", F.min("_least").over(before)).drop("_least")  # a row for each partition and group
    inside = Window.partitionBy("_pid", *key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = s.withColumn("_own", F.min(value).over(inside))
    return own.join(stats, ["_pid", *key]).withColumn(out, F.least("_own", "_carried")).drop("_pid", "_own", "_carried")


def exact_median(df: DataFrame, column: str, out: str, num_partitions: int | None = None) -> DataFrame:
    """One row: the middle of the column's values (the mean of the middle two), nulls left out.

    The values are range-partitioned; counts by partition say where the middle lies, and one or two rows are picked there.
    """
    s = _ranged(df.select(column).where(F.col(column).isNotNull()), [F.col(column)], num_partitions)
    stats = s.groupBy("_pid").agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid")  # a row for each partition
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = stats.agg(F.sum("_n").alias("_all"))
    rank = F.col("_off") + F.col("_mid") - F.col("_first")
    middle = s.join(F.broadcast(stats.crossJoin(F.broadcast(total))), "_pid").where(
        (rank == F.expr("(_all - 1) div 2")) | (rank == F.expr("_all div 2")))
    return middle.agg(F.avg(column).alias(out))


def grouped_row_number(df: DataFrame, group: str, order: list[Column], out: str = "rank",
                       num_partitions: int | None = None) -> DataFrame:
    """1-based row number within ``group`` by ``order`` (which must end with a unique key).

    The sorted, numbered table is checkpointed so both uses see the same partition ids.
    """
    s = _ranged(df, [F.col(group), *order], num_partitions)
    stats = s.groupBy("_pid", group).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return (s.join(F.broadcast(stats), ["_pid", group])
            .withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("long"))
            .drop("_pid", "_mid", "_first", "_n", "_off"))
