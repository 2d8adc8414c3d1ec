"""Shared pieces of the corpus operators: tables, scratch cuts, worker imports, text columns.

Conventions that every operator of this package keeps:

* a null text counts as the empty text unless the operator's docstring says otherwise;
* operators read the columns they are told to and select them at once, so other columns of the
  input (also ones named like their results) neither reach the plan nor clash;
* no result depends on how rows are spread over partitions.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Hashable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargolens.session import ensure_checkpoint_dir

#: White space that separates words: space and U+0009 to U+000D, as a Java and Python character class.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

#: Rows of a table that may be broadcast after they were counted; beyond it a shuffle join is used.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder of ``spark.checkpoint.dir`` and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a (cut, so cheap to count) table for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def importable_on_workers(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package from where the driver has it.

    On a cluster the package is installed or shipped with ``--py-files``; a session that was
    started from another folder needs the path.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def trim() -> None:
    """Give memory that was freed back to the system: workers live on, and other operators' tasks run in them."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def tidy(batches: Iterator) -> Iterator:
    """Pass batches on, and trim when they end."""
    yield from batches
    gc.collect()
    trim()


_kept: dict[Hashable, object] = {}


def kept(key: Hashable, build: Callable[[], object]) -> object:
    """What a worker keeps between tasks: the last thing built, so that nothing of earlier operators stays."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def fresh(batches: Iterator) -> Iterator:
    """Pass batches on in a worker that forgets what earlier operators kept there, and trim when they end."""
    _kept.clear()
    trim()
    yield from tidy(batches)


def total_bytes(df: DataFrame, col: str = "text") -> tuple[int, int]:
    """(rows, UTF-8 bytes of the column) over the whole table."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.col(col)).cast("long")).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int, count: int | None = None) -> DataFrame:
    """About ``rows`` rows at most, chosen by a hash of ``key`` alone, so the same on every run."""
    n = df.count() if count is None else count
    if n <= rows:
        return df
    unit = F.pmod(F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return df.where(unit < F.lit(rows / n))
