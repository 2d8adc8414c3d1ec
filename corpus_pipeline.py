"""Corpus pipeline: quality, near duplicates, personal data, source mix, tokens.

``STAGES`` are applied to the table ``documents`` in order; each stage's rows are written as Parquet
and read again as the next one's input.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cargolens.llm.common import importable_on_workers, table
from cargolens.session import ensure_checkpoint_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts."""
    from cargolens.llm.quality import keep_good

    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    from cargolens.llm.minhash import keep_representatives

    return keep_representatives(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal numbers, addresses and dates by pseudonyms of the same format."""
    from cargolens.llm.pii import pseudonymise

    return pseudonymise(docs).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the sources' words meet their targets."""
    from cargolens.llm.mixing import mixed_documents

    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts; the last stage returns ids, token lists and the round trip's outcome."""
    from cargolens.llm.sentencepiece_codec import encode_documents

    return encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality),
    ("minhash_near_dedup", near_duplicates),
    ("pii", personal_data),
    ("source_mixing", mixture),
    ("sentencepiece_encoding", tokens),
]

#: A fitted network, MinHash and keyed permutations have no SQL form; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    importable_on_workers(spark)
    at = f"{ensure_checkpoint_dir(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
