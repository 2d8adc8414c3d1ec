"""Small tables with the awkward rows that every operator must take."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
                     # Columns that bear the names of results.
                     T.StructField("score", T.StringType()), T.StructField("size", T.StringType()), T.StructField("id", T.StringType())])


def long_text(words: int = 30_000) -> str:
    return " ".join(f"w{i * 7919 % 10007}" for i in range(words))


def awkward_rows() -> list[tuple]:
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [None, "", "   \n\t ", "one", "one two three", base, base, base.upper(), base + " extra", "head " + passage + " tail",
             "other " + passage + " end", "x " * 100, long_text(), "😀 ünï code <|endoftext|> ՘ ▁x", "call +1 (212) 555-0123 or a.b@c.example.com"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or ""), "a", "b", "c") for i, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rows.append((None, "one two three four five six", None, None, None, None, None, None))
    rows.append((99, base + " again", None, None, None, None, None, None))
    return rows


@pytest.fixture(scope="package", autouse=True)
def few_partitions(spark):
    """The tables are small and the jobs many."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
