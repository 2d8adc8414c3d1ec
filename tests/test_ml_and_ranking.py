"""MLlib fits reach the survey's thresholds; the skew-safe rank equals a window rank."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator

from cargolens.functions.ranking import grouped_row_number
from cargolens.operators import ml
from cargolens.sources import views
from tests.conftest import SF001


def test_gbt_thresholds(spark):
    d = ml.train_test_split(ml.with_labels(views.deliveries(
        spark, SF001, ["delivery_id", "delayed", "delivery_cost", *ml.FEATURES])), stratify="is_delayed")
    train, test = d.where(~F.col("is_test")), d.where(F.col("is_test"))
    reg = ml.fit_regressor(train, "delivery_cost", 20).transform(test)
    r2 = RegressionEvaluator(labelCol="delivery_cost", predictionCol="pred_delivery_cost", metricName="r2").evaluate(reg)
    assert r2 > 0.9
    clf = ml.fit_classifier(train, 20).transform(test)
    auc = BinaryClassificationEvaluator(labelCol="is_delayed").evaluate(clf)
    assert auc > 0.9


def test_grouped_rank_matches_window(spark):
    df = spark.range(0, 5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 7).cast("string"))).alias("g"),
        ((F.col("id") * 37) % 101).cast("double").alias("x"), F.col("id"))
    got = grouped_row_number(df, "g", [F.col("x").desc(), F.col("id")], out="r")
    w = Window.partitionBy("g").orderBy(F.col("x").desc(), F.col("id"))
    ref = df.withColumn("r", F.row_number().over(w).cast("long"))
    assert got.select("id", "r").exceptAll(ref.select("id", "r")).count() == 0
    assert got.count() == 5000
