"""What keeps options and choices cheap for each request."""

from pyspark.sql import functions as F

from cargolens.operators import choice, frontier, quotes
from cargolens.plans import q_choice
from cargolens.session import JIT_LIMIT

from .conftest import SF001


def test_a_filter_on_the_number_of_options_does_not_work_the_offers_out_twice(spark):
    d = choice.decide(spark, q_choice._options(spark, SF001), carry=[]).where(F.col("num_options") > 0)
    plan = d.select("shipment_id", "best")._jdf.queryExecution().optimizedPlan().toString()
    prices = f"[0,{quotes.carriers()[0]['max_weight_kg']},["  # the head of the constant list of carriers
    assert plan.count(prices) == 1
    want = choice.decide(spark, q_choice._options(spark, SF001), carry=[]).select("shipment_id", "num_options").collect()
    assert d.count() == sum(r["num_options"] > 0 for r in want) < len(want)


def test_no_stage_is_left_to_the_bytecode_interpreter(spark):
    """Stages with methods that the JVM never compiles run operator by operator."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    q_choice._options(spark, SF001)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) == JIT_LIMIT


def test_the_frontier_works_its_points_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x % 7)

    points = spark.range(100).select(F.col("id").alias("shipment_id"), F.lit("p").alias("package_type"), counted("id").alias("service_level"),
                                     (F.col("id") % 11).cast("double").alias("carbon_gco2"))
    assert frontier.frontier_points(points).collect() and seen.value == 100
