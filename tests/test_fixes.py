"""Cases that once gave wrong answers, and the predictor hook."""

import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cargolens import session
from cargolens.operators import choice, lanes, ml, quotes, risk
from cargolens.plans import q_choice
from cargolens.sources import files

from .conftest import SF001


def test_json_export_writes_nulls_and_cleans_nested_nan(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1, nan, [nan, 1.0], (nan, "x"), {"k": nan}), (2, None, None, None, None)],
                               "id int, d double, a array<double>, st struct<v:double,w:string>, m map<string,double>")
    got = [json.loads(r["json"]) for r in files.json_safe_export(df).orderBy("json").collect()]
    assert got[0] == {"id": 1, "d": None, "a": [None, 1.0], "st": {"v": None, "w": "x"}, "m": {"k": None}}
    assert got[1] == {"id": 2, "d": None, "a": None, "st": None, "m": None}


def test_merged_factors_keep_repeats_and_drop_known_ones(spark):
    df = spark.createDataFrame([(["a"], ["rain", "rain", "", None, "a"])], "m array<string>, e array<string>")
    assert df.select(risk.merge_risk_factors(F.col("m"), F.col("e")).alias("x")).first()["x"] == ["a", "rain", "rain"]


def test_two_provider_rows_do_not_double_a_request(spark):
    req = spark.createDataFrame([(1, "nowhere", "elsewhere")], "id int, origin string, destination string")
    two = spark.createDataFrame([("Nowhere", "Elsewhere", 70.0), ("nowhere", "elsewhere", 60.0)], "origin string, destination string, distance_km double")
    rows = lanes.distance_cascade(spark, req, provider=two).collect()
    assert [(r["cascade_distance_km"], r["distance_source"]) for r in rows] == [(60.0, "openrouteservice")]


def test_unknown_category_is_all_zeros(spark):
    from pyspark.ml import Pipeline

    rows = [("p", "t", "v", "m", "r", "w", 1.0, 2.0, 3.0), ("q", "u", "v", "m", "r", "w", 2.0, 3.0, 4.0)]
    cols = [*ml.CATEGORICAL, *ml.NUMERIC]
    model = Pipeline(stages=ml.feature_pipeline()).fit(spark.createDataFrame(rows, cols))
    new = spark.createDataFrame([("other", "t", "v", "m", "r", "w", 1.0, 2.0, 3.0)], cols)
    assert model.transform(new).first()["delivery_partner_oh"].toArray().tolist() == [0.0, 0.0]


def test_checkpoint_folder_must_be_set_off_local_mode():
    conf = SimpleNamespace(get=lambda *a: None, set=lambda *a: None)
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(SimpleNamespace(conf=conf, sparkContext=sc))


def test_choice_follows_another_predictor_and_shuffles_no_request(spark):
    def flat(requests, carriers):
        return requests.withColumns({k: v for c in carriers for k, v in (
            (f"p_cost_{c['seq']}", F.lit(float(c["seq"]))), (f"p_on_time_{c['seq']}", F.lit(100.0)),
            (f"p_carbon_{c['seq']}", F.lit(float(100 - c["seq"]))))})

    d = choice.decide(spark, q_choice._options(spark, SF001), carry=[], predictor=flat).where("num_options > 0 and stakes <> 'standard'")
    rows = d.select("best.predicted_cost", "greenest_carbon_gco2", "num_options").limit(200).collect()
    assert rows and all(r["predicted_cost"] + r["num_options"] - 1 <= 9 for r in rows)
    assert all(100 - r["greenest_carbon_gco2"] >= r["predicted_cost"] for r in rows)
    plan = choice.decide(spark, q_choice._options(spark, SF001), carry=[])._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "shipment_id" not in "".join(x for x in plan.splitlines() if "hashpartitioning" in x)
