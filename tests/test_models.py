"""Tree scorer against MLlib, predictors inside the choice, the model store, exact splits, clusters."""

import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargolens.operators import choice, ml, quotes
from cargolens.plans import q_choice, q_ml

from .conftest import SF001


@pytest.fixture(scope="module")
def labeled(spark):
    return q_ml._labeled(spark, SF001).cache()


@pytest.fixture(scope="module")
def models(labeled):
    return {x: ml.fit_regressor(labeled, x, 5) for x in ("delivery_cost", "on_time_pct", "is_delayed")}


def test_tree_scorer_predicts_what_the_pipeline_does(spark, labeled, models):
    rows = labeled.select(*ml.FEATURES).limit(300)
    odd = spark.createDataFrame([("nobody", "nothing", "sled", "two day", "west", "clear", 10.0, 2.0, 3)], rows.schema)
    rows = rows.unionByName(odd)
    frame = rows.toPandas()
    for x, model in models.items():
        out = model.transform(rows)
        want = out.select(ml.to_array("probability")[1]) if x == "is_delayed" else out.select("pred_" + x)
        assert np.allclose(ml.tree_scorer(model)(frame), [r[0] for r in want.collect()], rtol=0, atol=1e-9)


def test_route_choice_and_risk_run_with_fitted_models(spark, labeled, models):
    requests, history = q_choice._requests(spark, SF001), q_choice._history(spark, SF001)
    options = quotes.carrier_options(spark, requests, history, delay_scorer=ml.tree_scorer(models["is_delayed"]))
    predictor = quotes.fitted_predictor(models["delivery_cost"], models["on_time_pct"])
    d = choice.decide(spark, options, carry=["delay_probability", "pkg", "risk_weather"], predictor=predictor).where("num_options > 0")
    rows = d.select("shipment_id", "delay_probability", "best").collect()
    assert len(rows) > 1000 and len({round(r["delay_probability"], 9) for r in rows}) > 3
    # The same by MLlib, one row for each option.
    e = quotes.explode_options(spark, options, ["shipment_id", "route_distance_km", "route_weight_kg", "pkg", "route_mode", "origin_region", "route_weather"],
                               ["carrier_code", "delivery_partner", "vehicle_type"])
    routes = e.select("shipment_id", "carrier_code", "delivery_partner", "vehicle_type", F.col("route_distance_km").alias("distance_km"),
                      F.col("route_weight_kg").alias("package_weight_kg"), F.col("pkg").alias("package_type"), F.col("route_mode").alias("delivery_mode"),
                      F.col("origin_region").alias("region"), F.col("route_weather").alias("weather_condition"),
                      F.lit(float(quotes.ROUTE_RATING)).alias("delivery_rating"))
    cost = {(r["shipment_id"], r["carrier_code"]): r["pred_delivery_cost"] for r in models["delivery_cost"].transform(routes).collect()}
    for r in rows:
        assert abs(cost[r["shipment_id"], r["best"]["carrier_code"]] - r["best"]["predicted_cost"]) < 1e-6
    p = ml.tree_scorer(models["is_delayed"])
    some = options.select("shipment_id", "delay_probability", "distance_km", "package_weight_kg", "pkg", "risk_weather").limit(50).toPandas()
    frame = some.rename(columns={"pkg": "package_type", "risk_weather": "weather_condition"}).assign(
        delivery_partner="delhivery", vehicle_type="van", delivery_mode="express", region="west", delivery_rating=4.0)
    frame["distance_km"] = frame["distance_km"].fillna(150.0)
    frame["package_weight_kg"] = frame["package_weight_kg"].fillna(25.0)
    assert np.allclose(p(frame), some["delay_probability"], atol=1e-9)


def test_route_choice_runs_with_a_function_of_batches(spark):
    def score(routes):
        import pandas as pd

        fast = routes["delivery_partner"].isin(["delhivery"]).to_numpy()
        return pd.DataFrame({"predicted_cost": routes["distance_km"] + fast, "predicted_on_time": 100.0 - ~fast * 60.0})

    d = choice.decide(spark, q_choice._options(spark, SF001), carry=["route_distance_km"], predictor=quotes.batch_predictor(score))
    rows = d.where("num_options > 0").select("best", "route_distance_km").collect()
    assert {r["best"]["delivery_partner"] == "delhivery" for r in rows if r["best"]["meets_sla"]} == {True}
    for r in rows:
        fast = r["best"]["delivery_partner"] == "delhivery"
        assert r["best"]["predicted_cost"] == r["route_distance_km"] + fast and r["best"]["predicted_on_time_pct"] == (100.0 if fast else 40.0)


def test_flagship_stays_compiled(spark):
    """No generated method is so large that it is dropped or left to the interpreter."""
    from cargolens.plans import pipelines

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        d = pipelines.integrated_recommendation(spark, q_choice._requests(spark, SF001), q_choice._history(spark, SF001))
        plan = d._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    codegen = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenStringSeq(plan)
    sizes = [codegen.apply(i)._3().maxMethodCodeSize() for i in range(codegen.size())]
    assert sizes and max(sizes) < 65535


def test_store_keeps_a_fit_for_its_training_rows(spark, labeled, tmp_path):
    store = ml.ModelStore(spark, str(tmp_path))
    train = labeled.where(~q_ml.is_test())
    model, fill = store.get("m", train, "delivery_cost", 2)
    key = next(p.name for p in tmp_path.iterdir())
    again, _ = store.get("m", train, "delivery_cost", 2)
    assert [p.name for p in tmp_path.iterdir()] == [key] and again.stages[-1].toDebugString == model.stages[-1].toDebugString
    store.get("m", train.where("distance_km > 20"), "delivery_cost", 2)
    assert len(list(tmp_path.iterdir())) == 2
    (tmp_path / key / "_COMPLETE" / "_SUCCESS").exists()
    gaps = spark.createDataFrame([(None, None, "van")], "distance_km double, package_type string, vehicle_type string")
    r = ml.impute(gaps, fill).first()
    mean = train.agg(F.avg("distance_km")).first()[0]
    assert r["vehicle_type"] == "van" and r["distance_km"] == pytest.approx(mean) and r["region"] is not None and r["package_type"] is not None


def test_training_rows_of_an_empty_store_are_worked_out_once(spark, labeled, tmp_path):
    """The fingerprint is that of the stored rows; a store that holds a fit is asked first."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x

    train = labeled.where(~q_ml.is_test()).limit(500).checkpoint()
    rows, store = train.withColumn("distance_km", counted("distance_km")), ml.ModelStore(spark, str(tmp_path))
    assert not store._holds("m")
    store.get("m", rows, "delivery_cost", 2)
    assert seen.value == 500 and store._holds("m") and not store._holds("n")
    assert store.key("m", train, sorted({*ml.FEATURES, "delivery_cost"})) in next(p.name for p in tmp_path.iterdir())
    store.get("m", rows, "delivery_cost", 2)
    assert seen.value == 1000 and len(list(tmp_path.iterdir())) == 1


def test_fits_run_at_the_same_time(spark):
    """Each waits for the other one: one after the other they would not end."""
    both = threading.Barrier(2)

    def fit(n):
        both.wait(60)
        return spark.range(n).count(), spark.sparkContext.getLocalProperty("spark.jobGroup.id")

    spark.sparkContext.setJobGroup("fits", "fits")
    assert ml.at_once(spark, lambda: fit(3), lambda: fit(5)) == [(3, "fits"), (5, "fits")]
    spark.sparkContext.setJobGroup("rest", "rest")
    with pytest.raises(ZeroDivisionError):
        ml.at_once(spark, lambda: 1, lambda: 1 / 0)


def test_top_features_come_from_fits_side_by_side(spark, monkeypatch):
    both = threading.Barrier(2)
    keep = ml.ModelStore.get_all

    def get_all(self, name, train, labels, max_iter=2):
        both.wait(60)
        return keep(self, name, train, labels, 2)

    monkeypatch.setattr(ml.ModelStore, "get_all", get_all)
    rows = q_ml.q_top_k_importance(spark, SF001).collect()
    assert Counter(r["model"] for r in rows) == {"delay": 10, "on_time": 10}


def test_stratified_split_takes_exactly_the_share(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1, 998)] + [(2000, None), (2001, None)]
    df = spark.createDataFrame(rows, "delivery_id long, y string")
    got = ml.train_test_split(df, stratify="y").groupBy("y", "is_test").count().collect()
    size = Counter(y for _, y in rows)
    assert {(r["y"], r["is_test"]): r["count"] for r in got if r["is_test"]} == {(y, True): n * 20 // 100 for y, n in size.items() if n * 20 // 100}
    spread = {(r["y"], r["fold"]): r["count"] for r in ml.folds(df, stratify="y").groupBy("y", "fold").count().collect()}
    assert all(abs(n - size[y] / 5) < 1 for (y, _), n in spread.items())


def test_clusters_are_the_best_of_many_starts(spark):
    rng = np.random.default_rng(1)
    middle = rng.normal(0, 10, (4, 5))
    rows = [(f"v{i}", *map(float, middle[i % 4] + rng.normal(0, 0.1, 5))) for i in range(80)]
    df = spark.createDataFrame(rows, ["delivery_partner", *ml.CLUSTER_COLUMNS])
    out, info = ml.vendor_kmeans(df, k=4)
    found = {r["delivery_partner"]: r["cluster"] for r in out.collect()}
    assert len({found[f"v{i}"] for i in range(4)}) == 4 and all(found[f"v{i}"] == found[f"v{i % 4}"] for i in range(80))
    assert len(info["centres"]) == 4 and ml.silhouette(out) > 0.9
    same = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 1.0), ("b", 1.0, 1.0, 1.0, 1.0, 1.0)], ["delivery_partner", *ml.CLUSTER_COLUMNS])
    assert {r["cluster"] for r in ml.vendor_kmeans(same, k=4)[0].collect()} == {0}
