"""Boosted trees fitted together against MLlib's, one fit at a time."""

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from cargolens.operators import ml, trees


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    names = {c: [f"{c[0]}{i}" for i in range(2 + j)] for j, c in enumerate(ml.CATEGORICAL)}
    rows = []
    for i in range(3000):
        kinds = [str(rng.choice(v)) for v in names.values()]
        km, kg, stars = float(rng.integers(1, 400)), float(np.round(rng.gamma(2, 9), 2)), float(rng.integers(1, 6))
        cost = 100 + 3 * km + 5 * kg + 40 * (kinds[0] == "d1") + rng.normal(0, 20)
        late = float(km / 400 + (kinds[5] == "w3") + rng.normal(0, 0.3) > 0.8)
        rows.append((i, i % 5, *kinds, km, kg, stars, cost, late))
    df = spark.createDataFrame(rows, ["id", "fold", *ml.CATEGORICAL, *ml.NUMERIC, "cost", "is_delayed"])
    return ml.feature_table(df, F.lit(True), ["id", "fold", "cost", "is_delayed"])[1].coalesce(3)


def _mllib(label, n):
    kind = {"featuresCol": "features", "labelCol": label, "maxIter": n, "maxDepth": 3, "stepSize": 0.1, "seed": 42}
    return GBTClassifier(**kind) if label == "is_delayed" else GBTRegressor(**kind, predictionCol="pred_" + label)


def test_fits_together_predict_what_mllib_predicts(table):
    n = 12
    jobs = [("cost", None, None), ("cost", "fold", 2), ("is_delayed", "fold", 4)]
    for (label, by, k), model in zip(jobs, ml.fit_all(table, jobs, n), strict=True):
        want = _mllib(label, n).fit(table.where(F.col(by) != k) if by else table)
        value = ml.to_array("probability")[1] if label == "is_delayed" else F.col("pred_" + label)
        a, b = ([r[0] for r in m.transform(table).orderBy("id").select(value).collect()] for m in (want, model))
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
        assert np.allclose(want.featureImportances.toArray(), model.featureImportances.toArray(), atol=1e-6)
        if label == "is_delayed":
            a, b = ([r[0] for r in m.transform(table).orderBy("id").select("prediction").collect()] for m in (want, model))
            assert a == b


def test_models_are_loaded_as_they_were_saved(table, tmp_path):
    [model] = ml.fit_all(table, [("is_delayed", None, None)], 3)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert again.toDebugString == model.toDebugString and again.classifier
    a, b = (m.transform(table).select("id", "probability", "prediction").collect() for m in (model, again))
    assert sorted(a) == sorted(b)


def test_passes_do_not_grow_with_the_models(spark, table):
    """Three jobs a tree, whatever the number of fits."""
    def jobs_of(jobs, n):
        sc = spark.sparkContext
        group = f"fits-{len(jobs)}-{n}"
        sc.setJobGroup(group, group)
        ml.fit_all(table, jobs, n)
        sc.setJobGroup("rest", "rest")
        return len(sc.statusTracker().getJobIdsForGroup(group))

    for jobs in ([("cost", None, None)], [(x, "fold", k) for x in ("cost", "is_delayed") for k in range(2)]):
        assert jobs_of(jobs, 4) - jobs_of(jobs, 2) == 2 * 3


def test_more_rows_than_the_borders_are_taken_from(spark):
    """The same sample of the rows as MLlib's gives the same borders and models."""
    rng = np.random.default_rng(4)
    rows = [(i, *(str(rng.integers(2 + j)) for j in range(len(ml.CATEGORICAL))), float(rng.gamma(2, 60)), float(rng.gamma(2, 9)), float(rng.integers(1, 6)))
            for i in range(13000)]
    df = spark.createDataFrame(rows, ["id", *ml.CATEGORICAL, *ml.NUMERIC]).withColumn("cost", F.col("distance_km") * 3 + F.sqrt("package_weight_kg") * 9)
    table = ml.feature_table(df, F.lit(True), ["id", "cost"])[1]
    [model] = ml.fit_all(table, [("cost", None, None)], 4)
    a, b = ([r[0] for r in m.transform(table).orderBy("id").select("pred_cost").collect()] for m in (_mllib("cost", 4).fit(table), model))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_yes_no_features_that_never_meet_share_a_digit(spark, table):
    """One-hot columns of a category take one digit; two that some row has both of do not, however rare that is."""
    arrays = table.select(trees.vector_to_array("features"))
    width = len(table.first()["features"])
    borders = [np.array([0.5])] * width
    digits = trees._digits(arrays, [np.arange(3.0)] * 3 + borders[3:])
    assert sorted(f for d in digits for f in d) == list(range(width)) and len(digits) == 3 + len(ml.CATEGORICAL)
    odd = spark.createDataFrame([([0.0] * 3 + [1.0] * (width - 3),)], "features array<double>")
    assert all(len(d) == 1 for d in trees._digits(arrays.toDF("features").unionAll(odd), borders))


def test_features_that_share_no_digit_fit_as_mllib(spark):
    """Flags of which several are set in a row, a rare value, a fold left out."""
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.random((2000, 4)) < [0.5, 0.3, 0.02, 0.9], rng.gamma(2, 5, 2000)]).astype(float)
    y = x @ [3, -5, 40, 1, 2] + rng.normal(0, 1, 2000)
    rows = [(i, i % 3, Vectors.dense(v), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))]
    t = spark.createDataFrame(rows, ["id", "fold", "features", "cost"]).repartition(3, "id").checkpoint()
    jobs = [("cost", "fold", k) for k in range(3)]
    fitted = ml.fit_all(t, jobs, 8)
    for (_, by, k), model in zip(jobs, fitted, strict=True):
        want = _mllib("cost", 8).fit(t.where(F.col(by) != k))
        a, b = ([r[0] for r in m.transform(t).orderBy("id").select("pred_cost").collect()] for m in (want, model))
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    left = {r["id"]: r["pred_cost"] for r in trees.predict_left_out(t, jobs, fitted).collect()}
    for (_, by, k), model in zip(jobs, fitted, strict=True):
        assert all(left[r["id"]] == r["pred_cost"] for r in model.transform(t.where(F.col(by) == k)).collect())


def test_one_pass_predicts_the_rows_left_out_of_every_fold(spark, table):
    """The scan does not grow with the folds."""
    jobs = [(x, "fold", k) for x in ("cost", "is_delayed") for k in range(5)]
    scored = trees.predict_left_out(table, jobs, ml.fit_all(table, jobs, 2)).select("pred_cost", "pred_is_delayed")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1
    assert {r[1] for r in scored.collect()} <= {0.0, 1.0}


def test_blocks_are_dealt_one_by_one(spark, monkeypatch):
    """Rows of one partition go to all tasks, a byte a digit."""
    monkeypatch.setattr(trees, "BLOCK", 100)
    kept, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *a: kept.append(self) or persist(self, *a))
    n = 2 * spark.sparkContext.defaultParallelism
    x = F.array((F.col("id") % 9).cast("double"), (F.col("id") % 2).cast("double"))
    t = spark.range(0, 200 * n, 1, 1).select(F.col("id").cast("double").alias("cost"), trees.array_to_vector(x).alias("features")).checkpoint()
    ml.fit_all(t, [("cost", None, None)], 1)
    parts = kept[0].map(lambda block: (block[0].dtype.itemsize, block[0].shape[1])).glom().collect()
    assert {w for p in parts for w, _ in p} == {1}
    assert sum(r for p in parts for _, r in p) == 200 * n and max(sum(r for _, r in p) for p in parts) <= 400


def test_rows_are_looked_at_once_unless_digits_turn_out_shared(spark, table, monkeypatch):
    """Digits come from the borders' rows; the pass over all rows is left to tables whose other rows do not allow them."""
    looked, digits = [], trees._digits
    monkeypatch.setattr(trees, "_digits", lambda *a: looked.append(1) or digits(*a))
    ml.fit_all(table, [("cost", None, None)], 2)
    assert not looked
    # Of 30,000 rows one has both flags and is not among those that the borders are taken from.
    jobs = [("cost", None, None)]

    def rows(odd):
        flags = [((F.col("id") % 3 == k) | (F.col("id") == odd)).cast("double") for k in range(2)]
        cost = (F.col("id") % 3 * 5 + F.col("id") / 1000 + F.when(F.col("id") == odd, 1000).otherwise(0)).cast("double")
        return spark.range(0, 30_000, 1, 3).select("id", cost.alias("cost"), trees.array_to_vector(F.array(*flags, F.col("id").cast("double"))).alias("features")).checkpoint()

    drawn = set(trees._borders(rows(-1), jobs)[1][:, 2])
    t = rows(next(i for i in range(30_000) if i not in drawn))
    borders, some = trees._borders(t, jobs)
    assert len(trees._likely_digits(some, borders[0])) == 2
    [model] = ml.fit_all(t, jobs, 4)
    assert looked == [1]
    a, b = ([r[0] for r in m.transform(t).orderBy("id").select("pred_cost").collect()] for m in (_mllib("cost", 4).fit(t), model))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_sparse_and_dense_vectors_are_the_same_rows(spark):
    rows = [Vectors.dense([0.0, 2.5, -1.0]), Vectors.sparse(3, [1, 2], [4.0, 0.0]), Vectors.sparse(3, [], []), Vectors.dense([1.0, 0.0, 7.0])] * 5
    df = spark.createDataFrame([(v,) for v in rows], ["features"]).select(F.unwrap_udt("features").alias("v"))
    column = df.toArrow().column(0).combine_chunks()
    assert np.array_equal(trees._dense(3)(column).T, [v.toArray() for v in rows])
    assert np.array_equal(trees._dense(3)(column.slice(1, 6)).T, [v.toArray() for v in rows[1:7]])


def test_margins_are_stored_in_small_records(spark, table, monkeypatch):
    """However many models, no stored array is large; together they hold every model's margin of every row."""
    monkeypatch.setattr(trees, "BLOCK", 100)
    monkeypatch.setattr(trees, "RECORD", 4000, raising=False)
    kept, persist = [], RDD.persist
    monkeypatch.setattr(RDD, "persist", lambda self, *a: kept.append(self) or persist(self, *a))
    jobs = [(x, "fold", k) for x in ("cost", "is_delayed") for k in range(5)]
    ml.fit_all(table, jobs, 1)
    found = kept[1].map(lambda r: (len(r), r[0].shape[1]) if isinstance(r, tuple) else (r.nbytes, r.size)).collect()
    rows, margins = sum(n for k, n in found if k == 4), [x for x in found if x[0] != 4]
    assert rows == 3000 and sum(n for _, n in margins) == 10 * rows and max(b for b, _ in margins) <= 4000


def test_margins_between_two_stores_fit_as_mllib(table):
    """Trees that look at one packed number or several, one to four of them since the margins were stored, and a store after them."""
    n = 2 * trees.RESTORE + 2
    want, [model] = _mllib("cost", n).fit(table), ml.fit_all(table, [("cost", None, None)], n)
    a, b = ([r[0] for r in m.transform(table).orderBy("id").select("pred_cost").collect()] for m in (want, model))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9)


def test_borders_read_the_features_once(spark):
    """Whatever the number of folds left out: sizes and draws need no features."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def counted(i):
        seen.add(1)
        return [float(i % 7), float(i)]

    t = spark.range(0, 12_000, 1, 3).select((F.col("id") % 5).cast("int").alias("fold"), F.col("id").cast("double").alias("cost"), counted("id").alias("a"))
    t = t.select("fold", "cost", trees.array_to_vector("a").alias("features"))
    borders, rows = trees._borders(t, [("cost", "fold", k) for k in range(5)])
    assert len(borders) == 5 and seen.value <= 12_000 and len(rows) == 5 * 9600
