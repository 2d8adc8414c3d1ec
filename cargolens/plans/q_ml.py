"""Registered queries: MLlib fits (rows-only checks) and evaluation tables on the baseline predictor (SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cargolens.functions.exprs import late_flag, r6
from cargolens.operators import ml, quotes, trees, vendors
from cargolens.plans import q_choice
from cargolens.plans.catalog import query
from cargolens.plans.sqlkit import register
from cargolens.sources import dims, views

SPLIT_SQL = "((delivery_id % 1000003) * 7919 + 13) % 100"


def is_test():
    return ml.split_bucket() < 20



def _labeled(spark, sf):
    return ml.with_labels(views.deliveries(spark, sf, ["delivery_id", "delayed", "delivery_cost", *ml.FEATURES]))


@query("train_test_split", f"""
SELECT delivery_id, {SPLIT_SQL} < 20 AS is_test,
  row_number() OVER (PARTITION BY delayed ORDER BY {SPLIT_SQL}, delivery_id) <= (count(*) OVER (PARTITION BY delayed)) * 20 // 100 AS is_test_stratified
FROM deliveries""")
def q_train_test_split(spark, sf):
    d = ml.train_test_split(views.deliveries(spark, sf, ["delivery_id", "delayed"]))
    return ml.train_test_split(d, stratify="delayed", out="is_test_stratified").select("delivery_id", "is_test", "is_test_stratified")


@query("cross_validation_folds", f"""
SELECT delivery_id, CAST({SPLIT_SQL} % 5 AS INTEGER) AS fold,
  CAST((row_number() OVER (PARTITION BY delayed ORDER BY {SPLIT_SQL}, delivery_id) - 1) % 5 AS INTEGER) AS stratified_fold
FROM deliveries""")
def q_cross_validation_folds(spark, sf):
    d = ml.folds(views.deliveries(spark, sf, ["delivery_id", "delayed"]))
    return ml.folds(d, stratify="delayed", out="stratified_fold").select("delivery_id", "fold", "stratified_fold")


@query("feature_pipeline")
def q_feature_pipeline(spark, sf):
    from pyspark.ml import Pipeline
    d = _labeled(spark, sf)
    model = Pipeline(stages=ml.feature_pipeline()).fit(d)
    return model.transform(d).select("delivery_id", ml.to_array("features").alias("features"))


LABELS = ["delivery_cost", "carbon_gco2", "on_time_pct"]


def _regressors(spark, sf, labels):
    """Models of the plain split's training rows, from the store."""
    return ml.ModelStore(spark).get_all("deliveries", _labeled(spark, sf).where(~is_test()), labels)


def _delay_split(spark, sf):
    return ml.train_test_split(_labeled(spark, sf), stratify="is_delayed")


def _delay_classifier(spark, train):
    return ml.ModelStore(spark).get("deliveries", train, "is_delayed")[0]


@query("gbt_regressors")
def q_gbt_regressors(spark, sf):
    """The three regressors over the holdout; the features are worked out once for all."""
    models = _regressors(spark, sf, LABELS)
    test = _labeled(spark, sf).where(is_test())
    features, out = models[LABELS[0]][0].stages[:-1], test
    for stage in features:
        out = stage.transform(out)
    for x in LABELS:
        out = models[x][0].stages[-1].transform(out)
    return out.select("delivery_id", *["pred_" + x for x in LABELS])


@query("gbt_delay_classifier")
def q_gbt_delay_classifier(spark, sf):
    d = _delay_split(spark, sf)
    p = _delay_classifier(spark, d.where(~F.col("is_test"))).transform(d.where(F.col("is_test")))
    return p.select("delivery_id", "is_delayed", ml.to_array("probability")[1].alias("delay_probability"),
                    F.col("prediction").alias("predicted"))


@query("top_k_importance")
def q_top_k_importance(spark, sf):
    """The ten most important features of the delay classifier and of the on-time regressor."""
    delay, on_time = ml.at_once(spark, lambda: _delay_classifier(spark, _delay_split(spark, sf).where(~F.col("is_test"))),
                                lambda: _regressors(spark, sf, LABELS)["on_time_pct"][0])
    rows = []
    for name, model in (("delay", delay), ("on_time", on_time)):
        names = ml.feature_names(model)
        found = sorted(zip(model.stages[-1].featureImportances.toArray().tolist(), names, strict=True), key=lambda x: (-x[0], x[1]))
        rows += [(name, n[:25], v) for v, n in found[:10]]
    from cargolens.sources import dims
    return dims.local_table(spark, rows, "model string, feature string, importance double")


_FILLS = ", ".join([f"(SELECT avg({c}) FROM train) AS {c}" for c in ml.NUMERIC]
                   + [f"(SELECT {c} FROM train WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS {c}" for c in ml.CATEGORICAL])
register("imp_train", f"SELECT * FROM deliveries WHERE NOT ({SPLIT_SQL} < 20)")
_HELD = ["delivery_partner", "package_type", "vehicle_type", "delivery_mode", "weather_condition"]


@query("impute_and_score", f"""
WITH train AS (SELECT * FROM imp_train), f AS (SELECT {_FILLS})
SELECT s.shipment_id, {', '.join(f'coalesce(s.{c}, f.{c}) AS {c}' for c in _HELD)}, f.region,
  round(coalesce(s.distance_km, f.distance_km), 6) AS distance_km,
  round(coalesce(s.package_weight_kg, f.package_weight_kg), 6) AS package_weight_kg, round(f.delivery_rating, 6) AS delivery_rating
FROM shipments s CROSS JOIN f""")
def q_impute_and_score(spark, sf):
    """The nine features of every request as they are scored (the predictions: ``impute_and_score_predictions``)."""
    return _imputed(spark, sf, ml.fills(views.deliveries(spark, sf, ["delivery_id", *ml.FEATURES]).where(~is_test())))


def _imputed(spark, sf, fill):
    # Requests have no rating and no region: those two come from the training rows altogether.
    s = ml.impute(views.shipments(spark, sf, ["shipment_id", *_HELD, "distance_km", "package_weight_kg"]), fill)
    return s.select("shipment_id", *ml.CATEGORICAL, *[r6(c).alias(c) for c in ml.NUMERIC])


@query("impute_and_score_predictions")
def q_impute_and_score_predictions(spark, sf):
    """Cost, carbon and on-time percentage of every request by the stored models, features filled from their training rows."""
    models = _regressors(spark, sf, LABELS)
    out = _imputed(spark, sf, models[LABELS[0]][1])
    for stage in models[LABELS[0]][0].stages[:-1]:
        out = stage.transform(out)
    for x in LABELS:
        out = models[x][0].stages[-1].transform(out)
    return out.select("shipment_id", *[F.col("pred_" + x).alias("predicted_" + x) for x in LABELS])


def _partner_stats(spark, sf):
    return vendors.vendor_stats(views.deliveries(spark, sf, ["delivery_partner", "delivery_cost", "distance_km",
                                                             "delayed", "delivery_rating"]))


@query("vendor_kmeans")
def q_vendor_kmeans(spark, sf):
    out, _ = ml.vendor_kmeans(_partner_stats(spark, sf), k=4)
    return out.select("delivery_partner", "cluster")


@query("vendor_kmeans_by_vendor_id")
def q_vendor_kmeans_by_vendor_id(spark, sf):
    stats = vendors.vendor_stats(views.deliveries(spark, sf, ["vendor_id", "delivery_cost", "distance_km", "delayed",
                                                              "delivery_rating"]), key="vendor_id")
    out, _ = ml.vendor_kmeans(stats, k=4, key="vendor_id")
    return out.select("vendor_id", "cluster")


@query("vendor_silhouette")
def q_vendor_silhouette(spark, sf):
    out, _ = ml.vendor_kmeans(_partner_stats(spark, sf), k=4)
    from cargolens.sources import dims
    return dims.local_table(spark, [(float(ml.silhouette(out)),)], "silhouette double")


@query("option_fitted_clusters")
def q_option_fitted_clusters(spark, sf):
    """Every option with the fitted cluster of its partner and the cluster's type."""
    clustered = ml.vendor_kmeans(_partner_stats(spark, sf), k=4)[0].drop("features")
    profile = vendors.cluster_profiles(clustered).select("cluster", F.col("type").alias("cluster_type"))
    labels = clustered.select("delivery_partner", "cluster").join(profile, "cluster")
    e = q_choice._exploded(spark, sf, fields=["carrier_code", "delivery_partner"])
    # One row for each partner of the carriers: at most ten.
    return e.join(F.broadcast(labels.where(F.col("delivery_partner").isin(quotes.CARRIER_PARTNERS))), "delivery_partner", "left").select(
        "shipment_id", "carrier_code", "delivery_partner", "cluster", "cluster_type")


@query("cross_validation")
def q_cross_validation(spark, sf):
    """5-fold scores, mean and population deviation: cost and on-time regressors (folds by id), delay classifier (stratified)."""
    d = ml.folds(ml.folds(_labeled(spark, sf)), stratify="is_delayed", out="stratified")
    _, table = ml.feature_table(d, F.lit(True), ["fold", "stratified", "delivery_cost", "on_time_pct", "is_delayed"])
    runs = [(x, by, k) for x, by in (("delivery_cost", "fold"), ("on_time_pct", "fold"), ("is_delayed", "stratified")) for k in range(5)]
    scored = trees.predict_left_out(table, runs, ml.fit_all(table, runs))
    kinds = dict.fromkeys((x, by) for x, by, _ in runs)
    rows = scored.select(F.inline(F.array(*[F.struct(F.lit(x).alias("label"), F.col(by).alias("k"), F.col(x).alias("y"), F.col("pred_" + x).alias("p"))
                                            for x, by in kinds])))
    y, p, e, classed = F.col("y"), F.col("p"), F.col("y") - F.col("p"), F.col("label") == "is_delayed"
    hit = F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0))
    named = F.sum(F.when(p == 1, 1).otherwise(0)) + F.sum(F.when(y == 1, 1).otherwise(0))
    # n * var_pop is the sum of squares around the fold's mean: one pass, partial sums.
    found = rows.groupBy("label", "k").agg((1 - F.try_divide(F.sum(e * e), F.count(y) * F.var_pop(y))).alias("r2"), F.avg(F.abs(e)).alias("mae"),
                                           F.try_divide(2 * hit, named).alias("f1"))
    every = dims.local_table(spark, [(x, k) for x, _, k in runs], "label string, k int")  # a fold may have no rows
    scores = every.join(F.broadcast(found), ["label", "k"], "left").select(
        "label", F.when(~classed, F.col("r2")).alias("r2"), F.when(~classed, F.col("mae")).alias("mae"),
        F.when(classed, F.coalesce("f1", F.lit(0.0))).alias("f1"))
    return scores.groupBy("label").agg(*[f(c).alias(f"{c}_{n}") for c in ("r2", "mae", "f1") for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))])


LATE = "CASE WHEN delayed = 'yes' THEN 1 ELSE 0 END"
register("base_pred", f"""
SELECT d.delivery_id, CASE WHEN d.delayed = 'yes' THEN 1 ELSE 0 END AS actual,
  CASE WHEN 2 * h.late >= h.n THEN 1 ELSE 0 END AS predicted
FROM deliveries d JOIN hist_rates h USING (delivery_partner, weather_condition)
WHERE {SPLIT_SQL} < 20""")
register("confusion_long", """
SELECT CASE WHEN c.a = 1 THEN 'Delayed' ELSE 'On-Time' END AS actual,
       CASE WHEN c.p = 1 THEN 'Delayed' ELSE 'On-Time' END AS predicted,
       CAST(coalesce(x.n, 0) AS BIGINT) AS count
FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(a, p)
LEFT JOIN (SELECT actual AS a, predicted AS p, count(*) AS n FROM base_pred GROUP BY ALL) x USING (a, p)""")


def _baseline_pred(spark, sf):
    d = views.deliveries(spark, sf, ["delivery_id", "delivery_partner", "weather_condition", "delayed"])
    h = d.groupBy("delivery_partner", "weather_condition").agg(F.count(F.lit(1)).alias("n"),
                                                               F.sum(late_flag()).alias("late"))
    t = ml.train_test_split(d).where(F.col("is_test"))
    j = t.join(F.broadcast(h), ["delivery_partner", "weather_condition"])
    return j.select("delivery_id", late_flag().alias("actual"),
                    F.when(2 * F.col("late") >= F.col("n"), 1).otherwise(0).alias("predicted"))


@query("confusion_matrix", "SELECT * FROM confusion_long")
def q_confusion_matrix(spark, sf):
    return ml.confusion(_baseline_pred(spark, sf))


@query("classification_report", """
WITH c AS (SELECT sum(CASE WHEN actual = 'On-Time' AND predicted = 'On-Time' THEN count END) AS tn,
                  sum(CASE WHEN actual = 'On-Time' AND predicted = 'Delayed' THEN count END) AS fp,
                  sum(CASE WHEN actual = 'Delayed' AND predicted = 'On-Time' THEN count END) AS fn,
                  sum(CASE WHEN actual = 'Delayed' AND predicted = 'Delayed' THEN count END) AS tp FROM confusion_long),
     k AS (SELECT 'Delayed' AS label, tp AS hit, tp + fp AS npred, tp + fn AS support, tn + fp + fn + tp AS total FROM c
           UNION ALL SELECT 'On-Time', tn, tn + fn, tn + fp, tn + fp + fn + tp FROM c),
     m AS (SELECT label, CASE WHEN npred > 0 THEN hit / npred ELSE 0.0 END AS precision,
             CASE WHEN support > 0 THEN hit / support ELSE 0.0 END AS recall, support, total FROM k),
     f AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM f
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
                 round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, round((SELECT (tp + tn) / (tn + fp + fn + tp) FROM c), 6), CAST(sum(support) AS BIGINT) FROM f""")
def q_classification_report(spark, sf):
    c = ml.confusion(_baseline_pred(spark, sf))
    cnt = lambda a, p: F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("count")))
    w = c.agg(cnt("On-Time", "On-Time").alias("tn"), cnt("On-Time", "Delayed").alias("fp"),
              cnt("Delayed", "On-Time").alias("fn"), cnt("Delayed", "Delayed").alias("tp"))
    k = w.select(F.expr("stack(2, 'Delayed', tp, tp + fp, tp + fn, 'On-Time', tn, tn + fn, tn + fp) AS (label, hit, npred, support)"),
                 (F.col("tp") + F.col("tn")).alias("ok"), (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).alias("total"))
    m = k.select("label", "support", "ok", "total",
                 F.when(F.col("npred") > 0, F.col("hit") / F.col("npred")).otherwise(0.0).alias("precision"),
                 F.when(F.col("support") > 0, F.col("hit") / F.col("support")).otherwise(0.0).alias("recall"))
    f = m.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                  2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
                     .otherwise(0.0))
    per = f.select("label", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"),
                   F.col("support").cast("long").alias("support"))
    s = F.sum("support")
    macro = f.agg(F.lit("macro avg").alias("label"), r6(F.avg("precision")).alias("precision"),
                  r6(F.avg("recall")).alias("recall"), r6(F.avg("f1")).alias("f1"), s.cast("long").alias("support"))
    weighted = f.agg(F.lit("weighted avg").alias("label"), r6(F.sum(F.col("precision") * F.col("support")) / s).alias("precision"),
                     r6(F.sum(F.col("recall") * F.col("support")) / s).alias("recall"),
                     r6(F.sum(F.col("f1") * F.col("support")) / s).alias("f1"), s.cast("long").alias("support"))
    acc = f.agg(F.lit("accuracy").alias("label"), F.lit(None).cast("double").alias("precision"),
                F.lit(None).cast("double").alias("recall"), r6(F.first("ok") / F.first("total")).alias("f1"),
                s.cast("long").alias("support"))
    return per.unionByName(macro).unionByName(weighted).unionByName(acc)


@query("regression_report", f"""
WITH t AS (SELECT d.delivery_cost AS y, (100 + 3 * d.distance_km) + 5 * d.package_weight_kg AS p,
             CASE WHEN d.delayed = 'no' THEN 100.0 ELSE 0.0 END::DOUBLE AS oy, 100 * (1 - h.late / h.n) AS op
           FROM deliveries d JOIN hist_rates h USING (delivery_partner, weather_condition) WHERE {SPLIT_SQL} < 20)
SELECT 'delivery_cost' AS target, round(1 - sum((y - p) * (y - p)) / sum((y - my) * (y - my)), 6) AS r2,
       round(avg(abs(y - p)), 6) AS mae FROM t, (SELECT avg(y) AS my FROM t) m
UNION ALL
SELECT 'on_time_pct', round(1 - sum((oy - op) * (oy - op)) / sum((oy - mo) * (oy - mo)), 6), round(avg(abs(oy - op)), 6)
FROM t, (SELECT avg(oy) AS mo FROM t) m""")
def q_regression_report(spark, sf):
    d = views.deliveries(spark, sf, ["delivery_id", "delivery_partner", "weather_condition", "delayed", "delivery_cost",
                                     "distance_km", "package_weight_kg"])
    h = d.groupBy("delivery_partner", "weather_condition").agg(F.count(F.lit(1)).alias("n"),
                                                               F.sum(late_flag()).alias("late"))
    t = ml.train_test_split(d).where(F.col("is_test")).join(F.broadcast(h), ["delivery_partner", "weather_condition"])
    t = t.select((F.col("delivery_cost")).alias("y"),
                 ((100 + 3 * F.col("distance_km")) + 5 * F.col("package_weight_kg")).alias("p"),
                 F.when(F.col("delayed") == "no", 100.0).otherwise(0.0).alias("oy"),
                 (100 * (1 - F.col("late") / F.col("n"))).alias("op"))
    means = F.broadcast(t.agg(F.avg("y").alias("my"), F.avg("oy").alias("mo")))
    j = t.crossJoin(means)
    a = j.agg((1 - F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
               / F.sum((F.col("y") - F.col("my")) * (F.col("y") - F.col("my")))).alias("r2c"),
              F.avg(F.abs(F.col("y") - F.col("p"))).alias("maec"),
              (1 - F.sum((F.col("oy") - F.col("op")) * (F.col("oy") - F.col("op")))
               / F.sum((F.col("oy") - F.col("mo")) * (F.col("oy") - F.col("mo")))).alias("r2o"),
              F.avg(F.abs(F.col("oy") - F.col("op"))).alias("maeo"))
    return a.select(F.expr("stack(2, 'delivery_cost', round(r2c, 6), round(maec, 6), 'on_time_pct', round(r2o, 6), round(maeo, 6)) AS (target, r2, mae)"))
