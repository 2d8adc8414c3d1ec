"""MLlib jobs: feature table, splits, GBT regressors / classifier, model store, k-means vendor clusters,
cross-validation folds and evaluation tables.

Tree fits share passes over one stored feature table (``trees``); the evaluation
tables are plain aggregations (confusion counts, MAE, R^2) and therefore
SQL-checkable against any predictor's output.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cargolens.functions.ranking import grouped_row_number
from cargolens.operators import trees
from cargolens.session import ensure_checkpoint_dir

CATEGORICAL = ["delivery_partner", "package_type", "vehicle_type", "delivery_mode", "region", "weather_condition"]
NUMERIC = ["distance_km", "package_weight_kg", "delivery_rating"]
FEATURES = CATEGORICAL + NUMERIC
TREES = 100


def split_bucket(id_col: str = "delivery_id"):
    """Re-runnable 0..99 bucket from an arithmetic hash of the id."""
    return ((F.col(id_col) % 1000003) * 7919 + 13) % 100


def train_test_split(df: DataFrame, test_pct: int = 20, id_col: str = "delivery_id",
                     stratify: str | None = None, out: str = "is_test") -> DataFrame:
    """Adds ``is_test``.  Stratified: of each label's rows, in order of bucket and id, exactly the first ``test_pct`` %
    (rounded down) go to test.

    Counts by label and bucket say which bucket the cut falls into; only that bucket's rows are ranked, by a
    distributed rank, so no label's rows meet in one task.
    """
    b = split_bucket(id_col)
    if stratify is None:
        return df.withColumn(out, b < test_pct)
    counts = df.groupBy(F.col(stratify).alias("_label"), b.alias("_b")).agg(F.count(F.lit(1)).alias("_size"))
    label = Window.partitionBy("_label")
    before = F.coalesce(F.sum("_size").over(label.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.floor(F.sum("_size").over(label) * test_pct / 100) - before
    cut = counts.withColumn("_take", F.least(F.greatest(room, F.lit(0)), F.col("_size")))  # 100 rows a label
    rows = df.withColumn("_bucket", b).join(
        F.broadcast(cut), F.col("_bucket").eqNullSafe(F.col("_b")) & F.col(stratify).eqNullSafe(F.col("_label")), "left").drop("_b", "_label")
    split = (F.col("_take") > 0) & (F.col("_take") < F.col("_size"))
    whole = rows.where(~split).withColumn(out, F.col("_take") > 0)
    ranked = grouped_row_number(rows.where(split), stratify, [F.col(id_col)], out="_rank")
    return (whole.unionByName(ranked.withColumn(out, F.col("_rank") <= F.col("_take")).drop("_rank"))
            .drop("_bucket", "_size", "_take"))


def folds(df: DataFrame, k: int = 5, id_col: str = "delivery_id", stratify: str | None = None, out: str = "fold") -> DataFrame:
    """Adds a fold from 0 to k - 1; stratified: each label's rows, in order of bucket and id, go to the folds in turn."""
    if stratify is None:
        return df.withColumn(out, (split_bucket(id_col) % k).cast("int"))
    ranked = grouped_row_number(df, stratify, [split_bucket(id_col), F.col(id_col)], out="_rank")
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def feature_pipeline() -> list:
    """Index + one-hot the categoricals (unknown -> all zeros), scale the numerics, assemble."""
    idx = StringIndexer(inputCols=CATEGORICAL, outputCols=[c + "_idx" for c in CATEGORICAL], handleInvalid="keep")
    ohe = OneHotEncoder(inputCols=[c + "_idx" for c in CATEGORICAL], outputCols=[c + "_oh" for c in CATEGORICAL],
                        dropLast=True)  # the indexer's last category is "unknown": it gets no column
    num = VectorAssembler(inputCols=NUMERIC, outputCol="num_raw")
    scaler = StandardScaler(inputCol="num_raw", outputCol="num_scaled", withMean=True, withStd=True)
    asm = VectorAssembler(inputCols=["num_scaled"] + [c + "_oh" for c in CATEGORICAL], outputCol="features")
    return [idx, ohe, num, scaler, asm]


def feature_names(features: PipelineModel) -> list[str]:
    """The name of each entry of the assembled vector: the numerics, then column_value."""
    return NUMERIC + [f"{c}_{v}" for c, labels in zip(CATEGORICAL, features.stages[0].labelsArray, strict=True) for v in labels]


def with_labels(deliveries: DataFrame) -> DataFrame:
    from cargolens.sources import dims
    fac = F.coalesce(*[F.when(F.col("vehicle_type") == v, F.lit(g)) for v, g in dims.VEHICLE_GCO2_PER_KM],
                     F.lit(dims.DEFAULT_VEHICLE_GCO2_PER_KM))
    return deliveries.withColumns({
        "on_time_pct": F.when(F.col("delayed") == "no", 100.0).otherwise(0.0),
        "carbon_gco2": F.col("distance_km") * fac,
        "is_delayed": F.when(F.col("delayed") == "yes", 1.0).otherwise(0.0)})


def feature_table(df: DataFrame, train: Column, keep: list[str]) -> tuple[PipelineModel, DataFrame]:
    """The feature pipeline fitted on the training rows, and every row's ``keep`` columns with its features, stored once."""
    ensure_checkpoint_dir(df.sparkSession)
    model = Pipeline(stages=feature_pipeline()).fit(df.where(train))
    return model, model.transform(df).select(*keep, "features").checkpoint()


def fit_all(table: DataFrame, jobs: list[tuple[str, str | None, int | None]], max_iter: int = TREES) -> list:
    """One tree model for each (label, column, value left out); all grow in the same passes over the table with features."""
    return trees.fit_all(table, jobs, max_iter) if jobs else []


def fit_regressor(train: DataFrame, label: str, max_iter: int = TREES) -> PipelineModel:
    features, table = feature_table(train, F.lit(True), [label])
    return PipelineModel(features.stages + fit_all(table, [(label, None, None)], max_iter))


def fit_classifier(train: DataFrame, max_iter: int = TREES) -> PipelineModel:
    return fit_regressor(train, "is_delayed", max_iter)


def tree_scorer(model: PipelineModel) -> Callable:
    """A function of a pandas frame of delivery features that gives what the fitted pipeline predicts (a classifier: P(1)).

    It holds nothing but arrays, so it runs in tasks without a JVM; all rows walk down each tree together.
    """
    index, _, _, scaler, _, fitted = model.stages
    margins, classifier = fitted.scorer(), fitted.classifier
    mean, std = scaler.mean.toArray(), scaler.std.toArray()
    labels = [list(x) for x in index.labelsArray]
    numeric, categorical = list(NUMERIC), list(CATEGORICAL)

    def score(routes):
        import numpy as np

        parts = [(routes[numeric].to_numpy(float) - mean) / np.where(std > 0, std, 1.0) * (std > 0)]
        for c, known in zip(categorical, labels, strict=True):
            parts.append(routes[c].to_numpy()[:, None] == np.array(known, object)[None, :])
        out = margins(np.concatenate(parts, 1).astype(float))
        return 1 / (1 + np.exp(-2 * out)) if classifier else out

    return score


def fills(train: DataFrame) -> DataFrame:
    """One row: the training mean of each numeric and the mode of each categorical feature."""
    return train.agg(*[F.avg(c).alias(c) for c in NUMERIC], *[F.mode(c, True).alias(c) for c in CATEGORICAL])


def impute(df: DataFrame, fill: DataFrame) -> DataFrame:
    """Missing features take the fill row's values; a feature column that is not there at all counts as missing."""
    known = fill.select(*[F.col(c).alias("_f_" + c) for c in FEATURES])
    j = df.crossJoin(F.broadcast(known))  # one row
    kind = {c: "double" if c in NUMERIC else "string" for c in FEATURES}
    return j.withColumns({c: F.coalesce(F.col(c).cast(kind[c]), F.col("_f_" + c)) if c in df.columns else F.col("_f_" + c).cast(kind[c])
                          for c in FEATURES}).drop(*["_f_" + c for c in FEATURES])


def at_once(spark, *work: Callable) -> list:
    """The results of functions that run Spark jobs, each in a thread: many short jobs leave tasks' places free to one another."""
    with ThreadPoolExecutor(len(work)) as pool:
        return [r.result() for r in [pool.submit(inheritable_thread_target(spark)(w)) for w in work]]


class ModelStore:
    """Fitted pipelines with their training fills, in a folder that all machines share.

    An entry's name ends with a fingerprint of its training rows, so other data never get an older fit.
    """

    def __init__(self, spark, path: str | None = None):
        folder = ensure_checkpoint_dir(spark)
        self.spark, self.path = spark, path or f"{folder}/models"

    def _exists(self, at: str) -> bool:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{at}/_COMPLETE")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _holds(self, name: str) -> bool:
        """Whether any fit of that name is stored."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}-*")
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p))

    def key(self, name: str, train: DataFrame, columns: list[str]) -> str:
        """``name`` and a fingerprint of the training rows."""
        row = train.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*columns)).alias("x"),
                        F.sum(F.pmod(F.xxhash64(*columns), F.lit(1_000_000_007))).alias("s")).first()
        return f"{name}-{hashlib.sha256(repr((tuple(row), columns)).encode()).hexdigest()[:16]}"

    def save(self, key: str, model: PipelineModel, fill: DataFrame) -> None:
        at = f"{self.path}/{key}"
        model.write().overwrite().save(f"{at}/pipeline")
        fill.write.mode("overwrite").parquet(f"{at}/fills")
        self.spark.range(1).write.mode("overwrite").parquet(f"{at}/_COMPLETE")  # last: an entry without it is not used

    def load(self, key: str) -> tuple[PipelineModel, DataFrame]:
        at = f"{self.path}/{key}"
        return PipelineModel.load(f"{at}/pipeline"), self.spark.read.parquet(f"{at}/fills")

    def get(self, name: str, train: DataFrame, label: str, max_iter: int = TREES) -> tuple[PipelineModel, DataFrame]:
        """The stored model for these training rows, fitted and stored if there is none."""
        return self.get_all(name, train, [label], max_iter)[label]

    def get_all(self, name: str, train: DataFrame, labels: list[str], max_iter: int = TREES) -> dict[str, tuple[PipelineModel, DataFrame]]:
        columns, kept = sorted({*FEATURES, *labels}), not self._holds(name)
        if kept:  # a fit is to come, whatever the rows: they are worked out once, for the fingerprint too
            train = train.select(*columns).checkpoint()
        base = self.key(name, train, columns)
        keys = {x: f"{base}-{x}-{max_iter}-shared" for x in labels}
        missing = [x for x in labels if not self._exists(f"{self.path}/{keys[x]}")]
        if missing:
            train = train.select(*FEATURES, *missing) if kept else train.select(*FEATURES, *missing).checkpoint()  # read several times
            features, table = feature_table(train, F.lit(True), missing)
            fill = fills(train).checkpoint()
            models = fit_all(table, [(x, None, None) for x in missing], max_iter)
            at_once(self.spark, *[lambda x=x, m=m: self.save(keys[x], PipelineModel([*features.stages, m]), fill) for x, m in zip(missing, models, strict=True)])
        return {x: self.load(keys[x]) for x in labels}


CLUSTER_COLUMNS = ["avg_cost", "delay_rate", "avg_rating", "on_time_pct", "reliability_score"]


def vendor_kmeans(stats: DataFrame, k: int = 4, seeds: int = 10, key: str = "delivery_partner", rounds: int = 50) -> tuple[DataFrame, dict]:
    """Scaled k-means on the five vendor features; best of ``seeds`` starts (like n_init).

    All starts advance together: a round is one aggregation in which every task sums its points for each
    start's centres.  The first centres come from k-means++ sampling: of all points the one with the largest
    u ** (1 / d2), u a hash of the point's values and the start, d2 its squared distance to the centres so far, so
    that too is one aggregation a centre.  Returns the rows with ``features`` and ``cluster``, and the centres.
    """
    ensure_checkpoint_dir(stats.sparkSession)
    cols = CLUSTER_COLUMNS
    stats = stats.checkpoint()  # the fact is aggregated once, not for every round
    m = stats.agg(*[F.avg(c).alias("m_" + c) for c in cols], *[F.stddev_samp(c).alias("s_" + c) for c in cols]).first()
    scaled = stats.withColumn("_x", F.array(*[
        (F.col(c) - m["m_" + c]) / m["s_" + c] if m["s_" + c] else F.lit(0.0) for c in cols]))
    points = scaled.select(F.xxhash64("_x").alias("h"), "_x")

    def run(work: Callable) -> list:
        """Rows of small sums, from every task."""
        def task(batches):
            import numpy as np
            import pyarrow as pa

            parts = [(b.column(0).to_numpy(), b.column(1).flatten().to_numpy().reshape(-1, len(cols))) for b in batches if len(b)]
            if parts:
                h, x = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in work(h, x)], names=["start", "cluster", "rank", "n", "sums"])

        return points.mapInArrow(task, "start long, cluster long, rank double, n double, sums array<double>")

    def first(h, x, centres):
        """For each start the point that comes first in the sampling order."""
        import numpy as np

        out = []
        for s in range(seeds):
            d2 = np.ones(len(x)) if not centres[s] else ((x[:, None, :] - np.array(centres[s])[None]) ** 2).sum(2).min(1)
            mixed = (h.astype(np.uint64) ^ np.uint64((s + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xD6E8FEB86659FD93)
            u = ((mixed >> np.uint64(11)).astype(float) + 1) / (1 << 53)
            rank = np.where(d2 > 1e-18, np.log(u) / np.maximum(d2, 1e-18), -np.inf)
            i = int(np.lexsort((h, rank))[-1])
            out.append((s, len(centres[s]), float(rank[i]), 1.0, x[i].tolist()))
        return list(zip(*out, strict=True))

    centres: list[list[list[float]]] = [[] for _ in range(seeds)]
    for _ in range(k):
        found = run(lambda h, x, c=[list(z) for z in centres]: first(h, x, c))
        for r in found.groupBy("start").agg(F.max_by("sums", F.struct("rank", "sums")).alias("sums"), F.max("rank").alias("rank")).collect():
            if r["rank"] > -np.inf or not centres[r["start"]]:
                centres[r["start"]].append(list(r["sums"]))  # fewer different points than k: fewer centres

    def sums(h, x, centres):
        import numpy as np

        out = []
        for s, c in enumerate(centres):
            d2 = ((x[:, None, :] - np.array(c)[None]) ** 2).sum(2)
            own = d2.argmin(1)
            for j in range(len(c)):
                mine = own == j
                out.append((s, j, float(d2[mine, j].sum()), float(mine.sum()), x[mine].sum(0).tolist()))
        return list(zip(*out, strict=True))

    cost = [np.inf] * seeds
    for _ in range(rounds):
        got = run(lambda h, x, c=[list(z) for z in centres]: sums(h, x, c)).groupBy("start", "cluster").agg(
            F.sum("rank").alias("cost"), F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(len(cols))]).alias("sums")).collect()
        now = [sum(r["cost"] for r in got if r["start"] == s) for s in range(seeds)]  # seeds x k rows
        for r in got:
            if r["n"] > 0:
                centres[r["start"]][r["cluster"]] = [v / r["n"] for v in r["sums"]]
        if all(a - b <= 1e-12 * max(a, 1e-300) for a, b in zip(cost, now, strict=True) if np.isfinite(a)) and np.isfinite(cost).all():
            break
        cost = now
    best = sorted(centres[int(np.argmin(cost))])  # numbered by their first coordinate, whatever start won
    far = [sum(((F.col("_x")[i] - v) * (F.col("_x")[i] - v) for i, v in enumerate(c)), F.lit(0.0)) for c in best]
    nearest = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(j).alias("j")) for j, d in enumerate(far)]))["j"]
    out = scaled.withColumn("cluster", nearest).withColumn("features", array_to_vector("_x")).drop("_x")
    return out, {"centres": best, "cost": min(cost)}


def silhouette(clustered: DataFrame) -> float:
    return ClusteringEvaluator(featuresCol="features", predictionCol="cluster").evaluate(clustered)


def confusion(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """TN / FP / FN / TP in long form (all four cells, zero when empty)."""
    from cargolens.sources import dims
    cells = dims.local_table(pred.sparkSession, [(0, 0), (0, 1), (1, 0), (1, 1)], "a int, p int")
    counts = pred.groupBy(F.col(actual).cast("int").alias("a"), F.col(predicted).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("count"))
    return F.broadcast(cells).join(counts, ["a", "p"], "left").select(
        F.when(F.col("a") == 1, "Delayed").otherwise("On-Time").alias("actual"),
        F.when(F.col("p") == 1, "Delayed").otherwise("On-Time").alias("predicted"),
        F.coalesce("count", F.lit(0)).cast("long").alias("count"))


def to_array(c: str):
    return vector_to_array(F.col(c))
