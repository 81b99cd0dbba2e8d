"""Models as Spark jobs (M3-M6, S10): boosted regression on log1p targets,
balanced 5-class models with probabilities (softmax boosting, see
``softmax_boost``, or a forest), batch prediction, and per-row Shapley attribution.

Only bounded things reach the driver: class weights (<= 5 rows) and the node
table of a trained model (trees x nodes), which is broadcast to the tasks that
compute attributions in Arrow batches."""
from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.constants import N_CLASSES
from postcast.functions.labels import argmax, expected_score, from_log, log_target, reception_class
from postcast.operators.shapley import ROWS, Tree, shapley_values
from postcast.operators.softmax_boost import SoftmaxModel, fit_softmax  # noqa: F401
from postcast.operators.stats import with_class_weight
from postcast.session import scratch_path, ship_package

# boosting defaults (learning rate, row and feature fraction, depth ~ 63 leaves,
# rounds); depth-wise trees, so values differ from a leaf-wise learner
GBT_DEFAULTS = dict(stepSize=0.05, subsamplingRate=0.8, featureSubsetStrategy="0.8",
                    maxDepth=6, maxIter=500, seed=42)


PATIENCE = 50


def best_rounds(errors: list[float], patience: int) -> tuple[int, bool]:
    """(best number of rounds, settled): early stopping as a learner with
    ``patience`` does it, read off the validation errors by round.  Settled if
    ``patience`` rounds in a row did not improve on the best."""
    best = 0
    for i, e in enumerate(errors):
        if e < errors[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


POINTS = 1 << 27  # binned features of a partition


def few_partitions(rows: DataFrame, features: str) -> DataFrame:
    """A task for each core, more only where the binned features of a partition would be
    too many: every level of every tree sends the sums of its nodes from each partition,
    so what is shuffled grows with their number and not with the rows."""
    first = rows.select(features).first()
    if first is None:
        return rows
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.coalesce(max(cores, -(-rows.count() * len(first[0]) // POINTS)))


def fit_regressor(train: DataFrame, label: str, features: str = "features",
                  validation_col: str | None = None, patience: int = PATIENCE, **params):
    """M3: GBT on log1p(label), up to ``maxIter`` rounds.  With ``validation_col``
    the flagged rows are held out, and the rounds stop where ``patience`` rounds in
    a row did not improve their error; the best prefix is kept.

    MLlib itself stops at the first round that does not improve, so the rounds are
    grown here: fit, read the validation error of every prefix, and cut the trees
    behind the best prefix off the model.  Only where the error is not settled after
    the first rounds are more grown, twice as many each time."""
    from pyspark.ml.regression import GBTRegressor
    p = dict(GBT_DEFAULTS)
    p.update(params)
    data = train.withColumn("_y", log_target(label))

    def fit(rows: DataFrame, rounds: int):
        return GBTRegressor(featuresCol=features, labelCol="_y", **(p | {"maxIter": rounds})).fit(rows)
    if not validation_col:
        return fit(few_partitions(data, features), p["maxIter"])
    held, rows = data.filter(F.col(validation_col)), data.filter(~F.col(validation_col))
    rows = few_partitions(rows, features)
    if not held.take(1):
        return fit(rows, p["maxIter"])
    rounds = min(p["maxIter"], patience + 14)
    while True:
        model = fit(rows, rounds)
        best, settled = best_rounds(model.evaluateEachIteration(held, "squared"), patience)
        if settled or rounds == p["maxIter"]:
            return first_rounds(model, best)
        rounds = min(p["maxIter"], 2 * rounds)


def first_rounds(model, rounds: int):
    """The model of the first ``rounds`` trees of a boosted model."""
    from pyspark import SparkContext
    from pyspark.ml.regression import GBTRegressionModel
    if rounds >= model.getNumTrees:
        return model
    sc = SparkContext._active_spark_context
    regression = sc._jvm.org.apache.spark.ml.regression
    grown, kept = model._java_obj.trees(), sc._gateway.new_array(regression.DecisionTreeRegressionModel, rounds)
    weights = sc._gateway.new_array(sc._jvm.double, rounds)
    for n, w in enumerate(model.treeWeights[:rounds]):
        kept[n], weights[n] = grown[n], float(w)
    cut = GBTRegressionModel(regression.GBTRegressionModel(f"{model.uid}_first_{rounds}", kept, weights))
    cut._set(featuresCol=model.getFeaturesCol(), labelCol=model.getLabelCol(), predictionCol=model.getPredictionCol())
    cut._transfer_params_to_java()
    return cut


def predict_count(model, df: DataFrame, out: str) -> DataFrame:
    """M5: expm1 of the model output, clipped at 0."""
    pred_col = model.getPredictionCol()
    res = model.transform(df)
    return res.withColumn(out, from_log(F.col(pred_col))).drop(pred_col)


def fit_classifier(train: DataFrame, score: str, features: str = "features", **params):
    """M4: 5-class forest on the reception class of ``score`` with balanced
    class weights (joined by class id)."""
    from pyspark.ml.classification import RandomForestClassifier
    # the label is declared nominal with all 5 values, so the model always has 5
    # classes (a class absent from the training rows gets probability 0)
    meta = {"ml_attr": {"type": "nominal", "num_vals": N_CLASSES, "name": "_cls"}}
    cls = reception_class(score).cast("double").alias("_cls", metadata=meta)
    data = with_class_weight(train.withColumn("_cls", cls), "_cls", "_wt")
    p = dict(numTrees=50, maxDepth=6, seed=42, featureSubsetStrategy="sqrt")
    p.update(params)
    est = RandomForestClassifier(featuresCol=features, labelCol="_cls", weightCol="_wt", **p)
    return est.fit(few_partitions(data, features))


def predict_classes(model, df: DataFrame, prefix: str = "") -> DataFrame:
    """Probabilities as array<double>, arg-max class, expected score."""
    from pyspark.ml.functions import vector_to_array
    boosted = isinstance(model, SoftmaxModel)
    if boosted:
        res = model.probabilities(df, out=f"{prefix}probs")
    else:
        res = model.transform(df)
        res = res.withColumn(f"{prefix}probs", vector_to_array(F.col(model.getProbabilityCol())))
    res = res.withColumn(f"{prefix}predicted_class", argmax(f"{prefix}probs"))
    res = res.withColumn(f"{prefix}expected_score", expected_score(f"{prefix}probs"))
    if boosted:
        return res
    return res.drop(model.getProbabilityCol(), model.getRawPredictionCol(), model.getPredictionCol())


def save_model(model, path: str) -> None:
    """S10."""
    if isinstance(model, SoftmaxModel):
        from pyspark.sql import SparkSession
        return model.save(SparkSession.active(), path)
    model.write().overwrite().save(path)


def load_model(kind: str, path: str):
    """A saved ``regressor``, ``softmax`` or ``forest``; a missing path is an error."""
    from pyspark.sql import SparkSession

    from postcast.sources.items import _exists
    if not _exists(SparkSession.active(), path):  # asked through Hadoop, whatever the store
        raise FileNotFoundError(path)
    if kind == "regressor":
        from pyspark.ml.regression import GBTRegressionModel
        return GBTRegressionModel.load(path)
    if kind == "softmax":
        return SoftmaxModel.load(SparkSession.active(), path)
    from pyspark.ml.classification import RandomForestClassificationModel
    return RandomForestClassificationModel.load(path)


# ---- M6: Shapley attribution ------------------------------------------

_NODE_TABLES: dict = {}


def node_table(model, spark, name: str) -> tuple[pd.DataFrame, np.ndarray]:
    """All nodes of a tree ensemble (model-sized) plus the tree weights; read
    once per trained model (by uid) from the saved model's node data."""
    if model.uid in _NODE_TABLES:
        return _NODE_TABLES[model.uid]
    path = scratch_path(spark, f"models/{name}_{model.uid}")
    model.write().overwrite().save(path)
    nodes = (spark.read.parquet(os.path.join(path, "data"))
             .select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats",
                     "nodeData.leftChild", "nodeData.rightChild",
                     F.col("nodeData.split.featureIndex").alias("feature"),
                     F.try_element_at(F.col("nodeData.split.leftCategoriesOrThreshold"), F.lit(1)).alias("threshold"))
             .toPandas())
    _NODE_TABLES[model.uid] = (nodes, np.asarray(model.treeWeights, dtype=np.float64))
    return _NODE_TABLES[model.uid]


def _pack(nodes: pd.DataFrame, weights: np.ndarray, classes: int | None, scale: float) -> list[Tree]:
    """The ensemble's trees; the cover of a node is its (weighted) training rows."""
    trees = []
    for tid, g in nodes.groupby("treeID"):
        n = int(g["id"].max()) + 1
        ids = g["id"].to_numpy()
        stats = np.stack([np.asarray(s, dtype=np.float64) for s in g["impurityStats"]])
        cover = np.zeros(n)
        cover[ids] = stats[:, 0] if classes is None else stats.sum(axis=1)  # of a regression: rows, sum, sum of squares
        value = np.zeros(n) if classes is None else np.zeros((n, classes))
        value[ids] = g["prediction"].to_numpy() if classes is None else np.divide(
            stats, cover[ids][:, None], out=np.zeros_like(stats), where=cover[ids][:, None] > 0)
        columns = []
        for name, empty in (("leftChild", -1), ("rightChild", -1), ("feature", -1), ("threshold", 0.0)):
            c = np.full(n, empty, np.float64 if name == "threshold" else np.int64)
            c[ids] = g[name].fillna(empty).to_numpy()
            columns.append(c)
        trees.append(Tree(float(weights[int(tid)]) * scale, *columns, cover, value))
    return trees


def _top_rows(signed: np.ndarray, rank_by: np.ndarray, names: list[str], k: int) -> list:
    """W7 inside the task: per row the k largest ``rank_by`` (ties by position),
    reported with the signed value and its direction."""
    order = np.argsort(-rank_by, axis=1, kind="stable")[:, :k]
    out = []
    for r, idx in enumerate(order):
        out.append([{"feature": names[j], "importance": float(signed[r, j]),
                     "direction": "up" if signed[r, j] > 0 else "down"} for j in idx])
    return out


def in_parts(batches, rows: int = ROWS):
    """A few rows at a time: the values of a whole Arrow batch are features x classes
    numbers a row, several times over."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at:at + rows]


def shapley_attribution(model, df: DataFrame, features: str = "features", key: str = "id",
                     name: str = "explain", classifier: bool = False,
                     reduce_classes: bool = False, top_k: int | None = None,
                     names: list[str] | None = None) -> DataFrame:
    """Shapley values of a tree ensemble per row (see ``shapley``): sum(attribution) +
    base = raw prediction (log-score for the regressor, class probability for the
    forest, class margin before the softmax for the boosted classifier), and the base is the average over the training rows.  Runs in mapInPandas
    over Arrow batches with the node table broadcast.  ``reduce_classes`` (forest)
    returns the class means of |value| and value (A14) computed in the same task,
    instead of the per-class matrix.  ``top_k`` (with ``names``) returns only the
    top-k features per row (W7, computed in the task), so the wide attribution
    vectors never leave the executor."""
    from pyspark.ml.functions import vector_to_array
    spark = df.sparkSession
    ship_package(spark)
    classes = int(model.numClasses) if classifier else None
    start = 0.0
    if isinstance(model, SoftmaxModel):
        bc, start = spark.sparkContext.broadcast(model.shapley_trees()), model.start
    else:
        nodes, weights = node_table(model, spark, name)
        scale = 1.0 / len(weights) if classifier else 1.0
        bc = spark.sparkContext.broadcast(_pack(nodes, weights, classes, scale))
    src = df.select(F.col(key).alias("_k"), vector_to_array(F.col(features)).alias("_x"))
    if top_k is not None:
        schema = ("_k long, top array<struct<feature:string,importance:double,"
                  "direction:string>>")
    elif classifier and reduce_classes:
        schema = "_k long, mean_abs array<double>, mean_signed array<double>"
    elif classifier:
        schema = "_k long, attribution array<array<double>>, base array<double>"
    else:
        schema = "_k long, attribution array<double>, base double"

    def run(batches):
        trees = bc.value
        for pdf in in_parts(batches):
            x = np.stack(pdf["_x"].to_numpy()).astype(np.float64)
            contrib, base = shapley_values(trees, x, classes)
            base = base + start
            if top_k is not None:
                if classes is None:
                    signed, rank_by = contrib, np.abs(contrib)
                else:
                    signed, rank_by = contrib.mean(axis=1), np.abs(contrib).mean(axis=1)
                yield pd.DataFrame({"_k": pdf["_k"].astype("int64"),
                                    "top": _top_rows(signed, rank_by, names, top_k)})
            elif classes is None:
                yield pd.DataFrame({"_k": pdf["_k"].astype("int64"), "attribution": list(contrib),
                                    "base": float(base)})
            elif reduce_classes:
                yield pd.DataFrame({"_k": pdf["_k"].astype("int64"),
                                    "mean_abs": list(np.abs(contrib).mean(axis=1)),
                                    "mean_signed": list(contrib.mean(axis=1))})
            else:
                yield pd.DataFrame({"_k": pdf["_k"].astype("int64"),
                                    "attribution": [list(m) for m in contrib],
                                    "base": [list(base)] * len(pdf)})
    out = src.mapInPandas(run, schema)
    return out.withColumnRenamed("_k", key)
