"""Learning jobs: attribution additivity, classifier probabilities, backtest invariants."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postcast.operators import models as M
from postcast.operators.embed import encoder_embedding, hashing_embedding
from postcast.plans.jobs import Trained, backtest


def regression_data(spark, n=500, d=20):
    rng = np.random.default_rng(42)
    x = rng.standard_normal((n, d)).astype(np.float32)
    y = np.clip(10 * x[:, 0] + 5 * x[:, 1] + 2 * rng.standard_normal(n), 0, None)
    rows = [(i, Vectors.dense(x[i].tolist()), float(y[i]), bool(i >= 400)) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "features", "score", "is_validation"])


def test_regressor_and_attribution_additive(spark):
    df = regression_data(spark)
    model = M.fit_regressor(df, "score", validation_col="is_validation", maxIter=15, maxDepth=4)
    pred = model.transform(df).select("id", "prediction")
    attr = M.shapley_attribution(model, df, key="id", name="test_gbt")
    j = attr.join(pred, "id").toPandas()
    total = j["attribution"].apply(sum) + j["base"]
    assert np.allclose(total, j["prediction"], atol=1e-9)
    p = M.predict_count(model, df, "predicted").select("predicted").toPandas()["predicted"]
    assert (p >= 0).all()
    # the strongest feature is the one the target depends on most
    mean_abs = np.abs(np.stack(j["attribution"].to_numpy())).mean(axis=0)
    assert int(np.argmax(mean_abs)) == 0


def test_classifier_probabilities_and_attribution(spark):
    df = regression_data(spark, n=400, d=10).withColumn("score", F.col("score") * 20)
    model = M.fit_classifier(df, "score", numTrees=8, maxDepth=4)
    p = M.predict_classes(model, df).toPandas()
    assert np.allclose(p["probs"].apply(sum), 1.0)
    attr = M.shapley_attribution(model, df, key="id", name="test_rf", classifier=True).toPandas()
    j = attr.merge(p[["id", "probs"]], on="id")
    for a, b, pr in zip(j["attribution"], j["base"], j["probs"]):
        assert np.allclose(np.stack(list(a)).sum(axis=1) + np.asarray(b), pr, atol=1e-9)


@pytest.mark.parametrize("params", [dict(numTrees=8, maxDepth=4), dict(classifier="softmax", rounds=3, depth=2)])
def test_backtest_invariants(spark, params):
    df = regression_data(spark, n=500, d=10).withColumn("score", F.col("score") * 20)
    b = backtest(df, **params)
    s = b["summary"].first()
    conf = b["confusion"].toPandas()
    assert len(conf) == 25 and conf["n"].sum() == s["n_test"]
    assert 0.0 <= s["accuracy"] <= 1.0
    pr = b["per_class"].toPandas()
    assert ((pr["precision"] >= 0) & (pr["precision"] <= 1) & (pr["recall"] >= 0) & (pr["recall"] <= 1)).all()
    b2 = backtest(df, **params)
    assert b2["summary"].first()["accuracy"] == s["accuracy"]  # deterministic by seed


def test_two_encoders_in_one_worker(spark):
    df = spark.createDataFrame([(1, "a")], "id long, title string").coalesce(1)
    for value in (1.0, 2.0):
        make = lambda v=value: (lambda texts: np.full((len(texts), 3), v, np.float32))
        assert encoder_embedding(df, factory=make).first()["embedding"] == [value] * 3


def test_patience():
    assert M.best_rounds([5, 4, 3, 3.5, 3.6, 3.7], 3) == (3, True)
    assert M.best_rounds([5, 4, 3, 3.5, 2.9], 3) == (5, False)
    assert M.best_rounds([5, 6, 7, 4, 8, 9, 10, 3], 2) == (1, True)
    assert M.best_rounds([1.0], 50) == (1, False)


def test_early_stopping_keeps_the_best_prefix(spark):
    df = regression_data(spark, n=500, d=5)
    model = M.fit_regressor(df, "score", validation_col="is_validation", patience=4, maxIter=40, maxDepth=3)
    full = M.fit_regressor(df.filter("NOT is_validation"), "score", maxIter=40, maxDepth=3)
    held = df.filter("is_validation").withColumn("_y", F.log1p("score"))
    errors = full.evaluateEachIteration(held, "squared")
    best, _ = M.best_rounds(errors, 4)
    assert model.getNumTrees == best
    assert np.allclose(model.evaluateEachIteration(held, "squared"), errors[:best])


def test_embeddings(spark):
    def stand_in_encoder(dim=384):
        """Gaussian unit vector from a seed that the text gives."""
        import zlib

        def encode(texts):
            vecs = [np.random.default_rng(zlib.crc32(t.encode())).standard_normal(dim) for t in texts]
            return np.array([v / np.linalg.norm(v) for v in vecs], np.float32)
        return encode

    df = spark.createDataFrame([(1, "Rust is fast"), (2, "Rust is fast"), (3, "")], "id long, title string")
    h = {r["id"]: r["embedding"] for r in hashing_embedding(df).collect()}
    assert len(h[1]) == 384 and h[1] == h[2]
    assert abs(sum(v * v for v in h[1]) - 1.0) < 1e-5
    e = {r["id"]: r["embedding"] for r in encoder_embedding(df, factory=stand_in_encoder).collect()}
    assert len(e[1]) == 384 and e[1] == e[2] and abs(sum(v * v for v in e[3]) - 1.0) < 1e-5


def test_reduced_class_attribution(spark):
    df = regression_data(spark, n=200, d=6).withColumn("score", F.col("score") * 20)
    model = M.fit_classifier(df, "score", numTrees=4, maxDepth=3)
    full = M.shapley_attribution(model, df, key="id", name="t_full", classifier=True).toPandas()
    red = M.shapley_attribution(model, df, key="id", name="t_red", classifier=True,
                             reduce_classes=True).toPandas()
    j = full.merge(red, on="id")
    for a, ma, ms in zip(j["attribution"], j["mean_abs"], j["mean_signed"]):
        m = np.stack(list(a))
        assert np.allclose(np.abs(m).mean(axis=0), ma) and np.allclose(m.mean(axis=0), ms)


def test_model_save_load_and_missing(spark):
    import pytest
    from postcast.session import scratch_path
    df = regression_data(spark, n=120, d=4)
    m = M.fit_regressor(df, "score", maxIter=3, maxDepth=2)
    path = scratch_path(spark, "test_saved_gbt")
    M.save_model(m, path)
    back = M.load_model("regressor", path)
    a = m.transform(df).select("prediction").collect()
    b = back.transform(df).select("prediction").collect()
    assert a == b
    with pytest.raises(FileNotFoundError):
        M.load_model("regressor", scratch_path(spark, "no_such_model"))


def test_fill_invalid_and_assemble(spark):
    from postcast.operators.features import assemble, feature_names, fill_invalid
    from postcast.schema import STRUCTURAL_FEATURES
    vals = {c: 1.0 for c in STRUCTURAL_FEATURES}
    vals.update(title_length=None, text_length=float("nan"))
    ddl = "id long, " + ", ".join(f"{c} double" for c in STRUCTURAL_FEATURES) + ", embedding array<float>"
    df = spark.createDataFrame([tuple([1] + [vals[c] for c in STRUCTURAL_FEATURES] + [[0.5, 0.5]])], ddl)
    f = fill_invalid(df, STRUCTURAL_FEATURES).first()
    assert f["title_length"] == 0.0 and f["text_length"] == 0.0
    v = assemble(df).first()["features"]
    assert len(v) == 17 and not np.isnan(v.toArray()).any()
    assert feature_names(384)[0] == "title_length" and feature_names(384)[-1] == "emb_383"
    assert len(feature_names(384)) == 399


def test_classifier_always_has_five_classes(spark):
    df = regression_data(spark, n=200, d=4).withColumn("score", F.lit(5.0) + F.col("id") % 3)  # class 1 only
    model = M.fit_classifier(df, "score", numTrees=3, maxDepth=2)
    assert model.numClasses == 5
    p = M.predict_classes(model, df).first()
    assert len(p["probs"]) == 5 and p["predicted_class"] == 1


def test_top_k_in_task_equals_w7_operator(spark):
    from postcast.operators.explain import top_features
    df = regression_data(spark, n=150, d=8)
    model = M.fit_regressor(df, "score", maxIter=5, maxDepth=3)
    names = [f"f{i}" for i in range(8)]
    full = M.shapley_attribution(model, df, key="id", name="t_top_full")
    a = full.select("id", top_features(F.col("attribution"), names, 3).alias("t")).toPandas()
    b = M.shapley_attribution(model, df, key="id", name="t_top_task", top_k=3, names=names).toPandas()
    m = a.merge(b, on="id")
    for x, y in zip(m["t"], m["top"]):
        assert [(r["feature"], r["direction"]) for r in x] == [(r["feature"], r["direction"]) for r in y]
        assert np.allclose([r["importance"] for r in x], [r["importance"] for r in y])


def test_hashing_tokens_are_unicode_words(spark):
    df = spark.createDataFrame([(1, "Über Änderung"), (2, "über änderung")], "id long, title string")
    e = {r["id"]: r["embedding"] for r in hashing_embedding(df).collect()}
    assert e[1] == e[2] and sum(1 for v in e[1] if v != 0) == 2  # two whole words, case-folded


def test_models_are_made_when_they_are_asked_for():
    made = []

    def make(name):
        return lambda: made.append(name) or name.upper()
    t = Trained({"features": "F"}, {n: make(n) for n in ("a", "b", "c")}, 2)
    assert t["features"] == "F" and made == []
    assert t["b"] == "B" and t["b"] == "B" and made == ["b"]
    assert t.fit("a", "b", "c") is t and sorted(made) == ["a", "b", "c"] and dict(t) == \
        {"features": "F", "a": "A", "b": "B", "c": "C"}
    with pytest.raises(KeyError):
        t["d"]


def test_fits_read_a_task_for_each_core(spark, monkeypatch):
    cores = spark.sparkContext.defaultParallelism
    df = regression_data(spark).repartition(5 * cores)
    assert M.few_partitions(df, "features").rdd.getNumPartitions() == cores
    monkeypatch.setattr(M, "POINTS", 500 * 20 // (2 * cores))  # too many features for a partition of that few
    assert M.few_partitions(df, "features").rdd.getNumPartitions() == 2 * cores
    assert M.few_partitions(df.where("false"), "features").count() == 0
