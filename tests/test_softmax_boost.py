"""Softmax boosting: better than the forest on held-out rows, the same trees under any
partitioning, exact attributions, round trip."""
import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from postcast.constants import LOGLOSS_EPS
from postcast.operators import models as M
from postcast.operators.softmax_boost import GrownTree, softmax
from postcast.session import scratch_path

SMALL = dict(patience=3, depth=3, step=0.6, min_rows=5)


def labelled(spark, n=1500, d=6):
    """Scores that the features decide, with noise; every fifth row is held out."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((n, d))
    score = np.exp(2.5 + 1.4 * x[:, 0] - x[:, 1] * (x[:, 2] > 0) + 0.3 * rng.standard_normal(n)).astype(int)
    rows = [(i, Vectors.dense(x[i].tolist()), float(score[i]), i % 5 == 0) for i in range(n)]
    return spark.createDataFrame(rows, ["id", "features", "score", "is_validation"])


def log_loss(model, held):
    p = M.predict_classes(model, held).withColumn("_y", M.reception_class("score")).toPandas()
    probs = np.stack(p["probs"].to_numpy())
    assert np.allclose(probs.sum(axis=1), 1)
    return -np.log(np.clip(probs[np.arange(len(p)), p["_y"]], LOGLOSS_EPS, 1 - LOGLOSS_EPS)).mean()


@pytest.fixture(scope="module")
def fitted(spark):
    df = labelled(spark).cache()
    return df, M.fit_softmax(df, "score", validation_col="is_validation", **SMALL)


def test_held_out_loss(fitted):
    df, model = fitted
    held, train = df.filter("is_validation"), df.filter("not is_validation")
    loss = log_loss(model, held)
    assert abs(loss - min(model.losses[1:])) < 1e-5  # the measured loss is that of the kept prefix
    assert len(model.rounds) == 1 + int(np.argmin(model.losses[1:]))
    assert len(model.losses) == len(model.rounds) + 1 + SMALL["patience"]  # patience, then stop
    assert loss <= log_loss(M.fit_classifier(train, "score"), held)


def test_same_trees_under_any_partitioning(fitted):
    df, model = fitted
    other = M.fit_softmax(df.orderBy(F.rand(3)).repartition(7), "score", validation_col="is_validation", **SMALL)
    assert [[vars(t) for t in r] for r in other.rounds] == [[vars(t) for t in r] for r in model.rounds]


def test_a_round_against_sums_over_the_rows(spark):
    """The first tree of each class splits where plain sums over all rows say, and its
    leaves have their Newton steps."""
    df = labelled(spark, n=400, d=3)
    model = M.fit_softmax(df, "score", rounds=1, depth=1, step=0.25, row_share=1.0, feature_share=1.0, min_rows=10)
    rows = df.withColumn("y", M.reception_class("score")).toPandas()
    x, y = np.stack([v.toArray() for v in rows["features"]]), rows["y"].to_numpy()
    w = len(y) / (5 * np.bincount(y, minlength=5))[y]
    for c, tree in enumerate(model.rounds[0]):
        g, h = w * (0.2 - (y == c)), w * 0.2 * 0.8
        best = (-np.inf,)
        for f in range(3):
            edges = np.unique(np.quantile(np.unique(x[:, f]), np.arange(1, 32) / 32))
            for e in edges:
                left = x[:, f] <= e
                if min(left.sum(), (~left).sum()) >= 10:
                    gain = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
                    if gain > best[0] + 1e-6:
                        best = (gain, f, e, [-0.25 * g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])
        assert tree.feature[0] == best[1] and np.isclose(tree.threshold[0], best[2])
        assert np.allclose([tree.value[tree.left[0]], tree.value[tree.right[0]]], best[3], atol=1e-4)


def test_attribution_sums_to_the_margin(fitted):
    df, model = fitted
    rows = df.limit(40)
    a = M.shapley_attribution(model, rows, key="id", classifier=True).join(rows, "id").toPandas()
    x = np.stack([v.toArray() for v in a["features"]])
    total = np.stack([np.stack(list(m)).sum(axis=1) for m in a["attribution"]]) + np.stack(a["base"].to_numpy())
    assert np.allclose(total, model.margins(x), atol=1e-9)
    assert np.allclose(softmax(total).sum(axis=1), 1)


def test_round_trip(spark, fitted):
    df, model = fitted
    path = scratch_path(spark, "saved_softmax", unique=True)
    M.save_model(model, path)
    back = M.load_model("softmax", path)
    assert [[vars(t) for t in r] for r in back.rounds] == [[vars(t) for t in r] for r in model.rounds]
    a, b = (M.predict_classes(m, df).orderBy("id").select("probs").collect() for m in (model, back))
    assert a == b
    with pytest.raises(FileNotFoundError):
        M.load_model("softmax", scratch_path(spark, "no_such_softmax"))


def test_margins_written_between_rounds(spark, monkeypatch):
    """Rows written with their margins every other round give the same trees."""
    from postcast.operators import softmax_boost as B
    df = labelled(spark, n=300, d=3)
    few = dict(rounds=5, depth=2, min_rows=5)
    once = M.fit_softmax(df, "score", **few)
    monkeypatch.setattr(B, "WRITE_EVERY", 2)
    often = M.fit_softmax(df, "score", **few)
    assert [[vars(t) for t in r] for r in once.rounds] == [[vars(t) for t in r] for r in often.rounds]
    assert len(once.rounds) == 5 and all(t.cover[0] > 0 for r in once.rounds for t in r)


def test_missing_classes_and_rows(spark):
    one = labelled(spark, n=80, d=3).withColumn("score", F.lit(9.0))
    model = M.fit_softmax(one, "score", rounds=2)
    p = M.predict_classes(model, one).first()
    assert model.numClasses == 5 and len(p["probs"]) == 5 and p["predicted_class"] == 1 and p["probs"][1] > 0.999
    assert M.predict_classes(model, one.limit(0)).count() == 0
    with pytest.raises(ValueError):
        M.fit_softmax(one.limit(0), "score", rounds=2)


def test_rows_stop_at_the_same_node_by_bins():
    rng = np.random.default_rng(9)
    tree, open_ = GrownTree(), [0]
    for _ in range(12):
        node = open_.pop(int(rng.integers(len(open_))))
        open_ += tree.split(node, int(rng.integers(5)), int(rng.integers(8)), 0.0, (0.0, 0.0))
    x = rng.integers(0, 9, (300, 5)).astype(np.uint8)
    assert (tree.walk_bins(np.ascontiguousarray(x.T)) == tree.walk(x, tree.cut)).all()
    assert (GrownTree().walk_bins(np.ascontiguousarray(x.T)) == np.zeros(300)).all()


def test_sums_of_packed_rows_against_plain_sums():
    """The rows of a slot that is left out and those out of the bag count nowhere; a second
    pack adds to the first."""
    from postcast.operators.softmax_boost import UNIT, BinSums, bin_places
    rng = np.random.default_rng(3)
    bins, features, slots = 4, 6, 2
    sums, want = BinSums(slots, features, bins), np.zeros((3, slots, features, bins))
    for n in (50, 30):
        x = (rng.integers(0, bins, (features, n)) * (rng.random((features, n)) < 0.5)).astype(np.uint8)
        slot, use = rng.integers(0, slots + 1, n), rng.random(n) < 0.8
        slope, curve = np.rint(rng.standard_normal(n) * UNIT), np.rint(rng.random(n) * UNIT)
        sums.add(bin_places(x, use, bins), slot, use, slope, curve)
        for r in np.flatnonzero(use & (slot < slots)):
            for f in range(features):
                want[:, slot[r], f, x[f, r]] += (slope[r], curve[r], UNIT)
    assert (sums.get() == want).all()


def test_rows_are_packed_and_read_by_a_task_for_each_core(spark, monkeypatch):
    """A level sends the sums of its nodes from each task, however many partitions the rows
    come in; what is held out is read by the first pass of a round alone."""
    from postcast.operators import softmax_boost as B
    df = labelled(spark, n=900, d=3).repartition(40)
    written, passes = [], []
    write, level = B.write_rows, B.level_pass
    monkeypatch.setattr(B, "write_rows", lambda *a: written.append(write(*a)) or written[-1])
    monkeypatch.setattr(B, "level_pass", lambda *a: passes.append(a[-2:]) or level(*a))
    B.fit_softmax(df, "score", validation_col="is_validation", rounds=1, depth=2, min_rows=5)
    cores = spark.sparkContext.defaultParallelism
    packs = written[0].select("n", "held").collect()
    assert sum(p["n"] for p in packs) == 900 and sum(p["n"] for p in packs if p["held"]) == 180
    assert len(packs) <= 2 * cores
    assert passes[:2] == [(True, cores), (False, cores)]
