import itertools
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from postcast.operators import models as M
from postcast.operators.shapley import Tree, cases, shapley_values
from tests.test_models import regression_data


def grown(rng, depth, d, classes=None, weight=1.0):
    """A random tree, whose features may come again on a path."""
    nodes = []

    def grow(level, rows):
        at = len(nodes)
        nodes.append(None)
        if level == 0 or rows < 2 or rng.random() < .15:
            nodes[at] = (-1, -1, -1, 0.0, rows, rng.normal(size=classes) if classes else rng.normal())
            return at
        go = rng.integers(1, rows)
        feature, cut = int(rng.integers(d)), rng.normal()
        nodes[at] = (grow(level - 1, go), grow(level - 1, rows - go), feature, cut, rows,
                     np.zeros(classes) if classes else 0.0)
        return at
    grow(depth, 1000)
    return Tree(weight, *(np.array(c) for c in zip(*nodes)))


def known(tree, x, some, node=0):
    """Expected value of the tree where only the features in ``some`` are known."""
    if tree.left[node] < 0:
        return tree.weight * tree.value[node]
    left, right = tree.left[node], tree.right[node]
    if tree.feature[node] in some:
        return known(tree, x, some, left if x[tree.feature[node]] <= tree.threshold[node] else right)
    part = tree.cover[left] / tree.cover[node]
    return part * known(tree, x, some, left) + (1 - part) * known(tree, x, some, right)


def brute(trees, x):
    d = len(x)
    out = []
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        total = 0.0
        for k in range(d):
            for some in itertools.combinations(rest, k):
                w = factorial(k) * factorial(d - k - 1) / factorial(d)
                total = total + w * sum(known(t, x, {*some, i}) - known(t, x, set(some)) for t in trees)
        out.append(total)
    return np.array(out)


@pytest.mark.parametrize("seed,classes", [(1, None), (2, None), (3, 3)])
def test_equals_all_subsets(seed, classes):
    rng = np.random.default_rng(seed)
    trees = [grown(rng, 5, 5, classes, w) for w in (1.0, 0.3, -0.7)]
    x = rng.normal(size=(12, 5))
    values, base = shapley_values(trees, x, classes)
    for row, got in zip(x, values):
        want = brute(trees, row)
        assert np.allclose(got.T if classes else got, want)
        assert np.allclose(got.sum(-1) + base, sum(known(t, row, range(5)) for t in trees))


def test_single_leaf_and_wide_paths():
    """A tree without a split has its value as the base; paths with more features than
    are tabulated give the same."""
    rng = np.random.default_rng(4)
    stump = Tree(2.0, [-1], [-1], [-1], [0.0], [10.0], [0.5])
    values, base = shapley_values([stump], rng.normal(size=(3, 2)))
    assert base == 1.0 and not values.any()
    n = 13  # a chain of 13 features
    left = [2 * i + 1 if i < n else -1 for i in range(n + 1)]
    tree = {"left": [], "right": [], "feature": [], "threshold": [], "cover": [], "value": []}
    for i in range(n):
        for k, v in zip(tree, (2 * i + 1, 2 * i + 2, i, 0.0, 2.0 ** (n - i), 0.0)):
            tree[k].append(v)
        for k, v in zip(tree, (-1, -1, -1, 0.0, 2.0 ** (n - i - 1), float(i))):
            tree[k].append(v)
    for k, v in zip(tree, (-1, -1, -1, 0.0, 1.0, 5.0)):
        tree[k].append(v)
    assert len(left) == n + 1
    chain = Tree(1.0, **tree)
    x = np.where(np.arange(n) < np.arange(n + 1)[:, None], 1.0, -1.0)
    values, base = shapley_values([chain], x)
    want = [known(chain, r, range(n)) for r in x]
    assert np.allclose(values.sum(1) + base, want)


def test_cases_sum_to_the_difference():
    """Over all features, the factors sum to prod o - prod z."""
    z = np.random.default_rng(5).random((4, 6))
    o = (np.arange(64)[:, None] >> np.arange(6) & 1).astype(float)
    assert np.allclose(cases(z, o).sum(2), o.prod(1)[None] - z.prod(1)[:, None])


def test_models_equal_all_subsets(spark):
    df = regression_data(spark, n=300, d=4)
    x = np.array([r["features"].toArray() for r in df.orderBy("id").limit(5).collect()])
    model = M.fit_regressor(df, "score", maxIter=4, maxDepth=3)
    nodes, weights = M.node_table(model, spark, "shap_gbt")
    trees = M._pack(nodes, weights, None, 1.0)
    got = M.shapley_attribution(model, df, key="id", name="shap_gbt").orderBy("id").limit(5).collect()
    for row, g in zip(x, got):
        assert np.allclose(g["attribution"], brute(trees, row))
    forest = M.fit_classifier(df.withColumn("score", F.col("score") * 20), "score", numTrees=3, maxDepth=3)
    nodes, weights = M.node_table(forest, spark, "shap_forest")
    trees = M._pack(nodes, weights, 5, 1.0 / len(weights))
    got = M.shapley_attribution(forest, df, key="id", name="shap_forest", classifier=True).orderBy("id").limit(5).collect()
    probs = M.predict_classes(forest, df).orderBy("id").limit(5).collect()
    for row, g, p in zip(x, got, probs):
        a = np.array([list(v) for v in g["attribution"]])
        assert np.allclose(a.T, brute(trees, row)) and np.allclose(a.sum(1) + np.array(g["base"]), p["probs"])


def test_tables_of_cases_are_made_once_for_all_rows(monkeypatch):
    rng = np.random.default_rng(6)
    trees, x = [grown(rng, 5, 9, 3) for _ in range(4)], rng.normal(size=(70, 9))
    whole, base = shapley_values(trees, x, 3)
    monkeypatch.setattr("postcast.operators.shapley.cases", None)
    for at in range(0, 70, 20):
        part, again = shapley_values(trees, x[at:at + 20], 3)
        assert (part == whole[at:at + 20]).all() and (again == base).all()


def test_attribution_takes_a_few_rows_at_a_time():
    batches = [pd.DataFrame({"_k": range(7)}), pd.DataFrame({"_k": []}), pd.DataFrame({"_k": range(3)})]
    assert [len(p) for p in M.in_parts(iter(batches), 3)] == [3, 3, 1, 3]
    assert [k for p in M.in_parts(iter(batches), 3) for k in p["_k"]] == [*range(7), *range(3)]
