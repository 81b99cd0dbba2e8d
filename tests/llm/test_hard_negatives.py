import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from postcast.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def made(seed, n, d=8, labels=4):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < .3:
            v = list(rng.choice(rows)[1])  # a copy
            if rng.random() < .5:
                v[rng.randrange(d)] += 0.01
        else:
            v = [rng.gauss(0, 1) for _ in range(d)]
        rows.append((i, [float(np.float32(x)) for x in v], rng.randrange(labels)))
    return rows


def brute(rows, every):
    seen = {}
    for i, v, label in rows:
        if None in (i, v, label) or any(x is None or not np.isfinite(x) for x in v):
            continue
        seen[i, label, tuple(int(np.floor(256 * float(x))) for x in v)] = True
    rows = list(seen)
    out = []
    for i, label, v in rows:
        if i % every:
            continue
        score = {n: sum(x * y for x, y in zip(v, w)) for n, (j, m, w) in enumerate(rows) if j != i}
        same = sorted((-s, rows[n][0]) for n, s in score.items() if rows[n][1] == label)[:5]
        rest = sorted((-s, rows[n][0]) for n, s in score.items() if rows[n][1] != label)
        for p, j in dict.fromkeys(same):
            fits = [(-s, m) for s, m in rest if 80 * -p <= 100 * -s <= 100 * -p][:5]
            out += [(i, j, k + 1, m, -p, s) for k, (s, m) in enumerate(fits)]
    return sorted(out)


def mined(df, every, **more):
    rows = H.quantised(df)
    got = H.hard_negatives(rows, rows.where(F.col("vec_id") % every == 0), **more)
    return sorted(tuple(r) for r in got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score",
                                               "negative_score").collect())


@pytest.mark.parametrize("seed,blocks", [(1, {}), (2, {"query_block": 7, "row_block": 23}), (3, {"row_block": 60})])
def test_equals_brute_force(spark, seed, blocks):
    rows = made(seed, 300)
    want = brute(rows, 10)
    assert want and mined(spark.createDataFrame(rows, SCHEMA), 10, **blocks) == want


def test_thresholds_change_nothing(spark):
    rows = made(4, 200, d=40)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows, 10)
    assert mined(df, 10, positive_steps=(), negative_steps=()) == want
    assert mined(df, 10, positive_steps=(0.9, 0.01), negative_steps=(0.99, 0.81)) == want


def test_join_equals_all_pairs():
    rng = np.random.default_rng(5)
    for d in (1, 16, 33, 70):
        y = np.floor(rng.normal(size=(500, d)) * 40 * rng.random(d))
        q = np.concatenate([y[:20], np.floor(rng.normal(size=(20, d)) * 40)])
        exact = q @ y.T
        for least in (np.full(40, -np.inf), np.full(40, 900.0), np.sort(exact, 1)[:, -7], (q * q).sum(1)):
            got = {(i, j): s for a, b, c in H.threshold_join(q, y, least) for i, j, s in zip(a, b, c)}
            assert got == {(i, j): exact[i, j] for i, j in zip(*np.nonzero(exact >= least[:, None]))}


def test_index_leaves_out_what_cannot_reach(monkeypatch):
    """Rows whose norm is too small are never scored."""
    y = np.concatenate([np.ones((50, 4)), np.full((50, 4), 100.0)])
    got = [s for _, b, s in H.threshold_join(np.ones((1, 4)), y, np.array([300.0]))]
    assert [len(s) for s in got] == [50]


def test_one_common_vector(spark):
    """A third of all rows is one vector, with every label."""
    rows = made(6, 200) + [(1000 + i, [1.0] * 8, i % 4) for i in range(100)]
    assert mined(spark.createDataFrame(rows, SCHEMA), 10) == brute(rows, 10)


def test_hard_rows(spark):
    v = [1.0, 2.0, -1.0]
    rows = [(0, v, 1), (0, v, 1), (10, None, 1), (20, [1.0, None, 2.0], 1), (30, [float("nan"), 1.0, 1.0], 2),
            (40, [float("inf"), 1.0, 1.0], 2), (None, v, 1), (50, v, None), (60, [], 2), (70, [0.0] * 3, 1), (71, v, 1),
            (72, [1.0, 2.0], 1), (73, [1.0, 2.0, -0.9], 2), (74, [-1.0, -2.0, 1.0], 1), (75, v, 2), (75, [1.0, 1.9, -1.0], 2),
            (80, [1e30, -1e30, 0.0], 1), (81, [1e30, -1e30, 0.0], 2)]
    rows = [(i, w if w is None else [None if x is None else float(np.float32(x)) for x in w], n) for i, w, n in rows]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"h": F.lit(1), "e": F.lit(2), "least": F.lit(3)})
    got = mined(df, 10)
    small = [r for r in rows if r[0] not in (80, 81)]
    assert [r for r in got if r[0] not in (80, 81)] != [] and {r[0] for r in got} <= {0, 60, 70, 80}
    assert mined(df.where("vec_id IS NULL OR vec_id < 80"), 10) == brute(small, 10)


def test_empty_table(spark):
    assert mined(spark.createDataFrame([], SCHEMA), 10) == []
    assert mined(spark.createDataFrame([(3, [1.0], 1)], SCHEMA), 10) == []
