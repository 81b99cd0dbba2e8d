"""Variant ranking, the optimisation trace against a plain loop, splits, parsing, reports."""
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postcast.functions.parse import comment_items, suggestion_items
from postcast.operators import ranking as R
from postcast.operators import splits as SP
from postcast.operators.explain import explanation_text, mean_over_classes, top_features


def test_rank_variants_stable(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, 1, 9.0), (1, 2, 5.0), (2, 0, 1.0)],
                               "pitch long, idx long, score double")
    r = {(x["pitch"], x["idx"]): x["rank"] for x in R.rank_variants(df, "pitch", "idx", "score").collect()}
    assert r == {(1, 1): 1, (1, 0): 2, (1, 2): 3, (2, 0): 1}


def loop(orig_title, s0, rounds, max_iter=5, min_gain=2.0):
    """Plain re-statement of the optimisation loop (per pitch): a round without
    unseen suggestions, also an absent one, ends it."""
    seen, best, title, run = {orig_title}, s0, orig_title, 0
    for rnd in range(1, max_iter + 1):
        run += 1
        fresh = [(t, s) for t, s in rounds.get(rnd, []) if t not in seen]
        seen.update(t for t, _ in fresh)
        if not fresh:
            break
        top = max(s for _, s in fresh)
        if top <= best or top - best < min_gain:
            break
        best, title = top, min(t for t, s in fresh if s == top)
    return run, title, best, best - s0


def test_optimise_trace_matches_loop(spark):
    rng = np.random.default_rng(5)
    v, o, expect = [], [], {}
    for p in range(90):
        t0 = f"t{rng.integers(0, 6)}"
        s0 = float(rng.integers(0, 20))
        o.append((p, t0, s0))
        rounds = {}
        for rnd in range(1, int(rng.integers(1, 8))):
            if rng.random() < 0.2:
                continue  # a gap
            rounds[rnd] = [(f"t{rng.integers(0, 9)}", float(rng.integers(0, 60))) for _ in range(3)]
        for rnd, items in rounds.items():
            v += [(p, rnd, t, s) for t, s in items]
        expect[p] = loop(t0, s0, rounds)
    assert any(not any(x[0] == p for x in v) for p in expect)  # some pitch has no suggestion at all
    vdf = spark.createDataFrame(v, "pitch long, rnd long, title string, score double")
    odf = spark.createDataFrame(o, "pitch long, title0 string, s0 double")
    got = {r["pitch"]: (r["rounds_run"], r["best_title"], r["best_score"], r["total_gain"])
           for r in R.optimise_trace(vdf, odf).collect()}
    assert got == expect


def test_reports(spark):
    df = spark.createDataFrame([(1, 0, "A", 12.25, "low"), (1, 1, "B", 30.0, "moderate")],
                               "pitch long, idx long, title string, score double, label string")
    r = R.rank_variants(df, "pitch", "idx", "score")
    ex = R.best_explanation(r, "pitch", "title", "score", "label").first()["explanation"]
    assert ex == "'B' is predicted to perform best (score: 30.0, label: moderate)."
    lines = [x["line"] for x in R.ranked_lines(r, "pitch", "title", "score", "label").orderBy("rank").collect()]
    assert lines[0] == '1. "B" — score: 30.0, label: moderate' and lines[1].startswith('2. "A" — score: 12.')
    tried = R.tried_list(df, "pitch", "title").first()["tried"]
    assert tried == '"A", "B"'


def test_temporal_split(spark, stories_df):
    s = SP.temporal_split(stories_df, "time", "2023-01-01").groupBy("is_validation").count().collect()
    assert {r["is_validation"]: r["count"] for r in s} == {False: 2, True: 5}


def test_hash_split_exact_and_stable(spark):
    df = spark.range(20000).withColumnRenamed("id", "id")
    a = SP.hash_split(df, "id")
    assert a.filter("is_test").count() == 4000  # int(n * 0.2), as a seeded permutation gives
    b = SP.hash_split(df.repartition(13), "id")
    assert a.filter("is_test").select("id").subtract(b.filter("is_test").select("id")).count() == 0
    approx = SP.hash_split(df, "id", exact=False).filter("is_test").count() / 20000
    assert abs(approx - 0.2) < 0.02


def test_validation_tail_sizes(spark):
    df = SP.hash_split(spark.range(1000).withColumnRenamed("id", "id"), "id")
    v = SP.validation_tail(df, "id")
    assert v.filter("is_validation").count() == 80  # int(800 * 0.1)
    assert v.filter("is_validation AND is_test").count() == 0
    small = SP.hash_split(spark.range(20).withColumnRenamed("id", "id"), "id")
    assert SP.validation_tail(small, "id").filter("is_validation").count() == 5  # at least 5 rows


def test_parse_responses(spark):
    texts = ['[{"username": "a", "comment": "x", "tone": "y"}, {"username": "b"}]',
             'Sure:\n```json\n[{"username": "c", "comment": "z"}]\n```',
             "not json", '{"username": "d", "comment": "w"}', '[{"username": "e", "comment": null}]']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [[m["username"] for m in r[0]] for r in df.select(comment_items(F.col("t"))).collect()]
    assert got == [["a"], ["c"], [], [], ["e"]]
    s = spark.createDataFrame([('[{"title": "T", "description": "D"}, {"description": "x"}]',),
                               ('```json\n[{"title": "fenced"}]\n```',), ("nope",)], "t string")
    got = [[m["title"] for m in r[0]] for r in s.select(suggestion_items(F.col("t"))).collect()]
    assert got == [["T"], [], []]


def test_attribution_topk(spark):
    df = spark.createDataFrame([([0.1, -0.5, 0.3, 0.0],)], "v array<double>")
    names = ["struct_0", "struct_1", "emb_0", "emb_1"]
    top = df.select(top_features(F.col("v"), names, k=2).alias("t")).first()["t"]
    assert [(t["feature"], t["direction"]) for t in top] == [("struct_1", "down"), ("emb_0", "up")]
    allow = df.select(top_features(F.col("v"), names, k=5, allow=["struct_0", "struct_1"]).alias("t")).first()["t"]
    assert [t["feature"] for t in allow] == ["struct_1", "struct_0"]
    txt = df.select(explanation_text(top_features(F.col("v"), names, k=1)).alias("s")).first()["s"]
    assert txt == "  ↓ struct_1 (-0.50)"
    pc = spark.createDataFrame([([[1.0, -2.0], [3.0, 2.0]],)], "a array<array<double>>")
    mabs, msigned = mean_over_classes(F.col("a"))
    r = pc.select(mabs.alias("m"), msigned.alias("s")).first()
    assert r["m"] == [2.0, 2.0] and r["s"] == [2.0, 0.0]


def test_rank_variants_of_a_hot_pitch(spark):
    rng = np.random.default_rng(11)
    n = 2000
    pitch = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 40, n))  # one hot pitch
    pdf = pd.DataFrame({"pitch": pitch, "idx": np.arange(n), "score": rng.integers(0, 50, n).astype(float)})
    df = spark.createDataFrame(pdf)
    a = R.rank_variants(df, "pitch", "idx", "score").toPandas()
    assert len(a) == n
    exp = pdf.sort_values(["pitch", "score", "idx"], ascending=[True, False, True])
    exp["rank"] = exp.groupby("pitch").cumcount() + 1
    assert (a.set_index("idx")["rank"].sort_index() == exp.set_index("idx")["rank"].sort_index()).all()


def test_every_text_comes_in_every_kind_of_reply(spark, tmp_path):
    from postcast.plans.queries import REGISTRY
    rows = [(c, t, "user", f"words {c} {t}") for c in (1, 2) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(
        str(tmp_path / "conversations.parquet"))
    said = REGISTRY["parse_responses"](spark, str(tmp_path)).collect()
    assert sorted((r["conv_id"], r["turn"], r["reply"]) for r in said) == \
        [(c, t, k) for c, t, _, _ in rows for k in range(4)]
    assert all(r["comment"] == f"words {r['conv_id']} {r['turn']}" for r in said)
    asked = REGISTRY["parse_suggestions"](spark, str(tmp_path)).collect()
    assert sorted((r["conv_id"], r["turn"], r["reply"]) for r in asked) == \
        [(c, t, k) for c, t, _, _ in rows for k in range(2)]
