"""Statistics operators: smoothing, lookups, percentiles, time means, skew-safe running totals."""
import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from postcast.operators import stats as S
from postcast.operators.running import running_total


def test_smoothed_mean(spark):
    df = spark.createDataFrame([("github.com", 100), ("github.com", 200), ("github.com", 300),
                                ("blog.com", 10)], "domain string, score int")
    got = {r["domain"]: (r["avg_score"], r["post_count"]) for r in
           S.domain_stats(df, k=10, prior=50.0).collect()}
    assert abs(got["github.com"][0] - 1100 / 13) < 1e-9 and got["github.com"][1] == 3
    assert abs(got["blog.com"][0] - 510 / 11) < 1e-9 and got["blog.com"][1] == 1


def test_smoothed_mean_empty(spark):
    df = spark.createDataFrame([], "domain string, score int")
    assert S.domain_stats(df).count() == 0


def test_lookup_default(spark):
    stats = spark.createDataFrame([("github.com", 120.5, 5000), ("blog.example.com", 25.0, 50)],
                                  "domain string, avg_score double, post_count long")
    df = spark.createDataFrame([("github.com",), ("unknown.org",), ("",)], "domain string")
    got = {r["domain"]: (r["domain_avg_score"], r["domain_post_count"])
           for r in S.domain_reputation(df, stats).collect()}
    assert got["github.com"] == (120.5, 5000)
    assert got["unknown.org"] == (47.57, 0)
    assert got[""] == (47.57, 0)
    none = {r["domain"]: r["domain_avg_score"] for r in S.domain_reputation(df, None).collect()}
    assert none["github.com"] == 47.57


def test_percentile_unseen(spark):
    hist = spark.createDataFrame([(float(v),) for v in [1] * 50 + [5] * 30 + [9] * 10 + [50] * 7 + [500] * 3],
                                 "score double")
    q = spark.createDataFrame([(1, 9.0), (2, 1000.0), (3, 0.5)], "id long, s double")
    got = {r["id"]: r["percentile"] for r in S.percentile_of(q, hist, "id", "s").collect()}
    assert abs(got[1] - 10.0) < 1e-9
    assert got[2] == 0.0 and got[3] == 100.0
    hist2 = spark.createDataFrame([(float(v),) for v in range(1, 101)], "score double")
    q2 = spark.createDataFrame([(1, 1000.0), (2, 1.0)], "id long, s double")
    got2 = {r["id"]: r["percentile"] for r in S.percentile_of(q2, hist2, "id", "s").collect()}
    assert got2[1] < 1 and got2[2] >= 99


def test_history_percentile_matches_cume_dist(spark):
    rng = np.random.default_rng(1)
    vals = rng.integers(0, 30, 500)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(vals)], "id long, score long")
    got = S.history_percentile(df, "id", "score").toPandas().set_index("id")["percentile"]
    expect = 100.0 * (1 - pd.Series(vals).rank(method="max") / len(vals))
    assert np.allclose(got.sort_index().values, expect.values)


def test_time_stats_and_best_time(spark):
    rows = [(dt.datetime(2024, 1, 7, 9, 0), 100), (dt.datetime(2024, 1, 7, 9, 30), 50),
            (dt.datetime(2024, 1, 8, 10, 0), 10)]
    df = spark.createDataFrame(rows, "time timestamp, score int")
    st = S.time_stats(df)
    d = {(r["grain"], r["key"]): r["avg_score"] for r in st.collect()}
    assert d[("hour", 9)] == 75.0
    assert d[("day", 6)] == 75.0 and d[("day", 0)] == 10.0  # Sunday = 6, Monday = 0
    b = S.best_time(st).first()
    assert (b["best_hour"], b["best_day"], b["best_day_name"]) == (9, 6, "Sunday")
    assert b["advice"] == "Best posting time: 9 UTC on Sunday"


def test_top_hours_by_key(spark):
    st = spark.createDataFrame([("hour", h, float(h), 1) for h in range(24)],
                               "grain string, key long, avg_score double, n long")
    assert [r["hour"] for r in S.top_hours(st).orderBy("position").collect()] == [23, 22, 21]


def test_best_time_ties_to_smallest_key(spark):
    st = spark.createDataFrame([("hour", 5, 1.0, 1), ("hour", 3, 1.0, 1), ("day", 2, 4.0, 1), ("day", 1, 4.0, 1)],
                               "grain string, key long, avg_score double, n long")
    b = S.best_time(st).first()
    assert (b["best_hour"], b["best_day"]) == (3, 1)


def test_running_total_skewed_group(spark):
    """One group holds a third of the rows; result equals a pandas cumsum."""
    rng = np.random.default_rng(7)
    n = 3000
    groups = np.where(np.arange(n) < n // 3, 0, rng.integers(1, 50, n))
    pdf = pd.DataFrame({"g": groups, "k": rng.permutation(n), "w": rng.integers(1, 5, n)})
    df = spark.createDataFrame(pdf)
    got = running_total(df, ["g"], ["k"], "w", out="cum", partitions=8).toPandas()
    exp = pdf.sort_values(["g", "k"]).assign(cum=lambda x: x.groupby("g")["w"].cumsum())
    m = got.merge(exp, on=["g", "k"], suffixes=("", "_e"))
    assert len(m) == n and (m["cum"] == m["cum_e"]).all()


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(c,) for c in [0, 1, 2, 3, 4] * 10], "cls long")
    w = [r["weight"] for r in S.class_weights(df).collect()]
    assert len(set(w)) == 1 and abs(w[0] - 1.0) < 1e-12


def test_percentile_with_empty_history_is_null(spark):
    hist = spark.createDataFrame([], "score double")
    q = spark.createDataFrame([(1, 5.0)], "id long, s double")
    assert S.percentile_of(q, hist, "id", "s").first()["percentile"] is None


def test_history_tables_are_saved_whole(spark, stories_df):
    """One scan gives the tables that the single operators give; they come back as saved,
    and a version without its manifest is no version."""
    import os

    import pytest
    from postcast.operators import stats
    from postcast.operators.clean import clean_stories
    from postcast.plans import jobs
    from postcast.session import scratch_path
    from postcast.sources.items import live_stories
    clean = clean_stories(live_stories(stories_df))
    tables = jobs.history_statistics(stories_df)
    want = {"domain_stats": stats.domain_stats(clean, prior="data", keep_empty=True),
            "time_stats": stats.time_stats(clean), "score_cdf": stats.score_cdf(clean)}
    version = jobs.save_statistics(tables, scratch_path(spark, "test_statistics", unique=True))
    back = jobs.load_statistics(spark, version)

    def rows(df, like):
        return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*like.columns).collect())
    for name, df in want.items():
        assert rows(back[name], df) == rows(tables[name], df) == rows(df, df)
        assert back[name].schema == tables[name].schema
    assert "" in {r["domain"] for r in back["domain_stats"].collect()}
    with pytest.raises(FileNotFoundError):
        jobs.load_statistics(spark, os.path.dirname(version))
    guarded = jobs.history_statistics(stories_df, before="2023-01-01 00:00:00")["score_cdf"]
    assert {r["total"] for r in guarded.collect()} == {2}
