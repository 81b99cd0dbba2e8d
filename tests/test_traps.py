import datetime as dt

from pyspark.sql import functions as F

from postcast.functions.text import url_text_features
from postcast.operators import stats as S
from postcast.operators.explain import top_features
from postcast.sources.bindings import stories
from postcast.sources.items import live_stories


def test_empty_domain_excluded_from_statistics(spark):
    """5b-10: '' is not a statistics group (it falls back to the prior);
    keep_empty=True makes it a normal group."""
    df = spark.createDataFrame([("", 500), ("", 500), ("a.com", 10)], "domain string, score int")
    assert {r["domain"] for r in S.domain_stats(df).collect()} == {"a.com"}
    assert {r["domain"] for r in S.domain_stats(df, keep_empty=True).collect()} == {"", "a.com"}
    rep = S.domain_reputation(df, S.domain_stats(df)).filter("domain = ''").first()
    assert rep["domain_avg_score"] == 47.57 and rep["domain_post_count"] == 0


def test_github_is_a_substring_test(spark):
    """5b-23: gist.github.com and notgithub.com count as GitHub."""
    df = spark.createDataFrame([("gist.github.com",), ("notgithub.com",), ("gitlab.com",)], "d string")
    got = [r[0] for r in df.select(url_text_features("d", F.lit(""))["is_github"]).collect()]
    assert got == [1, 1, 0]


def test_zero_attribution_points_down(spark):
    """5b-25: direction is 'down' for exactly 0."""
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    top = df.select(top_features(F.col("v"), ["a", "b"], k=2).alias("t")).first()["t"]
    assert [t["direction"] for t in top] == ["down", "down"]


def test_null_descendants_become_zero(spark):
    """5b-22: stories without a conversation have 0 comments, not null."""
    s = stories(spark, "/root/testdata/sf0.001")
    assert s.filter(F.col("descendants").isNull()).count() == 0
    assert s.filter(F.col("descendants") == 0).count() > 0


def test_top_score_percentile_is_zero(spark):
    """5b-16: counting <= means the highest score is 'top 0%'."""
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 11)], "id long, score double")
    got = {r["id"]: r["percentile"] for r in S.history_percentile(df, "id", "score").collect()}
    assert got[10] == 0.0 and abs(got[1] - 90.0) < 1e-9


def test_live_filter_keeps_negative_scores_without_threshold(spark):
    """5b / F3: a 0 threshold keeps negative and null scores."""
    from postcast.sources.items import story_scan
    rows = [(1, 1, "t", -3, dt.datetime(2024, 1, 1), 0, 0), (2, 1, "u", None, dt.datetime(2024, 1, 1), 0, 0)]
    df = spark.createDataFrame(rows, "id long, type int, title string, score int, time timestamp, dead int, deleted int")
    assert live_stories(df).count() == 2
    assert story_scan(df, None, min_score=0, columns=["id", "score"]).count() == 2
