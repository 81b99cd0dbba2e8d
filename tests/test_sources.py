"""Scans, comment lookups, index sinks/sources, sampling."""
import pytest
from pyspark.sql import functions as F

from postcast.operators.clean import clean_comments, clean_stories
from postcast.operators.sampling import seeded_sample, stratified_sample, strata_quotas
from postcast.schema import COMMENT_INDEX
from postcast.session import scratch_path
from postcast.sources.items import (comments_for_stories, comments_of, live_stories, read_or_empty,
                                    read_required, story_scan, write_comment_index)


def test_live_filter_and_scan(stories_df):
    assert {r["id"] for r in live_stories(stories_df).collect()} == {11, 12, 13, 14, 17}  # no empty title, not dead
    top = story_scan(stories_df, limit=2)
    assert [r["id"] for r in top.collect()] == [11, 14]
    assert story_scan(stories_df, None, min_score=90).count() == 3
    assert story_scan(stories_df, None, min_date="2023-02-14 05:00:00").count() == 3
    assert top.columns == ["id", "title", "url", "text", "score", "descendants", "by", "time", "dead", "deleted"]


def test_missing_column_is_an_error(stories_df):
    with pytest.raises(Exception, match="by"):
        story_scan(stories_df.drop("by"), limit=2)


def test_comments_by_parent(spark, stories_df, comments_df):
    c = comments_for_stories(comments_df, stories_df.select("id"))
    assert c.columns == ["id", "parent", "text", "by", "time", "dead", "deleted"]
    counts = {r["parent"]: r["count"] for r in c.groupBy("parent").count().collect()}
    assert counts == {13: 3, 11: 1, 14: 1}
    assert comments_for_stories(comments_df, stories_df.select("id"), limit_per_story=1).count() == 3
    none = comments_for_stories(comments_df, stories_df.select("id").limit(0))
    assert none.count() == 0 and none.columns == c.columns
    path = scratch_path(spark, "test_comment_index")
    write_comment_index(clean_comments(comments_df), path)
    idx = read_or_empty(spark, path, COMMENT_INDEX)
    assert comments_of(idx, 13).count() == 3
    assert comments_of(idx, 11).count() == 1
    assert comments_of(idx, 99999).count() == 0
    missing = read_or_empty(spark, scratch_path(spark, "does_not_exist"), COMMENT_INDEX)
    assert missing.count() == 0 and missing.columns == ["id", "parent", "clean_text", "by"]
    with pytest.raises(FileNotFoundError):
        read_required(spark, scratch_path(spark, "no_story_index"))


def test_clean_stories(stories_df):
    r = {x["id"]: x for x in clean_stories(stories_df).collect()}
    assert r[11]["domain"] == "github.com" and r[11]["post_type"] == "show_hn"
    assert r[11]["clean_text"] == "Charts & tables for 300 harbours"
    assert r[13]["clean_text"] == "Mine is the Peirce quincuncial \u2014 it's odd." and r[13]["domain"] == ""
    assert r[12]["clean_text"] == "" and r[17]["clean_text"] == "a\nb"
    assert clean_stories(stories_df, min_score=90).count() == 3


def test_seeded_sample_deterministic(spark):
    df = spark.range(1000).withColumnRenamed("id", "id")
    a = sorted(r["id"] for r in seeded_sample(df, 20, seed=42).collect())
    b = sorted(r["id"] for r in seeded_sample(df.repartition(7), 20, seed=42).collect())
    assert a == b and len(set(a)) == 20


def test_stratified_quotas(spark):
    assert strata_quotas(100) == [30, 30, 25, 15]
    assert strata_quotas(2) == [1, 1, 1, 1]
    import datetime as dt
    rows = [(i, 1, f"t{i}", i % 150 - 5, dt.datetime(2024, 1, 1), 0, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, type int, title string, score int, time timestamp, "
                                     "dead int, deleted int")
    s = stratified_sample(df, 100).groupBy("stratum").count().collect()
    assert sorted((r["stratum"], r["count"]) for r in s) == [(0, 30), (1, 30), (2, 25), (3, 15)]


def test_samples_equal_a_full_sort(spark):
    """Radix thresholds give the rows of a full sort by (md5, id), also with a hot
    group, ties in the key and quotas beyond a group's size."""
    import datetime as dt
    import hashlib

    from postcast.operators.topn import seeded_take, top_n
    rows = [(i, 1, f"t{i}", (0 if i % 3 else 7) + i % 9, dt.datetime(2024, 1, 1), 0, 0) for i in range(6000)]
    df = spark.createDataFrame(rows, "id long, type int, title string, score int, time timestamp, "
                                     "dead int, deleted int")
    key = lambda i: (hashlib.md5(str(i + 42).encode()).hexdigest(), i)
    got = [(r["id"], r["sample_rank"]) for r in seeded_take(df, "id", 42, 250).collect()]
    want = sorted(range(6000), key=key)[:250]
    assert sorted(got) == sorted((i, n + 1) for n, i in enumerate(want))
    assert seeded_take(df, "id", 42, 10 ** 6).count() == 6000
    s = stratified_sample(df, 300)
    strata = {0: [], 1: [], 2: [], 3: []}
    for i, _, _, score, *_ in rows:
        if score >= 1:
            strata[0 if score < 5 else 1 if score < 20 else 2].append(i)
    want = {(g, i, n + 1) for g, q in zip(range(4), strata_quotas(300))
            for n, i in enumerate(sorted(strata[g], key=key)[:q])}
    assert {(r["stratum"], r["id"], r["stratum_rank"]) for r in s.collect()} == want
    a = [r["id"] for r in top_n(df, 77, "score", tie=["id"]).collect()]
    b = [r["id"] for r in df.orderBy(F.col("score").desc(), "id").limit(77).collect()]
    assert a == b


def test_read_files_explicit_list(spark):
    from postcast.sources.tables import read_files, table_path
    sf = "/root/testdata/sf0.001"
    one = spark.read.parquet(table_path(sf, "events")).count()
    both = read_files(spark, [table_path(sf, "events"), table_path(sf, "events")]).count()
    assert both == 2 * one


def test_year_list_reads_only_its_folders(spark):
    import tempfile

    import pytest
    from pyspark.sql import functions as F
    from pyspark.sql.types import LongType, StructField, StructType

    from postcast.sources.tables import read_years
    base = tempfile.mkdtemp(prefix="postcast-years-")
    (spark.range(40).select("id", (F.lit(2018) + F.col("id") % 4).alias("year"))
     .write.mode("overwrite").partitionBy("year").parquet(base))
    got = read_years(spark, base, [2021, 2019, 2019, 2050])  # repeated and missing years
    assert {(r["id"], r["year"]) for r in got.collect()} == {(i, 2018 + i % 4) for i in range(40) if i % 4 in (1, 3)}
    assert {f.split("year=")[1][:4] for f in got.inputFiles()} == {"2019", "2021"}
    schema = StructType([StructField("id", LongType())])
    assert read_years(spark, base, [2019], schema).count() == 10
    none = read_years(spark, base, [2050], schema)
    assert none.count() == 0 and none.columns == ["id", "year"]
    with pytest.raises(FileNotFoundError):
        read_years(spark, base, [2050])


def test_story_table_is_not_dealt_by_day_again(spark, tmp_path, monkeypatch):
    """Few days: the joined rows are written as they lie; many: dealt by day and salt."""
    from postcast.sources import bindings as B
    rows = spark.range(4000).repartition(4, "id").selectExpr("id", "date_add(date'2024-01-01', cast(id % 10 as int)) day",
                                                             "cast(id as string) title")
    dealt = []
    monkeypatch.setattr(type(rows), "repartition", lambda df, *a: (dealt.append(a), df)[1])
    for most, n in ((10_000, 0), (10, 1)):
        path = str(tmp_path / str(most))
        B.write_by_day(rows, path, 10, most)
        back = spark.read.parquet(path)
        assert len(dealt) == n
        assert sorted(map(tuple, back.select("id", "title", F.col("day").cast("string")).collect())) \
            == sorted(map(tuple, rows.select("id", "title", F.col("day").cast("string")).collect()))
        assert len(list((tmp_path / str(most)).glob("day=*"))) == 10


def test_stream_lands_the_binding_without_a_written_table(spark, monkeypatch):
    import __spark_entry__ as E
    from postcast.sources import bindings as B
    monkeypatch.setattr(B, "_WRITTEN", {})
    got = E.queries()["stream_domain_stats"](spark, "/root/testdata/sf0.001").collect()
    assert got and not B._WRITTEN
    B.stories_table(spark, "/root/testdata/sf0.001")
    assert B._WRITTEN and sorted(E.queries()["stream_domain_stats"](spark, "/root/testdata/sf0.001").collect()) == sorted(got)
