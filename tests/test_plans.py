"""Plan properties the design relies on, read from the physical plans."""
import contextlib
import io

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def q():
    return E.queries()


def test_live_filter_and_projection_reach_the_scan(spark, q):
    p = plan(q["title_features"](spark, SF))
    assert "EqualTo(type,1)" in p and "EqualTo(dead,0)" in p
    schema = [ln for ln in p.splitlines() if ln.startswith("ReadSchema")][0]
    assert "text" not in schema  # the HTML column is pruned when only titles are needed


def test_partition_filter_prunes_days(spark, q):
    p = plan(q["multi_file_scan"](spark, SF))
    assert "PartitionFilters: [isnotnull(day" in p and "2024-01-10" in p


@pytest.mark.parametrize("key", ["comments_limited", "comment_lookup"])
def test_top_k_per_group_uses_window_group_limit(spark, q, key):
    df = q[key](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    assert "WindowGroupLimit" in plan(df)


@pytest.mark.parametrize("key", ["hash_split", "fallback_split", "validation_tail", "seeded_sample",
                                 "stratified_sample"])
def test_samples_and_splits_meet_in_no_single_task(spark, q, key):
    df = q[key](spark, SF)
    df.write.format("noop").mode("overwrite").save()
    assert "SinglePartition" not in plan(df)


@pytest.mark.parametrize("quota", [400, 30_000])
def test_large_quotas_neither(spark, quota):
    from postcast.operators.sampling import stratified_sample
    rows = spark.range(50_000).selectExpr("id", "cast(1 as int) type", "concat('t', id) title",
                                          "cast(id % 150 as int) score", "timestamp'2024-01-01' time",
                                          "0 dead", "0 deleted")
    df = stratified_sample(rows, quota)
    assert "SinglePartition" not in plan(df) and df.count() > 0.5 * quota


@pytest.mark.parametrize("key", ["domain_reputation", "time_stats", "score_cdf", "title_features",
                                 "reception_soft", "structural_features"])
def test_no_python_udf_in_the_hot_path(spark, q, key):
    p = plan(q[key](spark, SF))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_partial_aggregation_before_the_shuffle(spark, q):
    p = plan(q["domain_reputation"](spark, SF))
    assert p.count("HashAggregate") >= 2  # partial (map side) and final


def test_story_time_bound_prunes_day_directories(spark, q):
    p = plan(q["story_scan_since"](spark, SF))
    assert "PartitionFilters: [isnotnull(day" in p and "(day" in p
