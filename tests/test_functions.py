"""Scalar operators against the values pinned by the reference's tests."""
import math

import pytest
from pyspark.sql import functions as F

from postcast.functions import labels as L
from postcast.functions.text import (html_to_text, html_to_text_exact, post_type, title_features,
                                     url_domain)
from postcast.functions.time import time_features


def one(spark, expr, value, typ="string"):
    return spark.createDataFrame([(value,)], f"v {typ}").select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("src,expected", [
    ("<p>Some <b>bold</b> and <i>italic</i></p>", "Some bold and italic"),
    ("I&#x27;m happy &amp; excited", "I'm happy & excited"),
    ("&amp;lt;", "&lt;"),
    ("<p>a</p><p>b</p>", "a\nb"),
    ("<script>x()</script>text<!-- c -->", "text"),
    ("https:&#x2F;&#47;x.y &mdash; if x < 5 and y > 3 end&nbsp;", "https://x.y \u2014 if x < 5 and y > 3 end"),
    ("&copy 2024 &eacute;t&eacute; &#8212;&#150;", "\u00a9 2024 \u00e9t\u00e9 \u2014\u2013"),
    ("&unknown; AT&T & &#0;&#x110000;&#xD800;", "&unknown AT&T & \ufffd\ufffd\ufffd"),
    ("&&amp;&#39;&amp;#39;", "&&'&#39;"),
    ("\u00a0 padded \u2003", "padded"),
    (None, ""), ("", ""),
])
def test_html_to_text_native(spark, src, expected):
    assert one(spark, html_to_text(F.col("v")), src) == expected


def test_html_to_text_exact(spark):
    df = spark.createDataFrame([("<p>Some <b>bold</b></p>",), ("I&#x27;m &eacute;",), (None,)], "v string")
    got = [r[0] for r in df.select(html_to_text_exact(F.col("v"))).collect()]
    assert got == ["Some bold", "I'm é", ""]


@pytest.mark.parametrize("url,domain", [
    ("https://www.nytimes.com/article", "nytimes.com"),
    ("https://github.com/user/repo", "github.com"),
    ("http://user@Example.COM:8080/x", "user@Example.COM:8080"),
    ("not a url", ""), ("", ""), (None, ""),
])
def test_domain(spark, url, domain):
    assert one(spark, url_domain(F.col("v")), url) == domain


@pytest.mark.parametrize("title,kind", [
    ("Show HN: x", "show_hn"), ("Ask HN: x", "ask_hn"), ("Tell HN: x", "tell_hn"),
    ("Launch HN: x", "launch_hn"), ("show hn: x", "regular"), ("Show HN x", "regular"),
    ("Other", "regular"), ("", "regular"), (None, "regular"),
])
def test_post_type(spark, title, kind):
    assert one(spark, post_type(F.col("v")), title) == kind


def test_title_features(spark):
    df = spark.createDataFrame([("Short",), ("x" * 40,), ("One two three four",), ("",),
                                ("Show HN: I built a tool to predict HN reactions",), ("Has ٣ digit?",)],
                               "t string")
    rows = df.select(*[c.alias(n) for n, c in title_features("t").items()]).collect()
    assert rows[0]["title_length"] == 5
    assert rows[1]["title_length"] == 40
    assert rows[2]["title_word_count"] == 4
    assert (rows[3]["title_length"], rows[3]["title_word_count"]) == (0, 0)
    assert rows[4]["title_word_count"] == 10 and rows[4]["is_show_hn"] == 1
    assert rows[5]["title_has_number"] == 1 and rows[5]["title_has_question"] == 1


def test_time_features(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(2022, 6, 15, 14, 30),), (dt.datetime(2022, 6, 18, 10, 0),)],
                               "t timestamp")
    r = df.select(*[c.alias(n) for n, c in time_features("t").items()]).collect()
    assert (r[0]["hour"], r[0]["day_of_week"], r[0]["is_weekend"]) == (14, 2, 0)
    assert r[1]["is_weekend"] == 1


@pytest.mark.parametrize("score,label", [
    (-5, "flop"), (0, "flop"), (3, "flop"), (3.5, "low"), (4, "low"), (15, "low"),
    (16, "moderate"), (100, "moderate"), (101, "hot"), (300, "hot"), (301, "viral")])
def test_label_bounds(spark, score, label):
    assert one(spark, L.reception_label(F.col("v")), float(score), "double") == label


def test_soft_label_and_confidence(spark):
    df = spark.createDataFrame([(4.0,)], "s double")
    r = df.select(L.reception_label("s").alias("l"), L.confidence("s").alias("c"),
                  L.soft_distribution("s").alias("p")).first()
    assert r["l"] == "low"
    assert abs(r["c"] - 0.7749) < 1e-4
    assert abs(sum(r["p"]) - 1.0) < 1e-12


def test_expected_score(spark):
    df = spark.createDataFrame([([0.2] * 5,), ([0.5, 0.5, 0.0, 0.0, 0.0],)], "p array<double>")
    got = [r[0] for r in df.select(L.expected_score("p", [2, 8, 50, 200, 500])).collect()]
    assert abs(got[0] - sum([2, 8, 50, 200, 500]) * 0.2) < 1e-9
    assert abs(got[1] - 5.0) < 1e-12


def test_argmax_first_wins(spark):
    df = spark.createDataFrame([([0.1, 0.4, 0.4, 0.1, 0.0],)], "p array<double>")
    assert df.select(L.argmax("p")).first()[0] == 1


def test_log_target_roundtrip(spark):
    df = spark.createDataFrame([(10.0,), (-3.0,)], "y double")
    r = df.select(L.from_log(L.log_target("y")).alias("b")).collect()
    assert math.isclose(r[0]["b"], 10.0, rel_tol=1e-12)
    assert r[1]["b"] == 0.0


def test_native_and_exact_html_agree_on_pages(spark):
    """The codegen-friendly regex form and the tokenizer form are two
    independent implementations; on the driver's pages they agree."""
    p = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    r = p.select(html_to_text("html").alias("a"), html_to_text_exact(F.col("html")).alias("b"))
    assert r.count() > 0 and r.filter(F.col("a") != F.col("b")).count() == 0


def test_bare_amp_before_tag(spark):
    src = "and&amp</title>Toon &amp;amp; x&ampy"
    native = one(spark, html_to_text(F.col("v")), src)
    exact = spark.createDataFrame([(src,)], "v string").select(html_to_text_exact(F.col("v"))).first()[0]
    assert native == exact == "and&Toon &amp; x&ampy"


def test_label_and_argmax_disagree_where_expected(spark):
    """Threshold label vs arg-max of the soft distribution: they differ for
    integer scores 16, 77-100 and 265-300 (the label follows the thresholds)."""
    df = spark.createDataFrame([(float(s),) for s in range(0, 400)], "s double")
    rows = df.select("s", L.reception_label("s").alias("l"), L.soft_label("s").alias("a")).collect()
    differ = sorted(int(r["s"]) for r in rows if r["l"] != r["a"])
    # 3 lies exactly between the flop and low centres in log space: a tie that
    # floating-point rounding decides either way
    assert [d for d in differ if d != 3] == [16] + list(range(77, 101)) + list(range(265, 301))
