"""Statistics: domain reputation, time-of-day means, score distribution and
percentiles, class weights (A1-A7, W1-W3, J2, T5)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postcast.constants import DAY_NAMES, SMOOTHING_K, SMOOTHING_PRIOR
from postcast.functions.time import day_name, day_of_week, hour_utc
from postcast.operators.running import running_total


def global_mean(df: DataFrame, col: str = "score") -> Column:
    """Data mean as a scalar subquery: computed once, inlined as a value
    (no cross join)."""
    return df.select(F.avg(F.col(col).cast("double"))).scalar()


def domain_stats(clean: DataFrame, k: int = SMOOTHING_K, prior=SMOOTHING_PRIOR,
                 keep_empty: bool = False) -> DataFrame:
    """A1/A2: smoothed mean per domain, (sum + k*prior) / (n + k) with n the
    non-null scores.  ``prior='data'`` uses the mean of the input (A2).  The
    empty domain is excluded unless ``keep_empty`` (then it is a normal group).
    Partial aggregation happens map-side, so a hot domain costs one row per
    map partition in the shuffle."""
    p = global_mean(clean) if prior == "data" else F.lit(float(prior))
    df = clean if keep_empty else clean.filter(F.col("domain") != "")
    g = df.groupBy("domain").agg(F.count("score").alias("post_count"),
                                 F.sum(F.col("score").cast("double")).alias("_sum"),
                                 F.avg(F.col("score").cast("double")).alias("mean_score"))
    return g.select(
        "domain", F.col("post_count").cast("long").alias("post_count"), "mean_score",
        ((F.coalesce(F.col("_sum"), F.lit(0.0)) + F.lit(float(k)) * p)
         / (F.col("post_count") + F.lit(k))).alias("avg_score"))


def domain_reputation(clean: DataFrame, stats: DataFrame | None,
                      prior: float = SMOOTHING_PRIOR) -> DataFrame:
    """Left join of the statistics; unknown or empty domain -> (prior, 0);
    missing statistics (None) -> the defaults for every row (S12).  The
    statistics side is an aggregate: AQE broadcasts it only when its measured
    size is under the broadcast threshold, else keeps the shuffle join."""
    if stats is None:
        return clean.withColumns({"domain_avg_score": F.lit(float(prior)),
                                  "domain_post_count": F.lit(0).cast("long")})
    s = stats.select(F.col("domain").alias("_d"), F.col("avg_score").alias("_a"),
                     F.col("post_count").alias("_n"))
    j = clean.join(s, clean["domain"] == s["_d"], "left")
    return j.withColumns({
        "domain_avg_score": F.coalesce(F.col("_a"), F.lit(float(prior))),
        "domain_post_count": F.coalesce(F.col("_n"), F.lit(0)).cast("long"),
    }).drop("_d", "_a", "_n")


def time_stats(df: DataFrame, time_col: str = "time", score_col: str = "score") -> DataFrame:
    """A3-A5: mean score per UTC hour and per weekday (0 = Monday) in one scan
    with grouping sets.  Output (grain, key, avg_score, n)."""
    t = df.select(hour_utc(time_col).alias("hour"), day_of_week(time_col).alias("dow"),
                  F.col(score_col).cast("double").alias("_s"))
    g = t.groupingSets([["hour"], ["dow"]], "hour", "dow").agg(
        F.avg("_s").alias("avg_score"), F.count("_s").alias("n"),
        F.grouping("hour").alias("_gh"))
    return g.select(F.when(F.col("_gh") == 0, F.lit("hour")).otherwise(F.lit("day")).alias("grain"),
                    F.coalesce("hour", "dow").cast("long").alias("key"),
                    "avg_score", F.col("n").cast("long").alias("n"))


def best_time(stats: DataFrame) -> DataFrame:
    """Best hour and best day, ties to the smallest key; posting advice."""
    def best(grain):
        on = F.col("grain") == grain
        key = F.max_by(F.when(on, F.col("key")),
                       F.when(on, F.struct(F.col("avg_score"), -F.col("key"))))
        avg = F.max_by(F.when(on, F.col("avg_score")),
                       F.when(on, F.struct(F.col("avg_score"), -F.col("key"))))
        return key, avg
    bh, bha = best("hour")
    bd, bda = best("day")
    r = stats.agg(bh.alias("best_hour"), bha.alias("best_hour_avg_score"),
                  bd.alias("best_day"), bda.alias("best_day_avg_score"))
    return r.withColumns({
        "best_day_name": day_name("best_day"),
        "advice": F.format_string("Best posting time: %d UTC on %s", F.col("best_hour"),
                                  day_name("best_day")),
    })


def top_hours(stats: DataFrame, n: int = 3) -> DataFrame:
    """Hours by mean score, descending, ties in key order (<= 24 rows)."""
    h = stats.filter(F.col("grain") == "hour")
    w = Window.orderBy(F.col("avg_score").desc(), F.col("key"))
    return (h.withColumn("position", F.row_number().over(w).cast("long"))
             .filter(F.col("position") <= n)
             .select(F.col("key").alias("hour"), "avg_score", "position"))


def score_cdf(df: DataFrame, score_col: str = "score") -> DataFrame:
    """(score, n, cum_n, total) over the distinct scores; the cumulative
    count is skew-safe (no single-partition window)."""
    d = df.filter(F.col(score_col).isNotNull()).groupBy(
        F.col(score_col).alias("score")).agg(F.count(F.lit(1)).alias("n"))
    total = df.select(F.count(score_col)).scalar()
    return running_total(d, [], ["score"], "n", out="cum_n").withColumn("total", total)


def history_groups(clean: DataFrame, time_col: str = "time", score_col: str = "score") -> DataFrame:
    """A1-A6 in one scan: (grain, domain, key, score, n, total) for the groups by
    domain, by UTC hour, by weekday, by score and over all rows, ``n`` scores with the
    sum ``total``.  Partial aggregation leaves a row per group and map task, so a hot
    domain or score is no hot key."""
    t = clean.select("domain", hour_utc(time_col).alias("hour"), day_of_week(time_col).alias("dow"),
                     F.col(score_col).alias("score"), F.col(score_col).cast("double").alias("_s"))
    sets = ["domain", "hour", "dow", "score"]
    g = t.groupingSets([*[[c] for c in sets], []], *sets).agg(
        F.count("_s").alias("n"), F.sum("_s").alias("total"), *[F.grouping(c).alias(f"_{c}") for c in sets])
    grain = F.when(F.col("_domain") == 0, "domain").when(F.col("_hour") == 0, "hour") \
        .when(F.col("_dow") == 0, "day").when(F.col("_score") == 0, "score").otherwise("all")
    return g.select(grain.alias("grain"), "domain", F.coalesce("hour", "dow").cast("long").alias("key"), "score",
                    F.col("n").cast("long").alias("n"), "total")


def history_tables(groups: DataFrame, k: int = SMOOTHING_K) -> dict[str, DataFrame]:
    """The saved tables of a training run from the written ``history_groups``:
    domain_stats (A2: the prior is the mean of the data, and the empty domain is a
    group like any other), time_stats (A3-A5) and score_cdf (A6)."""
    whole = groups.where("grain = 'all'").select(F.try_divide(F.col("total"), F.col("n"))).scalar()
    smoothed = (F.coalesce("total", F.lit(0.0)) + F.lit(float(k)) * whole) / (F.col("n") + F.lit(k))
    scores = groups.where("grain = 'score' AND score IS NOT NULL").select("score", "n")
    seen = groups.where("grain = 'all'").select("n").scalar()
    return {
        "domain_stats": groups.where("grain = 'domain'").select(
            "domain", F.col("n").alias("post_count"), F.try_divide("total", F.col("n")).alias("mean_score"),
            smoothed.alias("avg_score")),
        "time_stats": groups.where("grain IN ('hour', 'day')").select(
            "grain", "key", F.try_divide("total", F.col("n")).alias("avg_score"), "n"),
        "score_cdf": running_total(scores, [], ["score"], "n", out="cum_n").withColumn("total", seen)}


def history_percentile(df: DataFrame, id_col: str, score_col: str = "score") -> DataFrame:
    """W1 on history rows: 100 * (1 - #{scores <= s} / n) (same as cume_dist)."""
    cdf = score_cdf(df, score_col).select(F.col("score").alias("_s"), "cum_n", "total")
    j = df.select(id_col, score_col).join(cdf, F.col(score_col) == F.col("_s"), "inner")
    return j.select(id_col, score_col,
                    (F.lit(100.0) * (F.lit(1.0) - F.try_divide(F.col("cum_n"), F.col("total"))))
                    .alias("percentile"))


def percentile_of(queries: DataFrame, history: DataFrame, query_id: str,
                  query_score: str, history_score: str = "score") -> DataFrame:
    """W1 for any score, also one not in the history.  The distinct history
    scores (with counts) and the distinct query scores are range-partitioned
    together; the running count of history rows up to each query score is
    #{history <= s}.  Never sorts all rows in one partition."""
    h = (history.filter(F.col(history_score).isNotNull())
         .groupBy(F.col(history_score).cast("double").alias("_v"))
         .agg(F.count(F.lit(1)).alias("_n")).withColumn("_kind", F.lit(0)))
    q = (queries.select(F.col(query_score).cast("double").alias("_v")).distinct()
         .withColumn("_n", F.lit(0).cast("long")).withColumn("_kind", F.lit(1)))
    total = history.select(F.count(history_score)).scalar()
    cum = running_total(h.unionByName(q), [], ["_v", "_kind"], "_n", out="_le")
    per_score = cum.filter(F.col("_kind") == 1).select(
        "_v", (F.lit(100.0) * (F.lit(1.0) - F.try_divide(F.col("_le"), total))).alias("percentile"))
    return (queries.select(query_id, F.col(query_score).cast("double").alias(query_score))
            .join(per_score, F.col(query_score) == F.col("_v"), "left").drop("_v"))


def class_weights(df: DataFrame, class_col: str = "cls") -> DataFrame:
    """Balanced weights n / (k * n_c), k = classes present (<= 5 rows)."""
    c = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()
    return c.select(class_col, F.col("n_c").cast("long").alias("n_c"),
                    (F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")))
                    .alias("weight"))


def with_class_weight(df: DataFrame, class_col: str = "cls", out: str = "weight") -> DataFrame:
    """A7 applied: joined by class id (never by position); the weight table has
    at most one row per class, so broadcasting it is bounded."""
    w = class_weights(df, class_col).select(F.col(class_col).alias("_c"), F.col("weight").alias(out))
    return df.join(F.broadcast(w), F.col(class_col) == F.col("_c"), "left").drop("_c")


__all__ = ["DAY_NAMES"]
