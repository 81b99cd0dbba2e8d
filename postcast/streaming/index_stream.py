"""Incremental index build (M10) and running statistics (A1, A3/A4) as
Structured Streaming queries over a landing folder of item parquet files.

New files are picked up by the file source; each micro-batch is cleaned with
the same column expressions as the batch job and appended to the story and
comment indexes.  Domain and time statistics are streaming aggregations whose
state is one row per domain / hour / weekday; the smoothed mean is derived
from (n, sum) when the table is read.  Progress and state live in checkpoint
folders under the shared ``spark.checkpoint.dir``, so a restarted query
continues where it stopped and a lost executor replays from the log.
"""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcast.constants import SMOOTHING_K, SMOOTHING_PRIOR
from postcast.functions.time import day_of_week, hour_utc
from postcast.operators.clean import clean_comments, clean_stories
from postcast.operators.embed import hashing_embedding
from postcast.schema import ITEM
from postcast.session import shared_dir
from postcast.sources.items import live_comments, live_stories, story_index_rows


def _story_rows(batch: DataFrame) -> DataFrame:
    return story_index_rows(hashing_embedding(batch, "title"))


def start_index_stream(spark: SparkSession, landing_dir: str, out_dir: str,
                       name: str = "index_stream", available_now: bool = True) -> list:
    """Starts three streaming queries; returns them (call ``awaitTermination``)."""
    ckpt = os.path.join(shared_dir(spark), "streams", name)
    items = spark.readStream.schema(ITEM).parquet(landing_dir)
    stories = clean_stories(live_stories(items))
    comments = clean_comments(live_comments(items)).select(
        F.col("id").cast("long"), F.col("parent").cast("long"), "clean_text", "by")

    def append_stories(batch: DataFrame, batch_id: int) -> None:
        # idempotent: a micro-batch replayed after a failure overwrites its own
        # folder instead of appending its rows a second time
        (_story_rows(batch).write.mode("overwrite").option("compression", "zstd")
         .parquet(os.path.join(out_dir, "stories", f"batch_id={batch_id}")))

    def trig(w):
        return w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")

    q_stories = trig(stories.writeStream.foreachBatch(append_stories)
                     .option("checkpointLocation", os.path.join(ckpt, "stories"))).start()
    q_comments = trig(comments.writeStream.format("parquet")
                      .option("path", os.path.join(out_dir, "comments"))
                      .option("checkpointLocation", os.path.join(ckpt, "comments"))).start()

    dstats = (stories.filter(F.col("domain") != "").groupBy("domain")
              .agg(F.count("score").alias("n"), F.sum(F.col("score").cast("double")).alias("total")))

    def overwrite(path):
        def run(batch: DataFrame, _batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(path)
        return run

    q_domains = trig(dstats.writeStream.outputMode("complete")
                     .foreachBatch(overwrite(os.path.join(out_dir, "domain_counts")))
                     .option("checkpointLocation", os.path.join(ckpt, "domains"))).start()
    tstats = (stories.select(hour_utc("time").alias("hour"), day_of_week("time").alias("dow"), "score")
              .groupBy("hour", "dow").agg(F.count("score").alias("n"),
                                          F.sum(F.col("score").cast("double")).alias("total")))
    q_time = trig(tstats.writeStream.outputMode("complete")
                  .foreachBatch(overwrite(os.path.join(out_dir, "time_counts")))
                  .option("checkpointLocation", os.path.join(ckpt, "time"))).start()
    return [q_stories, q_comments, q_domains, q_time]


def smoothed_domains(spark: SparkSession, out_dir: str, k: int = SMOOTHING_K,
                     prior: float = SMOOTHING_PRIOR) -> DataFrame:
    """A1 from the streamed (n, sum) table."""
    c = spark.read.parquet(os.path.join(out_dir, "domain_counts"))
    return c.select("domain", F.col("n").cast("long").alias("post_count"),
                    ((F.coalesce(F.col("total"), F.lit(0.0)) + F.lit(k * prior))
                     / (F.col("n") + F.lit(k))).alias("avg_score"))


def time_means(spark: SparkSession, out_dir: str) -> DataFrame:
    """A3/A4 from the streamed (hour, dow, n, sum) cells, rolled up per grain."""
    c = spark.read.parquet(os.path.join(out_dir, "time_counts"))
    g = c.groupingSets([["hour"], ["dow"]], "hour", "dow").agg(
        (F.sum("total") / F.sum("n")).alias("avg_score"), F.sum("n").alias("n"),
        F.grouping("hour").alias("_gh"))
    return g.select(F.when(F.col("_gh") == 0, "hour").otherwise("day").alias("grain"),
                    F.coalesce("hour", "dow").alias("key"), "avg_score", "n")


def as_items(stories: DataFrame, comments: DataFrame) -> DataFrame:
    """Stories and comments in the one item schema the landing folder holds."""
    both = stories.unionByName(comments, allowMissingColumns=True)
    cols = [(F.col(f.name) if f.name in both.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in ITEM.fields]
    return both.select(*cols)
