"""Binding of the driver tables to the item model (stories and comments).

The driver tables are not forum posts, so ``stories`` and ``comments`` are
derived from them by a fixed rule (the same rule is written in SQL for the
DuckDB oracle, see ``postcast.plans.oracle``):

* a story per document that has events (event id modulo the number of
  documents): the first event gives author (column ``by``) and time, the last one
  the score, the page with the same id gives url and HTML text, the conversation
  with the same id gives the comment count, and the document's labels give the
  moderation flags (toxic -> dead, low quality -> deleted);
* a comment per conversation turn, its parent being the conversation id.

All five joins are on the same key, so after the first shuffle the later
joins reuse its hash partitioning (no re-shuffle of the joined side).
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcast.sources.tables import read_table

# fixed values of the binding rule: title prefix by doc_id % 10
TITLE_PREFIXES = {0: "Show HN: ", 1: "Ask HN: ", 2: "Tell HN: ", 3: "Launch HN: "}


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    # every event belongs to the document that its id gives modulo the number of documents
    n_docs = read_table(spark, sf_dir, "documents").select(F.count(F.lit(1))).scalar()
    when = F.struct("ts", "event_id")
    e = (read_table(spark, sf_dir, "events")
         .groupBy((F.col("event_id") % n_docs).alias("e_doc"))
         .agg(F.max_by("value", when).alias("value"), F.min_by("user_id", when).alias("user_id"),
              F.min("ts").alias("ts")))
    p = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    n = (read_table(spark, sf_dir, "conversations")
         .groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns")))
    lb = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"), "toxic", "quality")

    k = F.col("doc_id") % 10
    prefix = F.lit("")
    for key in sorted(TITLE_PREFIXES, reverse=True):
        prefix = F.when(k == key, F.lit(TITLE_PREFIXES[key])).otherwise(prefix)
    body = F.replace(F.col("text"), F.lit("\n"), F.lit(" "))
    # concat_ws('') skips nulls, like SQL concat of the oracle engine
    title = F.concat_ws("", prefix, body, F.when(k == 1, F.lit("?")).otherwise(F.lit("")))

    j = (d.join(e, d.doc_id == e.e_doc, "inner")
          .join(p, d.doc_id == p.page_id, "left")
          .join(n, d.doc_id == n.conv_id, "left")
          .join(lb, d.doc_id == lb.l_doc, "left"))
    return j.select(
        F.col("doc_id").alias("id"),
        F.lit(1).cast("tinyint").alias("type"),
        title.alias("title"),
        F.col("url"),
        F.col("html").alias("text"),
        F.floor("value").cast("int").alias("score"),
        F.coalesce(F.col("n_turns"), F.lit(0)).cast("long").alias("descendants"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("by"),
        F.col("ts").alias("time"),
        F.when(F.col("toxic") == 1, 1).otherwise(0).alias("dead"),
        F.when(F.col("quality") == 0, 1).otherwise(0).alias("deleted"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "conversations")
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("parent"),
        F.col("text"),
        F.col("role").alias("by"),
        F.lit(2).alias("type"),
        F.lit(None).cast("timestamp").alias("time"),
        F.lit(0).alias("dead"),
        F.lit(0).alias("deleted"),
    )


_WRITTEN: dict = {}
# Most files of the story table that are written without a shuffle by day.
MOST_FILES = 10_000


def _days(spark: SparkSession, sf_dir: str) -> int:
    """How many days the events span at most."""
    first, last = read_table(spark, sf_dir, "events").select(F.to_date(F.min("ts")), F.to_date(F.max("ts"))).first()
    return (last - first).days + 1 if first else 0


def write_by_day(rows: DataFrame, path: str, days: int, most_files: int = MOST_FILES) -> None:
    """Writes rows that a join left in hash partitions into one directory per ``day``.
    Every task writes a file for each of its days; only where that could be too many
    files are the rows dealt once more, by day and a salt, so that a day is a few files
    and a hot day many tasks.  The rows are wide, hence the stronger compression."""
    if days * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) > most_files:
        rows = rows.repartition("day", F.pmod(F.xxhash64("id"), F.lit(8)))
    rows.write.mode("overwrite").option("compression", "zstd").partitionBy("day").parquet(path)


def stories_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The story binding written once per session to the shared folder and
    read back: every later query scans one table instead of re-running the
    five-way join, and a lost executor recomputes from that table, not from
    the raw inputs.  The table is partitioned by ``day`` (date of ``time``), so
    time-bounded reads prune whole directories."""
    import hashlib

    from postcast.session import scratch_path
    key = (spark.sparkContext.applicationId, sf_dir)
    path = _WRITTEN.get(key)
    if path is None:
        path = scratch_path(spark, f"stories_{hashlib.md5(sf_dir.encode()).hexdigest()[:10]}")
        write_by_day(stories(spark, sf_dir).withColumn("day", F.to_date("time")), path, _days(spark, sf_dir))
        _WRITTEN[key] = path
    return spark.read.parquet(path)


def stories_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stories for a caller that reads them once: the written table where the
    session has it, else the binding itself, which is then not written."""
    written = (spark.sparkContext.applicationId, sf_dir) in _WRITTEN
    return stories_table(spark, sf_dir) if written else stories(spark, sf_dir)
