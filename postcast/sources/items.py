"""Item scans (stories, comments), story/comment index sinks and sources.

S1-S12, F1-F4, J1, J5, U2.  Filters are plain column predicates so that they
reach the parquet scan (PushedFilters); projections are explicit.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postcast.constants import COMMENT_LOOKUP_LIMIT
from postcast.schema import COMMENT_COLUMNS, COMMENT_INDEX, STORY_COLUMNS, STORY_INDEX


def live_stories(items: DataFrame) -> DataFrame:
    """type 1, not dead, not deleted, title present and not empty."""
    return items.filter((F.col("type") == 1) & (F.col("dead") == 0) & (F.col("deleted") == 0)
                        & F.col("title").isNotNull() & (F.col("title") != ""))


def live_comments(items: DataFrame) -> DataFrame:
    """type 2, not dead, not deleted (flags optional on derived tables)."""
    cond = F.col("type") == 2
    for flag in ("dead", "deleted"):
        if flag in items.columns:
            cond = cond & (F.col(flag) == 0)
    return items.filter(cond)


def with_day_pruning(df: DataFrame, min_date: str) -> DataFrame:
    """On a day-partitioned table, the same lower bound on the partition
    column, so the scan skips the earlier day directories (the time filter
    alone is not turned into a partition filter)."""
    if "day" in df.columns:
        df = df.filter(F.col("day") >= F.to_date(F.to_timestamp(F.lit(min_date))))
    return df


def seeded_order(id_col: str = "id", seed: int = 0) -> list:
    """Sampling order: md5 of the decimal string of id + seed, tie by id.
    md5 gives the same order in any engine (unlike engine-specific hashes)."""
    return [F.md5((F.col(id_col) + F.lit(seed)).cast("string")), F.col(id_col)]


def story_scan(items: DataFrame, limit: int | None, min_score: int = 0,
               min_date: str | None = None, seed: int | None = None,
               columns: list[str] | None = None) -> DataFrame:
    """Live stories, optional min score (only when > 0) and inclusive min
    date, ordered by score (desc, id) or by the seeded hash, limited."""
    df = live_stories(items)
    if min_score > 0:
        df = df.filter(F.col("score") >= min_score)
    if min_date is not None:
        df = df.filter(F.col("time") >= F.to_timestamp(F.lit(min_date)))
        df = with_day_pruning(df, min_date)
    df = df.select(*(columns or STORY_COLUMNS))
    if limit is None:
        order = seeded_order("id", seed) if seed is not None else [F.col("score").desc(), F.col("id")]
        return df.orderBy(*order)
    from postcast.operators.topn import seeded_take, top_n
    if seed is not None:
        return seeded_take(df, "id", seed, limit, rank_col=None).orderBy(*seeded_order("id", seed))
    return top_n(df, limit, "score", descending=True, tie=["id"])


def comments_for_stories(comments: DataFrame, story_ids: DataFrame,
                         limit_per_story: int | None = None,
                         id_col: str = "id") -> DataFrame:
    """Live comments whose parent is one of the story ids (direct
    replies only); optional per-story limit by comment id.  One semi join
    instead of IN-lists in batches; Spark picks broadcast or shuffle."""
    ids = story_ids.select(F.col(id_col).alias("_sid"))
    c = live_comments(comments).join(ids, F.col("parent") == F.col("_sid"), "left_semi")
    if limit_per_story is not None:
        c = per_group_limit(c, ["parent"], [F.col("id")], limit_per_story)
    return c.select(*COMMENT_COLUMNS)


def per_group_limit(df: DataFrame, group_cols: list[str], order_cols: list, n: int,
                    rank_col: str | None = None) -> DataFrame:
    """First n rows per group.  The filter on row_number with a
    literal bound lets Catalyst insert WindowGroupLimit, which keeps n rows per
    group in every map partition *before* the shuffle, so a hot group sends at
    most n rows per partition."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def comments_of(comment_index: DataFrame, parent_id, limit: int = COMMENT_LOOKUP_LIMIT) -> DataFrame:
    """J5 point lookup: the filter on ``parent`` reaches the parquet scan, and
    on an index written sorted by parent, row-group statistics skip the rest."""
    return (comment_index.filter(F.col("parent") == F.lit(parent_id))
            .orderBy("id").limit(limit))


# ----- sinks / sources ------------------------------------------------------

def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Overwrite a parquet table (optionally partitioned)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A missing comment index reads as an empty table of the schema."""
    if _exists(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def read_required(spark: SparkSession, path: str) -> DataFrame:
    """A missing story index is an error."""
    if not _exists(spark, path):
        raise FileNotFoundError(f"table not found: {path}")
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(hpath)


def story_index_rows(clean_stories: DataFrame) -> DataFrame:
    """the 9 index columns of cleaned stories that carry an ``embedding``, nulls
    to '' and 0 and post type 'regular'."""
    defaults = {"title": "", "url": "", "clean_text": "", "score": 0, "descendants": 0, "domain": "",
                "post_type": "regular"}
    return clean_stories.select(*[
        (F.coalesce(F.col(f.name), F.lit(defaults[f.name])) if f.name in defaults else F.col(f.name))
        .cast(f.dataType).alias(f.name) for f in STORY_INDEX.fields])


def write_story_index(clean_stories: DataFrame, path: str) -> None:
    """Overwrite the story index (``story_index_rows``)."""
    write_table(story_index_rows(clean_stories), path)


def write_comment_index(clean_comments: DataFrame, path: str) -> None:
    """Id, parent, clean_text, by; range-partitioned and sorted by
    parent so that parent lookups prune row groups by min/max statistics."""
    cols = [F.col(f.name).cast(f.dataType) for f in COMMENT_INDEX.fields]
    n = int(clean_comments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    idx = (clean_comments.select(*cols)
           .repartitionByRange(n, "parent", "id").sortWithinPartitions("parent", "id"))
    write_table(idx, path)
