"""Shared pieces of the registered queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcast.operators.clean import clean_comments, clean_stories
from postcast.sources.bindings import comments, stories_table
from postcast.sources.items import live_stories
from postcast.sources.tables import read_table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double/float column (the oracle rounds the same way)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def stories(spark, sf) -> DataFrame:
    """The derived story table (materialised once per session)."""
    return stories_table(spark, sf)


def live(spark, sf) -> DataFrame:
    return live_stories(stories(spark, sf))


def clean_live(spark, sf) -> DataFrame:
    return clean_stories(live(spark, sf))


def time_text(c: str):
    return F.date_format(F.col(c), "yyyy-MM-dd HH:mm:ss")


__all__ = ["rounded", "live", "clean_live", "time_text", "stories", "comments",
           "read_table", "clean_comments", "clean_stories"]
