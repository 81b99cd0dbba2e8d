"""Declared schemas of the tables the library reads and writes.

Fixed values: column names, their types and the order of the features."""
from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.ByteType()),
    T.StructField("parent", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("descendants", T.IntegerType()),
    T.StructField("by", T.StringType()),
    T.StructField("time", T.TimestampType()),
    T.StructField("dead", T.ShortType()),
    T.StructField("deleted", T.ShortType()),
    T.StructField("kids", T.ArrayType(T.LongType())),
])

STORY_COLUMNS = ["id", "title", "url", "text", "score", "descendants", "by",
                 "time", "dead", "deleted"]
COMMENT_COLUMNS = ["id", "parent", "text", "by", "time", "dead", "deleted"]

STORY_INDEX = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("descendants", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("post_type", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

COMMENT_INDEX = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("parent", T.LongType()),
    T.StructField("clean_text", T.StringType()),
    T.StructField("by", T.StringType()),
])

STRUCTURAL_FEATURES = [
    "title_length", "title_word_count", "title_has_question", "title_has_number",
    "is_show_hn", "is_ask_hn", "hour", "day_of_week", "is_weekend",
    "has_url", "is_github", "has_text", "text_length",
    "domain_avg_score", "domain_post_count",
]
