"""M8: cleaning jobs for stories and comments."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.session import ship_package
from postcast.functions.text import html_to_text, html_to_text_exact, post_type, url_domain


def clean_stories(stories: DataFrame, min_score: int = 0, exact_html: bool = False) -> DataFrame:
    """Adds clean_text, domain, post_type; keeps rows with score >= min_score
    only when min_score > 0 (so 0 keeps negative and null scores)."""
    if exact_html:
        ship_package(stories.sparkSession)
    text = html_to_text_exact(F.col("text")) if exact_html else html_to_text("text")
    df = stories.withColumns({
        "clean_text": text,
        "domain": url_domain("url"),
        "post_type": post_type("title"),
    })
    if min_score > 0:
        df = df.filter(F.col("score") >= min_score)
    return df


def clean_comments(comments: DataFrame, exact_html: bool = False) -> DataFrame:
    """Adds clean_text and drops comments that are empty after cleaning."""
    if exact_html:
        ship_package(comments.sparkSession)
    text = html_to_text_exact(F.col("text")) if exact_html else html_to_text("text")
    return comments.withColumn("clean_text", text).filter(F.col("clean_text") != "")
