"""The corpus pipeline: quality rules, line dedup, SimHash near-dedup, substring
dedup and best-fit packing, each stage on all that its predecessor kept.

Every stage takes and returns the columns of ``documents`` (the last one returns
token pieces with their places); where a stage changes a text, ``n_chars`` follows.
Documents that the quality rules reject and all but one of a group of near copies
go; the two dedup stages shorten texts and keep every document.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcast.llm import packing
from postcast.llm.common import Scratch, read_documents
from postcast.llm.line_dedup import dedup_lines
from postcast.llm.quality_rules import keep_good
from postcast.llm.queries import vocabulary
from postcast.llm.simhash import keep_first
from postcast.llm.substring_dedup import dedup_substrings
from postcast.session import ship_package


# Repeated runs of lines with fewer characters stay: headings, list marks and
# closing brackets that clean documents share.
LINE_CHARS = 30


def _with_new_text(docs: DataFrame, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The input's columns after a change of ``text``; the other columns travel in
    one struct, so none of their names can clash with the operator's."""
    rest = [c for c in docs.columns if c != "text"]
    boxed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"))
    done = change(boxed)
    kind = dict(docs.dtypes)
    columns = []
    for c in docs.columns:
        if c == "n_chars":
            columns.append(F.length("text").cast(kind[c]).alias(c))
        else:
            columns.append(F.col("text") if c == "text" else F.col(f"_rest.`{c}`"))
    return done.select(*columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule of the threshold table."""
    return keep_good(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later copies of repeated line runs."""
    return _with_new_text(docs, lambda d: dedup_lines(d, min_chars=LINE_CHARS))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (4-word shingles, 4 bits)."""
    ship_package(spark)
    return keep_first(docs, words=4, radius=4)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the spans that occur in an earlier document."""
    ship_package(spark)
    return _with_new_text(docs, dedup_substrings)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids (packed little-endian 32-bit) and places in
    sequences of at most 4096 tokens."""
    ship_package(spark)
    with open(vocabulary("word_bpe_49k.json"), encoding="utf-8") as f:
        pieces = packing.pieces(docs, f.read(), end_id=1, most=4096)
    return packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids")), order=["doc_id", "piece", "ids_crc32"])


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("best-fit packing", packing_stage),
]

# The token ids of the last stage are beyond SQL; tests compare the stages with
# brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written to the shared
    folder and read back as the next stage's input."""
    docs = read_documents(spark, sf_dir)
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
