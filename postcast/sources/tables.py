"""Readers for the parquet tables the jobs start from."""
from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan; projections and filters applied later reach the scan."""
    return spark.read.parquet(table_path(sf_dir, name))


def read_files(spark: SparkSession, paths: list[str], schema=None) -> DataFrame:
    """One scan over an explicit list of files or globs (e.g. the month
    files of chosen years), with a declared schema so no file is opened for
    inference.  For chosen years of a folder laid out as ``.../year=YYYY/``, see
    ``read_years``."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*paths)


def read_years(spark: SparkSession, base: str, years: list[int], schema=None) -> DataFrame:
    """The ``year=YYYY`` folders of the listed years under ``base``, each once, with
    the column ``year`` read from their names.  Only these folders are listed and
    scanned; years without a folder hold no rows, and where none of them has one the
    result is empty with the declared schema (without one, that is an error)."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    from postcast.sources.items import _exists
    folders = [(y, os.path.join(base, f"year={y}")) for y in sorted(set(years))]
    found = [path for _, path in folders if _exists(spark, path)]
    whole = StructType([*schema.fields, StructField("year", IntegerType())]) if schema is not None else None
    if not found:
        if whole is None:
            raise FileNotFoundError(f"none of the years {sorted(set(years))} under {base}")
        return spark.createDataFrame([], whole)
    reader = spark.read.option("basePath", base)
    return (reader.schema(whole) if whole is not None else reader).parquet(*found)
