"""Feature table: 15 structural columns + embedding."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.constants import SMOOTHING_PRIOR
from postcast.functions.text import title_features, url_text_features
from postcast.functions.time import time_features
from postcast.operators.stats import domain_reputation
from postcast.schema import STRUCTURAL_FEATURES


def structural_features(clean: DataFrame, stats: DataFrame | None = None,
                        prior: float = SMOOTHING_PRIOR, keep: list[str] | None = None) -> DataFrame:
    """All 15 structural columns on the same rows (column-wise concatenation is
    just more columns on one DataFrame, keyed by id)."""
    cols = {}
    cols.update(title_features("title"))
    cols.update(time_features("time"))
    cols.update(url_text_features("domain", "clean_text"))
    df = domain_reputation(clean.withColumns(cols), stats, prior)
    return df.select(*(keep or ["id"]), *STRUCTURAL_FEATURES)


def fill_invalid(df: DataFrame, cols: list[str]) -> DataFrame:
    """null and NaN -> 0.0 on every feature column."""
    return df.withColumns({c: F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
                           for c in cols})


def feature_names(dim: int) -> list[str]:
    return STRUCTURAL_FEATURES + [f"emb_{i}" for i in range(dim)]


def assemble(df: DataFrame, embedding_col: str = "embedding", out: str = "features") -> DataFrame:
    """M2: one ML vector per row, 15 structural columns first, then the
    embedding.  VectorAssembler carries the names in the column metadata;
    handleInvalid='error' proves F7 ran."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    filled = fill_invalid(df, STRUCTURAL_FEATURES).withColumn(
        "_emb", array_to_vector(F.col(embedding_col)))
    va = VectorAssembler(inputCols=STRUCTURAL_FEATURES + ["_emb"], outputCol=out,
                         handleInvalid="error")
    return va.transform(filled).drop("_emb")
