"""M1: title embedding column.

Default: a JVM-side hashing encoder (tokenise -> HashingTF(dim) -> L2
normalise), no Python in the hot path.  Pluggable: any encoder factory runs in
an iterator pandas UDF, loaded once per Python worker and fed Arrow batches.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.constants import EMBEDDING_DIM


def hashing_embedding(df: DataFrame, text_col: str = "title", dim: int = EMBEDDING_DIM,
                      out: str = "embedding") -> DataFrame:
    """Same text -> same unit vector; empty text -> zero vector."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    src = df.withColumn("_txt", F.coalesce(F.col(text_col), F.lit("")))
    stages = [RegexTokenizer(inputCol="_txt", outputCol="_tok", pattern=r"(?U)\W+", toLowercase=True),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim),
              Normalizer(inputCol="_tf", outputCol="_nv", p=2.0)]
    res = PipelineModel(stages).transform(src)
    return (res.withColumn(out, vector_to_array("_nv", "float32"))
               .drop("_txt", "_tok", "_tf", "_nv"))


_ENCODERS: dict = {}


def encoder_embedding(df: DataFrame, text_col: str = "title",
                      *, factory: Callable[[], Callable[[list[str]], np.ndarray]],
                      out: str = "embedding", batch_size: int = 64) -> DataFrame:
    """Pluggable encoder as an iterator pandas UDF: the model is created once
    per worker process (``factory`` is called lazily), texts are encoded in
    batches of ``batch_size``."""
    from postcast.session import ship_package
    ship_package(df.sparkSession)
    make = factory
    key = uuid.uuid4().hex  # one per call: worker processes are reused

    @F.pandas_udf("array<float>")
    def enc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _ENCODERS.get(key)
        if model is None:
            model = _ENCODERS[key] = make()
        for s in batches:
            texts = s.fillna("").tolist()
            vecs = [model(texts[i:i + batch_size]) for i in range(0, len(texts), batch_size)]
            mat = np.concatenate(vecs) if vecs else np.zeros((0, 1), np.float32)
            yield pd.Series(list(mat))
    return df.withColumn(out, enc(F.col(text_col)))
