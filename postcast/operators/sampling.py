"""Sorts, limits and samples."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.constants import SAMPLE_FLOOR_DATE, STRATA
from postcast.operators.topn import seeded_take, top_n
from postcast.sources.items import (live_stories, per_group_limit, seeded_order,  # noqa: F401
                                    with_day_pruning)


def top_by_score(df: DataFrame, n: int) -> DataFrame:
    """L1: exact top n by score (desc), ties by id."""
    return top_n(df, n, "score", descending=True, tie=["id"])


def seeded_sample(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """N rows by the md5 order of id + seed (stable across engines and
    retries); when the table has at most n rows, all of them."""
    return seeded_take(df, id_col, seed, n, rank_col=None)


def random_sample(df: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    """L3: unseeded (or rand-seeded) sample of n rows."""
    r = F.rand(seed) if seed is not None else F.rand()
    return df.orderBy(r).limit(n)


def strata_quotas(total: int) -> list[int]:
    return [max(1, int(total * share)) for _, _, share in STRATA]


def score_stratum(score_col: str = "score"):
    """Stratum index of a score; null for scores below the first stratum."""
    s = F.col(score_col)
    out = F.lit(None).cast("int")
    for i, (lo, hi, _) in reversed(list(enumerate(STRATA))):
        cond = (s >= lo) if hi is None else ((s >= lo) & (s < hi))
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out


def stratified_sample(items: DataFrame, total: int, seed: int = 42,
                      floor_date: str = SAMPLE_FLOOR_DATE) -> DataFrame:
    """Per score stratum, quota max(1, int(total * share)) rows in the
    seeded md5 order; scores below 1 never appear; unused quota is not passed
    on.  All strata are cut together by one threshold each; the sample's ranks
    are counted over range partitions, so no stratum meets in one task."""
    quotas = strata_quotas(total)
    df = (with_day_pruning(live_stories(items), floor_date)
          .filter(F.col("time") >= F.to_timestamp(F.lit(floor_date)))
          .withColumn("stratum", score_stratum())
          .filter(F.col("stratum").isNotNull()))
    return seeded_take(df, "id", seed, dict(enumerate(quotas)), group="stratum",
                       rank_col="stratum_rank")
