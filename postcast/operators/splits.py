"""Train/validation/test splits (P1-P4): row flags, no sort, no positional cut."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcast.constants import (SPLIT_SEED, TEMPORAL_CUTOFF, TEST_FRACTION, VALIDATION_FRACTION,
                                VALIDATION_MIN_ROWS)


def temporal_split(df: DataFrame, time_col: str = "time", cutoff: str = TEMPORAL_CUTOFF,
                   out: str = "is_validation") -> DataFrame:
    """train = time < cutoff; validation = the rest (null time included)."""
    train = F.coalesce(F.col(time_col) < F.to_timestamp(F.lit(cutoff)), F.lit(False))
    return df.withColumn(out, ~train)


def hash_threshold(fraction: float) -> str:
    return format(int(fraction * 16 ** 8), "08x")


def hash_below(id_col: str, fraction: float, salt: str) -> Column:
    """True for about ``fraction`` of the ids: the first 8 hex digits of
    md5('<id>:<salt>') below fraction * 16^8.  Stable under repartitioning and
    task retries (randomSplit is not), and the same rows in any engine."""
    h = F.substring(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{salt}"))), 1, 8)
    return h < F.lit(hash_threshold(fraction))


def hash_key(id_col: str, salt: str) -> Column:
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{salt}")))


def exact_share(df: DataFrame, id_col: str, rows: int, salt: str) -> Column:
    """True for exactly ``rows`` rows of ``df``: those with the smallest
    md5('<id>:<salt>') (ties by id).  The last admitted (key, id) is found by
    counting key digits (``topn.thresholds``); the flag is then a comparison with
    it, without a sort, a join or a window."""
    from postcast.operators.topn import admitted, thresholds
    if rows <= 0:
        return F.lit(False)
    k = hash_key(id_col, salt)
    last = thresholds(df.select(F.lit(0).alias("_g"), k.alias("_h"), F.col(id_col).alias("_i")), {0: rows})
    return admitted(k, F.col(id_col), last.get(0))


def hash_split(df: DataFrame, id_col: str, test_fraction: float = TEST_FRACTION,
               seed: int = SPLIT_SEED, out: str = "is_test", exact: bool = True) -> DataFrame:
    """Seeded random test part of exactly int(n * test_fraction) rows, the
    smallest md5('<id>:<seed>') keys (stable under repartitioning and retries,
    the same rows in any engine).  ``exact=False`` gives the one-pass
    expression cut with only approximately that share."""
    if not exact:
        return df.withColumn(out, hash_below(id_col, test_fraction, str(seed)))
    n = df.count()
    return df.withColumn(out, exact_share(df, id_col, int(n * test_fraction), str(seed)))


def validation_tail(df: DataFrame, id_col: str, fraction: float = VALIDATION_FRACTION,
                    seed: int = SPLIT_SEED, train_flag: str = "is_test",
                    out: str = "is_validation", min_rows: int = VALIDATION_MIN_ROWS,
                    exact: bool = True) -> DataFrame:
    """max(int(n_train * fraction), min_rows) training rows chosen by an
    independent second key, md5('<id>:val<seed>'), as validation."""
    if not exact:
        inside = ~F.col(train_flag) & hash_below(id_col, fraction, f"val{seed}")
        return df.withColumn(out, inside)
    train = df.filter(~F.col(train_flag))
    n = train.count()
    rows = min(max(int(n * fraction), min_rows), n)
    return df.withColumn(out, ~F.col(train_flag) & exact_share(train, id_col, rows, f"val{seed}"))


def fallback_split(df: DataFrame, time_col: str, id_col: str, cutoff: str = TEMPORAL_CUTOFF,
                   test_fraction: float = TEST_FRACTION, seed: int = SPLIT_SEED,
                   out: str = "is_validation") -> DataFrame:
    """The temporal split, unless its training side is empty; then the
    seeded split of P3 (exactly int(n * test_fraction) validation rows by md5
    key), never a positional cut."""
    cut = F.to_timestamp(F.lit(cutoff))
    if df.filter(F.col(time_col) < cut).limit(1).count() > 0:
        return df.withColumn(out, ~F.coalesce(F.col(time_col) < cut, F.lit(False)))
    n = df.count()
    return df.withColumn(out, exact_share(df, id_col, int(n * test_fraction), str(seed)))
