"""Skew-safe running totals and ranks.

A window ordered over a whole table (or over one huge group) runs in a single
task.  ``running_total`` instead range-partitions on (group, order) so a hot
group is spread over many partitions, sums along each sorted partition in the same
stage (one shuffle of the rows), and adds the totals of the earlier pieces of the
same group.  The piece table has at most (partitions + groups) rows.  Callers pass
pre-aggregated input where they can (distinct scores with counts), so the
checkpointed table is the distinct-key table, not the raw rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from postcast.session import shared_dir, ship_package


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _sums_along(batches):
    """Place and running sum of ``_w`` along a partition, batch by batch."""
    import numpy as np
    import pyarrow as pa
    at = total = 0
    for b in batches:
        w = b.column("_w").to_numpy(zero_copy_only=False)
        sums = total + np.cumsum(w, dtype=np.int64)
        yield (b.append_column("_at", pa.array(np.arange(at, at + len(w)), pa.int64()))
               .append_column("_sum", pa.array(sums, pa.int64())))
        at, total = at + len(w), int(sums[-1]) if len(w) else total


def running_total(df: DataFrame, group_cols: list[str], order_cols: list,
                  weight: Column | str | None = None, out: str = "running",
                  partitions: int | None = None) -> DataFrame:
    """Inclusive running sum of ``weight`` (whole numbers, null as 0; default 1) along ``order_cols``
    within each group.  With unique order keys and weight 1 it is row_number."""
    w = F.lit(1) if weight is None else (
        F.col(weight) if isinstance(weight, str) else weight)
    n = partitions or _partitions(df)
    keys = [F.col(c) for c in group_cols] + [F.col(c) if isinstance(c, str) else c
                                             for c in order_cols]
    # Range bounds come from sampling and may differ between two evaluations
    # of the same plan, so the piece id is fixed once by a reliable checkpoint
    # (shared folder; survives executor loss) before both branches read it.
    shared_dir(df.sparkSession)
    ship_package(df.sparkSession)
    dealt = (df.withColumn("_w", F.coalesce(w.cast("long"), F.lit(0).cast("long")))
             .repartitionByRange(n, *keys).sortWithinPartitions(*keys)
             .withColumn("_pid", F.spark_partition_id()))
    schema = StructType([*dealt.schema.fields, StructField("_at", LongType()), StructField("_sum", LongType())])
    r = dealt.mapInArrow(_sums_along, schema).checkpoint(eager=True)
    # ``_sum`` runs over the whole partition: what stood before a piece's first row is taken off again
    pieces = r.groupBy("_pid", *group_cols).agg(F.sum("_w").alias("_tot"),
                                                F.min_by(F.col("_sum") - F.col("_w"), "_at").alias("_start"))
    before = Window.partitionBy(*group_cols).orderBy("_pid") \
                   .rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("_pid", *group_cols,
                           (F.coalesce(F.sum("_tot").over(before), F.lit(0)) - F.col("_start")).alias("_off"))
    p = pieces.select(F.col("_pid").alias("_pp"), F.col("_off"),
                      *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group_cols)])
    cond = [r["_pid"] == p["_pp"]] + [r[c].eqNullSafe(p[f"_g{i}"])
                                      for i, c in enumerate(group_cols)]
    out_df = r.join(p, on=cond, how="inner") \
              .withColumn(out, (F.col("_sum") + F.col("_off")).cast("long"))
    return out_df.drop("_w", "_pid", "_at", "_sum", "_off", "_pp",
                       *[f"_g{i}" for i in range(len(group_cols))])


def row_number(df: DataFrame, group_cols: list[str], order_cols: list, out: str = "rank") -> DataFrame:
    """Exact row_number per group; order keys must be unique within a group (add
    the row key as the last tie-break).  The running count over range partitions
    spreads a hot group over many tasks, whatever the sizes."""
    return running_total(df, group_cols, order_cols, None, out)
