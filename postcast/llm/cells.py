"""A stated set of queries against all rows, in blocks.

Queries and rows are dealt to blocks by a hash; a cell is one block of queries and
one of rows, and both meet in one task (a cogroup over Arrow tables).  Blocks have a
bounded number of rows, so the work and memory of a task are bounded, whatever ids
or vectors are frequent; small tables are dealt to as many blocks as there are
shuffle partitions.  Nothing passes through the driver but two row counts."""
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postcast.llm.common import partitions

QUERY_BLOCK, ROW_BLOCK = 2048, 8192
LEAST = 256  # rows of a block, if there are so many


def in_cells(queries: DataFrame, rows: DataFrame, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str,
             query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """What ``kernel`` returns for each cell; both tables have ``vec_id``."""
    n_q, n_r = queries.count(), rows.count()
    wide = max(1, -(-n_q // query_block))
    long = max(1, -(-n_r // row_block), min(partitions(rows.sparkSession) // wide, n_r // LEAST))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64(*df.columns), F.lit(blocks)).cast("int")
        return df.select("*", mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))
    left = dealt(queries, "_q", wide, "_r", long).groupBy("_q", "_r")
    right = dealt(rows, "_r", long, "_q", wide).groupBy("_q", "_r")
    return left.cogroup(right).applyInArrow(kernel, schema)


def matrix(column: pa.ChunkedArray, width: int = 0) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    lists = column.combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width, int(sizes.max(initial=0)))
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) == width * len(sizes):
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def first_of(df: DataFrame, keys: list[str], order: list, k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each key with their ranks; the bound is applied before
    the shuffle too."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)
