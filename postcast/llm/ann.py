"""Approximate nearest neighbours by randomly rotated one-bit codes (after RaBitQ).

The index holds one bit per dimension.  A vector is scaled to length one, the mean of
all such vectors (over every row, one sum per dimension) is taken off, and what is
left, scaled to length one again, is turned by a seeded random rotation of ``bits``
dimensions; its code are the signs.  Three correction scalars go with the packed
bits: the inner product of the code and the turned vector, the length of the part
that was left, and the vector's inner product with the mean.

A query is turned likewise, rounded to ``QUERY_BITS`` bits and cut into bit planes,
so its inner product with a code is a weighted count of common bits.  Divided by the
first scalar this estimates the inner product of the two turned vectors without bias;
the error is below ``spread`` standard deviations, which follow from the same scalar
and the number of bits.  In a cell of queries and rows (see ``cells``), the rows with
the best estimates are scored exactly, and every row whose estimate and error bound
together reach the k-th score, or the k-th lower bound, is scored too.  Only a row
whose error exceeds its bound can be missed.  A row number merges the cells.

Of equal vectors only the k + 1 smallest ids can be among the k nearest, so the
others are left out before the index is built.

Defined cases: null ids, null, empty and zero vectors and vectors with a null or
non-finite component take no part; a repeated row counts once; rows with one id and
different vectors are rows of their own, but no candidates of each other; missing
dimensions of shorter vectors count as zero; ties go to the smaller id; extra columns
are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcast.llm.cells import columns, first_of, in_cells, matrix
from postcast.llm.common import Scratch

BITS = 128  # least number of bits of a code
QUERY_BITS = 6
SPREAD = 2.0  # standard deviations of the error bound
FIRST = 64  # rows of a cell that are scored first
PAIRS = 1 << 21  # estimates that a task holds at a time
SEED = 42

_ROTATIONS: dict = {}


def rotation(bits: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    if (bits, seed) not in _ROTATIONS:
        _ROTATIONS.clear()
        q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))
        _ROTATIONS[bits, seed] = q * np.sign(np.diag(r))
    return _ROTATIONS[bits, seed]


def _measured(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and their lengths; extreme ones scaled, so that squares fit."""
    most = np.abs(x).max(1, initial=0)
    far = (most > 1e140) | (most < 1e-140)
    if far.any():
        x = x / np.where(far & (most > 0), most, 1.0)[:, None]
    return x, np.sqrt((x * x).sum(1))


def turned(x: np.ndarray, centre: np.ndarray, bits: int, seed: int):
    """Turned unit vectors, the lengths of what was left beside the centre, and the
    inner products with the centre."""
    x, size = _measured(x)
    unit = (x / size[:, None])[:, :len(centre)]  # no row has what goes beyond
    rest = unit - centre
    left = np.sqrt((rest * rest).sum(1))
    rest = rest / np.where(left > 0, left, 1.0)[:, None]
    return rest @ rotation(bits, seed)[:rest.shape[1]], left, unit @ centre


def encode(x: np.ndarray, centre: np.ndarray, bits: int, seed: int):
    """Packed signs (uint64 words) and the three correction scalars."""
    y, left, along = turned(x, centre, bits, seed)
    words = np.packbits(y > 0, axis=1).view("<u8")
    return words, np.abs(y).sum(1) / np.sqrt(bits), left, along


def estimates(q: np.ndarray, words: np.ndarray, match: np.ndarray, spread: float):
    """Estimated inner products of turned queries with coded vectors, and their error
    bounds."""
    bits = q.shape[1]
    low = q.min(1)
    step = np.maximum((q.max(1) - low) / (2 ** QUERY_BITS - 1), 1e-12)
    level = np.rint((q - low[:, None]) / step[:, None]).astype(np.uint8)
    common = np.zeros((len(q), len(words)), np.int32)
    for n in range(QUERY_BITS):
        plane = np.packbits(level >> n & 1, axis=1).view("<u8")
        for w in range(words.shape[1]):
            common += np.bitwise_count(plane[:, w, None] & words[None, :, w]).astype(np.int32) << n
    ones = np.bitwise_count(words).sum(1, dtype=np.int64)
    rounded = low[:, None] + step[:, None] * level
    code = 2 * (low[:, None] * ones + step[:, None] * common) - rounded.sum(1)[:, None]
    match = np.maximum(match, 1e-9)
    error = np.sqrt(np.maximum(1 - match * match, 0) / (bits - 1)) + step[:, None] / np.sqrt(12)
    return code / (np.sqrt(bits) * match), spread * error / match


def cosines(q, q_size, y, y_size, i, j) -> np.ndarray:
    out = np.empty(len(i))
    for s in range(0, len(i), 1 << 15):
        a, b = i[s:s + (1 << 15)], j[s:s + (1 << 15)]
        out[s:s + (1 << 15)] = (q[a] * y[b]).sum(1) / (q_size[a] * y_size[b])
    return out


def nearest(q_ids, q, ids, y, code, centre: np.ndarray, k: int, bits: int, seed: int, spread: float):
    """(query id, row id, cosine) of the k nearest found of each query in one cell,
    and the number of exact scores."""
    words, match, left, along = code
    turned_q, left_q, along_q = turned(q, centre, bits, seed)
    (q, q_size), (y, y_size) = _measured(q), _measured(y)
    out, scored = [], 0
    step = max(1, PAIRS // max(1, len(ids)))
    for a in range(0, len(q), step):
        part = slice(a, a + step)
        inner, error = estimates(turned_q[part], words, match, spread)
        scale = left_q[part, None] * left
        guess = inner * scale + along_q[part, None] + along - centre @ centre
        error = error * scale + 1e-12
        guess[q_ids[part, None] == ids] = -np.inf
        # the k-th of some exact scores, and the k-th lower bound
        kk, some = min(k, len(ids)), min(max(8 * k, FIRST), len(ids))
        best = np.argpartition(-guess, some - 1, axis=1)[:, :some]
        first = cosines(q[part], q_size[part], y, y_size, np.repeat(np.arange(len(best)), some), best.ravel())
        first = np.where(np.isneginf(np.take_along_axis(guess, best, 1)), -np.inf, first.reshape(best.shape))
        reach = np.maximum(np.partition(first, some - kk, axis=1)[:, some - kk],
                           np.partition(guess - error, len(ids) - kk, axis=1)[:, len(ids) - kk])
        i, j = np.nonzero((guess + error >= reach[:, None]) & ~np.isneginf(guess))
        score = cosines(q[part], q_size[part], y, y_size, i, j)
        scored += len(i) + first.size
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.empty(0, bool)
        keep = np.arange(len(i)) - np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) < k
        out.append((q_ids[a + i[keep]], ids[j[keep]], score[keep]))
    if not out:
        return (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)), 0
    return tuple(np.concatenate(c) for c in zip(*out)), scored


def usable(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """(vec_id, v): the rows that take part, each once."""
    v = F.col(vec)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & good & F.exists(v, lambda x: x != 0)) \
        .select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).distinct()


class Index:
    """Written table (vec_id, v, words, match, left, along) with what its codes were
    made with."""

    def __init__(self, rows: DataFrame, centre: np.ndarray, bits: int, seed: int):
        self.rows, self.centre, self.bits, self.seed = rows, centre, bits, seed


def mean_direction(rows: DataFrame, width: int) -> np.ndarray:
    """Mean of all vectors, each scaled to length one: one sum per dimension."""
    def sums(batches):
        for batch in batches:
            if batch.num_rows:
                x, size = _measured(matrix(pa.chunked_array([batch.column(0)]), width))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array((x / size[:, None]).sum(0)),
                                                  pa.array(np.full(width, batch.num_rows))], names=["at", "s", "n"])
    total = rows.select("v").mapInArrow(sums, "at long, s double, n long").groupBy("at").agg(
        (F.sum("s") / F.sum("n")).alias("mean"))
    out = np.zeros(width)
    for r in total.collect():  # one row per dimension
        out[r["at"]] = r["mean"]
    return out


def build_index(rows: DataFrame, k: int, bits: int = BITS, seed: int = SEED) -> Index:
    """Index of ``usable`` rows for searches of up to k neighbours."""
    scratch = Scratch(rows.sparkSession, "ann")
    few = scratch.save(first_of(rows, ["v"], ["vec_id"], k + 1, "_n").drop("_n"), "distinct")
    width = few.agg(F.max(F.size("v"))).first()[0] or 0
    bits = -(-max(bits, width) // 64) * 64
    centre = mean_direction(few, width)
    schema = T.StructType([*few.schema.fields, T.StructField("words", T.BinaryType()),
                           *(T.StructField(n, T.DoubleType()) for n in ("match", "left", "along"))])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(pa.chunked_array([batch.column(1)]), width)
                words, *scalars = encode(x, centre, bits, seed)
                packed = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(
                    np.arange(0, len(words) * bits // 8 + 1, bits // 8, dtype="<i4").tobytes()),
                    pa.py_buffer(words.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), packed, *map(pa.array, scalars)],
                                                 names=schema.names)
    return Index(scratch.save(few.mapInArrow(run, schema), "index"), centre, bits, seed)


def search(queries: DataFrame, index: Index, k: int, spread: float = SPREAD, **blocks: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found of each query (rows
    (vec_id, v) as ``usable`` returns them), which is never its own neighbour."""
    centre, bits, seed = index.centre, index.bits, index.seed
    width = len(centre)
    schema = "query_id long, vec_id long, score double"

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        found = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        if left.num_rows and right.num_rows:
            packed = right.column("words").combine_chunks()
            words = np.frombuffer(b"".join(packed.to_pylist()), "<u8").reshape(-1, bits // 64)
            q = matrix(left.column("v"), width)
            y = matrix(right.column("v"), q.shape[1])
            found, _ = nearest(*columns(left, "vec_id"), q, *columns(right, "vec_id"), y,
                               (words, *columns(right, "match", "left", "along")), centre, k, bits, seed, spread)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found)))
    hits = in_cells(queries.select("vec_id", "v"), index.rows, kernel, schema, **blocks)
    return first_of(hits, ["query_id"], [F.desc("score"), "vec_id"], k).select("query_id", "rank", "vec_id", "score")
