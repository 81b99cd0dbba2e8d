"""Document fingerprints: the k smallest distinct hashes of a text's shingles.

A bottom-k sketch is a uniform sample of the text's set of shingles that depends
on the set alone: sketches merge by taking the k smallest of their union, and
two sketches estimate resemblance, containment and distinct counts.  Shingles
have five words; a set of fewer than k shingles is held whole and compared
exactly.

Defined cases: a null, empty or blank text has an empty sketch; two empty
sketches are alike (1.0), an empty and another are not (0.0); rows with the same
id follow one another by text; extra columns are ignored; an empty table gives
an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcast.llm.common import bounded_batches, partitions
from postcast.llm.shingles import shingle_hashes

WORDS, K, SEED = 5, 128, 0
SLICE = 256
FIRST = -(1 << 63)  # a null id comes before all others


def sketch(text: str | None, k: int = K, words: int = WORDS) -> np.ndarray:
    """The k smallest distinct shingle hashes, ascending."""
    out = np.empty(0, np.uint64)
    for h in shingle_hashes(text, words, SEED):
        if len(out) == k:
            h = h[h < out[-1]]
        out = np.unique(np.concatenate([out, h]))[:k]
    return out


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def distinct_count(s: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(s)) if len(s) < k else (k - 1) * 2.0 ** 64 / float(s[k - 1])


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the union that both sets hold."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(np.intersect1d(a, b, assume_unique=True), union, assume_unique=True)
    return len(both) / len(union)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's set that b's holds."""
    if not len(a):
        return 1.0
    shared = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, shared / distinct_count(a, k))


def sketches(docs: DataFrame, keys: list[str] = ["doc_id"], text: str = "text", k: int = K,
             words: int = WORDS) -> DataFrame:
    """Key columns and ``sketch`` (packed little-endian unsigned hashes)."""
    bounded_batches(docs.sparkSession)
    src = docs.select(*keys, docs[text].alias("_text_"))
    schema = T.StructType([src.schema[c] for c in keys] + [T.StructField("sketch", T.BinaryType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [sketch(t, k, words).tobytes() for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in range(len(keys))]
                                                 + [pa.array(made, pa.binary())], names=schema.names)
    return src.mapInArrow(run, schema)


def merged(docs: DataFrame, by: list[str], text: str = "text", k: int = K, words: int = WORDS) -> DataFrame:
    """One sketch (ascending array of hashes as signed integers, offset by 2**63
    to sort) for each group of documents, such as a source.  Documents are
    sketched first, repeats are combined before the shuffle, and every task keeps
    its k smallest before they meet, so no group is gathered."""
    one = sketches(docs, by, text, k, words)

    def explode(batches):
        for b in batches:
            raw = b.column(b.num_columns - 1).to_pylist()
            rows = np.repeat(np.arange(len(raw)), [len(x) // 8 for x in raw])
            h = (np.frombuffer(b"".join(raw), "<u8") ^ np.uint64(1 << 63)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(rows)) for c in range(len(by))]
                                             + [pa.array(h)], names=[*by, "h"])
    schema = T.StructType([one.schema[c] for c in by] + [T.StructField("h", T.LongType())])
    hashes = one.mapInArrow(explode, schema).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("h"))
    return hashes.withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*by).agg(
        F.sort_array(F.collect_list("h")).alias("sketch"))


def compare_with_next(docs: DataFrame, k: int = K, words: int = WORDS) -> DataFrame:
    """Each document against the next one by ascending doc_id (after the last
    comes the first) and against its edited text, whose last half is replaced by
    as many first code points of the next.

    Returns doc_id, n_chars, edited, sketch, edited_sketch, near_edited and
    near_next.  The ids alone are cut into ranges; every range is then walked in
    order by one task, with the first document of the following range as its
    last row.  So the texts are shuffled once, and the driver sees one id per
    range."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = min(8 * partitions(spark), 1 << 16)  # ranges, of any size
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = src.select(F.coalesce("doc_id", F.lit(FIRST)).alias("_key"))
    at = [i / parts for i in range(1, parts)]
    found = ids.agg(F.percentile_approx("_key", at, 10 * parts)).first()[0]
    bounds = np.unique(np.array(found or [], np.int64))

    def number(batches):
        for b in batches:
            part = np.searchsorted(bounds, b.column(0).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), b.column(0)], names=["part", "_key"])
    heads = ids.mapInArrow(number, "part int, _key long").groupBy("part").agg(F.min("_key")).toPandas()
    heads = heads.sort_values("part").to_numpy(np.int64).reshape(-1, 2)
    # the first id of each range also goes to the range before it, the very first to the last
    first_ids, to = heads[:, 1], np.roll(heads[:, 0], 1)

    def deal(batches):
        for b in batches:
            key = b.column("doc_id").fill_null(FIRST).to_numpy()
            part = np.searchsorted(bounds, key, "right")
            hit = np.searchsorted(first_ids, key)
            also = np.flatnonzero((hit < len(first_ids)) & (first_ids[np.minimum(hit, len(first_ids) - 1)] == key))
            rows = np.concatenate([np.arange(len(key)), also])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([part, to[hit[also]]]), pa.int32()),
                 pa.array(np.repeat([0, 1], [len(key), len(also)]), pa.int32()),
                 *(b.column(c).take(pa.array(rows)) for c in ("doc_id", "text"))],
                names=["part", "after", "doc_id", "text"])
    dealt = src.mapInArrow(deal, "part int, after int, doc_id long, text string")
    walked = dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "after", "doc_id", "text")
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
        T.StructField("edited", T.StringType()), T.StructField("sketch", T.BinaryType()),
        T.StructField("edited_sketch", T.BinaryType()), T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType())])

    def walk(batches):
        before = None  # (part, doc_id, text, sketch) that waits for its next
        rows = []
        for b in batches:
            for part, after, doc_id, text in zip(*(b.column(c).to_pylist() for c in range(4))):
                if after and (before is None or before[0] != part):
                    continue  # a further row with the id of the next range's first
                text = text or ""
                own = sketch(text, k, words)
                if before is not None and before[0] == part:
                    _, its_id, its_text, its_sketch = before
                    n = len(its_text)
                    edited = its_text[:n - n // 2] + text[:n // 2]
                    other = sketch(edited, k, words)
                    rows.append((its_id, n, edited, its_sketch.tobytes(), other.tobytes(),
                                 resemblance(its_sketch, other, k), resemblance(its_sketch, own, k)))
                before = None if after else (part, doc_id, text, own)
                if len(rows) >= SLICE:
                    yield _batch(rows, schema.names)
                    rows = []
        if rows:
            yield _batch(rows, schema.names)
    return walked.mapInArrow(walk, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
