"""SimHash near-duplicates with a bit-sliced comparison.

Fingerprint: A-Z lower-cased words, shingles of some words with repeats, XXH64
of each; a bit is set if it is set in over half of the hashes.  Two fingerprints
within the radius agree in at least three of seven bit blocks, so every
fingerprint is listed under the 35 choices of three blocks, and only
fingerprints under one key are compared.  There the fingerprints stand as 64 bit
planes; each plane updates all distances at once through carry-save counters,
and a block is left as soon as all its distances exceed the radius.  Links of a
key are reduced to a spanning star before they leave the task, and components
are found by the distributed contraction in ``common``.

Equal fingerprints are one node from the start, so copies are never paired.
Keys with more than ``RUN`` fingerprints are cut into blocks of about that size
and compared block against block in separate tasks, all of them.

Defined cases: a null, empty or blank text has fingerprint zero and links like
any other; fewer words than a shingle give one shingle; repeated rows have the
same fingerprint and component; extra columns are ignored; an empty table gives
an empty result.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcast.llm.common import Scratch, bounded_batches, connected_components, partitions
from postcast.llm.shingles import shingle_hashes

WORDS, RADIUS, SEED = 4, 4, 42
WIDTHS = (10, 9, 9, 9, 9, 9, 9)
AGREE = 3
RUN = 2048
SMALL = 48
SLICE = 256


# ------------------------------------------------------------ fingerprints

def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of one text, unsigned."""
    counts, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, words, SEED):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: list[str] = ["doc_id"], text: str = "text", words: int = WORDS) -> DataFrame:
    """Key columns and ``fp``, the fingerprint as a signed 64-bit integer."""
    bounded_batches(docs.sparkSession)
    src = docs.select(*keys, docs[text].alias("_text_"))
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField("fp", T.LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                fps = [fingerprint(t, words) for t in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(k) for k in range(len(keys))] + [pa.array(np.array(fps, np.uint64).view(np.int64))],
                    names=schema.names)
    return src.mapInArrow(run, schema)


# ------------------------------------------------------------ comparison

def bit_planes(fps: np.ndarray) -> np.ndarray:
    """64 rows, one per bit, each the packed bits of all fingerprints."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T, axis=1, bitorder="little")


def within(planes, shape: tuple[int, ...], radius: int) -> np.ndarray:
    """Packed flags: at most ``radius`` (under 8) of the difference planes set.

    Three counters per position add a plane at a time; what overflows them or
    exceeds the radius stays out.  When nothing is left inside, it ends."""
    one, two, four, out = (np.zeros(shape, np.uint8) for _ in range(4))
    for b, plane in enumerate(planes):
        carry = one & plane
        one = one ^ plane
        more = two & carry
        two = two ^ carry
        out |= four & more
        four = four ^ more
        if b % 8 == 7 and ((out | _over(one, two, four, radius)) == 0xFF).all():
            return np.zeros(shape, np.uint8)
    return ~(out | _over(one, two, four, radius))


def _over(one, two, four, radius: int) -> np.ndarray:
    """Packed flags: the counters hold more than ``radius``."""
    over, same = np.zeros_like(one), np.full_like(one, 0xFF)
    for weight, counter in ((4, four), (2, two), (1, one)):
        if radius & weight:
            same = same & counter
        else:
            over = over | (same & counter)
            same = same & ~counter
    return over


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """For aligned pairs: True where the two are within the radius."""
    planes = bit_planes(a ^ b)
    return np.unpackbits(within(planes, planes.shape[1:], radius), bitorder="little")[:len(a)].astype(bool)


def links_between(queries: np.ndarray, members: np.ndarray, radius: int, group: int = 64):
    """(query index, member index) of all pairs within the radius: groups of
    queries against all members at once."""
    planes = bit_planes(members)
    found_q, found_m = [], []
    for at in range(0, len(queries), group):
        q = queries[at:at + group]
        ask = -((q[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1)).astype(np.uint8)
        near = within((planes[b][None, :] ^ ask[b][:, None] for b in range(64)), (len(q), planes.shape[1]), radius)
        i, j = np.nonzero(np.unpackbits(near, axis=1, bitorder="little")[:, :len(members)])
        found_q.append(i + at)
        found_m.append(j)
    return np.concatenate(found_q), np.concatenate(found_m)


def star(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links reduced to (member, smallest member of its part)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x
    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    return [(x, r) for x in list(parent) if (r := root(x)) != x]


def block_keys(fp: Column) -> Column:
    """array<long>: one key per choice of agreeing blocks."""
    blocks, at = [], 0
    for width in WIDTHS:
        blocks.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1)), width))
        at += width
    keys = []
    for number, chosen in enumerate(combinations(range(len(WIDTHS)), AGREE)):
        key = F.lit(number).cast("long")
        for c in chosen:
            bits, width = blocks[c]
            key = F.shiftleft(key, width).bitwiseOR(bits)
        keys.append(key)
    return F.array(*keys)


def _links_of_runs(radius: int):
    """Over rows (key, i, j, side, fp) sorted by key, i, j: spanning links of
    each run.  A run is a key's whole group, or, for a cut key, the blocks i and
    j; then side tells the block, and i = j compares a block with itself."""
    def run(batches):
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            cols = [held.column(c).to_numpy() for c in ("key", "i", "j")]
            last = np.ones(held.num_rows, bool)
            last[:-1] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
            ends = np.flatnonzero(last)
            if len(ends) < 2:
                continue
            done = ends[-2] + 1  # the last run may go on
            yield from compare(held.slice(0, done))
            held = held.slice(done)
        if held is not None and held.num_rows:
            yield from compare(held)

    def compare(t: pa.Table):
        key, i, j, side = (t.column(c).to_numpy() for c in ("key", "i", "j", "side"))
        fp = t.column("fp").to_numpy().view(np.uint64)
        new = np.ones(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(fp)))
        a, b = [], []
        small = np.repeat((sizes <= SMALL) & (i[starts] == j[starts]), sizes)
        number = np.repeat(np.arange(len(starts)), sizes)
        for d in range(1, SMALL):  # small runs of this batch together: row against the row d below
            at = np.flatnonzero(small[:-d] & (number[d:] == number[:-d])) if len(fp) > d else []
            if not len(at):
                break
            near = at[close_pairs(fp[at], fp[at + d], radius)]
            a.append(fp[near])
            b.append(fp[near + d])
        for s, n in zip(starts.tolist(), sizes.tolist()):
            if small[s]:
                continue
            part = fp[s:s + n]
            if i[s] == j[s]:
                x, y = links_between(part, part, radius)
                keep = x < y
                links = star(part[x[keep]], part[y[keep]])
            else:
                left, right = part[side[s:s + n] == 0], part[side[s:s + n] == 1]
                if not len(left) or not len(right):
                    continue
                x, y = links_between(left, right, radius)
                links = star(left[x], right[y])
            a.append(np.array([u for u, _ in links], np.uint64))
            b.append(np.array([v for _, v in links], np.uint64))
        if a:
            links = star(np.concatenate(a), np.concatenate(b))
            if links:
                pairs = np.array(links, np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
    return run


def fingerprint_links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, run: int = RUN) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect just what
    all pairs within the radius connect."""
    if radius > len(WIDTHS) - AGREE:
        raise ValueError("the bit blocks find pairs up to 4 bits apart")
    spark = distinct.sparkSession
    keyed = distinct.select(F.explode(block_keys(F.col("fp"))).alias("key"), "fp")
    shared = scratch.save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared_keys")
    cut = F.ceil(F.col("n") / run).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("_s")).cast("int")
    found = keyed.join(shared, "key").withColumn("_s", cut).withColumn("_b", mine)
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("_s") - 1), lambda o: F.struct(
        F.least("_b", o).alias("i"), F.greatest("_b", o).alias("j"),
        F.when(F.col("_b") <= o, 0).otherwise(1).alias("side"))))
    rows = found.select("key", "fp", pair.alias("_p")).select("key", "_p.i", "_p.j", "_p.side", "fp")
    rows = rows.repartition(partitions(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j", "fp")
    return rows.mapInArrow(_links_of_runs(radius), "a long, b long")


def near_duplicates(docs: DataFrame, keys: list[str] = ["doc_id"], text: str = "text", words: int = WORDS,
                    radius: int = RADIUS) -> DataFrame:
    """Key columns, ``fp`` and ``first``: the smallest key (struct) that can be
    reached over links.  One row per input row."""
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.save(fingerprints(docs, keys, text, words), "fingerprints")
    distinct = scratch.save(marked.groupBy("fp").agg(F.min(F.struct(*keys)).alias("first")), "distinct")
    links = scratch.save(fingerprint_links(distinct.select("fp"), scratch, radius), "links")
    parts = connected_components(links, scratch)
    nodes = scratch.save(distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("root")), "nodes")
    least = scratch.save(nodes.groupBy("root").agg(F.min("first").alias("first")), "least")
    member = nodes.drop("first").join(least, "root").select("fp", "first")
    return marked.join(member, "fp")


def keep_first(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each group: the one with the smallest (doc_id, hash of
    the text); of repeated rows one.  The input's columns."""
    named = docs.select(F.struct(F.col("doc_id").alias("d"), F.xxhash64("text").alias("t")).alias("_k"),
                        F.struct("*").alias("_all"), F.col("text").alias("_text"))
    groups = near_duplicates(named, ["_k"], "_text", words, radius)
    stay = groups.where(F.col("first._k") == F.col("_k")).select("_k").distinct()
    once = Window.partitionBy("_k").orderBy("_k")
    return named.drop("_text").join(stay, "_k").withColumn("_n", F.row_number().over(once)) \
        .where("_n = 1").select("_all.*")
