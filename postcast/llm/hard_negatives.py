"""Hard-negative mining by threshold joins with norm bounds (after L2AP).

A threshold join finds all rows whose inner product with an anchor reaches the
anchor's threshold.  In a cell of anchors and rows (see ``cells``), dimensions are
put in order of their energy.  The inverted index of the cell's rows holds the head
of every row; its tail is left out where the norms of the tail and of the largest
anchor tail cannot reach the smallest threshold, and a row whose whole norm cannot
is left out altogether.  Posting lists are read in groups of dimensions: rows are in
order of their head's length, so a list is a slice and a group is one matrix product
of the anchors and the postings.  After a group, pairs go whose partial score and
remaining norms stay below the threshold.  What is left out of the index is added
for the pairs that remain, so scores are exact.

Thresholds start high and are lowered until the windows fill.  First the positives:
an anchor is done where a join finds enough rows of its label, as all rows above its
threshold were considered; the others go on to a lower one, the last of which lets
all rows in.  Then the negatives, by windows: a window of an anchor and a positive
is done where enough rows of another label lie between its threshold and the
positive's score, and the last threshold is the window's own lower end.  Cells keep
the first few rows per anchor or window and a row number merges them.  Of equal rows
(label and vector), only those with the smallest ids can be among the first, so the
others are left out before the search; equal rows therefore cost nothing.

Defined cases: rows with a null id, a null label, a null vector, or a null or
non-finite component take no part; a repeated row counts once; rows with one id and
different vectors or labels are rows of their own, but no "other" rows of each
other, and two positives of one id and score have one window; missing dimensions of shorter vectors count as zero; a negative positive
score has an empty window; scores are exact up to 2**53, and those beyond it, on
either side, count as that; extra columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.llm.cells import columns, first_of, in_cells, matrix
from postcast.llm.common import Scratch

GROUP = 16  # dimensions that are read before pairs are pruned
PAIRS = 1 << 21  # scores that a task holds at a time
POSITIVE_STEPS = (0.4, 0.2)  # thresholds, as parts of the anchor's product with itself
NEGATIVE_STEPS = (0.9,)  # as parts of the positive's score


def _tails(x: np.ndarray) -> np.ndarray:
    """Norms of what follows each dimension, with a zero at the end."""
    squares = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    return np.sqrt(np.concatenate([squares, np.zeros((len(x), 1))], axis=1))


def threshold_join(q: np.ndarray, y: np.ndarray, least: np.ndarray):
    """Pairs (anchor, row) with a score of at least ``least[anchor]``, as blocks of
    (anchor numbers, row numbers, scores)."""
    d = q.shape[1]
    order = np.argsort(-(q * q).sum(0) * (y * y).sum(0), kind="stable")
    q, y = q[:, order], y[:, order]
    tail_q, tail_y = _tails(q), _tails(y)
    slack = 1e-9 * (1 + tail_q[:, 0].max(initial=0) * tail_y[:, 0].max(initial=0))
    floor = least.min(initial=np.inf) - slack
    head = (tail_y * tail_q.max(0, initial=0) >= floor).sum(1) if floor > 0 else np.full(len(y), d)
    rows = np.argsort(-head, kind="stable")[:np.count_nonzero(head)] if d else np.arange(len(y))
    head, y, tail_y = np.minimum(head[rows], d), y[rows], tail_y[rows]
    index = np.where(np.arange(d) < head[:, None], y, 0.0)
    step = max(1, PAIRS // max(1, len(rows)))
    for a in range(0, len(q), step):
        part, low = q[a:a + step], least[a:a + step, None]
        tails = tail_q[a:a + step]
        at, score = np.arange(len(rows)), np.zeros((len(part), len(rows)))
        for lo in range(0, d, GROUP):
            hi = min(lo + GROUP, d)
            n = np.searchsorted(-head[at], -lo, "left")  # rows whose head goes beyond lo
            score[:, :n] += part[:, lo:hi] @ index[at[:n], lo:hi].T
            end = np.minimum(head[at], hi)
            if floor > 0 and lo > 0 and hi < d and len(at):
                alive = (score + tails[:, end] * tail_y[at, end] >= low - slack).any(0)
                if alive.sum() < 0.7 * len(at):  # smaller matrices from here on
                    at, score = at[alive], score[:, alive]
        end = head[at]
        i, j = np.nonzero(score + tails[:, end] * tail_y[at, end] >= low - slack)
        found = score[i, j]
        for s in range(0, len(i), 1 << 16):  # the tails that the index has not
            left, right = i[s:s + (1 << 16)], at[j[s:s + (1 << 16)]]
            if (head[right] < d).any():
                out = np.arange(d) >= head[right][:, None]
                found[s:s + (1 << 16)] += (part[left] * np.where(out, y[right], 0.0)).sum(1)
        keep = found >= low[i, 0]
        yield a + i[keep], rows[at[j[keep]]], found[keep]


def _first(keys: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the first ``k`` pairs of each key: higher scores, then smaller ids."""
    order = np.lexsort((ids, -score, keys))
    sorted_keys = keys[order]
    start = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]] if len(order) else np.empty(0, bool)
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[place < k]


def _long(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -2.0 ** 53, 2.0 ** 53).astype(np.int64)


def _table(schema: str, parts: list[list[np.ndarray]]) -> pa.Table:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.table({n: np.concatenate([np.empty(0, np.int64), *(p[k] for p in parts)]) for k, n in enumerate(names)})


def _positives(k: int, schema: str):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            y = matrix(right.column("e"))
            q = matrix(left.column("e"), y.shape[1])
            y = matrix(right.column("e"), q.shape[1])
            anchor, key, label, least = columns(left, "vec_id", "h", "label", "least")
            ids, labels = columns(right, "vec_id", "label")
            for i, j, score in threshold_join(q, y, least):
                own = (labels[j] == label[i]) & (ids[j] != anchor[i])
                i, j, score = i[own], j[own], score[own]
                n = _first(i, score, ids[j], k)
                parts.append([anchor[i[n]], key[i[n]], ids[j[n]], _long(score[n])])
        return _table(schema, parts)
    return kernel


def _negatives(k: int, schema: str):
    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            y = matrix(right.column("e"))
            q = matrix(left.column("e"), y.shape[1])
            y = matrix(right.column("e"), q.shape[1])
            anchor, key, label = columns(left, "vec_id", "h", "label")
            ids, labels = columns(right, "vec_id", "label")
            lists = left.column("windows").combine_chunks()
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            positive, top, low = (lists.flatten().field(n).to_numpy(zero_copy_only=False)
                                  for n in ("positive_id", "positive_score", "least"))
            owner = np.repeat(np.arange(len(anchor)), sizes)
            floor = np.full(len(anchor), np.inf)
            np.minimum.at(floor, owner, low)
            for i, j, score in threshold_join(q, y, floor):
                other = labels[j] != label[i]
                i, j, score = i[other], j[other], score[other]
                order = np.lexsort((ids[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                # place of (anchor, score) among all scores that occur, from the highest
                levels = np.unique(np.concatenate([score, top.astype(np.float64)]))
                level = len(levels) - np.searchsorted(levels, score)
                here = np.flatnonzero((owner >= i[0]) & (owner <= i[-1])) if len(i) else np.empty(0, int)
                goal = len(levels) - np.searchsorted(levels, top[here].astype(np.float64))
                size = len(levels) + 1
                start = np.searchsorted(i * size + level, owner[here] * size + goal, "left")
                at = start[:, None] + np.arange(k)
                inside = at < len(i)
                at = np.where(inside, at, 0)
                if len(i):
                    inside &= (i[at] == owner[here][:, None]) & (score[at] >= low[here][:, None])
                w, place = np.nonzero(inside)
                n, w = at[w, place], here[w]
                parts.append([anchor[owner[w]], key[owner[w]], positive[w], top[w], ids[j[n]], _long(score[n])])
        return _table(schema, parts)
    return kernel


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, label, e): the rows that take part, each once, with whole components."""
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                    & (F.abs(x.cast("double")) < float("inf")))
    e = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")).cast("double"))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
                         & good).select(F.col("vec_id").cast("long").alias("vec_id"),
                                        F.col("label").cast("long").alias("label"), e.alias("e")).distinct()


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, share: int = 80,
                   positive_steps: tuple = POSITIVE_STEPS, negative_steps: tuple = NEGATIVE_STEPS,
                   **blocks: int) -> DataFrame:
    """Per anchor and positive, the first rows of another label with a score from
    ``share`` percent of the positive's score up to it.  ``rows`` and ``anchors`` as
    ``quantised`` returns them.  Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score."""
    scratch = Scratch(rows.sparkSession, "hard_negatives")
    # of equal rows, the anchor itself and the first ones are enough
    few = first_of(rows, ["label", "e"], ["vec_id"], 1 + max(positives, negatives), "_n").drop("_n")
    rows = scratch.save(few, "rows")
    anchors = scratch.save(anchors.withColumn("h", F.xxhash64("label", "e")), "anchors")
    own = F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)
    key, todo, found = ["vec_id", "h"], anchors, []
    schema = "vec_id long, h long, positive_id long, positive_score long"
    for step in [*positive_steps, None]:
        least = F.lit(float("-inf")) if step is None else own * step
        hits = first_of(in_cells(todo.withColumn("least", least), rows, _positives(positives, schema), schema, **blocks),
                        key, [F.desc("positive_score"), "positive_id"], positives)
        hits = scratch.save(hits, "positives")
        found.append(hits)
        if step is None:
            break
        full = hits.where(F.col("rank") == positives).select(*key)
        found[-1] = hits.join(full, key, "left_semi")
        todo = scratch.save(todo.join(full, key, "left_anti"), "unfilled")
        if not todo.take(1):
            break
    pairs = found[0]
    for f in found[1:]:
        pairs = pairs.unionByName(f)
    pairs = scratch.save(pairs.where("positive_score >= 0").drop("rank").distinct(), "pairs")
    window = [*key, "positive_id", "positive_score"]
    schema = "vec_id long, h long, positive_id long, positive_score long, negative_id long, negative_score long"
    todo, found = pairs, []
    # whole numbers: the smallest score s with share * positive_score <= 100 * s
    low = F.expr(f"(positive_score * {share} + 99) div 100").cast("double")
    for step in [*negative_steps, None]:
        least = low if step is None else F.greatest(low, F.col("positive_score") * F.lit(step))
        asked = todo.withColumn("least", least).groupBy(*key).agg(
            F.collect_list(F.struct("positive_id", "positive_score", "least")).alias("windows"))  # one for each positive
        hits = in_cells(anchors.join(asked, key), rows, _negatives(negatives, schema), schema, **blocks)
        hits = scratch.save(first_of(hits, window, [F.desc("negative_score"), "negative_id"], negatives), "negatives")
        found.append(hits)
        if step is None:
            break
        full = hits.where(F.col("rank") == negatives).select(*window)
        found[-1] = hits.join(full, window, "left_semi")
        todo = scratch.save(todo.join(full, window, "left_anti"), "open")
        if not todo.take(1):
            break
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.select(F.col("vec_id").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score",
                      "negative_score")
