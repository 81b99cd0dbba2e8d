"""Softmax boosting of the five reception classes (M4).

A round grows one regression tree per class on the probability residuals of the rounds
before it, all classes in the same passes.  Rows are binned once (one byte a feature),
packed by a few thousand with a feature's bins side by side, and stay where they are;
held-out rows are apart, as only the first pass of a round reads them.  A level of a
round is one job of a task for each core (more only for large tables): every task sums
gradient, curvature and number of its rows by (class, node, feature, bin), the histograms
meet by (class, node, block of features), where the best split of the block is chosen, and only those
splits (classes x nodes x blocks rows, whatever the corpus) come to the driver.  The
first pass of a round also measures the log loss of the held-out rows, so stopping needs
no pass of its own.  Every ``WRITE_EVERY`` rounds the rows are written with their
margins, which bounds the trees that a pass has to walk and the work after a loss.

Gradients are rounded to multiples of 2**-20, so their sums are exact in any order: a
retried task or another partitioning gives the same trees."""
from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.constants import LOGLOSS_EPS, N_CLASSES
from postcast.functions.labels import reception_class
from postcast.operators.sampling import seeded_sample
from postcast.operators.shapley import Tree
from postcast.session import few_rows_a_batch, scratch_path, ship_package

WRITE_EVERY = 16
BLOCK = 32       # features whose histograms meet in one place
UNIT = 2.0 ** 20
PACK_ROWS = 8192    # rows of a pack
POINTS = 1 << 27    # bins that a task reads


@dataclass
class Boosting:
    """``patience`` rounds of ``step`` go about as far as 50 rounds of 0.05: a round costs
    ``depth`` small jobs, so few larger steps are the default.
    ``edge_rows`` bounds the sample that the bin edges are read from; the trees see
    every row."""
    rounds: int = 500
    step: float = 0.25
    patience: int = 10
    depth: int = 4
    bins: int = 32
    row_share: float = 0.8
    bag_every: int = 5
    feature_share: float = 0.8
    min_rows: int = 20
    min_curvature: float = 1e-3
    penalty: float = 1.0
    edge_rows: int = 20_000
    seed: int = 42


class GrownTree:
    """Nodes as growing lists; children -1 at leaves, ``cut`` the last bin that goes left."""

    def __init__(self):
        self.left, self.right, self.feature, self.cut, self.threshold = [-1], [-1], [0], [0], [0.0]
        self.value, self.cover = [0.0], [0.0]

    def split(self, node: int, feature: int, cut: int, threshold: float, values: tuple[float, float]) -> list[int]:
        children = [len(self.left), len(self.left) + 1]
        for v in values:
            for column, empty in ((self.left, -1), (self.right, -1), (self.feature, 0), (self.cut, 0),
                                  (self.threshold, 0.0), (self.value, v), (self.cover, 0.0)):
                column.append(empty)
        self.left[node], self.right[node] = children
        self.feature[node], self.cut[node], self.threshold[node] = feature, cut, threshold
        return children

    def walk(self, x: np.ndarray, bounds: list) -> np.ndarray:
        """The node where each row stops; ``bounds`` are cuts for bins, thresholds for values."""
        at = np.zeros(len(x), np.int64)
        left, right = np.array(self.left), np.array(self.right)
        feature, bound = np.array(self.feature), np.array(bounds)
        rows = np.arange(len(x))
        while True:
            open_ = left[at] >= 0
            if not open_.any():
                return at
            go = x[rows, feature[at]] <= bound[at]
            at = np.where(open_, np.where(go, left[at], right[at]), at)

    def walk_bins(self, columns: np.ndarray) -> np.ndarray:
        """The node where each row stops, from its bins as (feature, row): a comparison
        along the rows for every split."""
        def stop(node):
            if self.left[node] < 0:
                return np.int32(node)
            return np.where(columns[self.feature[node]] <= self.cut[node], stop(self.left[node]), stop(self.right[node]))
        return np.broadcast_to(stop(0), columns.shape[1])

    def set_cover(self, leaves: np.ndarray) -> None:
        cover = leaves.copy()
        for n in range(len(self.left) - 1, -1, -1):  # children come after their parent
            if self.left[n] >= 0:
                cover[n] = cover[self.left[n]] + cover[self.right[n]]
        self.cover = cover.tolist()


def softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class SoftmaxModel:
    """The trees by round and class, and the margins that every row starts from."""

    def __init__(self, start: np.ndarray, rounds: list[list[GrownTree]], losses: list[float]):
        self.start, self.rounds, self.losses = np.asarray(start, float), rounds, losses
        self.numClasses = len(self.start)

    def margins(self, x: np.ndarray) -> np.ndarray:
        m = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for c, t in enumerate(trees):
                m[:, c] += np.array(t.value)[t.walk(x, t.threshold)]
        return m

    def probabilities(self, df: DataFrame, features: str = "features", out: str = "probs") -> DataFrame:
        """Adds the probabilities of the classes, in Arrow batches with the trees broadcast."""
        from pyspark.ml.functions import vector_to_array
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def probs(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(softmax(shared.value.margins(np.stack(s.to_numpy()).astype(float))))
                                if len(s) else [], dtype=object)
        return df.withColumn(out, probs(vector_to_array(F.col(features))))

    def shapley_trees(self) -> list[Tree]:
        """The trees with a value per class, for attributions in margins."""
        out = []
        for trees in self.rounds:
            for c, t in enumerate(trees):
                value = np.zeros((len(t.value), self.numClasses))
                value[:, c] = t.value
                out.append(Tree(1.0, t.left, t.right, t.feature, t.threshold, t.cover, value))
        return out

    def save(self, spark, path: str) -> None:
        """A row per tree; what holds for the whole model is in each of them, so
        the write is one table and is there as a whole or not at all."""
        whole = json.dumps({"start": self.start.tolist(), "losses": self.losses, "rounds": len(self.rounds)})
        rows = [(r, c, json.dumps(vars(t)), whole) for r, trees in enumerate(self.rounds) for c, t in enumerate(trees)]
        spark.createDataFrame(rows or [(-1, -1, "", whole)], "round int, class int, tree string, model string") \
            .coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark, path: str) -> SoftmaxModel:
        rows = spark.read.parquet(path).orderBy("round", "class").collect()  # one row per tree
        whole = json.loads(rows[0]["model"])
        rounds = [[None] * len(whole["start"]) for _ in range(whole["rounds"])]
        for r in rows:
            if r["round"] >= 0:
                tree = GrownTree()
                vars(tree).update(json.loads(r["tree"]))
                rounds[r["round"]][r["class"]] = tree
        return SoftmaxModel(whole["start"], rounds, whole["losses"])


def feature_edges(rows: DataFrame, features: str, key: str, p: Boosting) -> list[np.ndarray]:
    """Bin edges of each feature: between the different values of a bounded sample, at
    most ``bins`` - 1 of them."""
    from pyspark.ml.functions import vector_to_array
    sample = seeded_sample(rows.select(key, vector_to_array(F.col(features)).alias("_x")), p.edge_rows, p.seed, key)
    bins = p.bins

    def edges(batches):
        parts = [np.stack(b["_x"].to_numpy()) for b in batches if len(b)]
        if not parts:
            return
        x = np.concatenate(parts)
        for f in range(x.shape[1]):
            u = np.unique(x[:, f][np.isfinite(x[:, f])])
            if len(u) > bins:
                e = np.unique(np.quantile(u, np.arange(1, bins) / bins))
            else:
                e = (u[1:] + u[:-1]) / 2
            yield pd.DataFrame({"f": [f], "edges": [e.tolist()]})
    got = sample.select("_x").coalesce(1).mapInPandas(edges, "f int, edges array<double>").orderBy("f").collect()
    return [np.array(r["edges"], float) for r in got]


def binned_rows(df: DataFrame, features: str, key: str, edges: list[np.ndarray], weights: np.ndarray,
                start: np.ndarray) -> DataFrame:
    """Packs of rows, those that are held out apart: bins (feature, row) of one byte, the
    class, its weight, a hash of the key and the margins."""
    from pyspark.ml.functions import vector_to_array

    def run(batches):
        for b in batches:
            for held in (False, True):
                rows = b[b["held"] == held]
                for s in range(0, len(rows), PACK_ROWS):
                    part = rows.iloc[s:s + PACK_ROWS]
                    values = np.stack(part["_x"].to_numpy()).astype(float)
                    x = np.empty(values.shape[::-1], np.uint8)
                    for f, e in enumerate(edges):
                        x[f] = np.searchsorted(e, values[:, f], side="left")
                    y = part["y"].to_numpy().astype(np.int64)
                    yield pd.DataFrame({"n": [len(part)], "x": [x.tobytes()], "y": [y.tobytes()],
                                        "w": [weights[y].tobytes()], "h": [part["h"].to_numpy(np.int64).tobytes()],
                                        "m": [np.tile(start, (len(part), 1)).tobytes()], "held": [held]})
    src = df.select(vector_to_array(F.col(features)).alias("_x"), F.col("_cls").alias("y"),
                    F.col("_held").alias("held"), F.xxhash64(F.col(key)).alias("h"))
    return src.mapInPandas(run, ROW_SCHEMA)


ROW_SCHEMA = "n int, x binary, y binary, w binary, h binary, m binary, held boolean"


class Pack:
    """Arrays of a pack; ``since`` are the trees grown after it was written."""

    def __init__(self, r: dict, since: list[list[GrownTree]]):
        n, self.held = r["n"], r["held"]
        self.x = np.frombuffer(r["x"], np.uint8).reshape(-1, n)
        self.y, self.w, self.h = (np.frombuffer(r[c], t) for c, t in (("y", np.int64), ("w", float), ("h", np.int64)))
        self.m = np.frombuffer(r["m"]).reshape(n, -1).copy()
        for trees in since:
            for c, t in enumerate(trees):
                self.m[:, c] += np.array(t.value)[t.walk_bins(self.x)]


def packs(batches):
    """The packs of Arrow batches, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {name: b.column(name)[i].as_py() for name in b.schema.names}


def in_bag(h: np.ndarray, bag: int, p: Boosting) -> np.ndarray:
    """Row bagging by the key's hash: the same rows in every attempt."""
    mixed = (h.astype(np.uint64) ^ np.uint64((p.seed * 1_000_003 + bag) % 2 ** 63)) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(11)).astype(float) / 2.0 ** 53 < p.row_share


def level_pass(table: DataFrame, since: list[list[GrownTree]], trees: list[GrownTree], nodes: list[list[int]],
               columns: np.ndarray, drawn: list[np.ndarray], bag: int, p: Boosting, measure: bool, tasks: int) -> list:
    """The splits of one level: for each class and open node the best of every feature
    block, among the features ``drawn`` for the class's tree, by ``tasks`` tasks.  ``measure`` adds the held-out loss and the leaf covers of the last round."""
    bins = p.bins

    def histograms(batches):
        sums: dict = {}

        def add(k, a):
            if k in sums:
                sums[k] += a
            else:
                sums[k] = a
        for r in packs(batches):
            pack = Pack(r, since)
            x, y, w, prob = pack.x, pack.y, pack.w, softmax(pack.m)
            if measure and pack.held:
                true = np.clip(prob[np.arange(len(y)), y], LOGLOSS_EPS, 1 - LOGLOSS_EPS)
                add((-1, -1, -1), np.array([np.rint(-np.log(true) * UNIT).sum(), len(true)], float))
            if measure and since:  # held rows count as nothing, so that their covers are there
                for c, t in enumerate(since[-1]):
                    add((c, -1, -1), np.bincount(t.walk_bins(x), np.rint(w * UNIT) * (not pack.held), len(t.left)))
            if pack.held or not len(columns):
                continue
            use = in_bag(pack.h, bag, p)
            if not use.any():
                continue
            filled = bin_places(x if len(columns) == len(x) else x[columns], use, bins)
            slots = []
            for c, t in enumerate(trees):
                slot = np.full(len(t.left), len(nodes[c]))  # rows of closed nodes go to a slot that is left out
                slot[nodes[c]] = np.arange(len(nodes[c]))
                slots.append(slot[t.walk_bins(x)])
            for c, open_ in enumerate(nodes):
                if open_:
                    slope, curve = w * (prob[:, c] - (y == c)), w * prob[:, c] * (1 - prob[:, c])
                    if (c, 0, 0) not in sums:
                        sums[c, 0, 0] = BinSums(len(open_), len(columns), bins)
                    sums[c, 0, 0].add(filled, slots[c], use, np.rint(slope * UNIT), np.rint(curve * UNIT))
        out = []
        for (c, _, block), a in sums.items():
            if block < 0:
                out.append((c, -1, -1, a.tobytes()))
                continue
            a = a.get()
            for k, node in enumerate(nodes[c]):
                out += [(c, node, b, a[:, k, b:b + BLOCK].tobytes()) for b in range(0, len(columns), BLOCK)]
        if out:
            c, node, block, a = zip(*out)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in (c, node, block)), pa.array(a, pa.binary())],
                                             ["c", "node", "block", "sums"])

    def splits(batches):
        sums: dict = {}
        for pdf in batches:
            for c, node, block, s in zip(pdf["c"], pdf["node"], pdf["block"], pdf["sums"]):
                a = np.frombuffer(s)
                sums[c, node, block] = sums[c, node, block] + a if (c, node, block) in sums else a
        out = []
        for (c, node, block), a in sums.items():
            if block < 0:
                out.append((c, node, block, 0.0, -1, -1, (a / UNIT).tolist() if c >= 0 else a.tolist()))
                continue
            fs = columns[block:block + BLOCK]
            g, h, n = (a / UNIT).reshape(3, len(fs), bins)
            total_g, total_h = g[0].sum(), h[0].sum()
            lg, lh = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
            rg, rh = total_g - lg, total_h - lh
            gain = lg ** 2 / (lh + p.penalty) + rg ** 2 / (rh + p.penalty) - total_g ** 2 / (total_h + p.penalty)
            ln = n.cumsum(axis=1)[:, :-1]
            fair = (np.minimum(ln, n.sum(axis=1)[:, None] - ln) >= p.min_rows) & np.isin(fs, drawn[c])[:, None]
            fair &= (lh >= p.min_curvature) & (rh >= p.min_curvature)
            gain = np.where(fair, gain, -np.inf)
            f, b = np.unravel_index(np.argmax(gain), gain.shape)
            out.append((c, node, block, float(gain[f, b]), int(fs[f]), int(b),
                        [lg[f, b], lh[f, b], rg[f, b], rh[f, b], total_g, total_h]))
        if out:
            yield pd.DataFrame(out, columns=["c", "node", "block", "gain", "feature", "cut", "sums"])
    if not measure:  # held-out rows are of no use
        table = table.where(~F.col("held"))
    with few_rows_a_batch(table.sparkSession):
        return (table.coalesce(tasks).mapInArrow(histograms, HISTOGRAMS)
                .repartition("c", "node", "block")
                .mapInPandas(splits, "c int, node int, block int, gain double, feature int, cut int, sums array<double>")
                .collect())


HISTOGRAMS = "c int, node int, block int, sums binary"


_ROOM: dict = {}


def room(name: str, n: int, dtype=np.int64) -> np.ndarray:
    """Memory that a worker uses again: most of the time of a pass would go into getting
    new pages for large arrays."""
    if name not in _ROOM or len(_ROOM[name]) < n:
        _ROOM[name] = np.empty(n, dtype)
    return _ROOM[name][:n]


def bin_places(x: np.ndarray, use: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature x bin of what is not in the first bin of its feature, feature by
    feature, for the rows of ``use``.  Most is in the first bin, and its sums are what
    is left of the others.  Both arrays hold until the next call."""
    some = np.not_equal(x, 0, out=room("some", x.size, bool).reshape(x.shape))
    some &= use
    at = np.flatnonzero(some)
    row, place = room("row", len(at)), room("place", len(at))
    x.ravel().take(at, mode="clip", out=room("bin", len(at), np.uint8))
    place[:] = room("bin", len(at), np.uint8)
    end = np.cumsum(np.count_nonzero(some, axis=1))
    for f, (a, b) in enumerate(zip(np.r_[0, end[:-1]], end)):
        np.subtract(at[a:b], f * x.shape[1], out=row[a:b])
        place[a:b] += f * bins
    return row, place


class BinSums:
    """Sums of gradient, curvature and number of a class's rows by (slot, feature, bin), pack
    by pack."""

    def __init__(self, slots: int, features: int, bins: int):
        self.shape, self.width = (3, slots, features, bins), features * bins
        self.others, self.total = np.zeros((3, slots * self.width)), np.zeros((3, slots))

    def add(self, filled: tuple, slot: np.ndarray, use: np.ndarray, slope: np.ndarray, curve: np.ndarray) -> None:
        row, flat = filled
        slots = self.shape[1]
        if slots > 1 or slot.any():
            flat = (slot * self.width).take(row, mode="clip", out=room("flat", len(row)))  # "clip" does not check first
            flat += filled[1]
        for others, total, a in zip(self.others, self.total, (slope, curve, None)):
            each = None if a is None else a.take(row, mode="clip", out=room("each", len(row), float))
            others += np.bincount(flat, each, (slots + 1) * self.width)[:slots * self.width]
            total += np.bincount(slot[use], None if a is None else a[use], slots + 1)[:slots]

    def get(self) -> np.ndarray:
        """(sum, slot, feature, bin), the number of rows times UNIT."""
        out = self.others.reshape(self.shape)
        out[..., 0] = self.total[..., None] - out.sum(axis=3)
        out[2] *= UNIT
        return out


def grow_level(found: list, trees: list[GrownTree], edges: list[np.ndarray], p: Boosting) -> list[list[int]]:
    """Splits each open node at its best cut; returns the nodes of the next level."""
    best: dict = {}
    for r in found:
        if r["block"] >= 0:
            k = (r["c"], r["node"])
            if k not in best or (-r["gain"], r["feature"]) < (-best[k]["gain"], best[k]["feature"]):
                best[k] = r

    def leaf(g, h):
        return -p.step * g / (h + p.penalty)
    following: list[list[int]] = [[] for _ in trees]
    for (c, node), r in sorted(best.items()):
        s = r["sums"]
        if node == 0:
            trees[c].value[0] = leaf(s[4], s[5])
        # a cut beyond the last edge of its feature leaves nothing on the right
        if r["gain"] > 1e-9 and r["cut"] < len(edges[r["feature"]]):
            following[c] += trees[c].split(node, r["feature"], r["cut"], float(edges[r["feature"]][r["cut"]]),
                                           (leaf(s[0], s[1]), leaf(s[2], s[3])))
    return following


def write_rows(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name, unique=True)
    df.write.partitionBy("held").parquet(path)
    return df.sparkSession.read.schema(ROW_SCHEMA).parquet(path)


def fit_softmax(rows: DataFrame, score: str, validation_col: str | None = None, features: str = "features",
                key: str = "id", **params) -> SoftmaxModel:
    """M4: softmax boosting on the reception class of ``score`` with balanced class
    weights.  With ``validation_col`` the flagged rows are held out, and the rounds stop
    where ``patience`` in a row did not lower their log loss; the best prefix (one round at least) is kept.
    A class without training rows keeps a probability of about 0; no training rows are
    an error."""
    spark = rows.sparkSession
    ship_package(spark)
    p = Boosting(**params)
    held = F.coalesce(F.col(validation_col), F.lit(False)) if validation_col else F.lit(False)
    data = rows.select(key, features, reception_class(score).cast("int").alias("_cls"), held.alias("_held"))
    counts = {r["_cls"]: r["count"] for r in data.filter(~F.col("_held")).groupBy("_cls").count().collect()}  # <= 5 rows
    if not counts:
        raise ValueError("no training rows")
    n = sum(counts.values())
    weights = np.array([n / (len(counts) * counts[c]) if c in counts else 0.0 for c in range(N_CLASSES)])
    start = np.log(np.array([1.0 / len(counts) if c in counts else LOGLOSS_EPS for c in range(N_CLASSES)]))
    edges = feature_edges(data.filter(~F.col("_held")), features, key, p)
    # every level sends the sums of its nodes from each task, so there are no more than needed
    tasks = max(spark.sparkContext.defaultParallelism, -(-n * len(edges) // POINTS))
    table = write_rows(binned_rows(data.coalesce(tasks), features, key, edges, weights, start), "binned")
    usable = np.array([f for f, e in enumerate(edges) if len(e)], dtype=np.int64)
    classes = [c for c in range(N_CLASSES) if c in counts]
    model = SoftmaxModel(start, [], [])
    rng = np.random.default_rng(p.seed)
    since: list[list[GrownTree]] = []
    for r in range(p.rounds + 1):
        trees = [GrownTree() for _ in range(N_CLASSES)]
        share = max(1, round(p.feature_share * len(usable))) if len(usable) else 0
        drawn = [rng.choice(usable, share, replace=False) for _ in trees]
        last = r == p.rounds
        nodes = [[0] if c in classes and not last and share else [] for c in range(N_CLASSES)]
        for level in range(p.depth):
            found = level_pass(table, since, trees, nodes, usable, drawn, r // p.bag_every, p, level == 0, tasks)
            if level == 0:
                for f in found:
                    if f["block"] < 0 and f["c"] >= 0:
                        since[-1][f["c"]].set_cover(np.array(f["sums"]))
                seen = [f["sums"] for f in found if f["block"] < 0 and f["c"] < 0]
                if seen and seen[0][1]:
                    model.losses.append(seen[0][0] / UNIT / seen[0][1])
                best = 1 + int(np.argmin(model.losses[1:])) if len(model.losses) > 1 else r
                if last or r - best >= p.patience:
                    model.rounds = model.rounds[:best]
                    return model
            nodes = grow_level(found, trees, edges, p)
            if not any(nodes):
                break
        model.rounds.append(trees)
        since.append(trees)
        if len(since) == WRITE_EVERY:
            done, since = since[:-1], since[-1:]

            def add(batches, done=done):
                for r in packs(batches):
                    r["m"] = Pack(r, done).m.tobytes()
                    yield pa.RecordBatch.from_pylist([r], names)
            names = pa.schema([("n", pa.int32()), *((c, pa.binary()) for c in "xywhm"), ("held", pa.bool_())])
            with few_rows_a_batch(spark):
                table = write_rows(table.coalesce(tasks).mapInArrow(add, ROW_SCHEMA), "binned")
    return model

