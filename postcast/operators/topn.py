"""Top-n and exact seeded samples that stay distributed at any n.

The seeded order is md5 of the id, whose hex digits are uniform.  The last row
that a quota admits is found digit block by digit block: the rows of each group
are counted by their next four digits (at most 65,536 counts per group, combined
before the shuffle), which tells the block that holds the quota-th row; only that
block is counted again by its next four digits.  What remains after the last
step are rows with equal digits or a few hundred at most, from which the
threshold (key, id) is read.  The sample is then a plain filter against one
threshold per group, so nothing is sorted as a whole and no plan depends on the
number of rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcast.operators.running import running_total

DIGITS = 4  # hex digits per step
STEPS = 32 // DIGITS
FEW = 1000  # rows of a digit block whose threshold is read off directly


def hash_key(id_col: str, seed: int) -> Column:
    return F.md5((F.col(id_col) + F.lit(seed)).cast("string"))


def thresholds(keyed: DataFrame, quotas: dict) -> dict:
    """For each group (column ``_g``) the (key, id) of its quota-th row in (key,
    id) order, None where the group has no more rows than its quota.  ``keyed``
    has ``_g``, ``_h`` (md5 hex) and ``_i`` (id).  One row per group and digit
    block comes to the driver."""
    prefix, need, last = {g: "" for g in quotas}, dict(quotas), {}
    for step in range(STEPS):
        todo = [g for g in prefix if g not in last and need[g] > 0]
        if not todo:
            break
        inside = F.lit(False)
        for g in todo:
            inside = inside | ((F.col("_g") == F.lit(g)) & F.col("_h").startswith(prefix[g]))
        block = F.substring("_h", 1 + step * DIGITS, DIGITS)
        counts: dict = {}
        for g, b, n in keyed.where(inside).groupBy("_g", block).count().collect():
            counts.setdefault(g, {})[b] = n
        few = []
        for g in todo:
            found = counts.get(g, {})
            if need[g] > sum(found.values()):
                last[g] = None  # the quota takes the whole group
                continue
            for b in sorted(found):
                if found[b] >= need[g]:
                    prefix[g] += b
                    if found[b] <= FEW or step == STEPS - 1:
                        few.append(g)
                    break
                need[g] -= found[b]
        for g in few:
            rows = keyed.where((F.col("_g") == F.lit(g)) & F.col("_h").startswith(prefix[g]))
            row = rows.orderBy("_h", "_i").select("_h", "_i").offset(need[g] - 1).limit(1).first()
            last[g] = (row[0], row[1])
    return last


def admitted(h: Column, i: Column, last: tuple | None) -> Column:
    """True for the rows up to a threshold (all rows without one)."""
    if last is None:
        return F.lit(True)
    return (h < F.lit(last[0])) | ((h == F.lit(last[0])) & (i <= F.lit(last[1])))


def seeded_take(df: DataFrame, id_col: str, seed: int, quotas: dict | int, group: str | None = None,
                rank_col: str | None = "sample_rank", key: Column | None = None) -> DataFrame:
    """Per group (or overall) the ``quota`` rows with the smallest md5(id + seed)
    (or the given md5 ``key``), ties by id; ``rank_col`` (None: left out) is the
    position in that order."""
    h = hash_key(id_col, seed) if key is None else key
    g = F.col(group) if group else F.lit(0)
    qmap = quotas if isinstance(quotas, dict) else {0: quotas}
    last = thresholds(df.select(g.alias("_g"), h.alias("_h"), F.col(id_col).alias("_i")), qmap)
    take = F.lit(False)
    for k, q in qmap.items():
        if q > 0:
            take = take | ((g == F.lit(k)) & admitted(h, F.col(id_col), last.get(k)))
    chosen = df.where(take)
    if rank_col is None:
        return chosen
    ranked = running_total(chosen.withColumns({"_h": h, "_g": g}), ["_g"], ["_h", id_col], out=rank_col)
    return ranked.drop("_h", "_g")


def top_n(df: DataFrame, n: int, key: str, descending: bool = True, tie: list | None = None) -> DataFrame:
    """Top n by ``key`` (then ``tie``), sorted: every partition keeps its n best,
    and those are merged."""
    order = [F.col(key).desc_nulls_last() if descending else F.col(key).asc_nulls_last()]
    order += [F.col(c) if isinstance(c, str) else c for c in (tie or [])]
    return df.orderBy(*order).limit(n)
