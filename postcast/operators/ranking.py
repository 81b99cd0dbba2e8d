"""Variant ranking and the optimisation trace."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from postcast.constants import OPTIMISE_MIN_GAIN, OPTIMISE_ROUNDS
from postcast.functions.format import fixed
from postcast.operators.running import row_number
from postcast.sources.items import per_group_limit


def rank_variants(df: DataFrame, pitch: str, idx: str, score: str,
                  extra_order: list | None = None, out: str = "rank") -> DataFrame:
    """Rank per pitch by predicted score descending, ties in input order
    (variant index).  Exact and skew-safe: a pitch with a third of all rows is
    spread over many tasks (see ``running.row_number``)."""
    order = [F.col(score).desc()] + (extra_order or []) + [F.col(idx)]
    return row_number(df, [pitch], order, out=out)


def drop_seen(suggestions: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """F8: suggestions whose title was already tried are dropped (anti join)."""
    return suggestions.join(seen.select(*keys).distinct(), keys, "left_anti")


def rank_with_original(originals: DataFrame, suggestions: DataFrame, pitch: str, idx: str,
                       score: str) -> DataFrame:
    """Originals and (unseen) suggestions ranked together; on equal scores
    the original comes first (it is first in the candidate list)."""
    both = (originals.withColumn("is_original", F.lit(1).cast("long"))
            .unionByName(suggestions.withColumn("is_original", F.lit(0).cast("long"))))
    return rank_variants(both, pitch, idx, score, extra_order=[F.col("is_original").desc()])


def best_explanation(ranked: DataFrame, pitch: str, title: str, score: str, label: str) -> DataFrame:
    """One line about the rank-1 variant of each pitch."""
    best = ranked.filter(F.col("rank") == 1)
    return best.select(pitch, F.concat(
        F.lit("'"), F.col(title), F.lit("' is predicted to perform best (score: "),
        fixed(F.col(score), 1), F.lit(", label: "), F.col(label), F.lit(").")).alias("explanation"))


def ranked_lines(ranked: DataFrame, pitch: str, title: str, score: str, label: str) -> DataFrame:
    """Every variant of each pitch as a numbered line, one row per line in
    ``rank`` order, so a pitch with any number of variants is never gathered."""
    return ranked.select(pitch, "rank", F.concat(
        F.col("rank").cast("string"), F.lit('. "'), F.col(title), F.lit('" — score: '),
        fixed(F.col(score), 1), F.lit(", label: "), F.col(label)).alias("line"))


def tried_list(df: DataFrame, pitch: str, title: str) -> DataFrame:
    """Distinct tried titles, quoted, comma-joined (sorted for a stable
    text).  Bounded by rounds x suggestions per pitch in the optimisation loop."""
    g = df.groupBy(pitch).agg(F.array_sort(F.collect_set(title)).alias("_t"))
    return g.select(pitch, F.array_join(F.transform("_t", lambda t: F.concat(F.lit('"'), t, F.lit('"'))),
                                        ", ").alias("tried"))


def optimise_trace(variants: DataFrame, originals: DataFrame, pitch: str = "pitch",
                   rnd: str = "rnd", title: str = "title", score: str = "score",
                   title0: str = "title0", score0: str = "s0",
                   max_rounds: int = OPTIMISE_ROUNDS,
                   min_gain: float = OPTIMISE_MIN_GAIN) -> DataFrame:
    """Round-by-round optimisation over a table of scored suggestions.

    Every pitch of ``originals`` runs rounds 1, 2, ... up to ``max_rounds``; a
    round without an unseen suggestion stops the loop, also one that has no rows
    at all.  A suggestion is unseen in the first round its title appears (the
    original title is seen from the start; duplicates inside that round all
    count).  A round is accepted when its best unseen score beats the running
    best strictly and by at least ``min_gain``; the first other round stops the
    loop (it still counts as run).  Output per pitch: rounds_run, best_title,
    best_score, total_gain.  Of equal scores in a round the smallest title
    counts as best, as a table has no order of its own."""
    o = originals.select(F.col(pitch).alias("_p"), F.col(title0).alias("_t0"),
                         F.col(score0).cast("double").alias("_s0"))
    v = variants.filter(F.col(rnd).between(1, max_rounds)).select(
        F.col(pitch).alias("_p"), F.col(rnd).cast("long").alias("_r"), F.col(title).alias("_t"),
        F.col(score).cast("double").alias("_s"))
    first = v.groupBy("_p", "_t").agg(F.min("_r").alias("_r"))
    fresh = v.join(first, ["_p", "_t", "_r"])
    best = (fresh.join(o, "_p").filter(~F.col("_t").eqNullSafe(F.col("_t0")))
            .groupBy("_p", "_r").agg(F.max("_s").alias("_best"), F.min_by("_t", F.struct(-F.col("_s"), F.col("_t")))
                                     .alias("_title")))
    spine = o.select("_p", "_t0", "_s0", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max_rounds).cast("long")))
                     .alias("_r"))
    s = spine.join(best, ["_p", "_r"], "left")
    before = Window.partitionBy("_p").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    prev = F.greatest(F.col("_s0"), F.coalesce(F.max("_best").over(before), F.col("_s0")))
    s = s.withColumn("_prev", prev)
    ok = (F.col("_best").isNotNull() & (F.col("_best") > F.col("_prev"))
          & (F.col("_best") - F.col("_prev") >= F.lit(min_gain)))
    s = s.withColumn("_ok", ok)
    s = s.withColumn("_stop", F.min(F.when(~F.col("_ok"), F.col("_r"))).over(Window.partitionBy("_p")))
    kept = s.filter(F.col("_stop").isNull() | (F.col("_r") <= F.col("_stop")))
    won = F.col("_ok") & (F.col("_stop").isNull() | (F.col("_r") < F.col("_stop")))
    g = kept.groupBy("_p").agg(F.count(F.lit(1)).alias("rounds_run"), F.max(F.when(won, F.col("_best"))).alias("_b"),
                               F.max_by("_title", F.when(won, F.col("_best"))).alias("_bt"),
                               F.first("_s0").alias("_s0"), F.first("_t0").alias("_t0"))
    return g.select(F.col("_p").alias(pitch), F.col("rounds_run").cast("long"),
                    F.when(F.col("_b").isNull(), F.col("_t0")).otherwise(F.col("_bt")).alias("best_title"),
                    F.coalesce("_b", "_s0").alias("best_score"),
                    F.coalesce(F.col("_b") - F.col("_s0"), F.lit(0.0)).alias("total_gain"))


__all__ = ["per_group_limit"]
