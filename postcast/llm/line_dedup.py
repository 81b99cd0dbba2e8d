"""Line dedup: repeated runs of lines by prefix doubling, later copies deleted.
DataFrame operations only.

Every non-blank line is named by the identity of its content, and a document is
a sequence of line names.  Lines that occur once anywhere end every repeated run,
so only repeated lines are ranked.  Prefix doubling ranks the suffixes by their
first 1, 2, 4, ... lines: a rank is the place of a pair of ranks in the global
order.  Suffixes that share their first m lines form the interval of longest
common prefix m; its earliest member stays and the others are later copies.  A
window whose rank no other one shares has no longer repeat, so it is left out of
the next level, and doubling ends where no rank is shared.

A run counts if its lines have ``min_chars`` characters in all (1: every repeated
line).  Each line therefore asks for the shortest such run that begins with it and
the shortest that ends with it; every line of a longer repeated run lies in one of
those, so their union is the maximal repeated runs.  The interval of a run of m
lines is named by the ranks of its first and of its last 2**t lines,
2**t <= m < 2**(t+1).  The windows of 2**t lines are runs themselves; the longest
one of a document that occurs earlier is its ``longest``.

Earliest means by doc_id, then by a hash of the text, then by line number.
Intervals are combined before the shuffle (a minimum per task), and a line that
a third of all documents share is only ever joined with its one rank, in plain
equi-joins that AQE splits.

Defined cases: a null text stays null, an empty one empty; blank lines are never
repeats and stay, but a text whose other lines are all deleted becomes empty;
repeated rows count as one document and stay alike; extra columns travel along;
an empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postcast.llm.common import Scratch

MIN_CHARS = 1
SOLID = r"[^\x20\x09-\x0D]"


def _solid_lines(text: Column) -> Column:
    """array<struct<i, line>>: the non-blank lines with their line numbers."""
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x, n: F.struct(n.alias("i"), x.alias("line"))),
                    lambda s: s["line"].rlike(SOLID))


def _in_order(names: DataFrame, cols: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Distinct rows with ``rank``, a number that grows in their global order."""
    return scratch.save(names.orderBy(*cols).withColumn("rank", F.monotonically_increasing_id()), name)


def repeated_lines(docs: DataFrame, scratch: Scratch, doc: list[str], text: str, min_chars: int) -> DataFrame:
    """Positions of repeated lines (k, seg, j, r): document key, unbroken stretch,
    number among the non-blank lines, rank; and the runs asked for: ``ahead``
    lines from j on, ``back`` lines up to j (null: the stretch is too short)."""
    # the key first: beside a generator, its hash would be taken of the whole text for every line
    keyed = docs.select(F.struct(*doc, F.xxhash64(text).alias("_h")).alias("k"), F.col(text).alias("_body"))
    lines = keyed.select("k", F.posexplode(_solid_lines(F.col("_body"))).alias("j", "s"))
    lines = lines.select("k", "j", F.length("s.line").cast("long").alias("len"),
                         F.xxhash64("s.line").alias("d1"), F.xxhash64(F.lit(0), "s.line").alias("d2"))
    twice = lines.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("d1", "d2")
    ranks = _in_order(twice, ["d1", "d2"], scratch, "line_ranks")
    at = lines.join(ranks, ["d1", "d2"]).select("k", "j", "len", F.col("rank").alias("r")).distinct()
    in_doc = Window.partitionBy("k").orderBy("j")
    at = at.withColumn("seg", F.col("j") - F.row_number().over(in_doc))
    stretch = Window.partitionBy("k", "seg")
    before = stretch.orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("s", F.coalesce(F.sum("len").over(before), F.lit(0).cast("long"))) \
        .withColumn("e", F.col("s") + F.col("len")) \
        .withColumns({"_last": F.max("j").over(stretch), "_first": F.min("j").over(stretch),
                      "_all": F.max("e").over(stretch)})
    # in descending order, as a frame that grows is summed up once and one that shrinks anew for each row
    beyond = F.min("j").over(stretch.orderBy(F.desc("s")).rangeBetween(Window.unboundedPreceding, -min_chars))
    below = F.max("j").over(stretch.orderBy("e").rangeBetween(Window.unboundedPreceding, -min_chars))
    ahead = F.coalesce(beyond, F.when(F.col("_all") - F.col("s") >= min_chars, F.col("_last") + 1)) - F.col("j")
    back = F.col("j") + 1 - F.coalesce(below + 1, F.when(F.col("e") >= min_chars, F.col("_first")))
    return scratch.save(at.select("k", "seg", "j", "r", "len", ahead.alias("ahead"), back.alias("back")), "positions")


def later_copies(docs: DataFrame, scratch: Scratch, doc: list[str], text: str = "text",
                 min_chars: int = MIN_CHARS) -> DataFrame:
    """Runs (k, start, m) that occur earlier: m lines from number ``start``."""
    at = repeated_lines(docs, scratch, doc, text, min_chars)
    run = F.explode(F.array(F.struct(F.col("j").alias("start"), F.col("ahead").alias("m")),
                            F.struct((F.col("j") - F.col("back") + 1).alias("start"), F.col("back").alias("m"))))
    runs = scratch.save(at.select("k", run.alias("w")).select("k", "w.*").where("m IS NOT NULL").distinct(), "runs")
    named, level, size = [], at.select("k", "seg", "j", "r", "len"), 1
    while True:
        here = runs.where((F.col("m") >= size) & (F.col("m") < 2 * size))
        head = level.select("k", F.col("j").alias("start"), F.col("r").alias("a"))
        here = here.join(head, ["k", "start"])
        if size > 1:
            tail = level.select("k", F.col("j").alias("_t"), F.col("r").alias("b"))
            here = here.withColumn("_t", (F.col("start") + F.col("m") - size).cast("int")).join(tail, ["k", "_t"])
        else:
            here = here.withColumn("b", F.col("a"))
        named.append(here.select("k", "start", "m", "a", "b"))
        if size > 1:  # the windows of this level are runs too
            named.append(level.where(F.col("len") >= min_chars).select(
                "k", F.col("j").alias("start"), F.lit(size).alias("m"), F.col("r").alias("a"), F.col("r").alias("b")))
        along = Window.partitionBy("k", "seg").orderBy("j").rangeBetween(size, size)
        pairs = level.withColumns({"r2": F.first("r").over(along), "_more": F.first("len").over(along)})
        pairs = scratch.save(pairs.where("r2 IS NOT NULL").select("k", "seg", "j", "r", "r2", (
            F.col("len") + F.col("_more")).alias("len")), "pairs")
        shared = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        ranks = _in_order(shared, ["r", "r2"], scratch, "pair_ranks")
        if not ranks.take(1):
            break
        level = scratch.save(pairs.join(ranks, ["r", "r2"]).select("k", "seg", "j", F.col("rank").alias("r"), "len"),
                             "ranks")
        size *= 2
    windows = named[0]
    for n in named[1:]:
        windows = windows.unionByName(n)
    windows = scratch.save(windows, "intervals")
    # written, so that both sides of the join are plain exchanges, which AQE can
    # split where one run is very frequent
    first = windows.groupBy("m", "a", "b").agg(F.min(F.struct("k", "start")).alias("first"),
                                               F.max(F.struct("k", "start")).alias("last"))
    first = scratch.save(first.where(F.col("first") < F.col("last")).drop("last"), "first")
    return windows.join(first, ["m", "a", "b"]).where(
        F.struct("k", "start") > F.col("first")).select("k", "start", "m")


def dedup_lines(docs: DataFrame, doc: list[str] = ["doc_id"], text: str = "text",
                min_chars: int = MIN_CHARS) -> DataFrame:
    """The input's columns with ``text`` without later copies, ``n_lines`` (non-blank
    lines before), ``deleted`` (their numbers, ascending) and ``longest`` (lines of the
    longest window of 1, 2, 4, ... lines that occurs earlier)."""
    scratch = Scratch(docs.sparkSession, "line_dedup")
    named = docs.select(F.struct(F.col(text).alias("_text"), *[F.col(c).alias(f"_{n}") for n, c in enumerate(doc)])
                        .alias("_in"), F.struct("*").alias("_all"))
    keyed = named.select(*[F.col(f"_in._{n}").alias(f"_{n}") for n in range(len(doc))], F.col("_in._text").alias("_text"),
                         "_all")
    doc_cols = [f"_{n}" for n in range(len(doc))]
    gone = later_copies(keyed, scratch, doc_cols, "_text", min_chars)
    # lines are marked where runs begin and end, so a long run is one row until here
    ends = gone.select("k", "m", F.explode(F.array(F.struct(F.col("start").alias("j"), F.lit(1).alias("d")), F.struct(
        (F.col("start") + F.col("m")).cast("int").alias("j"), F.lit(-1).alias("d")))).alias("e"))
    ends = ends.groupBy("k", "e.j").agg(F.sum("e.d").alias("d"), F.max("m").alias("m"))
    in_doc = Window.partitionBy("k").orderBy("j")
    ends = ends.withColumns({"open": F.sum("d").over(in_doc), "next": F.lead("j").over(in_doc)})
    gone = ends.where("open > 0").groupBy("k").agg(
        F.sort_array(F.flatten(F.collect_list(F.sequence("j", F.col("next") - 1)))).alias("deleted"))
    power = F.max(F.expr("cast(shiftleft(1, cast(floor(log2(m)) as int)) as long)"))
    gone = scratch.save(gone.join(ends.groupBy("k").agg(power.alias("longest")), "k"), "deleted")
    joined = keyed.withColumn("k", F.struct(*doc_cols, F.xxhash64("_text").alias("_h"))).join(gone, "k", "left")
    joined = joined.withColumns({"_lines": F.split("_text", "\n", -1),
                                 "_solid": F.transform(_solid_lines(F.col("_text")), lambda s: s["i"])})
    cut = F.transform("deleted", lambda j: F.get(F.col("_solid"), j))
    left = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), cut)
    rest = F.array_join(F.transform(left, lambda n: F.get(F.col("_lines"), n)), "\n")
    body = F.when(F.col("deleted").isNull(), F.col("_text")) \
        .when(F.size("deleted") == F.size("_solid"), F.lit("")).otherwise(rest)
    others = [F.col(f"_all.`{c}`") if c != text else body.alias(text) for c in docs.columns
              if c not in ("n_lines", "deleted", "longest")]
    return joined.select(*others, F.coalesce(F.size("_solid"), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"),
                         F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))
