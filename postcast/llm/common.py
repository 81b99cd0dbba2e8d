"""Helpers shared by the training-data operators: word patterns, tables written
to the shared folder, and distributed connected components."""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postcast.session import scratch_path, ship_package

# A word is a run of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def words_of(text: Column) -> Column:
    """The words of a text in order; null or blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def read_documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


ARROW_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Fewer rows per Arrow batch than Spark's 10,000: whole documents are wide,
    and a batch is held by the JVM and by the Python worker at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Scratch:
    """Intermediate tables of one run, written to the shared folder that the
    cluster names in ``spark.checkpoint.dir``.  A written table cuts lineage,
    survives the loss of an executor and is computed once for all its readers.
    ``drop`` removes tables that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, f"{name}_{uuid.uuid4().hex[:10]}")
        self.n = 0

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n:03d}_{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable node of every node that has an edge.

    ``edges(a, b)`` of any orderable type, in any direction, repeats allowed.
    Returns ``(node, component)``, each node once.  Every round hooks each node
    to its smallest neighbour, follows the hooks to their roots by pointer
    jumping, and contracts the edges to the roots; at least half of the nodes
    that still have an edge disappear in two rounds (a hub with the largest id
    may lose but one node in the first), so rounds grow with the logarithm of
    the nodes.  Minima are combined before the shuffle, and joins
    on a hub are plain equi-joins that AQE splits.  Nothing is collected but
    one boolean per round."""
    both = edges.where(F.col("a") != F.col("b")).select("a", "b")
    live = scratch.save(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                        "edges")
    labels = None
    while True:
        if not live.take(1):
            break
        hook = scratch.save(live.groupBy("a").agg(F.min("b").alias("m"))
                            .select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "hook")
        while True:  # follow the hooks to the roots
            up = hook.select(F.col("node").alias("component"), F.col("component").alias("up"))
            jumped = scratch.save(hook.join(up, "component").select(
                "node", F.col("up").alias("component"), (F.col("up") != F.col("component")).alias("moved")),
                "jump")
            scratch.drop(hook)
            hook = jumped
            if not hook.where("moved").take(1):
                break
            hook = hook.drop("moved")
            hook._scratch_path = jumped._scratch_path
        roots = hook.select("node", "component")
        if labels is None:
            merged = scratch.save(roots, "labels")
        else:
            up = roots.select(F.col("node").alias("component"), F.col("component").alias("up"))
            merged = scratch.save(labels.join(up, "component", "left").select(
                "node", F.coalesce("up", "component").alias("component")), "labels")
            scratch.drop(labels)
        labels = merged
        a = roots.select(F.col("node").alias("a"), F.col("component").alias("ra"))
        b = roots.select(F.col("node").alias("b"), F.col("component").alias("rb"))
        contracted = scratch.save(live.join(a, "a").join(b, "b").where("ra != rb")
                                  .select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "edges")
        scratch.drop(live, hook)
        live = contracted
    if labels is None:
        labels = live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
