"""Session settings the library relies on (UTC clock, AQE, Arrow)."""
from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job of the library assumes.  Feature times are UTC, so the
# session zone is pinned; AQE re-plans joins/partition counts at runtime and
# splits skewed shuffle partitions.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "postcast",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for k in ("spark.sql.session.timeZone",):
        spark.conf.set(k, conf[k])
    ship_package(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and written intermediate tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names (a shared
    filesystem).  Where it is unset, a local run (tests) creates and registers a
    scratch folder; on a cluster that is an error, as executors could not see it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="postcast-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str, unique: bool = False) -> str:
    """A folder for a written table under the shared folder, per application
    (two applications sharing the checkpoint folder never overwrite each
    other); ``unique`` adds a run suffix for tables written once per call."""
    import uuid
    base = shared_dir(spark)
    leaf = f"{name}_{uuid.uuid4().hex[:8]}" if unique else name
    return os.path.join(base, "tables", spark.sparkContext.applicationId, leaf)


@contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int = 8):
    """Jobs that are run inside read Arrow batches of a few rows: each row is a pack of
    up to some MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``postcast`` importable in the Python workers (pandas UDFs,
    mapInPandas), as ``--py-files`` would: the package is zipped once per
    SparkContext on the driver and distributed by Spark's file server."""
    import zipfile

    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="postcast-pyfiles-"), "postcast.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
