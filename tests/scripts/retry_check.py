"""Run operators twice, once with one task of the input failing on its first
attempt (Spark retries it), and print whether the results are identical."""
import sys

sys.path.insert(0, sys.argv[1])

import pandas as pd  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from postcast.operators import knn as K, splits as SP, stats as S  # noqa: E402
from postcast.operators import ranking as R  # noqa: E402
from postcast.operators.sampling import seeded_sample  # noqa: E402
from postcast.operators.topn import seeded_take  # noqa: E402
from postcast.session import get_spark  # noqa: E402

spark = get_spark("local[4,3]", shuffle_partitions=4)  # up to 3 attempts per task
sf = "/root/testdata/sf0.001"


@F.pandas_udf("long")
def fail_once(s: pd.Series) -> pd.Series:
    ctx = TaskContext.get()
    if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    return s


def faulty(df, col):
    return df.withColumn(col, fail_once(F.col(col)))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


emb = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(3)
events = spark.read.parquet(f"{sf}/events.parquet").repartition(3)
checks = {
    "knn": lambda e: K.knn(e, e, k=3, index_id="vec_id", query_id="vec_id", exclude_self=True),
    "score_cdf": lambda e: S.score_cdf(e, "value"),
    "hash_split": lambda e: SP.hash_split(e.select("event_id"), "event_id"),
    "seeded_sample": lambda e: seeded_sample(e.select("event_id"), 50, id_col="event_id"),
    "variant_rank_skew_path": lambda e: R.rank_variants(e.select("event_id", "user_id", "value"),
                                                        "user_id", "event_id", "value"),
    "stratified_threshold_path": lambda e: seeded_take(
        e.select("event_id", (F.col("event_id") % 4).alias("g")), "event_id", 42,
        {0: 20, 1: 20, 2: 10, 3: 5}, group="g"),
}
ok = True
for name, fn in checks.items():
    src, key = (emb, "vec_id") if name == "knn" else (events, "event_id")
    clean = rows(fn(src))
    retried = rows(fn(faulty(src, key)))
    same = clean == retried and len(clean) > 0
    ok &= same
    print(name, "same" if same else "DIFFERENT")
print("ALL_SAME" if ok else "SOME_DIFFERENT")
