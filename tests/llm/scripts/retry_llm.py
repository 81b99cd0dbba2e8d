"""Runs operators twice, once with a task of the input failing on its first
attempt (Spark retries it), and prints whether the results are the same."""
import sys

sys.path.insert(0, sys.argv[1])

import pandas as pd  # noqa: E402
import public_tokenizers as P  # noqa: E402
from pyspark import TaskContext  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from postcast.llm import packing  # noqa: E402
from postcast.llm.line_dedup import dedup_lines  # noqa: E402
from postcast.llm.simhash import keep_first, near_duplicates  # noqa: E402
from postcast.llm.sketches import compare_with_next  # noqa: E402
from postcast.llm.substring_dedup import dedup_substrings  # noqa: E402
from postcast.session import get_spark  # noqa: E402

spark = get_spark("local[4,3]", shuffle_partitions=4)  # up to 3 attempts per task


@F.pandas_udf("long")
def fail_once(s: pd.Series) -> pd.Series:
    ctx = TaskContext.get()
    if ctx.partitionId() == 0 and ctx.attemptNumber() == 0:
        raise RuntimeError("injected task failure")
    return s


with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
    DEFINITION = f.read()
docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").repartition(3)
checks = {
    "near_duplicates": near_duplicates,
    "keep_first": keep_first,
    "dedup_lines": dedup_lines,
    "dedup_substrings": dedup_substrings,
    "compare_with_next": compare_with_next,
    "pack": lambda d: packing.pack(packing.pieces(d, DEFINITION).drop("ids")),
}
ok = True
for name, fn in checks.items():
    clean = sorted(map(repr, fn(docs).collect()))
    retried = sorted(map(repr, fn(docs.withColumn("doc_id", fail_once("doc_id"))).collect()))
    same = clean == retried and len(clean) > 0
    ok &= same
    print(name, "same" if same else "DIFFERENT")
print("ALL_SAME" if ok else "SOME_DIFFERENT")
