"""The streaming index build gives the same tables as the batch operators."""
import os
import tempfile

from pyspark.sql import functions as F

from postcast.operators import stats as S
from postcast.operators.clean import clean_stories
from postcast.schema import ITEM
from postcast.sources.items import live_stories
from postcast.streaming.index_stream import smoothed_domains, start_index_stream, time_means


def test_index_stream_matches_batch(spark, stories_df, comments_df):
    base = tempfile.mkdtemp(prefix="postcast-stream-")
    landing, out = os.path.join(base, "landing"), os.path.join(base, "out")
    items = stories_df.unionByName(comments_df, allowMissingColumns=True)
    cols = [F.col(f.name).cast(f.dataType) if f.name in items.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in ITEM.fields]
    items = items.select(*cols)
    items.filter("type = 1").write.parquet(os.path.join(landing, "part1"))
    items.filter("type = 2").write.parquet(os.path.join(landing, "part2"))
    for q in start_index_stream(spark, os.path.join(landing, "*"), out, name=os.path.basename(base)):
        q.awaitTermination(120)
    assert spark.read.parquet(os.path.join(out, "stories")).count() == 5
    assert spark.read.parquet(os.path.join(out, "comments")).count() == 5
    got = {r["domain"]: (r["post_count"], round(r["avg_score"], 9)) for r in smoothed_domains(spark, out).collect()}
    exp = {r["domain"]: (r["post_count"], round(r["avg_score"], 9))
           for r in S.domain_stats(clean_stories(live_stories(stories_df))).collect()}
    assert got == exp
    tm = {(r["grain"], r["key"]): r["avg_score"] for r in time_means(spark, out).collect()}
    tb = {(r["grain"], r["key"]): r["avg_score"]
          for r in S.time_stats(live_stories(stories_df)).collect()}
    assert tm == tb
