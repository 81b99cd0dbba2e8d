"""End-to-end jobs (M2, M7, M9, M10, M11) composed from the operators.

Each job reads DataFrames and returns DataFrames (and writes tables where the
job is a build step).  Intermediate tables that several steps reuse are
written once to the shared folder (``spark.checkpoint.dir``) and read back,
which also cuts the lineage, so a lost executor recomputes from the table and
not from the raw input."""
from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postcast.constants import EMBEDDING_DIM, KNN_K, SMOOTHING_PRIOR, TEMPORAL_CUTOFF
from postcast.functions import labels as L
from postcast.functions.time import day_of_week, hour_utc  # noqa: F401
from postcast.operators import evaluate as EV
from postcast.operators import explain as X
from postcast.operators import knn as K
from postcast.operators import models as M
from postcast.operators import splits as SP
from postcast.operators import stats as S
from postcast.operators.clean import clean_comments, clean_stories
from postcast.operators.embed import hashing_embedding
from postcast.operators.prompts import prompt_table
from postcast.operators.features import assemble, feature_names, structural_features
from postcast.session import scratch_path
from postcast.sources.items import live_stories, write_comment_index, write_story_index

KEEP = ["id", "time", "score", "descendants", "title"]


def feature_table(clean: DataFrame, domain_stats: DataFrame | None,
                  prior: float = SMOOTHING_PRIOR, extra: list[str] | None = None) -> DataFrame:
    """15 structural columns + title embedding + assembled vector,
    keyed by id (never by row position)."""
    keep = [c for c in KEEP + (extra or []) if c in clean.columns]
    st = structural_features(clean, domain_stats, prior, keep=keep)
    emb = hashing_embedding(st, "title")
    return assemble(emb)


def materialise(df: DataFrame, name: str, observation=None) -> DataFrame:
    """Write once to the shared folder and read back (reused by several fits).
    An ``Observation`` attached here is filled by the same write (no extra pass)."""
    path = scratch_path(df.sparkSession, name, unique=True)
    if observation is not None:
        df = df.observe(observation, *split_count_exprs())
    # hash-partitioned by id: every later fit scans balanced files (a small
    # upstream may have been coalesced to one partition) and joins back by id
    # find their side already clustered
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, "id").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def split_count_exprs() -> list:
    """Rows per split side and per reception class of the training side."""
    train = ~F.col("is_validation")
    exprs = [F.count(F.lit(1)).alias("rows"),
             F.sum(F.col("is_validation").cast("long")).alias("validation_rows")]
    cls = L.reception_class("score")
    for i, name in enumerate(L.LABELS):
        exprs.append(F.sum(F.when(train & (cls == i), 1).otherwise(0)).alias(f"train_{name}"))
    return exprs


def split_features(items: DataFrame, cutoff: str = TEMPORAL_CUTOFF, name: str = "features"):
    """P1 (with the P2 fallback) -> domain statistics from the training side
    only -> feature table with the validation flag, materialised."""
    from pyspark.sql import Observation
    clean = clean_stories(live_stories(items))
    flagged = SP.fallback_split(clean, "time", "id", cutoff)
    dstats = S.domain_stats(flagged.filter(~F.col("is_validation")))
    # the embedding is inside the assembled vector; storing it twice would
    # double the table the fits scan
    feats = feature_table(flagged, dstats, extra=["is_validation"]).drop("embedding")
    obs = Observation("split_counts")
    out = materialise(feats, name, obs)
    return out, dstats, obs.get


def history_statistics(items: DataFrame, before: str | None = None) -> dict[str, DataFrame]:
    """The statistics that a training run saves, over every live story.  ``before``
    is the leakage guard: only stories before that time count."""
    clean = clean_stories(live_stories(items))
    if before:
        clean = clean.where(F.col("time") < F.to_timestamp(F.lit(before)))
    path = scratch_path(items.sparkSession, "history_groups", unique=True)
    S.history_groups(clean).write.parquet(path)
    return S.history_tables(items.sparkSession.read.parquet(path))


MANIFEST = "_tables"


def save_statistics(tables: dict[str, DataFrame], out_dir: str) -> str:
    """Writes the tables into a new version of ``out_dir``; the version counts from
    its manifest on, which is written last.  Returns the version's folder."""
    import uuid
    spark = next(iter(tables.values())).sparkSession
    version = os.path.join(out_dir, f"version={uuid.uuid4().hex[:12]}")
    for name, table in tables.items():
        table.write.parquet(os.path.join(version, name))
    listed = [(name, table.schema.json()) for name, table in tables.items()]
    spark.createDataFrame(listed, "name string, schema string").coalesce(1).write.parquet(os.path.join(version, MANIFEST))
    return version


def load_statistics(spark, version: str) -> dict[str, DataFrame]:
    """The tables that the manifest names; no manifest is an error."""
    from pyspark.sql.types import StructType
    from postcast.sources.items import _exists
    if not _exists(spark, os.path.join(version, MANIFEST)):
        raise FileNotFoundError(os.path.join(version, MANIFEST))
    listed = spark.read.parquet(os.path.join(version, MANIFEST)).collect()  # one row per table
    return {r["name"]: spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(
        os.path.join(version, r["name"])) for r in listed}


class Trained(dict):
    """What a training run gives.  What is still in ``to_make`` is made when it is first
    asked for, models that are named together side by side (``fit``)."""

    def __init__(self, made: dict, to_make: dict, parallel_fits: int):
        super().__init__(made)
        self.to_make, self.parallel_fits = to_make, parallel_fits

    def __missing__(self, key):
        return self.fit(key)[key]

    def fit(self, *keys: str) -> Trained:
        """The named parts, made where they are not there yet."""
        from concurrent.futures import ThreadPoolExecutor
        missing = [k for k in keys if k not in self]
        if len(missing) == 1:
            self[missing[0]] = self.to_make[missing[0]]()
        elif missing:
            # the fits are independent; submitted from threads (as MLlib's own tuning does
            # with `parallelism`) their many small stages share the cluster
            with ThreadPoolExecutor(max_workers=max(1, self.parallel_fits)) as pool:
                self.update(zip(missing, pool.map(lambda k: self.to_make[k](), missing)))
        return self


MODELS = ("score_model", "comment_model", "classifier")


def training_job(items: DataFrame, cutoff: str = TEMPORAL_CUTOFF, out_dir: str | None = None,
                 gbt: dict | None = None, forest: dict | None = None, parallel_fits: int = 3,
                 statistics_before: str | None = None, classifier: str = "forest", wait: bool = True) -> Trained:
    """Split, three models, score CDF, time statistics, domain statistics.

    ``domain_stats`` are those of the training side, which the features use; the saved
    ``history`` tables cover all stories, or those before ``statistics_before``.  Without
    ``wait`` a model or history table is made when it is first asked for, so a caller of
    the feature table alone waits for no fit."""
    feats, dstats, counts = split_features(items, cutoff)
    out = Trained({"features": feats, "domain_stats": dstats, "counts": counts}, {
        "score_model": lambda: M.fit_regressor(feats, "score", validation_col="is_validation", **(gbt or {})),
        "comment_model": lambda: M.fit_regressor(feats, "descendants", validation_col="is_validation", **(gbt or {})),
        "classifier": lambda: fit_classes(feats, "score", classifier, **(forest or {})),
        "history": lambda: history_statistics(items, statistics_before),
        "score_cdf": lambda: out["history"]["score_cdf"],
        "time_stats": lambda: out["history"]["time_stats"]}, parallel_fits)
    if wait or out_dir:
        out.fit(*MODELS).fit("history").fit("score_cdf", "time_stats")
    if out_dir:
        for k in MODELS:
            M.save_model(out[k], os.path.join(out_dir, k))
        out["statistics_version"] = save_statistics(out["history"], os.path.join(out_dir, "statistics"))
    return out


def validation_metrics(trained: dict) -> DataFrame:
    """A8 for the score model on the validation rows, with the A15 counts
    recorded while the feature table was written."""
    val = trained["features"].filter(F.col("is_validation"))
    pred = trained["score_model"].transform(val)
    c = trained["counts"]
    m = EV.regression_error(pred, "score", trained["score_model"].getPredictionCol())
    return m.withColumns({k: F.lit(int(v or 0)).cast("long") for k, v in c.items()})


def explain_classes(trained: dict, df: DataFrame, top: int = 5) -> DataFrame:
    """M6 + A14 + W7 for the classifier: attributions by class, ranked by
    the mean |value| over classes, reported with the mean signed value."""
    return M.shapley_attribution(trained["classifier"], df, key="id", name="explain_classes",
                              classifier=True, top_k=top, names=feature_names(EMBEDDING_DIM))


def classifier_metrics(trained: dict) -> DataFrame:
    """A9/A10 for the classifier on the validation rows."""
    val = trained["features"].filter(F.col("is_validation"))
    p = M.predict_classes(trained["classifier"], val).withColumn("_y", L.reception_class("score"))
    return p.agg(EV.accuracy(F.col("_y"), F.col("predicted_class")).alias("accuracy"),
                 EV.log_loss(F.col("probs"), F.col("_y")).alias("log_loss"),
                 F.count(F.lit(1)).alias("n"))


def fit_classes(flagged: DataFrame, score: str, classifier: str, **params):
    """M4 on rows with ``is_validation``: ``softmax`` boosting stops by the log loss of
    the flagged rows (a round is a few small jobs, so it takes the longer), a ``forest``
    is fitted on the others."""
    if classifier == "softmax":
        return M.fit_softmax(flagged, score, validation_col="is_validation", **params)
    return M.fit_classifier(flagged.filter(~F.col("is_validation")), score, **params)


def backtest(feats: DataFrame, score: str = "score", seed: int = 42, classifier: str = "forest", **params) -> dict:
    """M7: hash split (P3) with its validation tail (P4), classes (X16), a balanced
    classifier (M4; ``softmax`` stops on the tail, a forest, which does not stop early,
    is trained on it like the rest), metrics on the test part: accuracy,
    confusion, per-class precision and recall, Spearman of expected score vs
    actual."""
    f = SP.validation_tail(SP.hash_split(feats.drop("is_validation"), "id", seed=seed), "id", seed=seed)
    train, test = f.filter(~F.col("is_test")), f.filter(F.col("is_test"))
    if classifier != "softmax":
        train = train.withColumn("is_validation", F.lit(False))
    model = fit_classes(train, score, classifier, **params)
    pred = M.predict_classes(model, test).withColumn("actual", L.reception_class(score))
    conf = EV.confusion(pred, "actual", "predicted_class")
    summary = pred.agg(EV.accuracy(F.col("actual"), F.col("predicted_class")).alias("accuracy"),
                       F.count(F.lit(1)).alias("n_test"))
    rho = EV.spearman(pred.select(F.col("expected_score"), F.col(score).cast("double").alias("_s")),
                      "expected_score", "_s")
    return {"summary": summary, "confusion": conf, "per_class": EV.precision_recall(conf),
            "spearman": rho, "model": model}


def batch_score(pitches: DataFrame, trained: dict, story_index: DataFrame, comment_index: DataFrame | None = None,
                k: int = KNN_K, top_features: int = 5) -> DataFrame:
    """M9: one wide row per pitch (pitch_id, title, time, and optionally url and
    description, which default to '').

    Scores, label with confidence and distribution, expected score from the
    forest, percentile of the predicted score in the training history, the k
    most similar stories, the comments of the nearest of them and the prompt,
    top attributed features of the score model and of the classifier, and the
    posting advice.  The scored table is written once; every part reads it."""
    def given(c):
        return F.coalesce(F.col(c), F.lit("")) if c in pitches.columns else F.lit("")
    p = (pitches.withColumns({"url": given("url"), "text": given("description")})
         .withColumnRenamed("pitch_id", "id")
         .withColumn("score", F.lit(0)).withColumn("descendants", F.lit(0)))
    if isinstance(trained, Trained):
        trained.fit(*MODELS)
    feats = feature_table(clean_stories(p), trained["domain_stats"], extra=["text"])
    scored = M.predict_count(trained["score_model"], feats, "predicted_score")
    scored = M.predict_count(trained["comment_model"], scored, "predicted_comments")
    scored = M.predict_classes(trained["classifier"], scored)
    scored = materialise(scored.select(
        "id", "title", F.col("text").alias("description"), "features", "embedding", "predicted_score",
        "predicted_comments", "expected_score", L.reception_label("predicted_score").alias("label"),
        L.confidence("predicted_score").alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(x) for x in L.LABELS]),
                          L.soft_distribution("predicted_score")).alias("distribution")), "scored")
    hist = trained["features"].filter(~F.col("is_validation")).select("score")
    pct = S.percentile_of(scored.select("id", "predicted_score"), hist, "id", "predicted_score")
    # pitches share the id space of the index: a pitch never counts as its own
    # neighbour (a new title is not in the index either)
    hits = K.knn(story_index, scored.select(F.col("id").alias("query_id"), "embedding"), k=k,
                 exclude_self=True)
    similar = hits.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "neighbour_id"))).alias("_h"))
    nearest = hits.join(story_index.select(F.col("id").alias("neighbour_id"), "title", "score", "descendants"),
                        "neighbour_id").select("query_id", "rank", "title", "score", "descendants")
    if comment_index is None:
        ctx = hits.where("false").select("query_id", "neighbour_id", F.col("rank").alias("neighbour_rank"), F.col(
            "rank").alias("comment_rank"), F.col("rank").alias("comment_id"), F.lit("").alias("by"),
            F.lit("").alias("clean_text"))
    else:  # at most 3 x 10 comments for a pitch
        ctx = K.context_comments(hits, comment_index)
    said = ctx.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "neighbour_rank", "comment_rank", "neighbour_id", "comment_id", "by", "clean_text"))).alias("_c"))
    asked = scored.withColumnRenamed("id", "query_id").select("query_id", "title", "description", "predicted_score", "label")
    prompts = prompt_table(asked, nearest, ctx)
    names = feature_names(EMBEDDING_DIM)
    attr = M.shapley_attribution(trained["score_model"], scored, key="id", name="batch_score",
                                 top_k=top_features, names=names)
    classes = explain_classes(trained, scored, top_features).withColumnRenamed("top", "_classes")
    advice = S.best_time(trained["time_stats"]).select("advice").scalar()
    out = (scored.join(pct.select("id", "percentile"), "id", "left")
           .join(similar.withColumnRenamed("query_id", "id"), "id", "left")
           .join(said.withColumnRenamed("query_id", "id"), "id", "left")
           .join(prompts.withColumnRenamed("query_id", "id"), "id", "left")
           .join(attr, "id", "left").join(classes, "id", "left"))
    return out.select(
        F.col("id").alias("pitch_id"), "title", "predicted_score", "predicted_comments", "label",
        "confidence", "distribution", "expected_score", "percentile",
        F.transform(F.coalesce("_h", F.array()), lambda h: h["neighbour_id"]).alias("similar_ids"),
        F.transform(F.coalesce("_c", F.array()), lambda c: F.struct(
            c["neighbour_id"].alias("story_id"), c["comment_id"].alias("comment_id"), c["by"].alias("by"),
            c["clean_text"].alias("text"))).alias("comments"), "prompt",
        X.explanation_text(F.coalesce("top", F.array())).alias("top_features"),
        X.explanation_text(F.coalesce("_classes", F.array())).alias("top_class_features"),
        advice.alias("advice"))


def index_job(items: DataFrame, comments: DataFrame, name: str = "index") -> dict:
    """Clean, embed, write the story index (S8) and the comment index."""
    spark = items.sparkSession
    clean = clean_stories(live_stories(items))
    run = scratch_path(spark, name, unique=True)
    spath, cpath = os.path.join(run, "stories"), os.path.join(run, "comments")
    write_story_index(hashing_embedding(clean, "title"), spath)
    write_comment_index(clean_comments(comments), cpath)
    return {"stories": spark.read.parquet(spath), "comments": spark.read.parquet(cpath)}
