"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the whole driver tables.  Keys and output columns match ``oracle.ORACLE_SQL``."""
from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postcast.constants import LABELS
from postcast.functions import labels as L
from postcast.functions.parse import comment_items, suggestion_items
from postcast.functions.text import html_to_text, post_type, title_features, url_domain, url_text_features
from postcast.functions.time import time_features
from postcast.operators import evaluate as EV
from postcast.operators import explain as X
from postcast.operators import knn as K
from postcast.operators import models as MD
from postcast.operators import ranking as R
from postcast.operators import sampling, stats
from postcast.operators import splits as SP
from postcast.operators.clean import clean_comments
from postcast.operators.embed import encoder_embedding, hashing_embedding
from postcast.operators.features import structural_features
from postcast.operators.prompts import prompt_table
from postcast.plans import jobs as JB
from postcast.plans.common import clean_live, live, rounded, stories, time_text
from postcast.session import scratch_path
from postcast.sources.bindings import comments, stories_once
from postcast.sources.items import comments_for_stories, story_scan
from postcast.sources.tables import read_table, read_years
from postcast.streaming import index_stream as ST

REGISTRY: dict = {}


def query(name):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# ---- minimum slice ---------------------------------------------------------

@query("domain_reputation")
def domain_reputation(spark: SparkSession, sf: str) -> DataFrame:
    """Domains with the highest smoothed score; prior = mean of the data."""
    s = stats.domain_stats(clean_live(spark, sf), prior="data")
    return rounded(s).orderBy(F.col("avg_score").desc(), F.col("domain"))


# ---- scans, filters, sampling ---------------------------------------------

def _scan_cols(df):
    return df.select("id", "title", "url", "text", "score", "descendants", "by",
                     time_text("time").alias("time"), "dead", "deleted")


@query("story_scan_top")
def story_scan_top(spark, sf):
    return _scan_cols(story_scan(stories(spark, sf), limit=100))


@query("story_scan_since")
def story_scan_since(spark, sf):
    return _scan_cols(story_scan(stories(spark, sf), limit=200, min_score=10,
                                 min_date="2024-01-02 12:00:00", seed=7))


@query("story_scan_recent_top")
def story_scan_recent_top(spark, sf):
    """S1 in score order under both bounds (min score and inclusive min date)."""
    return _scan_cols(story_scan(stories(spark, sf), limit=50, min_score=5,
                                 min_date="2024-01-02 00:00:00"))


def _popular_ids(spark, sf):
    return story_scan(stories(spark, sf), limit=None, min_score=100, columns=["id"])


@query("comments_for_stories")
def comments_for_stories_q(spark, sf):
    c = comments_for_stories(comments(spark, sf), _popular_ids(spark, sf))
    return c.select("id", "parent", "by", "text")


@query("comments_limited")
def comments_limited(spark, sf):
    c = comments_for_stories(comments(spark, sf), _popular_ids(spark, sf), limit_per_story=3)
    return c.select("id", "parent", "by", "text")


@query("stratified_sample")
def stratified_sample(spark, sf):
    s = sampling.stratified_sample(stories(spark, sf), total=400, seed=42)
    return s.select("id", "score", F.col("stratum").cast("long").alias("stratum"),
                    F.col("stratum_rank").cast("long").alias("stratum_rank"))


@query("seeded_sample")
def seeded_sample(spark, sf):
    e = read_table(spark, sf, "events")
    return rounded(sampling.seeded_sample(e, 500, seed=42, id_col="event_id")
                   .select("event_id", "user_id", "event_type", "value"))


# ---- cleaning and scalar features -------------------------------------------

@query("clean_html")
def clean_html(spark, sf):
    # every page with a paragraph of references and bare angle brackets behind it
    p = read_table(spark, sf, "pages")
    tail = F.lit("<p>https:&#x2F;&#47;x.y &mdash; if x < 5 and y > 3 end&nbsp;")
    return p.select("page_id", html_to_text(F.concat("html", tail)).alias("clean_text"))


@query("clean_comments")
def clean_comments_q(spark, sf):
    return clean_comments(comments(spark, sf)).select("id", "parent", "clean_text")


@query("url_domains")
def url_domains(spark, sf):
    p = read_table(spark, sf, "pages")
    return p.select("page_id", "url", url_domain("url").alias("domain"))


@query("post_types")
def post_types(spark, sf):
    return live(spark, sf).select("id", "title", post_type("title").alias("post_type"))


@query("title_features")
def title_features_q(spark, sf):
    return live(spark, sf).select("id", *[c.alias(n) for n, c in title_features("title").items()])


@query("time_features")
def time_features_q(spark, sf):
    return live(spark, sf).select("id", *[c.alias(n) for n, c in time_features("time").items()])


@query("url_text_features")
def url_text_features_q(spark, sf):
    return clean_live(spark, sf).select(
        "id", "domain", *[c.alias(n) for n, c in url_text_features("domain", "clean_text").items()])


TRAIN_CUTOFF = "2024-01-02 12:00:00"


@query("structural_features")
def structural_features_q(spark, sf):
    """Domain statistics from the training side only (no leakage), then the
    15 columns for every live story."""
    c = clean_live(spark, sf)
    train = c.filter(F.col("time") < F.to_timestamp(F.lit(TRAIN_CUTOFF)))
    return rounded(structural_features(c, stats.domain_stats(train)))


# ---- statistics ------------------------------------------------------------

def _events_stats(spark, sf):
    return stats.time_stats(read_table(spark, sf, "events"), "ts", "value")


@query("time_stats")
def time_stats_q(spark, sf):
    return rounded(_events_stats(spark, sf))


@query("best_time")
def best_time_q(spark, sf):
    return rounded(stats.best_time(_events_stats(spark, sf)))


@query("top_hours")
def top_hours_q(spark, sf):
    return rounded(stats.top_hours(_events_stats(spark, sf)))


@query("score_cdf")
def score_cdf_q(spark, sf):
    e = read_table(spark, sf, "events")
    return rounded(stats.score_cdf(e, "value"))


@query("score_percentile")
def score_percentile_q(spark, sf):
    e = read_table(spark, sf, "events")
    return rounded(stats.history_percentile(e, "event_id", "value"))


@query("score_percentile_new")
def score_percentile_new_q(spark, sf):
    d = read_table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") / 20.0).alias("new_score"))
    e = read_table(spark, sf, "events")
    return rounded(stats.percentile_of(d, e, "doc_id", "new_score", "value"))


# ---- labels ----------------------------------------------------------------

def _events(spark, sf):
    return read_table(spark, sf, "events").select("event_id", "value")


@query("reception")
def reception(spark, sf):
    return rounded(_events(spark, sf).select(
        "event_id", "value", L.reception_label("value").alias("label"),
        L.reception_class("value").alias("class_index")))


@query("reception_soft")
def reception_soft(spark, sf):
    e = L.with_reception(_events(spark, sf), "value")
    return rounded(e.select(
        "event_id", *[F.element_at("probs", i + 1).alias(f"p_{n}") for i, n in enumerate(LABELS)],
        "label", "confidence", "soft_label"))


@query("expected_score")
def expected_score_q(spark, sf):
    e = _events(spark, sf)
    return rounded(e.select("event_id", L.expected_score(L.soft_distribution("value"))
                            .alias("expected_score")))


@query("reception_described")
def reception_described(spark, sf):
    e = _events(spark, sf).withColumn("label", L.reception_label("value"))
    t = F.broadcast(L.label_table(spark).select("label", "description"))  # 5 rows
    return e.join(t, "label", "left").select("event_id", "label", "description")


# ---- nearest neighbours, context, prompts ------------------------------------


def _knn_hits(spark, sf):
    emb = read_table(spark, sf, "embeddings")
    return K.knn(emb, emb, k=5, index_id="vec_id", query_id="vec_id", vec="embedding",
                 exclude_self=True)


@query("knn_topk")
def knn_topk(spark, sf):
    return rounded(_knn_hits(spark, sf))


@query("knn_context")
def knn_context(spark, sf):
    ctx = K.context_comments(_knn_hits(spark, sf), comments(spark, sf))
    return ctx.select("query_id", "neighbour_id", F.col("neighbour_rank").cast("long"),
                      "comment_id", F.col("comment_rank").cast("long"), "by")


@query("comment_lookup")
def comment_lookup(spark, sf):
    from postcast.sources.items import per_group_limit
    c = comments(spark, sf)
    r = per_group_limit(c, ["parent"], [F.col("id")], 20, rank_col="rank")
    return r.select("id", "parent", "by", F.col("rank").cast("long"))


@query("prompt_table")
def prompt_table_q(spark, sf):
    st = stories(spark, sf).select("id", "title", "score", "descendants")
    ev = read_table(spark, sf, "events").select("event_id", "value")
    emb = read_table(spark, sf, "embeddings").select("vec_id")
    pitches = (emb.join(st, emb.vec_id == st.id, "left")
               .join(ev, emb.vec_id == ev.event_id, "left")
               .select(F.col("vec_id").alias("query_id"), "title", F.lit("").alias("description"),
                       F.col("value").alias("predicted_score"),
                       L.reception_label("value").alias("label")))
    hits = _knn_hits(spark, sf)
    sims = hits.join(st, hits.neighbour_id == st.id, "left").select(
        "query_id", "rank", "title", "score", "descendants")
    # the comment index: cleaned, without comments that are empty after cleaning
    ctx = K.context_comments(hits, clean_comments(comments(spark, sf)))
    return prompt_table(pitches, sims, ctx)


# ---- evaluation --------------------------------------------------------------


def _evalbase(spark, sf):
    lb = read_table(spark, sf, "labels").select("doc_id")
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("_d"), "n_chars")
    e = read_table(spark, sf, "events").select("event_id", "value")
    j = lb.join(d, lb.doc_id == d._d).join(e, lb.doc_id == e.event_id)
    return j.select("doc_id", F.col("value").alias("actual"),
                    (F.col("n_chars") / 50.0).alias("predicted"))


@query("class_weights")
def class_weights_q(spark, sf):
    b = _evalbase(spark, sf).withColumn("cls", L.reception_class("actual"))
    return rounded(stats.class_weights(b, "cls"))


@query("regression_error")
def regression_error_q(spark, sf):
    b = _evalbase(spark, sf).withColumn("predicted_log", F.log1p("predicted"))
    return rounded(EV.regression_error(b, "actual", "predicted_log"))


@query("accuracy_logloss")
def accuracy_logloss_q(spark, sf):
    b = _evalbase(spark, sf).select(L.reception_class("actual").alias("y"),
                                    L.soft_distribution("predicted").alias("p"))
    return rounded(b.agg(EV.accuracy(F.col("y"), L.argmax("p")).alias("accuracy"),
                         EV.log_loss(F.col("p"), F.col("y")).alias("log_loss"),
                         F.count(F.lit(1)).alias("n")))


def _classes(spark, sf):
    return _evalbase(spark, sf).select(L.reception_class("actual").alias("actual"),
                                       L.reception_class("predicted").alias("predicted"))


@query("confusion")
def confusion_q(spark, sf):
    return EV.confusion(_classes(spark, sf), "actual", "predicted")


@query("precision_recall")
def precision_recall_q(spark, sf):
    return rounded(EV.precision_recall(EV.confusion(_classes(spark, sf), "actual", "predicted")))


@query("spearman")
def spearman_q(spark, sf):
    return rounded(EV.spearman(_evalbase(spark, sf), "predicted", "actual"))


# ---- splits ----------------------------------------------------------------


def _flag(c):
    return F.col(c).cast("long").alias(c)


@query("temporal_split")
def temporal_split_q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return SP.temporal_split(o, "o_orderdate", "1999-01-01").select("o_orderkey", _flag("is_validation"))


@query("fallback_split")
def fallback_split_q(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return SP.fallback_split(o, "o_orderdate", "o_orderkey", "1990-01-01").select(
        "o_orderkey", _flag("is_validation"))


@query("hash_split")
def hash_split_q(spark, sf):
    e = read_table(spark, sf, "events").select("event_id")
    return SP.hash_split(e, "event_id").select("event_id", _flag("is_test"))


@query("validation_tail")
def validation_tail_q(spark, sf):
    e = SP.validation_tail(SP.hash_split(read_table(spark, sf, "events").select("event_id"),
                                         "event_id"), "event_id")
    part = (F.when(F.col("is_test"), F.lit("test"))
            .when(F.col("is_validation"), F.lit("validation")).otherwise(F.lit("train")))
    return e.select("event_id", part.alias("part"))


# ---- ranking ---------------------------------------------------------------


def _variants(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return e.withColumn("label", L.reception_label("value"))


@query("variant_rank")
def variant_rank_q(spark, sf):
    r = R.rank_variants(_variants(spark, sf), "user_id", "event_id", "value")
    return rounded(r.select("user_id", "event_id", "value", "rank"))


@query("variant_summary")
def variant_summary_q(spark, sf):
    r = R.rank_variants(_variants(spark, sf), "user_id", "event_id", "value")
    ex = R.best_explanation(r, "user_id", "event_type", "value", "label")
    lines = R.ranked_lines(r, "user_id", "event_type", "value", "label")
    return lines.join(ex, "user_id").select("user_id", "rank", "line", F.when(F.col("rank") == 1, F.col("explanation"))
                                            .alias("explanation"))


def _originals(v):
    first = v.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
    return v.join(first, ["user_id", "event_id"], "left_semi")


@query("suggestion_rank")
def suggestion_rank_q(spark, sf):
    v = _variants(spark, sf)
    orig = _originals(v)
    sugg = v.join(orig.select("event_id"), "event_id", "left_anti")
    sugg = R.drop_seen(sugg, orig, ["user_id", "event_type"])
    r = R.rank_with_original(orig, sugg, "user_id", "event_id", "value")
    return rounded(r.select("user_id", "event_id", "value", "is_original", "rank"))


@query("optimise_trace")
def optimise_trace_q(spark, sf):
    v = _variants(spark, sf)
    orig = _originals(v)
    o = orig.select(F.col("user_id").alias("pitch"), F.col("event_type").alias("title0"),
                    F.col("value").alias("s0"))
    sugg = (v.join(orig.select("event_id"), "event_id", "left_anti")
            .select(F.col("user_id").alias("pitch"), (F.col("event_id") % 5 + 1).alias("rnd"),
                    F.concat("event_type", F.lit(" "), (F.col("event_id") % 3).cast("string")).alias("title"),
                    F.col("value").alias("score")))
    t = R.optimise_trace(sugg, o)
    return rounded(t.withColumnRenamed("pitch", "user_id"))


@query("tried_titles")
def tried_titles_q(spark, sf):
    return R.tried_list(_variants(spark, sf), "user_id", "event_type")


# ---- attribution reports ----------------------------------------------------


EMB_NAMES = [f"emb_{i}" for i in range(64)]


def _top(spark, sf):
    e = read_table(spark, sf, "embeddings")
    vals = F.transform("embedding", lambda v: v.cast("double"))
    return e.select("vec_id", X.top_features(vals, EMB_NAMES, k=5).alias("top"))


@query("attribution_topk")
def attribution_topk_q(spark, sf):
    t = _top(spark, sf).select("vec_id", F.posexplode("top").alias("pos", "f"))
    return rounded(t.select("vec_id", (F.col("pos") + 1).cast("long").alias("position"),
                            F.col("f.feature").alias("feature"),
                            F.col("f.importance").alias("importance"),
                            F.col("f.direction").alias("direction")))


@query("attribution_allowed")
def attribution_allowed_q(spark, sf):
    """W7 with an allow-list of names (the first 16 features only)."""
    e = read_table(spark, sf, "embeddings")
    vals = F.transform("embedding", lambda v: v.cast("double"))
    top = e.select("vec_id", X.top_features(vals, EMB_NAMES, k=5, allow=EMB_NAMES[:16]).alias("top"))
    t = top.select("vec_id", F.posexplode("top").alias("pos", "f"))
    return rounded(t.select("vec_id", (F.col("pos") + 1).cast("long").alias("position"),
                            F.col("f.feature").alias("feature"),
                            F.col("f.importance").alias("importance"),
                            F.col("f.direction").alias("direction")))


@query("attribution_text")
def attribution_text_q(spark, sf):
    return _top(spark, sf).select("vec_id", X.explanation_text(F.col("top")).alias("text"))


# ---- response parsing (rows-only check) -------------------------------------


def _responses(spark, sf, kind):
    c = read_table(spark, sf, "conversations")
    if kind == "comments":
        item = F.struct(F.col("role").alias("username"), F.col("text").alias("comment"),
                        F.lit("neutral").alias("tone"))
        partial = F.struct(F.col("role").alias("username"))
    else:
        item = F.struct(F.col("text").alias("title"), F.col("role").alias("description"))
        partial = F.struct(F.col("role").alias("description"))
    js = F.concat(F.lit("["), F.to_json(item), F.lit(","), F.to_json(partial), F.lit("]"))
    # every row's text in every kind of reply: plain, padded, fenced, an object, a refusal
    replies = F.array(js, F.concat(F.lit("\n"), js, F.lit(" ")),
                      F.concat(F.lit("Here you go:\n```json\n"), js, F.lit("\n```\nEnjoy.")),
                      F.concat(F.lit("```\n"), js, F.lit("\n```")),
                      F.to_json(F.struct(F.col("text").alias("comment"))),
                      F.concat(F.lit("Sorry, no list: "), F.col("text")))
    return c.select("conv_id", "turn", F.posexplode(replies).alias("reply", "response"))


@query("parse_responses")
def parse_responses_q(spark, sf):
    r = _responses(spark, sf, "comments").select("conv_id", "turn", "reply",
                                                 F.posexplode(comment_items(F.col("response"))))
    return r.select("conv_id", "turn", F.col("pos").cast("long").alias("item"),
                    F.col("col")["username"].alias("username"), F.col("col")["comment"].alias("comment"),
                    F.col("reply").cast("long").alias("reply"))


@query("parse_suggestions")
def parse_suggestions_q(spark, sf):
    r = _responses(spark, sf, "suggestions").select("conv_id", "turn", "reply",
                                                    F.posexplode(suggestion_items(F.col("response"))))
    return r.select("conv_id", "turn", F.col("pos").cast("long").alias("item"),
                    F.col("col")["title"].alias("title"), F.col("col")["description"].alias("description"),
                    F.col("reply").cast("long").alias("reply"))


# ---- sources written and read back (S2, S5, L3) -------------------------------


def _tag(sf: str) -> str:
    return hashlib.md5(sf.encode()).hexdigest()[:8]


@query("multi_file_scan")
def multi_file_scan(spark, sf):
    """Events written as a day-partitioned parquet table, read back with
    a partition filter (partition pruning skips the earlier days' files)."""
    path = scratch_path(spark, f"events_by_day_{_tag(sf)}", unique=True)
    e = read_table(spark, sf, "events")
    (e.withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
      .repartition("day", F.pmod(F.xxhash64("event_id"), F.lit(8)))
      .write.mode("overwrite").partitionBy("day").parquet(path))
    r = spark.read.parquet(path).filter(F.col("day") >= F.lit("2024-01-10").cast("date"))
    return rounded(r.select("event_id", "user_id", "value", F.col("day").cast("string").alias("day")))


@query("random_sample")
def random_sample_q(spark, sf):
    e = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    return sampling.random_sample(e, 100)


# ---- learning, scoring, retrieval jobs (rows-only checks) ---------------------


_TRAINED: dict = {}


def _trained(spark, sf, *models):
    """The training run, with the named models fitted; others are when they are asked for."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        _TRAINED[key] = JB.training_job(stories(spark, sf), cutoff=TRAIN_CUTOFF, wait=False)
    return _TRAINED[key].fit(*models)


@query("title_embedding")
def title_embedding_q(spark, sf):
    return hashing_embedding(live(spark, sf).select("id", "title"), "title")


@query("train_score")
def train_score_q(spark, sf):
    return rounded(JB.validation_metrics(_trained(spark, sf)))


@query("train_reception")
def train_reception_q(spark, sf):
    return rounded(JB.classifier_metrics(_trained(spark, sf)))


@query("predict_batch")
def predict_batch_q(spark, sf):
    t = _trained(spark, sf, *JB.MODELS)
    p = MD.predict_count(t["score_model"], t["features"], "predicted_score")
    p = MD.predict_count(t["comment_model"], p, "predicted_comments")
    p = MD.predict_classes(t["classifier"], p)
    return rounded(p.select("id", "predicted_score", "predicted_comments", "predicted_class",
                            "expected_score"))


@query("explain_batch")
def explain_batch_q(spark, sf):
    t = _trained(spark, sf)
    a = MD.shapley_attribution(t["score_model"], t["features"], key="id", name=f"explain_{_tag(sf)}",
                            top_k=5, names=JB.feature_names(384))
    top = a.select("id", F.posexplode("top").alias("pos", "f"))
    return rounded(top.select("id", (F.col("pos") + 1).cast("long").alias("position"),
                              F.col("f.feature").alias("feature"),
                              F.col("f.importance").alias("importance"),
                              F.col("f.direction").alias("direction"),
                              F.lit("log1p_score").alias("unit")))


@query("explain_reception")
def explain_reception_q(spark, sf):
    t = _trained(spark, sf)
    top = JB.explain_classes(t, t["features"]).select("id", F.posexplode("top").alias("pos", "f"))
    # forest attributions are in class-probability units; they sum to zero over
    # the classes, so the class-mean signed value is ~0 while the ranking uses
    # the class-mean absolute value
    return rounded(top.select("id", (F.col("pos") + 1).cast("long").alias("position"),
                              F.col("f.feature").alias("feature"),
                              F.col("f.importance").alias("importance"),
                              F.col("f.direction").alias("direction"),
                              F.lit("class_probability").alias("unit")))


_SOFTMAX: dict = {}


def _softmax(spark, sf):
    """M4 by softmax boosting, on the written feature table of the training run."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SOFTMAX:
        _SOFTMAX[key] = JB.fit_classes(_trained(spark, sf)["features"], "score", "softmax")
    return _SOFTMAX[key]


@query("train_softmax")
def train_softmax_q(spark, sf):
    """A9/A10 of the boosted classifier on the rows that stopped it, and its rounds."""
    t = _trained(spark, sf)
    model = _softmax(spark, sf)
    m = JB.classifier_metrics({"features": t["features"], "classifier": model})
    return rounded(m).withColumn("rounds", F.lit(len(model.rounds)).cast("long"))


@query("softmax_invariants")
def softmax_invariants_q(spark, sf):
    """What holds for every boosted classifier: a row per live story, probabilities that
    sum to 1, attributions that sum with the base to margins with those probabilities."""
    feats, model = _trained(spark, sf)["features"], _softmax(spark, sf)
    p = MD.predict_classes(model, feats).select("id", "probs")
    a = MD.shapley_attribution(model, feats, key="id", classifier=True)
    sums = F.zip_with("attribution", "base", lambda v, b: F.exp(b + F.aggregate(v, F.lit(0.0), lambda x, y: x + y)))
    a = a.select("id", sums.alias("_e"))
    a = a.withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda x, y: x + y))
    off = F.zip_with("probs", "_e", lambda q, e: F.abs(q - e / F.col("_z")))
    total = F.aggregate("probs", F.lit(0.0), lambda x, y: x + y)
    return p.join(a, "id", "left").agg(
        F.count(F.lit(1)).alias("stories"), F.min(F.abs(total - 1) < 1e-9).alias("probabilities_sum_to_one"),
        F.min(F.coalesce(F.array_max(off) < 1e-9, F.lit(False))).alias("additive"))


_BACKTESTS: dict = {}


def _backtest(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _BACKTESTS:
        _BACKTESTS[key] = JB.backtest(_trained(spark, sf)["features"])
    return _BACKTESTS[key]


@query("backtest")
def backtest_q(spark, sf):
    b = _backtest(spark, sf)
    return rounded(b["summary"].withColumn("spearman", b["spearman"].select("spearman").scalar()))


@query("backtest_matrix")
def backtest_matrix_q(spark, sf):
    """A11 of the backtest: all 25 cells."""
    return _backtest(spark, sf)["confusion"]


@query("backtest_classes")
def backtest_classes_q(spark, sf):
    """A12 of the backtest: precision and recall of each class."""
    return rounded(_backtest(spark, sf)["per_class"])


@query("backtest_invariants")
def backtest_invariants_q(spark, sf):
    """What holds for every backtest: the confusion table's cells and rows, and what
    precision, recall and accuracy have to be by it."""
    b = _backtest(spark, sf)
    conf = b["confusion"]
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    rows = conf.groupBy(F.col("actual").alias("_c")).agg(F.sum("n").alias("_of"), F.sum(hit).alias("_tp"))
    cols = conf.groupBy(F.col("predicted").alias("_c")).agg(F.sum("n").alias("_as"))
    per = b["per_class"].withColumnRenamed("cls", "_c")

    def share(total):
        return F.when(F.col(total) > 0, F.col("_tp") / F.col(total)).otherwise(0.0)
    by_class = rows.join(cols, "_c").join(per, "_c").agg(
        F.sum("_of").alias("n_test"), F.count(F.lit(1)).alias("classes"), F.sum("_tp").alias("_hits"),
        F.min((F.abs(F.col("precision") - share("_as")) < 1e-9)
              & (F.abs(F.col("recall") - share("_of")) < 1e-9)).alias("shares_follow"))
    accuracy = b["summary"].select("accuracy").scalar()
    return by_class.select("n_test", "classes", "shares_follow", (F.abs(
        accuracy - F.col("_hits") / F.col("n_test")) < 1e-9).alias("accuracy_follows"))


@query("model_round_trip")
def model_round_trip_q(spark, sf):
    """The three models saved, loaded again and applied to every row."""
    t = _trained(spark, sf, *JB.MODELS)
    run = scratch_path(spark, f"saved_models_{_tag(sf)}", unique=True)

    def applied(score, comments_, classes, suffix):
        p = MD.predict_count(score, t["features"], "s")
        p = MD.predict_classes(classes, MD.predict_count(comments_, p, "c"))
        return p.select("id", *[F.col(c).alias(c + suffix) for c in ("s", "c", "probs")])
    models = [("score_model", "regressor"), ("comment_model", "regressor"), ("classifier", "forest")]
    for name, _ in models:
        MD.save_model(t[name], f"{run}/{name}")
    first = applied(*[t[name] for name, _ in models], "")
    again = applied(*[MD.load_model(kind, f"{run}/{name}") for name, kind in models], "2")
    return first.join(again, "id", "left").agg(
        F.count(F.lit(1)).alias("stories"), F.min(F.col("s").eqNullSafe(F.col("s2"))).alias("score_equal"),
        F.min(F.col("c").eqNullSafe(F.col("c2"))).alias("comments_equal"),
        F.min(F.col("probs").eqNullSafe(F.col("probs2"))).alias("classes_equal"))


def letter_encoder(dim: int = 384, seed: int = 42):
    """A stand-in for a sentence encoder: letter counts through a seeded matrix of whole
    numbers, whose sums are exact whatever texts share a batch."""
    import numpy as np
    matrix = np.random.default_rng(seed).integers(-100, 101, (256, dim)).astype(float)

    def encode(texts: list[str]) -> np.ndarray:
        counts = np.stack([np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=256) for t in texts])
        out = counts @ matrix
        return (out / np.sqrt(np.maximum((out ** 2).sum(axis=1, keepdims=True), 1))).astype(np.float32)
    return encode


@query("encoder_invariants")
def encoder_invariants_q(spark, sf):
    """M1: every title through the pluggable encoder; what holds for any unit encoder:
    its dimension and norm, and equal vectors for equal texts."""
    e = encoder_embedding(live(spark, sf).select("id", "title"), "title", factory=letter_encoder)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    e = e.select("title", (F.size("embedding") == 384).alias("_d"), (F.abs(norm - 1) < 1e-3).alias("_u"),
                 F.xxhash64("embedding").alias("_h"))
    same = e.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.min("_d").alias("_d"), F.min("_u").alias("_u"),
                                  (F.min("_h") == F.max("_h")).alias("_e"))
    return same.agg(F.sum("n").alias("stories"), F.count(F.lit(1)).alias("titles"), F.min("_d").alias("dimension"),
                    F.min("_u").alias("unit"), F.min("_e").alias("equal_for_equal_titles"))


_YEARS: dict = {}
ALL_YEARS = list(range(1970, 2101))


@query("year_files")
def year_files_q(spark, sf):
    """The stories landed by year, read back through a list of years."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _YEARS:
        _YEARS[key] = scratch_path(spark, f"years_{_tag(sf)}", unique=True)
        landed = stories(spark, sf).select("id", "score", "by", "time", F.year("time").alias("year"))
        landed.repartition("year", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("year").parquet(_YEARS[key])
    chosen = read_years(spark, _YEARS[key], ALL_YEARS)
    return chosen.select("id", "score", "by", F.col("year").cast("long").alias("year"))


_INDEXES: dict = {}


def _index(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = JB.index_job(stories(spark, sf), comments(spark, sf), name=f"index_{_tag(sf)}")
    return _INDEXES[key]


@query("index_build")
def index_build_q(spark, sf):
    """All columns of the written story index but the vector, which is told by its
    length and whether its norm is 1 (0 for a title without words)."""
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, v: a + v.cast("double") * v)
    return _index(spark, sf)["stories"].select(
        "id", "title", "url", "clean_text", "score", "descendants", "domain", "post_type",
        F.size("embedding").cast("long").alias("dim"), ((norm > 0.999) & (norm < 1.001)).alias("unit"))


@query("comment_index")
def comment_index_q(spark, sf):
    """The written comment index, read back."""
    return _index(spark, sf)["comments"].select("id", "parent", "clean_text", "by")


@query("train_counts")
def train_counts_q(spark, sf):
    """Rows per side of the split and per class of the training side, counted in
    the written feature table."""
    counts = _trained(spark, sf)["features"].agg(*JB.split_count_exprs())
    return counts.select(*[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in sorted(counts.columns)])


_HISTORY: dict = {}


def _history(spark, sf):
    """The statistics of the whole history, saved and read back."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _HISTORY:
        tables = JB.history_statistics(stories(spark, sf))
        _HISTORY[key] = JB.save_statistics(tables, scratch_path(spark, f"statistics_{_tag(sf)}", unique=True))
    return JB.load_statistics(spark, _HISTORY[key])


@query("saved_domain_stats")
def saved_domain_stats_q(spark, sf):
    """A2 over the whole history: the prior from the data, the empty domain kept."""
    return rounded(_history(spark, sf)["domain_stats"].select("domain", "post_count", "avg_score"))


@query("saved_time_stats")
def saved_time_stats_q(spark, sf):
    return rounded(_history(spark, sf)["time_stats"])


@query("saved_score_cdf")
def saved_score_cdf_q(spark, sf):
    return rounded(_history(spark, sf)["score_cdf"])


@query("predict_invariants")
def predict_invariants_q(spark, sf):
    """What holds for every prediction, whatever the model: a row per live story,
    no negative score, probabilities that sum to 1, attributions that sum with the
    base to the prediction."""
    t = _trained(spark, sf, "score_model", "classifier")
    p = MD.predict_count(t["score_model"], t["features"], "predicted_score")
    p = MD.predict_classes(t["classifier"], p)
    total = F.aggregate("probs", F.lit(0.0), lambda a, v: a + v)
    p = p.select("id", "predicted_score", (F.abs(total - 1) < 1e-9).alias("_one"))
    raw = t["score_model"].transform(t["features"]).select("id", F.col(t["score_model"].getPredictionCol()).alias("_p"))
    a = MD.shapley_attribution(t["score_model"], t["features"], key="id", name=f"additive_{_tag(sf)}")
    s = F.aggregate("attribution", F.lit(0.0), lambda x, v: x + v) + F.col("base")
    fit = raw.join(a, "id").select("id", (F.abs(s - F.col("_p")) < 1e-6).alias("_fit"))
    return p.join(fit, "id", "left").agg(
        F.count(F.lit(1)).alias("stories"), F.min(F.col("predicted_score") >= 0).alias("no_negative"),
        F.min("_one").alias("probabilities_sum_to_one"), F.min(F.coalesce("_fit", F.lit(False))).alias("additive"))


@query("backtest_confusion")
def backtest_confusion_q(spark, sf):
    """Actual classes of the backtest's test part (rows of its confusion table):
    they depend on the split alone, not on the model."""
    conf = _backtest(spark, sf)["confusion"]
    return conf.groupBy("actual").agg(F.sum("n").alias("n"))


@query("sample_invariants")
def sample_invariants_q(spark, sf):
    """L3: an unseeded sample is 100 different rows of the table."""
    e = read_table(spark, sf, "events").select("event_id", "user_id", "value")
    s = sampling.random_sample(e, 100)
    known = s.join(e.withColumn("_in", F.lit(1)), ["event_id", "user_id", "value"], "left")
    return known.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("event_id").alias("n_distinct"),
                     F.sum(F.coalesce("_in", F.lit(0))).alias("n_known"))


def _batch(spark, sf):
    idx = _index(spark, sf)
    pitches = live(spark, sf).select(F.col("id").alias("pitch_id"), "title", "url",
                                     F.col("text").alias("description"), "time")
    return JB.batch_score(pitches, _trained(spark, sf), idx["stories"], idx["comments"])


@query("batch_score")
def batch_score_q(spark, sf):
    out = _batch(spark, sf)
    return out.withColumn("similar_ids", F.array_join(F.col("similar_ids").cast("array<string>"), ","))\
              .withColumn("distribution", F.to_json("distribution")).withColumn("comments", F.to_json("comments"))


@query("batch_invariants")
def batch_invariants_q(spark, sf):
    """What holds for every pitch's row, whatever the models: comments of its first three
    neighbours only, each of them in the prompt, and both explanations."""
    first = F.slice("similar_ids", 1, 3)
    return _batch(spark, sf).agg(
        F.count(F.lit(1)).alias("pitches"),
        F.min(F.forall("comments", lambda c: F.array_contains(first, c["story_id"]))).alias("of_neighbours"),
        F.min(F.forall("comments", lambda c: F.contains(F.col("prompt"), c["text"]))).alias("in_prompt"),
        F.min(F.startswith("prompt", F.lit("## Pitch"))).alias("has_prompt"),
        F.min((F.length("top_features") > 0) & (F.length("top_class_features") > 0)).alias("explained"))


# ---- streaming build (Structured Streaming, run to completion) ----------------


@query("stream_domain_stats")
def stream_domain_stats_q(spark, sf):
    """Items derived from the driver tables land as files; the streaming index
    build processes them (availableNow) and its running (n, sum) state gives the
    smoothed domain table, equal to the batch statistics with the fixed prior."""
    run = scratch_path(spark, f"stream_{_tag(sf)}", unique=True)
    items = ST.as_items(stories_once(spark, sf), comments(spark, sf).withColumn("dead", F.lit(0))
                        .withColumn("deleted", F.lit(0)))
    for kind, name in ((1, "stories"), (2, "comments")):
        items.filter(F.col("type") == kind).write.option("compression", "zstd").parquet(f"{run}/landing/{name}")
    for q in ST.start_index_stream(spark, f"{run}/landing/*", f"{run}/out", name=run.rsplit("/", 1)[-1]):
        q.awaitTermination()
    return rounded(ST.smoothed_domains(spark, f"{run}/out"))
