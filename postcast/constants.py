"""Defaults of the library.

Fixed values: these must equal the behaviour being reproduced (label bounds,
bucket medians, sampling strata, smoothing prior, posting-time day names).
They are stated here once, in natural order; everything else derives from them.
"""

# --- fixed values -----------------------------------------------------------
LABELS = ["flop", "low", "moderate", "hot", "viral"]
LABEL_UPPER_BOUNDS = [3, 15, 100, 300]          # inclusive upper bound of the first four labels
BUCKET_MEDIANS = [1.0, 7.0, 37.0, 159.0, 441.0]  # one per label; also the soft-label centres
SOFT_LABEL_TEMPERATURE = 0.5
LABEL_DESCRIPTIONS = {
    "flop": (
        "Post received minimal engagement. Score stayed very low, suggesting it "
        "did not resonate with the HN community or was posted at a bad time."
    ),
    "low": (
        "Post received below-average engagement. Attracted only a handful of upvotes "
        "and limited discussion — typical for posts that did not break through."
    ),
    "moderate": (
        "Post received moderate engagement. Attracted a small but engaged audience "
        "and generated some discussion — a typical outcome for niche or technical content."
    ),
    "hot": (
        "Post did well on HN. Reached the front page or came close, generating "
        "significant discussion and broad community interest."
    ),
    "viral": (
        "Post went viral on HN. Exceptional score and widespread discussion — "
        "one of the top posts of the day or week."
    ),
}
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
POST_TYPE_PREFIXES = [("Show HN:", "show_hn"), ("Ask HN:", "ask_hn"),
                      ("Tell HN:", "tell_hn"), ("Launch HN:", "launch_hn")]
# stratified sample: (low inclusive, high exclusive or None, share of the total)
STRATA = [(1, 5, 0.30), (5, 20, 0.30), (20, 100, 0.25), (100, None, 0.15)]
SAMPLE_FLOOR_DATE = "2018-01-01"
SMOOTHING_K = 10
SMOOTHING_PRIOR = 47.57
TEMPORAL_CUTOFF = "2023-01-01"
EMBEDDING_DIM = 384
KNN_K = 5
CONTEXT_STORIES = 3
CONTEXT_COMMENTS = 10
COMMENT_LOOKUP_LIMIT = 20
TEST_FRACTION = 0.2
SPLIT_SEED = 42
VALIDATION_FRACTION = 0.1
VALIDATION_MIN_ROWS = 5
OPTIMISE_ROUNDS = 5
OPTIMISE_MIN_GAIN = 2.0
LOGLOSS_EPS = 1e-15
# ---------------------------------------------------------------------------

N_CLASSES = len(LABELS)
