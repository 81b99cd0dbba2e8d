"""Quality rules: a threshold table compiled into one Spark projection.

``judge(docs)`` keeps every row and column and adds the measures of its whole
text and the verdict.  All of it is built-in expressions: no user functions.

Defined cases: a null text counts as a text without words and is rejected;
an empty text likewise; a repeated row is judged like the first; a column of
the input named like a measure is replaced by the measure; an empty table
gives an empty table.
"""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postcast.llm.common import words_of

WINDOW = 5

# Function words of the four languages of the corpus.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "is", "a", "that", "for", "with", "as", "on", "are", "be", "this",
    "el", "la", "de", "que", "y", "en", "los", "las", "un", "una", "por", "para", "con", "no", "se", "su", "es",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "ist", "des", "ein", "eine", "nicht", "auf",
    "le", "les", "et", "des", "du", "une", "est", "pour", "qui", "dans", "sur", "au", "pas", "par",
]


class Rule(NamedTuple):
    """A document passes if low <= measure <= high (None: no bound)."""
    name: str
    measure: str
    low: float | None
    high: float | None


# The threshold table.  Measures are columns of ``measures``.
RULES = [
    Rule("length", "n_words", 10, None),
    Rule("repeated_words", "repeat_word_pct", None, 20),
    Rule("word_length", "mean_word_chars", 2, 15),
    Rule("symbols", "symbol_ratio", None, 0.3),
    Rule("exclamations", "exclamation_ratio", None, 0.5),
    Rule("stop_words", "stop_word_ratio", 0.02, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.5),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
]
BASE = ("length", "repeated_words")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures, each over the whole text.

    Repeated words: every 5-word window is hashed (xxhash64 over its words);
    if a text has no hash twice the count is zero at once, otherwise sorting
    (hash, position) finds the windows with an equal neighbour, and the words
    they cover are summed over the sorted positions, so the work per text is
    n log n also for very long or very repetitive texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({"_text": body, "_words": words_of(F.col(text)),
                          "_lines": F.filter(F.split(body, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("_words")
    d = d.withColumn("_h", F.when(n >= WINDOW, F.transform(
        F.sequence(F.lit(0), n - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("_words"), i + k) for k in range(WINDOW)]))))
    d = d.withColumn("_z", F.when(
        F.size(F.array_distinct("_h")) < F.size("_h"),
        F.sort_array(F.transform("_h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    z = F.col("_z")
    twice = F.filter(z, lambda x, j: F.coalesce(F.get(z, j - 1)["h"] == x["h"], F.lit(False))
                     | F.coalesce(F.get(z, j + 1)["h"] == x["h"], F.lit(False)))
    d = d.withColumn("_p", F.sort_array(F.transform(twice, lambda x: x["i"])))
    p = F.col("_p")
    covered = F.aggregate(
        F.transform(p, lambda v, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - v, F.lit(WINDOW)))),
        F.lit(0).cast("long"), lambda acc, v: acc + v)
    n_chars = F.length("_text")
    n_lines = F.size("_lines")
    d = d.withColumns({
        "n_words": n.cast("long"),
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (n_chars - F.length(F.regexp_replace("_text", r"[#*$%&|<>]", ""))).cast("long"),
        "n_exclamations": (n_chars - F.length(F.replace("_text", F.lit("!"), F.lit("")))).cast("long"),
        "n_lines": n_lines.cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_stop_words": F.size(F.filter("_words", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(STOP_WORDS))).cast("long"),
        "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: x.endswith("...") | x.endswith("…"))).cast("long"),
        "n_bullet_lines": F.size(F.filter("_lines", lambda x: x.rlike(r"^[\x20\x09]*[-•‣*]"))).cast("long"),
    })
    return d.drop("_text", "_words", "_lines", "_h", "_z", "_p")


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbol_ratio": ("n_symbols", "n_words"),
    "exclamation_ratio": ("n_exclamations", "n_words"),
    "dup_line_ratio": ("n_dup_lines", "n_lines"),
    "ellipsis_line_ratio": ("n_ellipsis_lines", "n_lines"),
    "bullet_line_ratio": ("n_bullet_lines", "n_lines"),
}


def _holds(rule: Rule) -> Column:
    if rule.measure == "stop_word_ratio":  # one word more than counted, so a short text may have none
        return (F.col("n_stop_words") + 1) / F.greatest("n_words", F.lit(1)) >= rule.low
    if rule.measure == "repeat_word_pct":  # in whole numbers: 100 * repeated > high * words fails
        return F.col("n_repeat_words") * 100 <= F.col("n_words") * rule.high
    m = _ratio(*RATIOS[rule.measure]) if rule.measure in RATIOS else F.col(rule.measure)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (m >= rule.low)
    if rule.high is not None:
        ok = ok & (m <= rule.high)
    return ok


def judge(docs: DataFrame, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Adds the measures, ``failed`` (names of the broken rules), ``base_failed``
    and ``kept``."""
    d = measures(docs, text)
    failed = F.filter(F.array(*[F.when(~_holds(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    base = F.lit(False)
    for r in rules:
        if r.name in BASE:
            base = base | ~_holds(r)
    kept = F.lit(True)
    for r in rules:
        kept = kept & _holds(r)
    return d.withColumns({"failed": failed, "base_failed": base, "kept": kept & ~base})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows that pass every rule, with the input's columns.

    The extra ``_bar`` column is not deterministic, which keeps the optimizer
    from pushing the filter below the projections and computing them twice."""
    d = judge(docs.withColumn("_all", F.struct("*")), "text").withColumn("_bar", F.rand(1))
    return d.where(F.col("kept") & (F.col("_bar") >= 0)).select("_all.*")
