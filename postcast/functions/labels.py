"""Score -> reception label, soft label distribution, expected score,
log-target transforms and arg-max.  Scalar expressions only."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from postcast.constants import (BUCKET_MEDIANS, LABELS, LABEL_UPPER_BOUNDS,
                                SOFT_LABEL_TEMPERATURE)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def reception_label(score) -> Column:
    """Inclusive upper bounds 3 / 15 / 100 / 300."""
    s = _c(score)
    out = F.lit(LABELS[-1])
    for bound, name in reversed(list(zip(LABEL_UPPER_BOUNDS, LABELS))):
        out = F.when(s <= bound, F.lit(name)).otherwise(out)
    return out


def reception_class(score) -> Column:
    """Class index 0 (flop) .. 4 (viral)."""
    s = _c(score)
    out = F.lit(len(LABELS) - 1)
    for i, bound in reversed(list(enumerate(LABEL_UPPER_BOUNDS))):
        out = F.when(s <= bound, F.lit(i)).otherwise(out)
    return out.cast("long")


def soft_probabilities(score, centres=BUCKET_MEDIANS,
                       temperature: float = SOFT_LABEL_TEMPERATURE) -> list[Column]:
    """Softmax of -(log1p(max(s,0)) - log1p(centre))^2 / temperature,
    one column per label.

    The common -ls^2/T term cancels, so logit_i = a_i*ls + b_i with
    a_i = 2*c_i/T and b_i = -c_i^2/T (c_i = log1p(centre_i)), and
    p_i = 1 / sum_j exp((a_j - a_i)*ls + (b_j - b_i)).  Each probability is a
    small flat expression (no nested softmax tree, no higher-order function),
    so it stays inside whole-stage codegen; overflow gives p_i = 0, never NaN."""
    ls = F.log1p(F.greatest(_c(score).cast("double"), F.lit(0.0)))
    cs = [math.log1p(c) for c in centres]
    a = [2.0 * c / temperature for c in cs]
    b = [-(c * c) / temperature for c in cs]
    probs = []
    for i in range(len(cs)):
        total = F.lit(1.0)
        for j in range(len(cs)):
            if j != i:
                total = total + F.exp(ls * F.lit(a[j] - a[i]) + F.lit(b[j] - b[i]))
        probs.append(F.lit(1.0) / total)
    return probs


def soft_distribution(score) -> Column:
    """X17 as an array<double> in label order."""
    return F.array(*soft_probabilities(score))


def confidence(score) -> Column:
    """Probability of the *threshold* label (not the arg-max)."""
    return F.element_at(soft_distribution(score), reception_class(score).cast("int") + 1)


def argmax(probs) -> Column:
    """First maximum wins, 0-based."""
    p = _c(probs)
    return (F.array_position(p, F.array_max(p)) - 1).cast("long")


def soft_label(score) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]),
                        argmax(soft_distribution(score)).cast("int") + 1)


def expected_score(probs, medians=BUCKET_MEDIANS) -> Column:
    """Probabilities . medians (fixed length, so plain element access
    instead of a higher-order function)."""
    p = _c(probs)
    out = F.lit(0.0)
    for i, m in enumerate(medians):
        out = out + F.element_at(p, i + 1) * F.lit(float(m))
    return out


def log_target(c) -> Column:
    """X19 forward: log1p of the (non-null) count."""
    return F.log1p(F.coalesce(_c(c), F.lit(0)).cast("double"))


def from_log(c) -> Column:
    """X19 inverse: expm1, clipped at 0."""
    return F.greatest(F.expm1(_c(c)), F.lit(0.0))


def label_table(spark):
    """5-row dimension table (label, class_index, description)."""
    from postcast.constants import LABEL_DESCRIPTIONS
    rows = [(name, i, LABEL_DESCRIPTIONS[name]) for i, name in enumerate(LABELS)]
    return spark.createDataFrame(rows, "label string, class_index long, description string")


def with_reception(df, score: str, probs: str = "probs"):
    """Label, class, soft distribution (array), confidence and arg-max label,
    added in two projection steps so the distribution is computed once."""
    d = df.withColumns({"label": reception_label(score), "class_index": reception_class(score),
                        probs: soft_distribution(score)})
    return d.withColumns({
        "confidence": F.element_at(F.col(probs), F.col("class_index").cast("int") + 1),
        "soft_label": F.element_at(F.array(*[F.lit(x) for x in LABELS]),
                                   argmax(probs).cast("int") + 1),
    })
