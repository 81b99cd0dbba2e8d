"""Time-of-post features (UTC, 0 = Monday)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postcast.constants import DAY_NAMES


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hour_utc(c) -> Column:
    return F.hour(_c(c)).cast("long")


def day_of_week(c) -> Column:
    """0 = Monday ... 6 = Sunday (``weekday``, not ``dayofweek``)."""
    return F.weekday(_c(c)).cast("long")


def time_features(c) -> dict[str, Column]:
    """X9-X11."""
    dow = day_of_week(c)
    return {
        "hour": hour_utc(c),
        "day_of_week": dow,
        "is_weekend": F.when(dow >= 5, 1).otherwise(0).cast("long"),
    }


def day_name(dow) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in DAY_NAMES]), _c(dow).cast("int") + 1)
