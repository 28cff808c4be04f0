"""Numeric value to named tier."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A rating above 8 is a star, above 7 good, above 6 average, anything else bad.
RATING_BOUNDS = (8.0, 7.0, 6.0)
RATING_LABELS = ("star", "good", "average", "bad")


def tier(
    value: Column | str,
    bounds: Sequence[float] = RATING_BOUNDS,
    labels: Sequence[str] = RATING_LABELS,
) -> Column:
    """Label of the first bound (descending) that ``value`` exceeds, the last label below all.

    NULL stays NULL. ``labels`` holds one entry more than ``bounds``.
    """
    if len(labels) != len(bounds) + 1:
        raise ValueError("labels must have exactly one more entry than bounds")
    if list(bounds) != sorted(bounds, reverse=True):
        raise ValueError("bounds must be descending")
    value = F.col(value) if isinstance(value, str) else value
    # The lowest tier is the default of a CASE that first sorts out NULL.
    case = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, label in zip(bounds, labels):
        case = case.when(value > F.lit(bound), F.lit(label))
    return case.otherwise(F.lit(labels[-1]))
