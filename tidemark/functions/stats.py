"""Aggregates that stay defined under ANSI arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over complete pairs; NULL where a side does not vary.

    The built-in ``corr`` divides by the product of the deviations and raises on
    a constant column.
    """
    x, y = a.cast("double"), b.cast("double")
    xs, ys = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(xs) * F.stddev_pop(ys))
