"""Order statistics of short arrays, for trailing windows of a few rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def array_median(values: Column) -> Column:
    """Interpolated median; NULL for an empty array."""
    ordered, n = F.array_sort(values), F.size(values)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ordered, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def array_mad(values: Column, centre: Column) -> Column:
    """Median absolute deviation about ``centre``."""
    return array_median(F.transform(values, lambda x: F.abs(x - centre)))
