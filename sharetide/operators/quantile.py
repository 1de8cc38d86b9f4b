"""Exact quantile of a column without gathering the column anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharetide.operators.selection import covers, ranked


def exact_quantile(df: DataFrame, column: str, p: float, accuracy: int = 10_000) -> float | None:
    """Linearly interpolated quantile, as ``numpy.percentile`` defines it.

    A mergeable sketch brackets the answer, one aggregation counts what lies below the bracket,
    and only the values inside it, collapsed to (value, copies), are ranked, range by range.  ``df`` is read
    three times, so hand in a stored table.
    """
    x = F.col(column)
    slack = 2.0 / accuracy
    probes = F.array(F.lit(max(p - slack, 0.0)), F.lit(min(p + slack, 1.0)))
    n, bracket, lowest, highest = df.agg(
        F.count(x), F.percentile_approx(x, probes, accuracy), F.min(x), F.max(x)
    ).first()
    if not n:
        return None
    position = (n - 1) * p
    low, high = bracket

    def inside(low: float, high: float) -> tuple[int, int]:
        below, within = df.agg(F.count_if(x < low), F.count_if(x.between(low, high))).first()
        return below, within

    below, within = inside(low, high)
    if not (below <= int(position) and int(position) + 1 < below + within):
        low, high = (lowest, high) if below > int(position) else (low, highest)
        below, within = inside(low, high)
    if within <= 1:
        return float(low)
    copies = df.filter(x.between(low, high)).groupBy(x.alias("value")).agg(F.count(F.lit(1)).alias("copies"))
    first = min(max(int(position) - below, 0), within - 1)
    ranks = (first, min(first + 1, within - 1))
    near = ranked(copies, []).filter(covers(F.lit(ranks[0])) | covers(F.lit(ranks[1]))).select("value").orderBy("value").collect()
    return float(near[0][0] + (position - int(position)) * (near[-1][0] - near[0][0]))
