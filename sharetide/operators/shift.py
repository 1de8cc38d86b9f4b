"""Week-over-week share shift."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sharetide.functions.dates import monday_of, year_week
from sharetide.schemas import SERIES_KEYS, no_nan, require


def series_window():
    """A series is one (region, category, brand), at most one row per week: bounded by the
    number of weeks.  Every trailing computation shares this spec, hence one shuffle and sort."""
    return Window.partitionBy(*SERIES_KEYS).orderBy("year_week")


def fill_gaps(shares: DataFrame) -> DataFrame:
    """``shares`` with a row for every week that a series lacks between its first and its last, and the column ``is_gap``.

    A gap has no measures, so a week after a gap has no shift, and baselines taken over the result reach over weeks
    of the calendar instead of rows.  Drop the gaps after that.  Without this step, the default, baselines count the rows
    that a series has.  Rows whose week is no valid label stay as they are.
    """
    monday = monday_of(F.col("year_week"))
    ends = shares.groupBy(*SERIES_KEYS).agg(F.min(monday).alias("a"), F.max(monday).alias("z")).filter(F.col("a").isNotNull())
    weeks = F.transform(F.sequence("a", "z", F.expr("INTERVAL 7 DAYS")), lambda day: year_week(day))
    spine = ends.select(*SERIES_KEYS, F.explode(F.array_distinct(weeks)).alias("year_week"))
    same = shares["year_week"] == spine["year_week"]
    for k in SERIES_KEYS:
        same = same & shares[k].eqNullSafe(spine[k])
    gaps = spine.join(shares, same, "left_anti").withColumn("is_gap", F.lit(True))
    return shares.withColumn("is_gap", F.lit(False)).unionByName(gaps, allowMissingColumns=True)


def share_shifts(shares: DataFrame) -> DataFrame:
    """Shift against the previous row of the series; the first week has none (NULL, not 0)."""
    require(shares, "year_week", *SERIES_KEYS, "market_share_trx_pct")
    share, before = F.col("market_share_trx_pct"), F.col("prev_market_share_pp")
    return (
        no_nan(shares, "market_share_trx_pct")
        .withColumn("prev_market_share_pp", F.lag("market_share_trx_pct", 1).over(series_window()))
        .withColumn("share_shift_pp", share - before)
        .withColumn("share_shift_bps", F.col("share_shift_pp") * 100.0)
    )
