"""Market totals and market share."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.functions.numbers import percent_of
from sharetide.schemas import MEASURES, SEGMENT_KEYS, no_nan, require
from sharetide.session import stage

BRAND_KEYS = (*SEGMENT_KEYS, "clean_brand")
SHARE_COLUMNS = (
    "year_week", "clean_region", "clean_brand", "brand_trx", "clean_nrx", "clean_units",
    "total_segment_trx", "total_segment_nrx", "total_segment_units", "clean_therapeutic_area",
    "market_share_trx_pct", "market_share_nrx_pct", "momentum_ratio", "clean_trx",
)


def competitive_set(df: DataFrame, brands: Iterable[str] | DataFrame | None) -> DataFrame:
    """Keep the chosen brands, before any total; none chosen means the full market.

    A list becomes a pushed-down ``IN``; a DataFrame of brands becomes a semi join.
    """
    if brands is None:
        return df
    if isinstance(brands, DataFrame):
        return df.join(brands.select("clean_brand").distinct(), "clean_brand", "left_semi")
    chosen = list(brands)
    return df.filter(F.col("clean_brand").isin(chosen)) if chosen else df


def _sums() -> list:
    return [F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in MEASURES]


def with_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Drop rows that lack a grouping key; Spark would group them together."""
    for key in keys:
        df = df.filter(F.col(key).isNotNull())
    return df


def category_totals(facts: DataFrame) -> DataFrame:
    """The one pass over the facts: sums by week, region, brand and category.

    Brand totals, segment totals and the brand-to-category map are all derived from this small
    table, so the facts are read, combined on the map side and shuffled once.  A missing week is
    dropped by the readers of this table: where the label is derived from a date, testing it
    here would mean deriving it twice per fact.
    """
    require(facts, *BRAND_KEYS, "clean_therapeutic_area", *MEASURES)
    keyed = with_keys(
        facts.select(*BRAND_KEYS, "clean_therapeutic_area", *MEASURES), "clean_region", "clean_brand"
    )
    return no_nan(keyed, *MEASURES).groupBy(*BRAND_KEYS, "clean_therapeutic_area").agg(*_sums())


def brand_totals(totals: DataFrame) -> DataFrame:
    summed = with_keys(totals, "year_week").groupBy(*BRAND_KEYS).agg(*_sums())
    return summed.withColumnRenamed("clean_trx", "brand_trx")


def segment_totals(totals: DataFrame) -> DataFrame:
    """Week and region totals; every category of the segment counts."""
    return (
        with_keys(totals, "year_week")
        .groupBy(*SEGMENT_KEYS)
        .agg(*_sums())
        .withColumnsRenamed({m: m.replace("clean_", "total_segment_") for m in MEASURES})
    )


def brand_categories(totals: DataFrame, on_multi: str = "fan_out") -> DataFrame:
    """Distinct (brand, category); ``first`` keeps the smallest category of a brand."""
    if on_multi == "fan_out":
        return totals.select("clean_brand", "clean_therapeutic_area").distinct()
    if on_multi == "first":
        return totals.groupBy("clean_brand").agg(
            F.min("clean_therapeutic_area").alias("clean_therapeutic_area")
        )
    raise ValueError("on_multi must be 'fan_out' or 'first'")


def join_segment_totals(brands: DataFrame, segments: DataFrame) -> DataFrame:
    return brands.join(segments, list(SEGMENT_KEYS), "left")


def add_shares(df: DataFrame) -> DataFrame:
    """Share of the segment by total and by new volume, and their ratio (momentum)."""
    trx, nrx = F.col("market_share_trx_pct"), F.col("market_share_nrx_pct")
    return df.withColumns(
        {
            "market_share_trx_pct": percent_of(F.col("brand_trx"), F.col("total_segment_trx")),
            "market_share_nrx_pct": percent_of(F.col("clean_nrx"), F.col("total_segment_nrx")),
            "clean_trx": F.col("brand_trx"),
        }
    ).withColumn("momentum_ratio", F.when(trx > 0, nrx / trx).otherwise(F.lit(1.0)))


def shares_from_totals(totals: DataFrame, on_multi: str = "fan_out") -> DataFrame:
    joined = join_segment_totals(brand_totals(totals), segment_totals(totals))
    mapped = joined.join(brand_categories(totals, on_multi), "clean_brand", "left")
    return add_shares(mapped).select(*SHARE_COLUMNS)


def market_share(
    facts: DataFrame,
    brands: Iterable[str] | DataFrame | None = None,
    s: Settings = Settings(),
    staged: bool = True,
) -> DataFrame:
    """Shares of the full market or of a competitive set.

    The category totals feed three branches (brand totals, segment totals, brand categories).
    Column pruning makes the branches differ, so Spark cannot reuse one exchange for all and
    would read the facts again for each; ``staged`` writes the small totals table once instead.
    """
    totals = category_totals(competitive_set(facts, brands))
    return shares_from_totals(stage(totals, "category-totals") if staged else totals, s.on_multi)


def share_sum_check(shares: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Sum of shares per segment, and whether it is 100 within the tolerance."""
    gap = F.abs(F.col("market_share_trx_pct") - 100.0)
    return (
        shares.groupBy(*SEGMENT_KEYS)
        .agg(F.sum("market_share_trx_pct").alias("market_share_trx_pct"))
        .withColumn("is_valid_100_pct", gap <= s.sum_tolerance + 1e-5 * 100.0)
    )
