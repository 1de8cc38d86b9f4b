"""Report tables over the gold table: slices, indicators, trends, movers, text briefs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharetide.config import ALL_REGIONS
from sharetide.operators.forecast import forecast_summary

ALL_CATEGORIES = "All Therapeutic Areas"
MOVER_COLUMNS = (
    "clean_region", "clean_therapeutic_area", "market_share_trx_pct",
    "share_shift_pp", "share_shift_bps", "clean_trx",
)


def slice_gold(
    df: DataFrame,
    region: str | None = None,
    category: str | None = None,
    week: str | None = None,
    brand: str | None = None,
) -> DataFrame:
    """Optional equality filters; ``None`` or the "All ..." label switches one off."""
    chosen = (
        ("clean_region", region), ("clean_therapeutic_area", category),
        ("year_week", week), ("clean_brand", brand),
    )
    for column, value in chosen:
        if value is not None and value not in (ALL_REGIONS, ALL_CATEGORIES):
            df = df.filter(F.col(column) == value)
    return df


def week_kpis(gold: DataFrame) -> DataFrame:
    """Per week and brand: volume of the week, mean share, mean shift in pp and bps.

    A week without a shift reads 0 and is labelled as baseline.
    """
    volume = gold.groupBy("year_week").agg(F.sum("clean_trx").alias("total_volume"))
    shift = F.col("mean_shift")
    per_brand = gold.groupBy("year_week", "clean_brand").agg(
        F.coalesce(F.avg("market_share_trx_pct"), F.lit(0.0)).alias("current_share"),
        F.avg("share_shift_pp").alias("mean_shift"),
    )
    return per_brand.join(volume, "year_week").select(
        "year_week",
        "clean_brand",
        "total_volume",
        "current_share",
        F.coalesce(shift, F.lit(0.0)).alias("shift_pp"),
        F.coalesce(shift * 100.0, F.lit(0.0)).alias("shift_bps"),
        F.when(shift.isNull(), "Baseline Week").otherwise("Shift").alias("shift_label"),
    )


def share_trend(gold: DataFrame) -> DataFrame:
    return gold.groupBy("year_week", "clean_brand").agg(
        F.avg("market_share_trx_pct").alias("market_share_trx_pct")
    )


def trailing_weeks(gold: DataFrame, week: str, brands: Sequence[str], span: int = 12, fallback: int = 26) -> DataFrame:
    """Rows of ``brands`` in the ``span`` distinct weeks up to ``week``.

    If ``week`` is absent only that week counts; if fewer than two weeks come out, all rows up
    to ``week`` are taken, at most the last ``fallback`` weeks.  Ranks run over distinct weeks.
    """
    chosen = gold.filter(F.col("clean_brand").isin(list(brands)) & (F.col("year_week") <= week))
    newest = Window.orderBy(F.desc("year_week"))
    every = newest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # One row per week: small, whatever the number of series.
    weeks = (
        gold.filter(F.col("year_week") <= week)
        .groupBy("year_week")
        .agg(F.max(F.col("clean_brand").isin(list(brands)).cast("int")).alias("_has"))
        .withColumn("_rank", F.row_number().over(newest))
        .withColumn("_known", F.max((F.col("year_week") == week).cast("int")).over(every))
        .withColumn("_own_rank", F.sum("_has").over(newest))
        .withColumn("_near", F.when(F.col("_known") == 1, F.col("_rank") <= span).otherwise(False).cast("int") * F.col("_has"))
        .withColumn("_count", F.sum("_near").over(every))
    )
    used = F.when(F.col("_count") >= 2, F.col("_near") == 1).otherwise((F.col("_has") == 1) & (F.col("_own_rank") <= fallback))
    return chosen.join(weeks.filter(used).select("year_week"), "year_week", "left_semi")


def distinct_brands(gold: DataFrame) -> DataFrame:
    return gold.select("clean_brand").distinct().orderBy("clean_brand")


def distinct_dims(gold: DataFrame) -> DataFrame:
    """Sorted choices of every selector, as (dimension, value); years come latest first."""
    year = F.split_part("year_week", F.lit("-W"), F.lit(1))
    choices = F.array(
        *[
            F.struct(F.lit(name).alias("dimension"), value.alias("value"))
            for name, value in (
                ("brand", F.col("clean_brand")),
                ("region", F.col("clean_region")),
                ("category", F.col("clean_therapeutic_area")),
                ("week", F.col("year_week")),
                ("year", year),
            )
        ]
    )
    latest_first = F.when(F.col("dimension") == "year", -F.col("value").try_cast("int"))
    return (
        gold.select(F.explode(choices).alias("c"))
        .select("c.*")
        .distinct()
        .orderBy("dimension", latest_first, "value")
    )


def brand_category_choices(gold: DataFrame) -> DataFrame:
    return gold.select("clean_brand", "clean_therapeutic_area").distinct()


def year_week_choices(gold: DataFrame) -> DataFrame:
    """Weeks of every year with their number, for the week selector."""
    weeks = gold.select("year_week").distinct()
    return weeks.select(
        F.split_part("year_week", F.lit("-W"), F.lit(1)).alias("year"),
        F.split_part("year_week", F.lit("-W"), F.lit(2)).cast("int").alias("week"),
        "year_week",
    ).orderBy("year", "week")


def region_lists(gold: DataFrame) -> DataFrame:
    """Per week and brand: sorted regions that lost and that gained share, as text."""

    def regions(direction: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_set(F.when(direction, F.col("clean_region")))), ", ")

    return gold.groupBy("year_week", "clean_brand").agg(
        regions(F.col("share_shift_pp") < 0).alias("decline_regions"),
        regions(F.col("share_shift_pp") > 0).alias("growth_regions"),
    )


def regional_declines(gold: DataFrame, week: str, brand: str) -> DataFrame:
    rows = slice_gold(gold, week=week, brand=brand).filter(F.col("share_shift_pp") < 0)
    return rows.orderBy("share_shift_pp", "clean_region").select(*MOVER_COLUMNS)


def regional_gains(gold: DataFrame, week: str, brand: str) -> DataFrame:
    rows = slice_gold(gold, week=week, brand=brand).filter(F.col("share_shift_pp") > 0)
    return rows.orderBy(F.desc("share_shift_pp"), "clean_region").select(*MOVER_COLUMNS)


def top_movers(gold: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` largest losses and gains of every (week, brand).

    The rank limit is applied before the shuffle too, so a hot (week, brand) sends ``k`` rows
    per task.
    """
    direction = F.when(F.col("share_shift_pp") < 0, "decline").when(F.col("share_shift_pp") > 0, "growth")
    order = Window.partitionBy("year_week", "clean_brand", "direction").orderBy(
        F.desc(F.abs("share_shift_pp")), "clean_region", "clean_therapeutic_area"
    )
    return (
        gold.withColumn("direction", direction)
        .filter(F.col("direction").isNotNull())
        .select(
            "year_week", "clean_brand", "direction", "clean_region", "clean_therapeutic_area",
            "share_shift_pp", "clean_trx",
        )
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
    )


def default_competitors(gold: DataFrame, brand: str, k: int = 3) -> DataFrame:
    return except_brand(gold, brand).orderBy("clean_brand").limit(k)


def except_brand(gold: DataFrame, brand: str) -> DataFrame:
    return gold.select("clean_brand").filter(F.col("clean_brand") != brand).distinct()


def latest_week(gold: DataFrame) -> DataFrame:
    return gold.groupBy("clean_brand", "clean_region").agg(F.max("year_week").alias("latest_week"))


def brand_week_brief(gold: DataFrame, forecast: DataFrame, region: str = ALL_REGIONS) -> DataFrame:
    """A text context per (week, brand): share, shift, regions, competitors, movers, forecast."""
    keys = ["year_week", "clean_brand"]
    mover = F.format_string("%s %+.2f pp (%.0f)", F.col("clean_region"), F.col("share_shift_pp"), F.col("clean_trx"))

    def listed(direction: str) -> Column:
        row = F.when(F.col("direction") == direction, F.struct("rank", mover.alias("text")))
        return F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["text"]), "; ")

    movers = top_movers(gold).groupBy(*keys).agg(
        listed("decline").alias("top_declines"), listed("growth").alias("top_gains")
    )
    rivals = Window.partitionBy("year_week").orderBy("clean_brand")
    first_names = (
        gold.select(*keys).distinct().withColumn("r", F.row_number().over(rivals)).filter(F.col("r") <= 4)
        .groupBy("year_week").agg(F.array_sort(F.collect_list("clean_brand")).alias("names"))
    )
    competitors = F.array_join(F.slice(F.array_remove(F.col("names"), F.col("clean_brand")), 1, 3), ", ")
    outlook = forecast_summary(forecast.filter(F.col("clean_region") == region)).select(
        "clean_brand", "mean_forecast", F.col("weeks").alias("forecast_weeks")
    )
    lines = F.concat_ws(
        "\n",
        F.format_string("Brand: %s", F.col("clean_brand")),
        F.format_string("Week: %s", F.col("year_week")),
        F.format_string("Current share: %.2f%%", F.col("current_share")),
        F.format_string("Shift: %+.2f pp", F.col("shift_pp")),
        F.concat(F.lit("Declining regions: "), F.col("decline_regions")),
        F.concat(F.lit("Growing regions: "), F.col("growth_regions")),
        F.concat(F.lit("Competitors: "), F.col("competitors")),
        F.format_string("Forecast share: %.2f%% across %s", F.col("mean_forecast"), F.col("forecast_weeks")),
        F.concat(F.lit("Largest declines: "), F.coalesce("top_declines", F.lit(""))),
        F.concat(F.lit("Largest gains: "), F.coalesce("top_gains", F.lit(""))),
    )
    return (
        week_kpis(gold)
        .join(region_lists(gold), keys)
        .join(movers, keys, "left")
        .join(first_names, "year_week", "left")
        .join(outlook, "clean_brand", "left")
        .withColumn("competitors", competitors)
        .withColumn("brief", lines)
        .select(*keys, "current_share", "shift_pp", "decline_regions", "growth_regions", "competitors", "brief")
    )


def summary_fallback(briefs: DataFrame, column: str = "brief", length: int | None = None) -> DataFrame:
    """Fixed summary text around a brief, or around its first ``length`` characters if that is asked for."""
    context = F.col(column) if length is None else F.left(F.col(column), F.lit(length))
    text = F.concat(
        F.lit("**Commercial Analytics Executive Summary**\n\n- **Context:** "),
        context,
        F.lit("...\n- **Baseline:** trailing three-week envelope.\n- **Outlook:** four-week forecast."),
    )
    return briefs.withColumn("summary", text)
