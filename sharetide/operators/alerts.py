"""Growth and decline alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.functions.numbers import flag
from sharetide.operators.detectors import TECHNIQUES
from sharetide.schemas import GOLD_KEYS

# Alert categories.
DECLINE = "REGIONAL SHARE DECLINE"
GROWTH = "REGIONAL GROWTH SPIKE"
NORMAL = "NORMAL"
ALERT_COLUMNS = (
    *GOLD_KEYS, "alert_category", "alert_type", "severity_level", "previous_share_pp",
    "current_share_pp", "share_shift_pp", "share_shift_bps", "dynamic_upper_threshold",
    "dynamic_lower_threshold", "statistical_z_score", "isolation_forest_score",
    "triggered_techniques", "executive_brief",
)


def qualified_shift(s: Settings = Settings()) -> Column:
    """Some detector fired and the shift is substantial."""
    fired = F.lit(False)
    for column, _ in TECHNIQUES:
        fired = fired | flag(F.col(column))
    return flag(fired & (F.abs("share_shift_pp") >= s.substantial_shift_pp))


def alert_category(s: Settings = Settings()) -> Column:
    """Erosion alerts at any size; other detectors need a substantial shift."""
    eroding = flag(F.col("t3_erosion_anomaly"))
    return (
        F.when(~(qualified_shift(s) | eroding), F.lit(NORMAL))
        .when((F.col("share_shift_pp") < 0) | eroding, F.lit(DECLINE))
        .otherwise(F.lit(GROWTH))
    )


def alert_brief() -> Column:
    sentence = F.format_string(
        "%s for %s in %s (Shift: %+.2f pp / %+.0f bps). Current Share: %.2f%%.",
        F.initcap(F.lower("alert_category")),
        F.col("clean_brand"),
        F.col("clean_region"),
        F.col("share_shift_pp"),
        F.coalesce(F.col("share_shift_bps"), F.lit(0.0)),
        F.coalesce(F.col("market_share_trx_pct"), F.lit(0.0)),
    )
    return F.when(F.col("alert_category") == NORMAL, F.lit("")).otherwise(sentence)


def classify(gold: DataFrame, s: Settings = Settings()) -> DataFrame:
    """One row per gold row that has a shift, NORMAL included."""
    share = F.coalesce(F.col("market_share_trx_pct"), F.lit(0.0))
    category = F.col("alert_category")
    return (
        gold.filter(F.col("share_shift_pp").isNotNull())
        .withColumn("alert_category", alert_category(s))
        .withColumns(
            {
                "alert_type": category,
                "severity_level": category,
                "previous_share_pp": share - F.col("share_shift_pp"),
                "current_share_pp": share,
                "executive_brief": alert_brief(),
            }
        )
        .select(*ALERT_COLUMNS)
    )


def active(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("alert_category").isin(GROWTH, DECLINE))


def generate_alerts(gold: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(all classified rows, active alerts)."""
    everything = classify(gold, s)
    return everything, active(everything)
