"""Trailing baselines and the anomaly detectors built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.functions.numbers import clip, flag
from sharetide.functions.stats import array_mad, array_median
from sharetide.operators.shift import series_window
from sharetide.schemas import SERIES_KEYS, no_nan, require

MEAN = "prev_3wk_rolling_mean_pp"
STD = "prev_3wk_rolling_std_pp"
MEDIAN = "prev_3wk_rolling_median_pp"
MAD = "prev_3wk_rolling_mad_pp"
# Detector column and the name it is reported under, in reporting order.
TECHNIQUES = (
    ("t1_moving_average_anomaly", "MA Trend Deviation"),
    ("t2_z_score_anomaly", "Robust Z-Score Spike"),
    ("t3_erosion_anomaly", "3-Wk Erosion"),
    ("t4_dynamic_threshold_anomaly", "Volatility Envelope Breach"),
    ("isolation_forest_anomaly", "Isolation Forest ML"),
)
# Fixed value: scales a median absolute deviation to a standard deviation.
MAD_TO_SIGMA = 0.6745


def trailing_baseline(shifts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Mean, sample deviation, median and MAD of the previous ``lookback`` shifts.

    The current week is outside its own frame; at least two shifts are needed.
    """
    require(shifts, "year_week", *SERIES_KEYS, "share_shift_pp")
    frame = series_window().rowsBetween(-s.lookback, -1)
    shift = F.col("share_shift_pp")
    enough = F.size("_trail") >= 2
    return (
        no_nan(shifts, "share_shift_pp")
        .withColumns(
            {
                "_trail": F.collect_list(shift).over(frame),
                "_mean": F.avg(shift).over(frame),
                "_std": F.stddev_samp(shift).over(frame),
                "_lag1": F.lag(shift, 1).over(series_window()),
                "_lag2": F.lag(shift, 2).over(series_window()),
            }
        )
        .withColumns(
            {
                MEAN: F.when(enough, F.col("_mean")),
                STD: F.when(enough, F.col("_std")),
                MEDIAN: F.when(enough, array_median(F.col("_trail"))),
            }
        )
        .withColumn(MAD, F.when(enough, array_mad(F.col("_trail"), F.col(MEDIAN))))
        .withColumn("_eroding", flag((shift < 0) & (F.col("_lag1") < 0) & (F.col("_lag2") < 0)))
        .drop("_trail", "_mean", "_std", "_lag1", "_lag2")
    )


def _floored(c: str, floor: float) -> Column:
    return F.greatest(F.coalesce(F.col(c), F.lit(floor)), F.lit(floor))


def dynamic_envelope(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    width = F.lit(s.envelope_factor) * _floored(STD, s.scale_floor_pp)
    return df.withColumns(
        {
            "dynamic_upper_threshold": F.col(MEAN) + width,
            "dynamic_lower_threshold": F.col(MEAN) - width,
        }
    )


def robust_z(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    distance = F.lit(MAD_TO_SIGMA) * (F.col("share_shift_pp") - F.col(MEDIAN))
    z = distance / _floored(MAD, s.scale_floor_pp)
    return df.withColumn("statistical_z_score", clip(z, -s.z_clip, s.z_clip))


def rule_detectors(df: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Moving-average deviation, robust z, three-week erosion and envelope breach."""
    shift = F.col("share_shift_pp")
    deviation = F.abs(shift - F.col(MEAN))
    outside = (shift > F.col("dynamic_upper_threshold")) | (shift < F.col("dynamic_lower_threshold"))
    return df.withColumns(
        {
            "t1_moving_average_anomaly": flag(
                deviation >= F.lit(s.ma_factor) * _floored(MAD, s.scale_floor_pp)
            ),
            "t2_z_score_anomaly": flag(F.abs("statistical_z_score") >= s.z_threshold),
            "t3_erosion_anomaly": F.col("_eroding"),
            "t4_dynamic_threshold_anomaly": flag(outside),
        }
    ).drop("_eroding")


def no_forest(df: DataFrame) -> DataFrame:
    """Neutral forest columns, for runs without the forest."""
    return df.withColumns(
        {
            "isolation_forest_label": F.lit(1),
            "isolation_forest_score": F.lit(0.0),
            "isolation_forest_anomaly": F.lit(False),
        }
    )


def combine(df: DataFrame) -> DataFrame:
    """Any detector fired, and the names of those that did."""
    fired = F.lit(False)
    for column, _ in TECHNIQUES:
        fired = fired | F.col(column)
    names = F.concat_ws(", ", *[F.when(F.col(c), F.lit(n)) for c, n in TECHNIQUES])
    return df.withColumns(
        {
            "combined_anomaly": fired,
            "is_statistical_anomaly": fired,
            "triggered_techniques": F.coalesce(F.nullif(names, F.lit("")), F.lit("None")),
        }
    )


def rules_only(shifts: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Baselines and the four rule detectors: one shuffle, no Python."""
    return rule_detectors(robust_z(dynamic_envelope(trailing_baseline(shifts, s), s), s), s)


def gold(shifts: DataFrame, s: Settings = Settings(), forest=None) -> DataFrame:
    """The full detector stage.

    ``forest``: ``None`` leaves it out, ``'fit'`` fits and scores on these rows, and a fitted
    :class:`~sharetide.operators.forest.ForestModel` scores them with that model.
    """
    from sharetide.operators.forest import isolation_forest

    ruled = rules_only(shifts, s)
    if forest is None:
        return combine(no_forest(ruled))
    if isinstance(forest, str):
        return combine(isolation_forest(ruled, s))
    return combine(forest.transform(ruled))
