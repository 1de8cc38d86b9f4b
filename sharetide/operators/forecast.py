"""Forecast of every brand and region series in one job."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharetide.config import ALL_REGIONS, Settings
from sharetide.functions.dates import next_year_weeks
from sharetide.functions.numbers import clip
from sharetide.operators import arima
from sharetide.session import spread

SERIES = ("clean_brand", "clean_region")
RECENT = 12
# Status texts and the weights of the trend and cycle adjustment.
FITTED = "ARIMA_MODEL_FIT"
NO_HISTORY = "Forecast unavailable — no historical data for selected brand/region."
TOO_SHORT = "Forecast unavailable — insufficient historical data."
FIT_ERROR = "Forecast unavailable — statistical fit error."
DAMPING, SIN_WEIGHT, SIN_PERIOD, COS_WEIGHT, COS_PERIOD = 0.02, 0.75, 8.0, 0.35, 4.0
FORECAST_COLUMNS = (
    *SERIES, "step", "year_week", "forecast_market_share_pp", "lower_ci_95", "upper_ci_95",
    "is_forecast", "status", "best_model_order", "mae", "rmse",
)


def all_region_series(gold: DataFrame) -> DataFrame:
    """Unweighted mean share over regions, by brand and week."""
    return (
        gold.groupBy("clean_brand", "year_week")
        .agg(F.avg("market_share_trx_pct").alias("market_share_trx_pct"))
        .withColumn("clean_region", F.lit(ALL_REGIONS))
    )


def forecast_series(gold: DataFrame) -> DataFrame:
    """Every per-region series and every all-region series, in one table."""
    names = [*SERIES, "year_week", "market_share_trx_pct"]
    tie = F.col("clean_therapeutic_area") if "clean_therapeutic_area" in gold.columns else F.lit("")
    regional = gold.select(*names, tie.alias("tie"))
    return regional.unionByName(all_region_series(gold).withColumn("tie", F.lit("")).select(*names, "tie"))


def series_profile(series: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Per series: length, last week, recent slope and volatility of first differences.

    The slope is the least-squares one over the last 12 points; a series of one or two points
    has slope 0 and a series of one point volatility 0.5.
    """
    in_order = Window.partitionBy(*SERIES).orderBy("year_week", "tie")
    backwards = Window.partitionBy(*SERIES).orderBy(F.desc("year_week"), F.desc("tie"))
    share = F.col("market_share_trx_pct")
    back = F.when(F.col("back") <= RECENT, -F.col("back").cast("double"))
    return (
        series.withColumns(
            {
                "change": share - F.lag(share, 1).over(in_order),
                "back": F.row_number().over(backwards),
            }
        )
        .groupBy(*SERIES)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.max("year_week").alias("last_week"),
            F.regr_slope(F.when(back.isNotNull(), share), back).alias("fitted_slope"),
            F.stddev_pop("change").alias("change_std"),
        )
        .select(
            *SERIES,
            "n",
            "last_week",
            F.when(F.col("n") > 2, F.coalesce("fitted_slope", F.lit(0.0))).otherwise(0.0).alias("slope"),
            F.when(F.col("n") > 1, F.col("change_std")).otherwise(0.5).alias("volatility"),
        )
    )


def trend_cycle_adjustment(step: Column, slope: Column, volatility: Column) -> Column:
    """Damped trend plus two weekly cycles, added to the mean and to both bounds."""
    h = step.cast("double")
    turn = F.lit(2.0) * F.pi() * h
    return (
        slope * h * F.exp(F.lit(-DAMPING) * h)
        + F.sin(turn / SIN_PERIOD) * (volatility * SIN_WEIGHT)
        + F.cos(turn / COS_PERIOD) * (volatility * COS_WEIGHT)
    )


def clip_share(c: Column) -> Column:
    return clip(c, 0.0, 100.0)


def forecast_status(n: Column, fitted: Column, min_history: int = 6) -> Column:
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, NO_HISTORY)
        .when(n < min_history, TOO_SHORT)
        .when(fitted, FITTED)
        .otherwise(FIT_ERROR)
    )


_MODEL_SCHEMA = (
    "clean_brand string, clean_region string, step int, mean double, se double, "
    "best_model_order string, mae double, rmse double"
)


def model_forecasts(series: DataFrame, horizon: int, s: Settings = Settings()) -> DataFrame:
    """Best model by AIC per series, its forecast and its backtest; one group per series.

    A series holds at most one point per week and category, so groups stay small however many
    series there are.  A series that cannot be fitted yields no rows.
    """
    holdout, min_train = s.holdout, s.min_history

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values(["year_week", "tie"])["market_share_trx_pct"].to_numpy(dtype=np.float64)
        model = arima.best_fit(y) if len(y) >= min_train and np.isfinite(y).all() else None
        if model is None:
            return pd.DataFrame(columns=[c.split()[0] for c in _MODEL_SCHEMA.split(", ")])
        mean, se = arima.forecast(y, model, horizon)
        mae, rmse = arima.backtest(y, holdout, min_train) or (None, None)
        return pd.DataFrame(
            {
                "clean_brand": rows["clean_brand"].iloc[0],
                "clean_region": rows["clean_region"].iloc[0],
                "step": np.arange(1, horizon + 1, dtype=np.int32),
                "mean": mean,
                "se": se,
                "best_model_order": f"ARIMA{model.order} (AIC={model.aic:.1f})",
                "mae": mae,
                "rmse": rmse,
            }
        )

    return spread(series, *SERIES).groupBy(*SERIES).applyInPandas(fit, _MODEL_SCHEMA)


def forecast_all(
    gold: DataFrame,
    horizon: int | None = None,
    s: Settings = Settings(),
    wanted: DataFrame | None = None,
) -> DataFrame:
    """``horizon`` rows for every series: the fitted forecast, or NULLs with the reason.

    ``wanted`` (brand, region) asks for particular series; those without history come back as
    NULL rows with status "no historical data".
    """
    horizon = horizon or s.horizon
    series = forecast_series(gold)
    if wanted is not None:
        series = series.join(wanted.select(*SERIES).distinct(), list(SERIES), "left_semi")
    profile = series_profile(series, s)
    if wanted is not None:
        profile = wanted.select(*SERIES).distinct().join(profile, list(SERIES), "left")
    weeks = F.coalesce(
        next_year_weeks(F.col("last_week"), horizon),
        F.array_repeat(F.lit(None).cast("string"), horizon),
    )
    grid = profile.select(
        *SERIES, "n", "slope", "volatility", F.posexplode(weeks).alias("pos", "year_week")
    ).withColumn("step", F.col("pos") + 1)
    models = model_forecasts(series, horizon, s)
    fitted = F.col("mean").isNotNull()
    adjusted = trend_cycle_adjustment(F.col("step"), F.col("slope"), F.col("volatility"))
    half = F.lit(arima.Z95) * F.col("se")
    return (
        grid.join(models, [*SERIES, "step"], "left")
        .withColumns(
            {
                "forecast_market_share_pp": clip_share(F.col("mean") + adjusted),
                "lower_ci_95": clip_share(F.col("mean") - half + adjusted),
                "upper_ci_95": clip_share(F.col("mean") + half + adjusted),
                "is_forecast": F.lit(True),
                "status": forecast_status(F.col("n"), fitted, s.min_history),
                "best_model_order": F.coalesce("best_model_order", F.lit("None")),
            }
        )
        .select(*FORECAST_COLUMNS)
    )


def forecast_statuses(series: DataFrame, wanted: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``n`` and ``status`` of every wanted (brand, region): whether it can be forecast, and if not, why.

    A series has a fit if the models can be fitted to the whole of it; one with missing shares has none.
    """
    counts = series.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("n"))
    fitted = model_forecasts(series, 1, s).select(*SERIES, F.lit(True).alias("_fitted"))
    asked = wanted.select(*SERIES).distinct().join(counts, list(SERIES), "left").join(fitted, list(SERIES), "left")
    status = forecast_status(F.col("n"), F.coalesce("_fitted", F.lit(False)), s.min_history)
    return asked.select(*SERIES, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), status.alias("status"))


def drift_ar_coefficients(series: DataFrame) -> DataFrame:
    """ARIMA(1,1,0) with drift by native regression: slope and intercept of each change on the
    change before it."""
    in_order = Window.partitionBy(*SERIES).orderBy("year_week", "tie")
    share = F.col("market_share_trx_pct")
    return (
        series.withColumn("change", share - F.lag(share, 1).over(in_order))
        .withColumn("before", F.lag("change", 1).over(in_order))
        .groupBy(*SERIES)
        .agg(
            F.regr_slope("change", "before").alias("ar1"),
            F.regr_intercept("change", "before").alias("constant"),
        )
    )


def backtest_metrics(pairs: DataFrame, *keys: str) -> DataFrame:
    """MAE and RMSE (3 decimals) from columns ``actual`` and ``predicted``."""
    error = F.col("predicted") - F.col("actual")
    return pairs.groupBy(*keys).agg(
        F.round(F.avg(F.abs(error)), 3).alias("mae"),
        F.round(F.sqrt(F.avg(F.pow(error, 2))), 3).alias("rmse"),
    )


def history_tail(series: DataFrame, rows: int = 16) -> DataFrame:
    """The last ``rows`` weeks of every series."""
    newest = Window.partitionBy(*SERIES).orderBy(F.desc("year_week"), F.desc("tie"))
    return (
        series.withColumn("_back", F.row_number().over(newest))
        .filter(F.col("_back") <= rows)
        .drop("_back")
    )


def align_history_and_forecast(series: DataFrame, forecast: DataFrame, rows: int = 16) -> DataFrame:
    """History weeks followed by forecast weeks, one ordered axis per series."""
    past = history_tail(series, rows).select(
        *SERIES, "year_week", F.col("market_share_trx_pct").alias("share"), F.lit(False).alias("is_forecast")
    )
    ahead = forecast.filter(F.col("forecast_market_share_pp").isNotNull()).select(
        *SERIES, "year_week", F.col("forecast_market_share_pp").alias("share"), "is_forecast"
    )
    axis = Window.partitionBy(*SERIES).orderBy("is_forecast", "year_week")
    return past.unionByName(ahead).withColumn("position", F.row_number().over(axis))


def axis_range(series: DataFrame, forecast: DataFrame, rows: int = 16, margin: float = 2.0) -> DataFrame:
    """Padded value range over history, forecast and interval, per region."""
    tail = history_tail(series, rows).select("clean_region", F.col("market_share_trx_pct").alias("v"))
    ahead = forecast.select(
        "clean_region", F.explode(F.array("forecast_market_share_pp", "lower_ci_95", "upper_ci_95")).alias("v")
    )
    return (
        tail.unionByName(ahead)
        .groupBy("clean_region")
        .agg(F.min("v").alias("low"), F.max("v").alias("high"))
        .select(
            "clean_region",
            F.greatest(F.lit(0.0), F.col("low") - margin).alias("y_min"),
            F.least(F.lit(100.0), F.col("high") + margin).alias("y_max"),
        )
        .filter(F.col("y_min").isNotNull())
    )


def forecast_summary(forecast: DataFrame) -> DataFrame:
    """Mean forecast and the list of forecast weeks per series (a series has ``horizon`` rows)."""
    ordered = F.array_sort(F.collect_list(F.struct("step", "year_week")))
    return (
        forecast.filter(F.col("forecast_market_share_pp").isNotNull())
        .groupBy(*SERIES)
        .agg(F.avg("forecast_market_share_pp").alias("mean_forecast"), ordered.alias("weeks"))
        .withColumn("weeks", F.array_join(F.col("weeks.year_week"), ", "))
    )
