"""Queries on forecasting."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sharetide.functions.dates import next_year_weeks, year_week
from sharetide.operators import forecast as fc
from sharetide.registry import query, sql
from sharetide.registry.market import gold
from sharetide.session import stage
from sharetide.sources import star_tables as st
from sharetide.streaming.feed_stream import week_totals

_SERIES = (
    "series AS (SELECT clean_brand, clean_region, year_week, market_share_trx_pct FROM shares UNION ALL "
    "SELECT clean_brand, 'All Regions', year_week, avg(market_share_trx_pct) FROM shares GROUP BY 1, 3)"
)
_ORDERED = "OVER (PARTITION BY clean_brand, clean_region ORDER BY year_week)"
_PROFILE = (
    "profile AS (SELECT clean_brand, clean_region, count(*) AS n, max(year_week) AS last_week, "
    "regr_slope(CASE WHEN back <= 12 THEN market_share_trx_pct END, CASE WHEN back <= 12 THEN -CAST(back AS DOUBLE) END) AS slope, "
    "stddev_pop(change) AS volatility FROM (SELECT *, market_share_trx_pct - lag(market_share_trx_pct) "
    f"{_ORDERED} AS change, row_number() OVER (PARTITION BY clean_brand, clean_region ORDER BY year_week DESC) AS back FROM series) "
    "GROUP BY ALL)"
)


def _over(select: str, profile: bool = False, extra: str = "") -> str:
    parts = [_SERIES] + ([_PROFILE] if profile else []) + ([extra] if extra else [])
    return sql.analytics(select, upto="shares", extra=", ".join(parts))


def series(spark, sf):
    return fc.forecast_series(gold(spark, sf))


def profile(spark, sf):
    return fc.series_profile(stage(series(spark, sf), "series"))


def forecasts(spark, sf, **kw):
    return fc.forecast_all(stage(gold(spark, sf), "gold"), **kw)


@query(
    "next_year_weeks",
    "WITH d AS (SELECT DISTINCT l_orderkey, l_shipdate, date_trunc('week', l_shipdate) AS monday FROM lineitem) "
    f"SELECT l_orderkey, {sql.label('l_shipdate', clamp=False)} AS label, "
    + ", ".join(f"{sql.label(f'(monday + INTERVAL {7 * k} DAY)', clamp=False)} AS week_{k}" for k in (1, 2, 3, 4))
    + " FROM d",
)
def _(spark, sf):
    label = year_week(F.col("l_shipdate").cast("date"), clamp53=False)
    lines = st.line_items(spark, sf).select("l_orderkey", "l_shipdate").distinct()
    ahead = lines.select("l_orderkey", label.alias("label")).withColumn("w", next_year_weeks(F.col("label"), 4))
    return ahead.select("l_orderkey", "label", *[F.get("w", F.lit(k - 1)).alias(f"week_{k}") for k in (1, 2, 3, 4)])


@query("series_select", _over("SELECT clean_brand, clean_region, year_week, round(market_share_trx_pct, 6) AS market_share_trx_pct FROM series"))
def _(spark, sf):
    return series(spark, sf).drop("tie")


@query(
    "all_region_series",
    _over("SELECT clean_brand, clean_region, year_week, round(market_share_trx_pct, 6) AS market_share_trx_pct FROM series WHERE clean_region = 'All Regions'"),
)
def _(spark, sf):
    return fc.all_region_series(gold(spark, sf))


@query(
    "history_tail",
    _over(
        "SELECT clean_brand, clean_region, year_week, round(market_share_trx_pct, 6) AS market_share_trx_pct FROM (SELECT *, "
        "row_number() OVER (PARTITION BY clean_brand, clean_region ORDER BY year_week DESC) AS back FROM series) WHERE back <= 16"
    ),
)
def _(spark, sf):
    return fc.history_tail(series(spark, sf)).drop("tie")


@query("recent_slope", _over("SELECT clean_brand, clean_region, round(slope, 6) + 0.0 AS slope FROM profile", True))
def _(spark, sf):
    return profile(spark, sf).select("clean_brand", "clean_region", "slope")


@query("shift_volatility", _over("SELECT clean_brand, clean_region, round(volatility, 6) AS volatility FROM profile", True))
def _(spark, sf):
    return profile(spark, sf).select("clean_brand", "clean_region", "volatility")


_STEPS = "profile, (SELECT unnest(generate_series(1, 8)) AS step)"
_ADJUST = (
    "slope * step * exp(-0.02 * step) + sin(2 * pi() * step / 8.0) * (volatility * 0.75) + cos(2 * pi() * step / 4.0) * (volatility * 0.35)"
)


def _stepped(spark, sf):
    steps = F.explode(F.sequence(F.lit(1), F.lit(8))).alias("step")
    return profile(spark, sf).select("*", steps)


@query(
    "trend_cycle_adjust",
    _over(f"SELECT clean_brand, clean_region, CAST(step AS BIGINT) AS step, round({_ADJUST}, 6) + 0.0 AS adjustment FROM {_STEPS}", True),
)
def _(spark, sf):
    adjustment = fc.trend_cycle_adjustment(F.col("step"), F.col("slope"), F.col("volatility"))
    return _stepped(spark, sf).select("clean_brand", "clean_region", "step", adjustment.alias("adjustment"))


@query(
    "clip_forecast",
    _over(
        f"SELECT clean_brand, clean_region, CAST(step AS BIGINT) AS step, round(greatest(least(12 * ({_ADJUST}), 100.0), 0.0), 6) + 0.0 AS clipped FROM {_STEPS}",
        True,
    ),
)
def _(spark, sf):
    adjustment = fc.trend_cycle_adjustment(F.col("step"), F.col("slope"), F.col("volatility"))
    return _stepped(spark, sf).select(
        "clean_brand", "clean_region", "step", fc.clip_share(F.lit(12) * adjustment).alias("clipped")
    )


# The weekly shares; the few weeks of the events; and large returns against sales, which some weeks do not have.
_ASKED = (
    "observed AS (SELECT clean_brand, clean_region, market_share_trx_pct AS v FROM series UNION ALL "
    "SELECT event_type, 'R' || CAST(user_id % 5 AS VARCHAR), 1.0 FROM events GROUP BY event_type, user_id % 5, date_trunc('week', ts) UNION ALL "
    "SELECT 'RETURNS', clean_region, sum(clean_trx) FILTER (l_returnflag = 'R' AND clean_trx = 50) / sum(clean_trx) FILTER (l_returnflag = 'N') FROM facts GROUP BY clean_region, year_week), "
    "counts AS (SELECT clean_brand, clean_region, count(*) AS n, count(v) AS good FROM observed GROUP BY ALL), "
    f"asked AS (SELECT clean_brand, clean_region FROM counts UNION SELECT p_brand, r_name FROM {sql.STAR})"
)


@query(
    "forecast_status",
    _over(
        "SELECT clean_brand, clean_region, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'Forecast unavailable — no historical data for selected brand/region.' "
        "WHEN n < 6 THEN 'Forecast unavailable — insufficient historical data.' WHEN good < n THEN 'Forecast unavailable — statistical fit error.' "
        "ELSE 'ARIMA_MODEL_FIT' END AS status FROM asked LEFT JOIN counts USING (clean_brand, clean_region)",
        extra=_ASKED,
    ),
)
def _(spark, sf):
    """Whole series of three kinds, and brands that have none, so that all four statuses occur."""
    share, names = F.col("market_share_trx_pct"), ["clean_brand", "clean_region", "year_week", "market_share_trx_pct"]
    weekly = series(spark, sf)
    events = week_totals(st.event_facts(st.table(spark, sf, "events")))
    total = F.sum("brand_trx").over(Window.partitionBy("week_start", "clean_region"))
    short = events.withColumn("market_share_trx_pct", F.col("brand_trx") / total * 100.0).withColumn("year_week", year_week(F.col("week_start").cast("date")))
    facts = st.facts(spark, sf)
    trx, back = F.col("clean_trx"), F.col("l_returnflag")
    returned, sold = F.sum(F.when((back == "R") & (trx == 50), trx)), F.sum(F.when(back == "N", trx))
    returns = facts.groupBy("clean_region", "year_week").agg((returned / sold).alias("market_share_trx_pct")).withColumn("clean_brand", F.lit("RETURNS"))
    every = weekly.unionByName(short.select(*names).unionByName(returns.select(*names)).withColumn("tie", F.lit("")))
    every = stage(every.withColumn("market_share_trx_pct", share.cast("double")), "observed")
    asked = every.select("clean_brand", "clean_region").unionByName(st.facts(spark, sf, brand="p_brand").select("clean_brand", "clean_region"))
    return fc.forecast_statuses(every, asked)


@query(
    "arima_drift_ar",
    _over(
        "SELECT clean_brand, clean_region, round(regr_slope(change, before), 6) + 0.0 AS ar1, round(regr_intercept(change, before), 6) + 0.0 AS constant "
        f"FROM (SELECT *, lag(change) {_ORDERED} AS before FROM (SELECT *, market_share_trx_pct - lag(market_share_trx_pct) {_ORDERED} AS change FROM series)) GROUP BY ALL"
    ),
)
def _(spark, sf):
    return fc.drift_ar_coefficients(series(spark, sf))


@query(
    "backtest_metrics",
    _over(
        "SELECT clean_brand, clean_region, round(avg(abs(predicted - actual)), 3) AS mae, round(sqrt(avg(pow(predicted - actual, 2))), 3) AS rmse "
        f"FROM (SELECT *, market_share_trx_pct AS actual, lag(market_share_trx_pct, 4) {_ORDERED} AS predicted FROM series) "
        "WHERE predicted IS NOT NULL GROUP BY ALL"
    ),
)
def _(spark, sf):
    in_order = Window.partitionBy("clean_brand", "clean_region").orderBy("year_week")
    share = F.col("market_share_trx_pct")
    pairs = series(spark, sf).select(
        "clean_brand", "clean_region", share.alias("actual"), F.lag(share, 4).over(in_order).alias("predicted")
    )
    return fc.backtest_metrics(pairs.filter(F.col("predicted").isNotNull()), "clean_brand", "clean_region")


@query("arima_select")
def _(spark, sf):
    return fc.model_forecasts(series(spark, sf), 4)


@query("forecast_all")
def _(spark, sf):
    return forecasts(spark, sf)


@query("forecast_interval")
def _(spark, sf):
    wide = forecasts(spark, sf, horizon=26)
    return wide.select("clean_brand", "clean_region", "step", "lower_ci_95", "forecast_market_share_pp", "upper_ci_95")


@query("align_hist_forecast")
def _(spark, sf):
    rows = stage(gold(spark, sf), "gold")
    return fc.align_history_and_forecast(fc.forecast_series(rows), fc.forecast_all(rows, 8))


@query("axis_range")
def _(spark, sf):
    rows = stage(gold(spark, sf), "gold")
    return fc.axis_range(fc.forecast_series(rows), stage(fc.forecast_all(rows, 8), "forecast"))


@query("forecast_avg_summary")
def _(spark, sf):
    return fc.forecast_summary(forecasts(spark, sf))
