"""Forecast rules, the small model helper, and week arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharetide.functions.dates import monday_of, next_year_weeks
from sharetide.operators import arima
from sharetide.operators import forecast as fc


def gold(spark, values, brand="A", region="TN"):
    rows = [(f"{2025 + i // 52}-W{i % 52 + 1:02d}", region, "C", brand, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(
        rows, "year_week string, clean_region string, clean_therapeutic_area string, clean_brand string, market_share_trx_pct double"
    )


@pytest.mark.parametrize(
    "label, expected",
    [
        ("2025-W51", ["2025-W52", "2026-W01", "2026-W02"]),
        ("2020-W52", ["2020-W53", "2021-W01", "2021-W02"]),
        ("2021-W53", [None] * 3),
        ("2025-W60", [None] * 3),
        ("2025", [None] * 3),
        (None, [None] * 3),
    ],
)
def test_next_weeks(spark, label, expected):
    row = spark.range(1).select(next_year_weeks(F.lit(label).cast("string"), 3).alias("w")).first()
    assert row.w == expected


def test_monday(spark):
    row = spark.range(1).select(monday_of(F.lit("2026-W01")).cast("string").alias("d")).first()
    assert row.d == "2025-12-29"


def test_linear_series_is_forecast_with_its_trend(spark):
    out = fc.forecast_all(gold(spark, [20 + 0.5 * i for i in range(14)])).filter("clean_region = 'TN'").orderBy("step").collect()
    assert len(out) == 4 and [r.year_week for r in out] == [f"2025-W{i}" for i in range(15, 19)]
    assert all(r.status == fc.FITTED and r.best_model_order.startswith("ARIMA(") for r in out)
    assert out[0].mae == pytest.approx(0.0, abs=1e-3) and out[0].lower_ci_95 <= out[0].forecast_market_share_pp <= out[0].upper_ci_95
    step = 1
    adjust = 0.5 * step * np.exp(-0.02 * step)
    assert out[0].forecast_market_share_pp == pytest.approx(27.0 + adjust, abs=1e-3)


@pytest.mark.parametrize("n, status", [(1, fc.TOO_SHORT), (5, fc.TOO_SHORT), (6, fc.FITTED), (9, fc.FITTED)])
def test_history_length_decides_the_status(spark, n, status):
    rng = np.random.default_rng(n)
    out = fc.forecast_all(gold(spark, 30 + rng.normal(0, 1, n))).filter("clean_region = 'TN'").collect()
    assert len(out) == 4 and {r.status for r in out} == {status}
    assert all((r.forecast_market_share_pp is None) == (status != fc.FITTED) for r in out)
    assert all(r.year_week is not None for r in out) and all(r.mae is None for r in out)


def test_unknown_series_comes_back_empty(spark):
    wanted = spark.createDataFrame([("Nobody", "TN"), ("A", "TN")], "clean_brand string, clean_region string")
    out = fc.forecast_all(gold(spark, range(20, 34)), wanted=wanted)
    assert out.count() == 8
    missing = out.filter("clean_brand = 'Nobody'").collect()
    assert all(r.status == fc.NO_HISTORY and r.year_week is None and r.best_model_order == "None" for r in missing)


def test_constant_series_does_not_fail(spark):
    out = fc.forecast_all(gold(spark, [25.0] * 20)).filter("clean_region = 'TN'").collect()
    assert all(r.forecast_market_share_pp == pytest.approx(25.0, abs=1e-3) for r in out)


def test_bounds_stay_within_0_and_100(spark):
    rng = np.random.default_rng(2)
    out = fc.forecast_all(gold(spark, np.clip(rng.normal(98, 6, 40), 0, 100)), horizon=26).collect()
    assert all(0 <= r.lower_ci_95 <= r.upper_ci_95 <= 100 for r in out)


def simulate(rng, n, phi, drift):
    z = np.zeros(n)
    for t in range(1, n):
        z[t] = drift * (1 - phi) + phi * z[t - 1] + rng.normal()
    return np.cumsum(z)


def test_ar_model_equals_native_regression(spark):
    y = simulate(np.random.default_rng(5), 120, 0.6, 0.3)
    fit = arima.fit_one(np.diff(y), 1, 0, True)
    # The helper leaves out the first two differences, so the native regression must as well.
    row = fc.drift_ar_coefficients(fc.forecast_series(gold(spark, y[1:])).filter("clean_region = 'TN'")).first()
    assert fit.ar[0] == pytest.approx(row.ar1, abs=1e-9) and fit.constant == pytest.approx(row.constant, abs=1e-9)
    assert abs(fit.ar[0] - 0.6) < 0.2


def test_moving_average_weight_is_recovered():
    rng = np.random.default_rng(8)
    e = rng.normal(size=2001)
    fit = arima.fit_one(e[1:] + 0.5 * e[:-1], 1, 1, False)
    assert abs(fit.ma + fit.ar[0] - 0.5) < 0.12


def test_interval_coverage():
    rng, inside, total = np.random.default_rng(11), 0, 0
    for _ in range(120):
        y = simulate(rng, 104, 0.5, 0.1)
        fit = arima.best_fit(y[:100])
        mean, se = arima.forecast(y[:100], fit, 4)
        inside += int(np.sum(np.abs(y[100:] - mean) <= arima.Z95 * se))
        total += 4
    assert 0.88 <= inside / total <= 0.99


def test_history_tail_alignment_and_axis(spark):
    g = gold(spark, [20 + (i % 3) for i in range(30)])
    series, ahead = fc.forecast_series(g), fc.forecast_all(g, 8)
    axis = fc.align_history_and_forecast(series, ahead).filter("clean_region = 'TN'").orderBy("position").collect()
    assert len(axis) == 24 and [r.year_week for r in axis] == [f"2025-W{i}" for i in range(15, 39)]
    assert [r.is_forecast for r in axis] == [False] * 16 + [True] * 8
    box = fc.axis_range(series, ahead).filter("clean_region = 'TN'").first()
    assert 0 <= box.y_min < 20 and 22 < box.y_max <= 100
    assert fc.axis_range(series.limit(0), ahead.limit(0)).isEmpty()
    assert fc.forecast_summary(ahead).filter("clean_region = 'TN'").first().weeks.startswith("2025-W31, 2025-W32")
