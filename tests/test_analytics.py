"""Shares, shifts, detectors, alerts, forest and report rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paths import SF_SMALL
from sharetide.config import Settings
from sharetide.operators import alerts, detectors, forest, quantile, rollups, share, shift
from sharetide.plans.weekly import gold_from_clean
from sharetide.schemas import SERIES_KEYS
from sharetide.session import stage
from sharetide.sources import star_tables as st

FACT = (
    "year_week string, clean_region string, clean_therapeutic_area string, clean_product string, "
    "clean_brand string, clean_trx double, clean_nrx double, clean_units double"
)


def facts(spark, *rows):
    """rows: (week, brand, trx[, category])."""
    full = [(w, "TN", (rest[0] if rest else "C"), "P", b, t, t / 5, t * 2) for w, b, t, *rest in rows]
    return spark.createDataFrame(full, FACT)


def series(spark, shifts, brand="A"):
    """Shift rows of one series with the given shifts."""
    rows = [
        (f"2025-W{i:02d}", "TN", "C", brand, 100.0, 10.0, None if x is None else float(x), None if x is None else x * 100.0, 1.0)
        for i, x in enumerate(shifts, 1)
    ]
    return spark.createDataFrame(
        rows,
        "year_week string, clean_region string, clean_therapeutic_area string, clean_brand string, clean_trx double, "
        "market_share_trx_pct double, share_shift_pp double, share_shift_bps double, momentum_ratio double",
    )


def test_competitive_set_is_its_own_denominator(spark):
    df = facts(spark, ("2025-W01", "A", 500.0), ("2025-W01", "B", 500.0), ("2025-W01", "C", 1000.0))
    got = share.market_share(df, ["A", "B"]).collect()
    assert [r.market_share_trx_pct for r in got] == [50.0, 50.0]
    assert share.market_share(df, []).count() == 3


def test_zero_and_missing_totals(spark):
    df = facts(spark, ("2025-W01", "A", 0.0), ("2025-W02", "A", -5.0), ("2025-W03", "A", float("nan")))
    for r in share.market_share(df).collect():
        assert r.market_share_trx_pct == 0.0 and r.momentum_ratio == 1.0 and r.brand_trx is not None


def test_brand_in_two_categories(spark):
    df = facts(spark, ("2025-W01", "A", 10.0, "X"), ("2025-W01", "A", 30.0, "Y"), ("2025-W01", "B", 60.0, "X"))
    fan = share.market_share(df)
    assert fan.count() == 3
    check = share.share_sum_check(fan).first()
    assert check.market_share_trx_pct == 140.0 and not check.is_valid_100_pct
    first = share.market_share(df, s=Settings(on_multi="first"))
    assert {(r.clean_brand, r.clean_therapeutic_area, r.market_share_trx_pct) for r in first.collect()} == {("A", "X", 40.0), ("B", "X", 60.0)}


def test_staged_and_lazy_shares_agree_and_sum_to_100(spark):
    df = st.facts(spark, SF_SMALL)
    a, b = share.market_share(df), share.market_share(df, staged=False)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    assert share.share_sum_check(a).filter("NOT is_valid_100_pct").isEmpty()


def test_first_week_has_no_shift_and_gaps_are_not_filled(spark):
    df = facts(spark, ("2025-W01", "A", 1.0), ("2025-W01", "B", 3.0), ("2025-W05", "A", 2.0), ("2025-W05", "B", 2.0))
    rows = {(r.clean_brand, r.year_week): r for r in shift.share_shifts(share.market_share(df)).collect()}
    assert rows["A", "2025-W01"].share_shift_pp is None and rows["A", "2025-W01"].share_shift_bps is None
    assert rows["A", "2025-W05"].share_shift_pp == 25.0 and rows["A", "2025-W05"].share_shift_bps == 2500.0


def test_baseline_needs_two_and_skips_the_current_week(spark):
    got = detectors.rules_only(series(spark, [None, 2.0, 2.0, 11.0, -1.0])).orderBy("year_week").collect()
    assert [r[detectors.MEAN] for r in got] == [None, None, None, 2.0, 5.0]
    assert got[3].statistical_z_score == 10.0 and got[3].t1_moving_average_anomaly and got[3].t4_dynamic_threshold_anomaly
    assert got[3].dynamic_upper_threshold == pytest.approx(2.6)
    assert got[4][detectors.MEDIAN] == 2.0 and got[4][detectors.MAD] == 0.0
    assert got[4][detectors.STD] == pytest.approx(np.std([2, 2, 11], ddof=1))
    changed = detectors.rules_only(series(spark, [None, 2.0, 2.0, 99.0, -1.0])).orderBy("year_week").collect()
    assert changed[3].dynamic_upper_threshold == got[3].dynamic_upper_threshold


@pytest.mark.parametrize("lookback", [2, 3, 5])
def test_baseline_matches_pandas(spark, lookback):
    rng = np.random.default_rng(1)
    xs = [None, *rng.normal(0, 2, 30).round(3).tolist()]
    pdf = detectors.rules_only(series(spark, xs), Settings(lookback=lookback)).toPandas().sort_values("year_week")
    prev = pdf["share_shift_pp"].shift(1).rolling(lookback, min_periods=2)
    np.testing.assert_allclose(pdf[detectors.MEAN].astype(float), prev.mean(), atol=1e-9)
    np.testing.assert_allclose(pdf[detectors.STD].astype(float), prev.std(), atol=1e-9)
    np.testing.assert_allclose(pdf[detectors.MEDIAN].astype(float), prev.median(), atol=1e-9)
    mad = prev.apply(lambda a: np.nanmedian(np.abs(a - np.nanmedian(a))), raw=True)
    np.testing.assert_allclose(pdf[detectors.MAD].astype(float), mad, atol=1e-9)


def test_erosion_alerts_at_any_size(spark):
    gold = detectors.gold(series(spark, [None, -0.1, -0.1, -0.1, 0.1]))
    rows = alerts.classify(gold).orderBy("year_week").collect()
    assert [r.alert_category for r in rows] == ["NORMAL", "NORMAL", alerts.DECLINE, "NORMAL"]
    assert rows[2].triggered_techniques == "3-Wk Erosion" and rows[0].executive_brief == ""
    assert rows[2].executive_brief == (
        "Regional Share Decline for A in TN (Shift: -0.10 pp / -10 bps). Current Share: 10.00%."
    )
    assert rows[2].alert_type == rows[2].severity_level == alerts.DECLINE
    assert alerts.active(alerts.classify(gold)).count() == 1


def test_growth_alert(spark):
    row = (
        series(spark, [3.5])
        .withColumns({c: F.lit(c != "t3_erosion_anomaly") for c, _ in detectors.TECHNIQUES})
        .withColumns({"dynamic_upper_threshold": F.lit(15.0), "dynamic_lower_threshold": F.lit(5.0)})
        .withColumns({"statistical_z_score": F.lit(4.2), "isolation_forest_score": F.lit(-0.15), "triggered_techniques": F.lit("x")})
    )
    everything, active = alerts.generate_alerts(row)
    assert active.count() == 1 and active.first().alert_category == alerts.GROWTH
    assert active.first().previous_share_pp == 6.5


def forest_rows(spark, n=19):
    rows = [(f"w{i:05d}", "TN", "C", "A", 100.0 + i % 7, 10.0 + i % 3, 0.1 * (i % 5), 1.0) for i in range(n - 1)]
    rows.append(("w99999", "TN", "C", "A", 5000.0, 70.0, 60.0, 1.0))
    names = "year_week string, clean_region string, clean_therapeutic_area string, clean_brand string, clean_trx double, market_share_trx_pct double, share_shift_pp double, momentum_ratio double"
    return spark.createDataFrame(rows, names)


@pytest.mark.parametrize("n", [1, 2, 19, 400])
def test_forest_finds_the_outlier(spark, n):
    got = forest.isolation_forest(forest_rows(spark, n)).orderBy("isolation_forest_score").collect()
    assert len(got) == n
    if n > 2:
        assert got[0].year_week == "w99999" and got[0].isolation_forest_label == -1 and got[0].isolation_forest_anomaly
        flagged = sum(r.isolation_forest_anomaly for r in got)
        assert flagged == max(1, round(0.04 * n)) or flagged <= int(0.04 * n) + 1


def test_forest_does_not_depend_on_partitioning(spark):
    rows = forest_rows(spark, 300)
    key = ["year_week", "isolation_forest_score"]
    a = forest.isolation_forest(rows.repartition(1)).select(*key)
    b = forest.isolation_forest(rows.repartition(5, "clean_trx")).select(*key)
    assert a.exceptAll(b).isEmpty()


def test_forest_on_constant_rows_flags_nothing(spark):
    rows = forest_rows(spark, 50).withColumns({c: F.lit(1.0) for c in forest.FEATURES})
    assert forest.isolation_forest(rows).filter("isolation_forest_anomaly").isEmpty()


@pytest.mark.parametrize("p", [0.0, 0.04, 0.5, 1.0])
def test_exact_quantile(spark, p):
    df = stage(spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(5003)).cast("double").alias("v")), "q")
    values = df.toPandas()["v"].to_numpy()
    assert quantile.exact_quantile(df, "v", p) == pytest.approx(np.quantile(values, p), abs=1e-6)


def test_full_gold_is_invariant_to_repartitioning(spark):
    df = st.facts(spark, SF_SMALL)
    a, b = gold_from_clean(df), gold_from_clean(df.repartition(13))
    assert a.exceptAll(b).isEmpty()
    assert a.filter(F.col("prev_market_share_pp").isNull()).count() == a.select(*SERIES_KEYS).distinct().count()


def test_trailing_weeks_when_the_week_is_absent_or_early(spark):
    gold = gold_from_clean(facts(spark, *[(f"2025-W{i:02d}", b, 1.0 + i) for i in range(1, 41) for b in "AB"]))
    gold = stage(gold, "gold")

    def weeks(week):
        rows = rollups.trailing_weeks(gold, week, ["A"]).select("year_week").distinct().orderBy("year_week").collect()
        return [r.year_week for r in rows]

    assert weeks("2025-W30") == [f"2025-W{i:02d}" for i in range(19, 31)]
    assert weeks("2025-W01") == ["2025-W01"]
    assert weeks("2025-W99") == [f"2025-W{i:02d}" for i in range(15, 41)]


def test_slice_switches_off_on_all(spark):
    gold = gold_from_clean(facts(spark, ("2025-W01", "A", 1.0), ("2025-W01", "B", 1.0)))
    assert rollups.slice_gold(gold, "All Regions", "All Therapeutic Areas").count() == 2
    assert rollups.slice_gold(gold, brand="A").count() == 1


def test_gaps_are_filled_by_week_and_baselines_reach_over_weeks(spark):
    weeks = {"A": ["2015-W51", "2015-W52", "2016-W01", "2016-W04", "2016-W05"], "B": ["2016-W02"]}
    rows = [(w, "TN", "C", b, 10.0 + i, 1.0) for b, ws in weeks.items() for i, w in enumerate(ws)]
    schema = "year_week string, clean_region string, clean_therapeutic_area string, clean_brand string, market_share_trx_pct double, other double"
    shares = spark.createDataFrame([*rows, ("bad", "TN", "C", "Z", 1.0, 1.0)], schema)
    filled = shift.fill_gaps(shares)
    assert sorted((r.clean_brand, r.year_week) for r in filled.where("is_gap").collect()) == [("A", "2016-W02"), ("A", "2016-W03")]
    assert filled.where("NOT is_gap").count() == 7 and filled.columns == [*shares.columns, "is_gap"]
    found = {r.year_week: r.share_shift_pp for r in shift.share_shifts(filled).where("clean_brand = 'A' AND NOT is_gap").collect()}
    assert found == {"2015-W51": None, "2015-W52": 1.0, "2016-W01": 1.0, "2016-W04": None, "2016-W05": 1.0}
    mean = {r.year_week: r.prev_3wk_rolling_mean_pp for r in detectors.trailing_baseline(shift.share_shifts(filled)).where("clean_brand = 'A'").collect()}
    assert mean["2016-W03"] == 1.0 and mean["2016-W05"] is None
    assert shift.fill_gaps(shares.where("false")).count() == 0
