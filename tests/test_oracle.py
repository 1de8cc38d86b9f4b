"""Registered queries with SQL, against DuckDB on the smallest tables.

Queries whose columns a larger query also returns, and the slow weekly writers (test_storage.py
has their rules), run only with ``ALL_QUERIES=1``; ``python tests/oracle.py`` runs every query.
"""

import os

import pytest

import __spark_entry__ as entry
from oracle import compare, connect
from paths import SF_SMALL
from sharetide import registry

NAMES = set(registry.QUERIES)  # the training-text queries have tests of their own
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in NAMES}
ON_REQUEST = set(
    """
    brand_totals segment_totals share_join_totals wow_shift rolling_mean_std rolling_median rolling_mad
    dynamic_envelope robust_z detect_ma_deviation detect_robust_z detect_erosion detect_envelope_breach
    combined_anomaly alert_prev_share active_alerts all_region_series clip_forecast recent_slope
    shift_volatility clean_string normalise_region normalise_labels parse_number disambiguate_date
    quality_flags week_mismatch dedupe_first audit_counts dq_summary share_trend except_selected
    export_csv read_stored_tables replace_week stream_gold stream_alerts
    arima_select forecast_interval forecast_avg_summary alert_brief
    """.split()
)
CHOSEN = NAMES if os.environ.get("ALL_QUERIES") else NAMES - ON_REQUEST


@pytest.fixture(scope="module")
def con():
    return connect(SF_SMALL)


@pytest.mark.parametrize("name", sorted(CHOSEN & set(ORACLES)))
def test_query_matches_sql(spark, con, name):
    mine = entry.queries()[name](spark, SF_SMALL).toPandas()
    problem = compare(mine, con.execute(ORACLES[name]).fetchdf())
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(CHOSEN - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    assert not entry.queries()[name](spark, SF_SMALL).isEmpty()


def test_every_oracle_has_a_query_and_entry_runs(spark):
    assert set(ORACLES) <= set(entry.queries())
    assert ON_REQUEST <= set(entry.queries())
    assert entry.entry(spark).count() > 0
