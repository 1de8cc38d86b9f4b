"""Queries on shares, shifts, detectors and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.operators import alerts, detectors, share, shift
from sharetide.operators.forest import fit_and_score, isolation_forest
from sharetide.plans.weekly import gold_from_clean
from sharetide.registry import query, sql
from sharetide.session import stage
from sharetide.sources import star_tables as st


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return gold_from_clean(st.facts(spark, sf))


def shifts(spark: SparkSession, sf: str) -> DataFrame:
    return shift.share_shifts(share.market_share(st.facts(spark, sf)))


def _chain(text, numbers, source: str, upto: str, **kw) -> str:
    return sql.analytics(f"SELECT {sql.pick(text, numbers)} FROM {source}", upto=upto, **kw)


_SEGMENT_TEXT = ("year_week", "clean_region")
_BRAND_TEXT = (*_SEGMENT_TEXT, "clean_brand")
_BRAND_NUMBERS = ("brand_trx", "clean_nrx", "clean_units")
_SEGMENT_NUMBERS = ("total_segment_trx", "total_segment_nrx", "total_segment_units")


@query("brand_totals", _chain(_BRAND_TEXT, _BRAND_NUMBERS, "brands", "brands"))
def _(spark, sf):
    return share.brand_totals(share.category_totals(st.facts(spark, sf)))


@query("segment_totals", _chain(_SEGMENT_TEXT, _SEGMENT_NUMBERS, "segments", "segments"))
def _(spark, sf):
    return share.segment_totals(share.category_totals(st.facts(spark, sf)))


@query(
    "share_join_totals",
    _chain(_BRAND_TEXT, (*_BRAND_NUMBERS, *_SEGMENT_NUMBERS), "brands LEFT JOIN segments USING (year_week, clean_region)", "segments"),
)
def _(spark, sf):
    totals = share.category_totals(st.facts(spark, sf))
    return share.join_segment_totals(share.brand_totals(totals), share.segment_totals(totals))


@query("market_share_report", _chain(sql.SHARE_TEXT, sql.SHARE_NUMBERS, "shares", "shares"))
def _(spark, sf):
    return share.market_share(st.facts(spark, sf))


_CHARGEBACK = sql.facts(quantity="CASE WHEN l_orderkey % 61 = 0 THEN -l_quantity ELSE l_quantity END")


@query(
    "market_share_chargebacks",
    _chain(sql.SHARE_TEXT, sql.SHARE_NUMBERS, "shares", "shares", facts_sql=_CHARGEBACK),
)
def _(spark, sf):
    return share.market_share(st.facts(spark, sf, chargebacks=True))


_SET = sql.facts(where="p_type IN ('ECONOMY', 'SMALL', 'PROMO')")


@query("competitive_set", _chain(sql.SHARE_TEXT, sql.SHARE_NUMBERS, "shares", "shares", facts_sql=_SET))
def _(spark, sf):
    return share.market_share(st.facts(spark, sf), list(st.COMPETITIVE_SET))


@query(
    "semi_brand_set",
    sql.analytics(
        "SELECT year_week, clean_region, clean_brand, count(*) AS rows FROM facts "
        "WHERE clean_brand IN (SELECT p_brand FROM part WHERE p_size >= 48) GROUP BY ALL",
        sql.facts(brand="p_brand"),
        "brands",
    ),
)
def _(spark, sf):
    chosen = st.table(spark, sf, "part").filter(F.col("p_size") >= 48).select(F.col("p_brand").alias("clean_brand"))
    kept = share.competitive_set(st.facts(spark, sf, brand="p_brand"), chosen)
    return kept.groupBy("year_week", "clean_region", "clean_brand").agg(F.count(F.lit(1)).alias("rows"))


_FAN = sql.facts(brand="p_brand", category="p_type")


@query("brand_category_fan_out", _chain(sql.SHARE_TEXT, sql.SHARE_NUMBERS, "shares", "shares", facts_sql=_FAN))
def _(spark, sf):
    return share.market_share(st.facts(spark, sf, brand="p_brand", category="p_type"))


@query(
    "brand_category_first",
    _chain(sql.SHARE_TEXT, sql.SHARE_NUMBERS, "shares", "shares", facts_sql=_FAN, brand_map=sql.MAP_FIRST),
)
def _(spark, sf):
    facts = st.facts(spark, sf, brand="p_brand", category="p_type")
    return share.market_share(facts, s=Settings(on_multi="first"))


@query(
    "distinct_pairs",
    sql.analytics("SELECT clean_brand, clean_therapeutic_area FROM brand_map", _FAN, "brand_map"),
)
def _(spark, sf):
    facts = st.facts(spark, sf, brand="p_brand", category="p_type")
    return share.brand_categories(share.category_totals(facts))


_SUM_CHECK = (
    "SELECT year_week, clean_region, round(total, 6) + 0.0 AS market_share_trx_pct, "
    "abs(total - 100.0) <= 0.5 + 1e-5 * 100.0 AS is_valid_100_pct FROM "
    "(SELECT year_week, clean_region, sum(market_share_trx_pct) AS total FROM shares GROUP BY ALL)"
)


@query("share_sum_check", sql.analytics(_SUM_CHECK, upto="shares"))
def _(spark, sf):
    return share.share_sum_check(share.market_share(st.facts(spark, sf)))


@query("share_sum_check_fan_out", sql.analytics(_SUM_CHECK, _FAN, "shares"))
def _(spark, sf):
    facts = st.facts(spark, sf, brand="p_brand", category="p_type")
    return share.share_sum_check(share.market_share(facts))


@query("wow_shift", _chain(sql.SHARE_TEXT, sql.SHIFT_NUMBERS, "shifts", "shifts"))
def _(spark, sf):
    return shifts(spark, sf)


@query("wow_shift_sparse", _chain(sql.SHARE_TEXT, sql.SHIFT_NUMBERS, "shifts", "shifts", facts_sql=sql.facts(brand="p_brand", category="'A'")))
def _(spark, sf):
    facts = st.facts(spark, sf, brand="p_brand").withColumn("clean_therapeutic_area", F.lit("A"))
    return shift.share_shifts(share.market_share(facts))


_MONDAY = "CAST(date_trunc('week', make_date(CAST(left(year_week, 4) AS INT), 1, 4)) AS DATE) + (CAST(right(year_week, 2) AS INT) - 1) * 7"
_OVER_WEEKS = (
    f"spine AS (SELECT DISTINCT {sql.SERIES}, {sql.label('day')} AS year_week FROM (SELECT {sql.SERIES}, "
    f"unnest(generate_series(CAST(min({_MONDAY}) AS TIMESTAMP), CAST(max({_MONDAY}) AS TIMESTAMP), INTERVAL 7 DAY)) AS day FROM known GROUP BY {sql.SERIES})), "
    f"shares AS (SELECT *, known.market_share_trx_pct IS NULL AS is_gap FROM spine LEFT JOIN known USING ({sql.SERIES}, year_week)), "
    f"shifts AS ({sql.SHIFTS}), base AS ({sql.baseline()}), bounds AS ({sql.BOUNDS}), detected AS ({sql.DETECTORS})"
)
_WEEK_NUMBERS = ("market_share_trx_pct", "share_shift_pp", *sql.BASE_NUMBERS, "statistical_z_score")


@query(
    "baseline_over_weeks",
    sql.analytics(
        f"SELECT {sql.pick((*sql.SHARE_TEXT, *sql.FLAGS), _WEEK_NUMBERS)} FROM detected WHERE NOT is_gap",
        sql.facts(brand="p_brand", category="'A'"), upto="shares", extra=f"known AS (SELECT * FROM shares), {_OVER_WEEKS.replace('shares AS (', 'filled AS (', 1).replace('FROM shares)', 'FROM filled)')}",
    ),
)
def _(spark, sf):
    """Series with missing weeks: shifts and baselines over weeks of the calendar."""
    facts = st.facts(spark, sf, brand="p_brand").withColumn("clean_therapeutic_area", F.lit("A"))
    filled = shift.fill_gaps(stage(share.market_share(facts), "shares"))
    found = detectors.rules_only(shift.share_shifts(filled)).filter("NOT is_gap")
    return found.select(*sql.SHARE_TEXT, *sql.FLAGS, *_WEEK_NUMBERS)


@query("rolling_mean_std", _chain(sql.SHARE_TEXT, sql.BASE_NUMBERS[:2], "base", "base"))
def _(spark, sf):
    return detectors.trailing_baseline(shifts(spark, sf)).select(*sql.SHARE_TEXT, *sql.BASE_NUMBERS[:2])


@query("rolling_median", _chain(sql.SHARE_TEXT, sql.BASE_NUMBERS[2:3], "base", "base"))
def _(spark, sf):
    return detectors.trailing_baseline(shifts(spark, sf)).select(*sql.SHARE_TEXT, sql.BASE_NUMBERS[2])


@query("rolling_mad", _chain(sql.SHARE_TEXT, sql.BASE_NUMBERS[3:], "base", "base"))
def _(spark, sf):
    return detectors.trailing_baseline(shifts(spark, sf)).select(*sql.SHARE_TEXT, sql.BASE_NUMBERS[3])


_BOUNDS = ("dynamic_upper_threshold", "dynamic_lower_threshold")


@query("dynamic_envelope", _chain(sql.SHARE_TEXT, _BOUNDS, "bounds", "bounds"))
def _(spark, sf):
    base = detectors.trailing_baseline(shifts(spark, sf))
    return detectors.dynamic_envelope(base).select(*sql.SHARE_TEXT, *_BOUNDS)


@query("robust_z", _chain(sql.SHARE_TEXT, ("statistical_z_score",), "bounds", "bounds"))
def _(spark, sf):
    base = detectors.trailing_baseline(shifts(spark, sf))
    return detectors.robust_z(base).select(*sql.SHARE_TEXT, "statistical_z_score")


def _detector(name: str, column: str) -> None:
    @query(name, _chain((*sql.SHARE_TEXT, column), (), "detected", "detected"))
    def _(spark, sf):
        return detectors.rules_only(shifts(spark, sf)).select(*sql.SHARE_TEXT, column)


_detector("detect_ma_deviation", sql.FLAGS[0])
_detector("detect_robust_z", sql.FLAGS[1])
_detector("detect_erosion", sql.FLAGS[2])
_detector("detect_envelope_breach", sql.FLAGS[3])


@query("gold_detectors", _chain(sql.GOLD_TEXT, sql.GOLD_NUMBERS, "gold", "gold"))
def _(spark, sf):
    return gold(spark, sf)


_COMBINED = ("combined_anomaly", "is_statistical_anomaly")


@query("combined_anomaly", _chain((*sql.SHARE_TEXT, *_COMBINED), (), "gold", "gold"))
def _(spark, sf):
    return gold(spark, sf).select(*sql.SHARE_TEXT, *_COMBINED)


@query("triggered_techniques", sql.analytics("SELECT triggered_techniques, count(*) AS rows FROM gold GROUP BY 1", upto="gold"))
def _(spark, sf):
    return gold(spark, sf).groupBy("triggered_techniques").agg(F.count(F.lit(1)).alias("rows"))


@query("isolation_forest")
def _(spark, sf):
    return isolation_forest(detectors.rules_only(shifts(spark, sf)))


@query("isolation_forest_score_new")
def _(spark, sf):
    """A model fitted on one half of the history scores the other half."""
    rows = detectors.rules_only(shifts(spark, sf))
    model, _ = fit_and_score(rows.filter(F.col("year_week") < "1998-W27"))
    return model.transform(rows.filter(F.col("year_week") >= "1998-W27"))


@query(
    "qualified_shift",
    sql.analytics(
        f"SELECT {', '.join(sql.SHARE_TEXT)}, coalesce(combined_anomaly AND abs(share_shift_pp) >= 1.5, false) AS qualified FROM gold",
        upto="gold",
    ),
)
def _(spark, sf):
    # Erosion is one of the four detectors, so any fired detector counts here as well.
    return gold(spark, sf).select(*sql.SHARE_TEXT, alerts.qualified_shift().alias("qualified"))


@query("alert_categories", _chain(sql.ALERT_TEXT, sql.ALERT_NUMBERS, "alerts", "alerts"))
def _(spark, sf):
    return alerts.classify(gold(spark, sf)).drop("executive_brief")


@query("active_alerts", _chain(sql.ALERT_TEXT, sql.ALERT_NUMBERS, "alerts WHERE alert_category <> 'NORMAL'", "alerts"))
def _(spark, sf):
    return alerts.generate_alerts(gold(spark, sf))[1].drop("executive_brief")


_NAME = "CASE alert_category WHEN 'REGIONAL SHARE DECLINE' THEN 'Regional Share Decline' ELSE 'Regional Growth Spike' END"


@query(
    "alert_brief",
    _chain(
        (*sql.SHARE_TEXT, f"printf('%s for %s in %s (Shift: %+.2f pp / %+.0f bps). Current Share: %.2f%%.', {_NAME}, clean_brand, clean_region, round(share_shift_pp, 2), round(share_shift_bps), round(market_share_trx_pct, 2)) AS executive_brief"),
        (), "alerts WHERE alert_category <> 'NORMAL'", "alerts",
    ),
)
def _(spark, sf):
    return alerts.generate_alerts(gold(spark, sf))[1].select(*sql.SHARE_TEXT, "executive_brief")


@query("alert_prev_share", _chain(sql.SHARE_TEXT, ("previous_share_pp", "current_share_pp"), "alerts", "alerts"))
def _(spark, sf):
    return alerts.classify(gold(spark, sf)).select(*sql.SHARE_TEXT, "previous_share_pp", "current_share_pp")
