"""SQL texts the registered queries are compared with."""

from __future__ import annotations

from collections.abc import Iterable

CATEGORY = (
    "CASE WHEN p_type IN ('ECONOMY','SMALL') THEN 'A' "
    "WHEN p_type IN ('MEDIUM','LARGE') THEN 'B' ELSE 'C' END"
)
STAR = (
    "lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey "
    "JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey "
    "JOIN region ON n_regionkey = r_regionkey"
)


def label(d: str, clamp: bool = True) -> str:
    week = f"least(weekofyear({d}), 52)" if clamp else f"weekofyear({d})"
    return f"CAST(isoyear({d}) AS VARCHAR) || '-W' || lpad(CAST({week} AS VARCHAR), 2, '0')"


def facts(brand: str = "p_type", category: str = CATEGORY, quantity: str = "l_quantity", where: str = "true") -> str:
    return (
        f"SELECT {label('l_shipdate')} AS year_week, r_name AS clean_region, {brand} AS clean_brand, "
        f"{category} AS clean_therapeutic_area, p_name AS clean_product, {quantity} AS clean_trx, "
        f"CASE WHEN l_returnflag = 'N' THEN {quantity} ELSE 0.0 END AS clean_nrx, "
        f"floor(l_extendedprice) AS clean_units, l_returnflag FROM {STAR} WHERE {where}"
    )


SUMS = (
    "coalesce(sum(clean_trx), 0.0) AS clean_trx, coalesce(sum(clean_nrx), 0.0) AS clean_nrx, "
    "coalesce(sum(clean_units), 0.0) AS clean_units"
)
BRANDS = (
    "SELECT year_week, clean_region, clean_brand, coalesce(sum(clean_trx), 0.0) AS brand_trx, "
    "coalesce(sum(clean_nrx), 0.0) AS clean_nrx, coalesce(sum(clean_units), 0.0) AS clean_units "
    "FROM facts GROUP BY ALL"
)
SEGMENTS = (
    "SELECT year_week, clean_region, coalesce(sum(clean_trx), 0.0) AS total_segment_trx, "
    "coalesce(sum(clean_nrx), 0.0) AS total_segment_nrx, "
    "coalesce(sum(clean_units), 0.0) AS total_segment_units FROM facts GROUP BY ALL"
)
MAP_ALL = "SELECT DISTINCT clean_brand, clean_therapeutic_area FROM facts"
MAP_FIRST = (
    "SELECT clean_brand, min(clean_therapeutic_area) AS clean_therapeutic_area FROM facts GROUP BY 1"
)
SHARES = (
    "SELECT *, CASE WHEN market_share_trx_pct > 0 THEN market_share_nrx_pct / market_share_trx_pct "
    "ELSE 1.0 END AS momentum_ratio FROM (SELECT b.*, s.total_segment_trx, s.total_segment_nrx, "
    "s.total_segment_units, m.clean_therapeutic_area, b.brand_trx AS clean_trx, "
    "CASE WHEN total_segment_trx > 0 THEN brand_trx / total_segment_trx * 100.0 ELSE 0.0 END "
    "AS market_share_trx_pct, CASE WHEN total_segment_nrx > 0 THEN b.clean_nrx / total_segment_nrx "
    "* 100.0 ELSE 0.0 END AS market_share_nrx_pct FROM brands b LEFT JOIN segments s "
    "USING (year_week, clean_region) LEFT JOIN brand_map m USING (clean_brand))"
)
SERIES = "clean_region, clean_therapeutic_area, clean_brand"
SHIFTS = (
    "SELECT *, share_shift_pp * 100.0 AS share_shift_bps FROM (SELECT *, market_share_trx_pct - "
    "prev_market_share_pp AS share_shift_pp FROM (SELECT *, lag(market_share_trx_pct) OVER "
    f"(PARTITION BY {SERIES} ORDER BY year_week) AS prev_market_share_pp FROM shares))"
)


def baseline(lookback: int = 3) -> str:
    frame = "f"
    columns = ", ".join(
        f"CASE WHEN count(share_shift_pp) OVER {frame} >= 2 THEN {fn}(share_shift_pp) OVER {frame} END "
        f"AS prev_3wk_rolling_{name}_pp"
        for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"), ("mad", "mad"))
    )
    return (
        f"SELECT *, {columns}, lag(share_shift_pp, 1) OVER w AS lag1, lag(share_shift_pp, 2) OVER w AS lag2 "
        f"FROM shifts WINDOW w AS (PARTITION BY {SERIES} ORDER BY year_week), "
        f"f AS (PARTITION BY {SERIES} ORDER BY year_week ROWS BETWEEN {lookback} PRECEDING AND 1 PRECEDING)"
    )


BOUNDS = (
    "SELECT *, prev_3wk_rolling_mean_pp + 3.0 * greatest(coalesce(prev_3wk_rolling_std_pp, 0.2), 0.2) "
    "AS dynamic_upper_threshold, prev_3wk_rolling_mean_pp - 3.0 * greatest(coalesce("
    "prev_3wk_rolling_std_pp, 0.2), 0.2) AS dynamic_lower_threshold, "
    "CASE WHEN share_shift_pp IS NOT NULL AND prev_3wk_rolling_median_pp IS NOT NULL THEN "
    "greatest(least(0.6745 * (share_shift_pp - prev_3wk_rolling_median_pp) / greatest(coalesce("
    "prev_3wk_rolling_mad_pp, 0.2), 0.2), 10.0), -10.0) END AS statistical_z_score FROM base"
)
DETECTORS = (
    "SELECT * EXCLUDE (lag1, lag2), coalesce(abs(share_shift_pp - prev_3wk_rolling_mean_pp) >= 2.0 * "
    "greatest(coalesce(prev_3wk_rolling_mad_pp, 0.2), 0.2), false) AS t1_moving_average_anomaly, "
    "coalesce(abs(statistical_z_score) >= 3.0, false) AS t2_z_score_anomaly, "
    "coalesce(share_shift_pp < 0 AND lag1 < 0 AND lag2 < 0, false) AS t3_erosion_anomaly, "
    "coalesce(share_shift_pp > dynamic_upper_threshold OR share_shift_pp < dynamic_lower_threshold, false) "
    "AS t4_dynamic_threshold_anomaly FROM bounds"
)
GOLD = (
    "SELECT *, 1 AS isolation_forest_label, 0.0 AS isolation_forest_score, false AS isolation_forest_anomaly, "
    "(t1_moving_average_anomaly OR t2_z_score_anomaly OR t3_erosion_anomaly OR t4_dynamic_threshold_anomaly) "
    "AS combined_anomaly, (t1_moving_average_anomaly OR t2_z_score_anomaly OR t3_erosion_anomaly OR "
    "t4_dynamic_threshold_anomaly) AS is_statistical_anomaly, coalesce(nullif(concat_ws(', ', "
    "CASE WHEN t1_moving_average_anomaly THEN 'MA Trend Deviation' END, "
    "CASE WHEN t2_z_score_anomaly THEN 'Robust Z-Score Spike' END, "
    "CASE WHEN t3_erosion_anomaly THEN '3-Wk Erosion' END, "
    "CASE WHEN t4_dynamic_threshold_anomaly THEN 'Volatility Envelope Breach' END), ''), 'None') "
    "AS triggered_techniques FROM detected"
)
ALERTS = (
    "SELECT *, alert_category AS alert_type, alert_category AS severity_level, "
    "market_share_trx_pct - share_shift_pp AS previous_share_pp, market_share_trx_pct AS current_share_pp "
    "FROM (SELECT *, CASE WHEN NOT ((combined_anomaly AND abs(share_shift_pp) >= 1.5) OR t3_erosion_anomaly) "
    "THEN 'NORMAL' WHEN share_shift_pp < 0 OR t3_erosion_anomaly THEN 'REGIONAL SHARE DECLINE' "
    "ELSE 'REGIONAL GROWTH SPIKE' END AS alert_category FROM gold WHERE share_shift_pp IS NOT NULL)"
)

STAGES = ("brands", "segments", "brand_map", "shares", "shifts", "base", "bounds", "detected", "gold", "alerts")


def analytics(select: str, facts_sql: str | None = None, upto: str = "alerts", brand_map: str = MAP_ALL, extra: str = "") -> str:
    """``select`` over the chain of stages from facts to alerts."""
    texts = {
        "brands": BRANDS, "segments": SEGMENTS, "brand_map": brand_map, "shares": SHARES,
        "shifts": SHIFTS, "base": baseline(), "bounds": BOUNDS, "detected": DETECTORS,
        "gold": GOLD, "alerts": ALERTS,
    }
    used = STAGES[: STAGES.index(upto) + 1]
    chain = [f"facts AS ({facts_sql or facts()})"] + [f"{n} AS ({texts[n]})" for n in used]
    if extra:
        chain.append(extra)
    return f"WITH {', '.join(chain)} {select}"


def pick(text: Iterable[str] = (), numbers: Iterable[str] = ()) -> str:
    """Select list: plain columns, then numbers rounded to six decimals without a minus zero."""
    return ", ".join([*text, *[f"round({n}, 6) + 0.0 AS {n}" for n in numbers]])


SHARE_TEXT = ("year_week", "clean_region", "clean_brand", "clean_therapeutic_area")
SHARE_NUMBERS = (
    "brand_trx", "clean_nrx", "clean_units", "total_segment_trx", "total_segment_nrx",
    "total_segment_units", "market_share_trx_pct", "market_share_nrx_pct", "momentum_ratio", "clean_trx",
)
SHIFT_NUMBERS = (*SHARE_NUMBERS, "prev_market_share_pp", "share_shift_pp", "share_shift_bps")
BASE_NUMBERS = (
    "prev_3wk_rolling_mean_pp", "prev_3wk_rolling_std_pp", "prev_3wk_rolling_median_pp", "prev_3wk_rolling_mad_pp",
)
GOLD_NUMBERS = (
    *SHIFT_NUMBERS, *BASE_NUMBERS, "dynamic_upper_threshold", "dynamic_lower_threshold",
    "statistical_z_score", "isolation_forest_score",
)
FLAGS = (
    "t1_moving_average_anomaly", "t2_z_score_anomaly", "t3_erosion_anomaly",
    "t4_dynamic_threshold_anomaly",
)
GOLD_TEXT = (
    *SHARE_TEXT, *FLAGS, "isolation_forest_label", "isolation_forest_anomaly", "combined_anomaly",
    "is_statistical_anomaly", "triggered_techniques",
)
ALERT_TEXT = (*SHARE_TEXT, "alert_category", "alert_type", "severity_level", "triggered_techniques")
ALERT_NUMBERS = (
    "previous_share_pp", "current_share_pp", "share_shift_pp", "share_shift_bps",
    "dynamic_upper_threshold", "dynamic_lower_threshold", "statistical_z_score", "isolation_forest_score",
)

# --- dirty feed -------------------------------------------------------------------------------

_IDENTITY = (
    "concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), "
    "CAST(l_suppkey AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d'))"
)
FEED = (
    "SELECT raw_id, CASE WHEN raw_id % 100 = 99 THEN 'not-a-date' WHEN raw_id % 10 <= 3 THEN strftime(d, '%Y-%m-%d') "
    "WHEN raw_id % 10 = 4 THEN strftime(d, '%Y/%m/%d') WHEN raw_id % 10 = 5 THEN strftime(d, '%d-%b-%Y') "
    "WHEN raw_id % 10 = 6 THEN strftime(d, '%b %d, %Y') WHEN raw_id % 10 = 7 THEN strftime(d, '%m/%d/%Y') "
    "WHEN raw_id % 10 = 8 THEN strftime(d, '%d/%m/%Y') ELSE strftime(d, '%d-%m-%Y') END AS date, "
    "CASE WHEN raw_id % 41 = 0 THEN NULL WHEN raw_id % 43 = 0 THEN 'wk' "
    "WHEN raw_id % 37 = 0 THEN CAST(weekofyear(d) + 9 AS VARCHAR) "
    "WHEN raw_id % 2 = 0 THEN CAST(weekofyear(d) AS VARCHAR) "
    "ELSE CAST((isoyear(d) - 1995) * 52 + weekofyear(d) AS VARCHAR) END AS week_number, "
    "CAST(isoyear(d) AS VARCHAR) AS year, "
    "CASE WHEN raw_id % 53 = 0 THEN 'nan' WHEN r_name = 'MIDDLE EAST' AND raw_id % 5 = 0 THEN 'middleeast' "
    "WHEN raw_id % 3 = 0 THEN lower(r_name) WHEN raw_id % 7 = 0 THEN '  ' || r_name || ' ' ELSE r_name END AS region, "
    f"{CATEGORY} AS therapeutic_area, p_name AS product, CASE WHEN raw_id % 59 = 0 THEN '' ELSE p_type END AS brand, "
    "CASE WHEN raw_id % 67 = 0 THEN '' WHEN raw_id % 61 = 0 THEN CAST(-q AS VARCHAR) ELSE CAST(q AS VARCHAR) END AS trx, "
    "CASE WHEN raw_id % 71 = 0 THEN CAST(q + 5 AS VARCHAR) WHEN l_returnflag = 'N' THEN CAST(q AS VARCHAR) "
    "ELSE CAST(q // 2 AS VARCHAR) END AS nrx, "
    "CASE WHEN raw_id % 5 = 0 THEN format('{:,}', u) ELSE CAST(u AS VARCHAR) END AS units "
    f"FROM (SELECT *, CAST('0x' || substr(md5({_IDENTITY}), 1, 15) AS BIGINT) AS raw_id, CAST(l_shipdate AS DATE) AS d, "
    f"CAST(l_quantity AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS u FROM {STAR})"
)
FEED_COLUMNS = (
    "raw_id", "date", "week_number", "year", "region", "therapeutic_area", "product", "brand", "trx", "nrx", "units",
)


def clean(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN ('nan','none','null','') THEN trim({c}) END"


def title(c: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(lower({c}), '([a-z]+|[^a-z]+)'), "
        "lambda x: upper(x[1]) || x[2:]), '')"
    )


def direct_date(t: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime({t}, '%Y-%m-%d') "
        f"WHEN regexp_full_match({t}, '\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}') THEN try_strptime({t}, '%Y/%m/%d') "
        f"WHEN regexp_full_match({t}, '\\d{{1,2}}-[A-Za-z]{{3}}-\\d{{4}}') THEN try_strptime({t}, '%d-%b-%Y') "
        f"WHEN regexp_full_match({t}, '[A-Za-z]{{3}} \\d{{1,2}}, \\d{{4}}') THEN try_strptime({t}, '%b %d, %Y') END"
    )


def read_as(t: str, fmt: str) -> str:
    return (
        f"CASE WHEN regexp_full_match({t}, '\\d{{1,2}}[/-]\\d{{1,2}}[/-]\\d{{4}}') "
        f"THEN try_strptime(replace({t}, '-', '/'), '{fmt}') END"
    )


def number(c: str) -> str:
    return (
        f"CASE WHEN regexp_full_match(replace({clean(c)}, ',', ''), '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?') "
        f"THEN TRY_CAST(replace({clean(c)}, ',', '') AS DOUBLE) END"
    )


def _distance(d: str) -> str:
    return f"least(abs(hint - weekofyear({d})), abs(hint - ((isoyear({d}) - 1995) * 52 + weekofyear({d}))))"


PARSED = (
    f"SELECT *, {clean('date')} AS dt, {clean('week_number')} AS ht, "
    f"CASE WHEN regexp_full_match({clean('week_number')}, '[+-]?\\d+') THEN TRY_CAST({clean('week_number')} AS BIGINT) END AS hint, "
    f"{clean('region')} AS raw_region, {clean('therapeutic_area')} AS raw_ta, {clean('product')} AS raw_product, "
    f"{clean('brand')} AS raw_brand, {number('trx')} AS clean_trx, {number('nrx')} AS clean_nrx, "
    f"{number('units')} AS clean_units FROM feed"
)
DATED = (
    "SELECT *, CAST(coalesce(direct, CASE WHEN mf IS NULL THEN df WHEN df IS NULL OR hint IS NULL THEN mf "
    f"WHEN {_distance('mf')} <= {_distance('df')} THEN mf ELSE df END) AS DATE) AS pd FROM (SELECT *, "
    f"{direct_date('dt')} AS direct, {read_as('dt', '%m/%d/%Y')} AS mf, {read_as('dt', '%d/%m/%Y')} AS df FROM parsed)"
)
FLAGGED = (
    "SELECT *, CAST(pd AS VARCHAR) AS iso_date, "
    f"{label('pd')} AS year_week, isoyear(pd) AS iso_year, least(weekofyear(pd), 52) AS iso_week, "
    f"coalesce(CASE WHEN lower(raw_region) = 'middleeast' THEN 'MIDDLE EAST' ELSE {title('raw_region')} END, 'Unknown') AS clean_region, "
    f"coalesce({title('raw_ta')}, 'Unknown') AS clean_therapeutic_area, coalesce({title('raw_product')}, 'Unknown') AS clean_product, "
    f"coalesce({title('raw_brand')}, 'Unknown') AS clean_brand, "
    "(raw_region IS NULL OR raw_ta IS NULL OR raw_product IS NULL OR raw_brand IS NULL) AS is_missing_categorical, "
    "coalesce(clean_trx < 0, false) AS is_negative_trx, "
    "(clean_trx IS NULL OR clean_nrx IS NULL OR clean_units IS NULL) AS is_missing_numeric, "
    "coalesce(clean_nrx > clean_trx AND clean_trx > 0, false) AS is_nrx_gt_trx_error, "
    "CASE WHEN ht IS NULL OR pd IS NULL THEN false WHEN hint IS NULL THEN true "
    "ELSE abs(hint - least(weekofyear(pd), 52)) > 1 AND abs(hint - ((isoyear(pd) - 1995) * 52 + least(weekofyear(pd), 52))) > 2 END "
    "AS is_week_mismatch FROM dated"
)
MARKED = (
    "SELECT *, row_number() OVER (PARTITION BY iso_date, clean_region, clean_therapeutic_area, clean_product, clean_brand "
    "ORDER BY raw_id) > 1 AS is_duplicate FROM flagged"
)
REASONED = (
    "SELECT *, reason <> '' AS is_quarantined, nullif(reason, '') AS rejection_reason FROM (SELECT *, concat_ws(' | ', "
    "CASE WHEN pd IS NULL THEN 'INVALID_DATE' END, CASE WHEN is_missing_categorical THEN 'MISSING_CATEGORICAL_FIELD' END, "
    "CASE WHEN clean_region = 'Unknown' THEN 'UNKNOWN_REGION' END, "
    "CASE WHEN clean_brand IN ('Unknown','Nan','nan','') THEN 'UNKNOWN_BRAND' END, "
    "CASE WHEN is_nrx_gt_trx_error THEN 'NRX_GREATER_THAN_TRX' END, CASE WHEN is_duplicate THEN 'DUPLICATE_RECORD' END, "
    "CASE WHEN is_week_mismatch THEN 'WEEK_DATE_MISMATCH' END) AS reason FROM marked)"
)
IMPUTED = (
    "SELECT * REPLACE (" + ", ".join(
        f"coalesce({m}, median({m}) OVER (PARTITION BY {SERIES})) AS {m}" for m in ("clean_trx", "clean_nrx", "clean_units")
    ) + ") FROM processed WHERE NOT is_quarantined"
)
FEED_STAGES = ("feed", "parsed", "dated", "flagged", "marked", "processed", "cleaned")


def feed_chain(upto: str = "cleaned") -> str:
    texts = dict(zip(FEED_STAGES, (FEED, PARSED, DATED, FLAGGED, MARKED, REASONED, IMPUTED)))
    return ", ".join(f"{n} AS ({texts[n]})" for n in FEED_STAGES[: FEED_STAGES.index(upto) + 1])


def over_feed(select: str, upto: str = "processed", extra: str = "") -> str:
    return f"WITH {feed_chain(upto)}{', ' + extra if extra else ''} {select}"


def cleaned_analytics(select: str, upto: str = "gold") -> str:
    """The analytics chain over the cleaned dirty feed."""
    inner = analytics(select, "SELECT * FROM cleaned", upto)
    return f"WITH {feed_chain()}, {inner.removeprefix('WITH ')}"
