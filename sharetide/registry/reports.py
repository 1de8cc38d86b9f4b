"""Queries behind the report tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharetide.operators import rollups
from sharetide.operators.alerts import generate_alerts
from sharetide.operators.forecast import forecast_all
from sharetide.registry import query, sql
from sharetide.registry.market import gold
from sharetide.session import stage

WEEK, BRAND, REGION, CATEGORY = "2000-W20", "ECONOMY", "ASIA", "A"


def _over(select: str, upto: str = "gold", extra: str = "") -> str:
    return sql.analytics(select, upto=upto, extra=extra)


@query(
    "slice_region_category_week",
    _over(
        f"SELECT {sql.pick(sql.GOLD_TEXT, sql.GOLD_NUMBERS)} FROM gold WHERE clean_region = '{REGION}' "
        f"AND clean_therapeutic_area = '{CATEGORY}' AND year_week = '{WEEK}'"
    ),
)
def _(spark, sf):
    return rollups.slice_gold(
        gold(spark, sf), REGION, CATEGORY, WEEK
    )


@query(
    "slice_alerts",
    _over(
        f"SELECT {sql.pick(sql.ALERT_TEXT, sql.ALERT_NUMBERS)} FROM alerts WHERE alert_category <> 'NORMAL' "
        f"AND clean_region = '{REGION}' AND clean_brand = '{BRAND}'",
        "alerts",
    ),
)
def _(spark, sf):
    active = generate_alerts(gold(spark, sf))[1].drop("executive_brief")
    return rollups.slice_gold(active, REGION, "All Therapeutic Areas", None, BRAND)


@query(
    "week_kpis",
    _over(
        "SELECT year_week, clean_brand, any_value(total_volume) AS total_volume, round(avg(market_share_trx_pct), 6) AS current_share, "
        "round(coalesce(avg(share_shift_pp), 0.0), 6) + 0.0 AS shift_pp, round(coalesce(avg(share_shift_pp) * 100.0, 0.0), 6) + 0.0 AS shift_bps, "
        "CASE WHEN avg(share_shift_pp) IS NULL THEN 'Baseline Week' ELSE 'Shift' END AS shift_label "
        "FROM gold JOIN (SELECT year_week, sum(clean_trx) AS total_volume FROM gold GROUP BY 1) USING (year_week) GROUP BY ALL"
    ),
)
def _(spark, sf):
    return rollups.week_kpis(stage(gold(spark, sf), "gold"))


_TREND = "SELECT year_week, clean_brand, round(avg(market_share_trx_pct), 6) AS market_share_trx_pct FROM {} GROUP BY ALL"


@query("share_trend", _over(_TREND.format("gold")))
def _(spark, sf):
    return rollups.share_trend(gold(spark, sf))


@query(
    "trailing_weeks",
    _over(
        _TREND.format(
            f"gold WHERE clean_brand IN ('ECONOMY', 'SMALL') AND year_week IN (SELECT DISTINCT year_week FROM gold "
            f"WHERE year_week <= '{WEEK}' ORDER BY 1 DESC LIMIT 12)"
        )
    ),
)
def _(spark, sf):
    rows = rollups.trailing_weeks(stage(gold(spark, sf), "gold"), WEEK, ("ECONOMY", "SMALL"))
    return rollups.share_trend(rows)


@query(
    "trailing_weeks_absent",
    _over(
        _TREND.format(
            "gold WHERE clean_brand IN ('ECONOMY', 'SMALL') AND year_week IN (SELECT DISTINCT year_week FROM gold "
            "WHERE year_week <= '2000-W99' AND clean_brand IN ('ECONOMY', 'SMALL') ORDER BY 1 DESC LIMIT 26)"
        )
    ),
)
def _(spark, sf):
    rows = rollups.trailing_weeks(stage(gold(spark, sf), "gold"), "2000-W99", ("ECONOMY", "SMALL"))
    return rollups.share_trend(rows)


@query(
    "distinct_dims",
    _over(
        "SELECT DISTINCT dimension, value FROM (SELECT unnest(['brand','region','category','week','year']) AS dimension, "
        "unnest([clean_brand, clean_region, clean_therapeutic_area, year_week, year_week[:4]]) AS value FROM gold)"
    ),
)
def _(spark, sf):
    return rollups.distinct_dims(gold(spark, sf))


@query("brand_category_choices", _over("SELECT DISTINCT clean_brand, clean_therapeutic_area FROM gold"))
def _(spark, sf):
    return rollups.brand_category_choices(gold(spark, sf))


@query(
    "year_week_choices",
    _over("SELECT DISTINCT year_week[:4] AS year, CAST(year_week[7:] AS BIGINT) AS week, year_week FROM gold"),
)
def _(spark, sf):
    return rollups.year_week_choices(gold(spark, sf))


@query(
    "region_lists",
    _over(
        "SELECT year_week, clean_brand, coalesce(string_agg(DISTINCT CASE WHEN share_shift_pp < 0 THEN clean_region END, ', ' "
        "ORDER BY CASE WHEN share_shift_pp < 0 THEN clean_region END), '') AS decline_regions, "
        "coalesce(string_agg(DISTINCT CASE WHEN share_shift_pp > 0 THEN clean_region END, ', ' "
        "ORDER BY CASE WHEN share_shift_pp > 0 THEN clean_region END), '') AS growth_regions FROM gold GROUP BY ALL"
    ),
)
def _(spark, sf):
    return rollups.region_lists(gold(spark, sf))


_MOVER_TEXT, _MOVER_NUMBERS = rollups.MOVER_COLUMNS[:2], rollups.MOVER_COLUMNS[2:]
_MOVERS = f"SELECT {sql.pick(_MOVER_TEXT, _MOVER_NUMBERS)} FROM gold WHERE year_week = '{WEEK}' AND clean_brand = '{BRAND}' AND share_shift_pp"


@query("regional_declines", _over(f"{_MOVERS} < 0"))
def _(spark, sf):
    return rollups.regional_declines(gold(spark, sf), WEEK, BRAND)


@query("regional_gains", _over(f"{_MOVERS} > 0"))
def _(spark, sf):
    return rollups.regional_gains(gold(spark, sf), WEEK, BRAND)


@query(
    "top5_movers",
    _over(
        "SELECT year_week, clean_brand, direction, clean_region, clean_therapeutic_area, round(share_shift_pp, 6) + 0.0 AS share_shift_pp, "
        "clean_trx, rank FROM (SELECT *, row_number() OVER (PARTITION BY year_week, clean_brand, direction ORDER BY abs(share_shift_pp) DESC, "
        "clean_region, clean_therapeutic_area) AS rank FROM (SELECT *, CASE WHEN share_shift_pp < 0 THEN 'decline' WHEN share_shift_pp > 0 "
        "THEN 'growth' END AS direction FROM gold) WHERE direction IS NOT NULL) WHERE rank <= 5"
    ),
)
def _(spark, sf):
    return rollups.top_movers(gold(spark, sf))


@query("default_competitors", _over(f"SELECT DISTINCT clean_brand FROM gold WHERE clean_brand <> '{BRAND}' ORDER BY 1 LIMIT 3"))
def _(spark, sf):
    return rollups.default_competitors(gold(spark, sf), BRAND)


@query("except_selected", _over(f"SELECT DISTINCT clean_brand FROM gold WHERE clean_brand <> '{BRAND}'"))
def _(spark, sf):
    return rollups.except_brand(gold(spark, sf), BRAND)


@query("latest_week", _over("SELECT clean_brand, clean_region, max(year_week) AS latest_week FROM gold GROUP BY ALL"))
def _(spark, sf):
    return rollups.latest_week(gold(spark, sf))


@query("brand_week_brief")
def _(spark, sf):
    rows = stage(gold(spark, sf), "gold")
    return rollups.brand_week_brief(rows, forecast_all(rows))


@query(
    "summary_fallback",
    _over(
        "SELECT year_week, clean_region, clean_brand, '**Commercial Analytics Executive Summary**' || chr(10) || chr(10) || "
        "'- **Context:** ' || left(repeat(clean_brand || ' in ' || clean_region || ' at ' || year_week || '; ', 20), 250) || '...' || chr(10) || "
        "'- **Baseline:** trailing three-week envelope.' || chr(10) || '- **Outlook:** four-week forecast.' AS summary FROM gold"
    ),
)
def _(spark, sf):
    context = F.concat("clean_brand", F.lit(" in "), "clean_region", F.lit(" at "), "year_week", F.lit("; "))
    briefs = gold(spark, sf).select("year_week", "clean_region", "clean_brand", F.repeat(context, 20).alias("brief"))
    return rollups.summary_fallback(briefs, length=250).drop("brief")
