"""Queries over the dirty feed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.functions import dates, numbers, text
from sharetide.operators import cleaning as ops
from sharetide.operators import quality
from sharetide.registry import query, sql
from sharetide.schemas import MEASURES, SERIES_KEYS
from sharetide.session import stage
from sharetide.sources import star_tables as st

S = Settings(epoch_year=st.EPOCH_YEAR)


def feed(spark: SparkSession, sf: str) -> DataFrame:
    return st.feed(spark, sf)


def derived(spark: SparkSession, sf: str) -> DataFrame:
    return ops.derive_columns(feed(spark, sf), S, st.FEED_ALIASES)


def processed(spark: SparkSession, sf: str, materialise: bool = True) -> DataFrame:
    return ops.process_feed(feed(spark, sf), S, aliases=st.FEED_ALIASES, materialise=materialise)


@query(
    "clean_string",
    sql.over_feed(
        f"SELECT raw_id, {sql.clean('region')} AS region, {sql.clean('brand')} AS brand, {sql.clean('trx')} AS trx FROM feed",
        "feed",
    ),
)
def _(spark, sf):
    names = ("region", "brand", "trx")
    return feed(spark, sf).select("raw_id", *[text.clean_string(F.col(c)).alias(c) for c in names])


@query(
    "parse_date_multi",
    sql.over_feed(
        f"SELECT raw_id, CAST(CAST({sql.direct_date('trim(date)')} AS DATE) AS VARCHAR) AS parsed FROM feed", "feed"
    ),
)
def _(spark, sf):
    return feed(spark, sf).select("raw_id", dates.parse_date_multi(F.trim("date")).alias("parsed"))


@query("disambiguate_date", sql.over_feed("SELECT raw_id, iso_date AS parsed FROM flagged", "flagged"))
def _(spark, sf):
    dated = dates.add_feed_date(feed(spark, sf), epoch_year=st.EPOCH_YEAR)
    return dated.select("raw_id", F.col("iso_date").alias("parsed"))


@query(
    "iso_year_week",
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(isoyear(l_shipdate) AS BIGINT) AS iso_year, "
    f"CAST(least(weekofyear(l_shipdate), 52) AS BIGINT) AS iso_week, {sql.label('l_shipdate')} AS year_week, "
    f"{sql.label('l_shipdate', clamp=False)} AS true_year_week FROM lineitem",
)
def _(spark, sf):
    d = F.col("l_shipdate").cast("date")
    return st.line_items(spark, sf).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        dates.iso_year(d).alias("iso_year"),
        dates.iso_week(d).alias("iso_week"),
        dates.year_week(d).alias("year_week"),
        dates.year_week(d, clamp53=False).alias("true_year_week"),
    )


@query("normalise_region", sql.over_feed("SELECT raw_id, clean_region FROM flagged", "flagged"))
def _(spark, sf):
    region = text.normalise_region(text.clean_string(F.col("region")), st.FEED_ALIASES)
    return feed(spark, sf).select("raw_id", region.alias("clean_region"))


@query(
    "normalise_labels",
    sql.over_feed("SELECT raw_id, clean_therapeutic_area, clean_product, clean_brand FROM flagged", "flagged"),
)
def _(spark, sf):
    names = ("therapeutic_area", "product", "brand")
    return feed(spark, sf).select(
        "raw_id", *[text.normalise_label(text.clean_string(F.col(c))).alias(f"clean_{c}") for c in names]
    )


@query("parse_number", sql.over_feed("SELECT raw_id, clean_trx, clean_nrx, clean_units FROM parsed", "parsed"))
def _(spark, sf):
    names = ("trx", "nrx", "units")
    return feed(spark, sf).select(
        "raw_id", *[numbers.parse_number(text.clean_string(F.col(c))).alias(f"clean_{c}") for c in names]
    )


def _lenient(c: str) -> str:
    return f"CAST(TRY_CAST(nullif(regexp_replace({c}, '[^0-9.-]', '', 'g'), '') AS DECIMAL(12,2)) AS DOUBLE)"


@query(
    "parse_number_lenient",
    sql.over_feed(
        f"SELECT raw_id, {_lenient('trx')} AS trx, {_lenient('units')} AS units, {_lenient('date')} AS from_date FROM feed",
        "feed",
    ),
)
def _(spark, sf):
    return feed(spark, sf).select(
        "raw_id",
        numbers.parse_number_lenient(F.col("trx")).alias("trx"),
        numbers.parse_number_lenient(F.col("units")).alias("units"),
        numbers.parse_number_lenient(F.col("date")).alias("from_date"),
    )


@query(
    "quality_flags",
    sql.over_feed(
        "SELECT raw_id, is_missing_categorical, is_negative_trx, is_missing_numeric, is_nrx_gt_trx_error FROM flagged",
        "flagged",
    ),
)
def _(spark, sf):
    return derived(spark, sf).select("raw_id", *ops.quality_flags())


@query("week_mismatch", sql.over_feed("SELECT raw_id, is_week_mismatch FROM flagged", "flagged"))
def _(spark, sf):
    dated = dates.add_feed_date(feed(spark, sf), epoch_year=st.EPOCH_YEAR)
    return dated.select("raw_id", "is_week_mismatch")


@query(
    "trigger_clean",
    sql.over_feed(
        "SELECT raw_id, CAST(pd AS VARCHAR) AS iso_date, "
        f"{sql.label('pd', clamp=False)} AS year_week, {sql.title('trim(region)')} AS clean_region, "
        f"{sql.title('trim(therapeutic_area)')} AS clean_therapeutic_area, trim(product) AS clean_product, trim(brand) AS clean_brand, "
        "t AS clean_trx, n AS clean_nrx, u AS clean_units, coalesce(t < 0, false) AS is_negative_trx, "
        "coalesce(n > t AND t > 0, false) AS is_nrx_gt_trx_error, nullif(concat_ws(' | ', CASE WHEN pd IS NULL THEN 'INVALID_DATE' END, "
        f"CASE WHEN {sql.clean('brand')} IS NULL OR {sql.clean('region')} IS NULL THEN 'MISSING_CATEGORICAL_FIELD' END), '') AS rejection_reason "
        "FROM (SELECT *, CAST(CASE WHEN regexp_full_match(trim(date), '\\d{4}-\\d{1,2}-\\d{1,2}') THEN try_strptime(trim(date), '%Y-%m-%d') "
        "WHEN regexp_full_match(trim(date), '\\d{4}/\\d{1,2}/\\d{1,2}') THEN try_strptime(trim(date), '%Y/%m/%d') "
        "WHEN regexp_full_match(trim(date), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN coalesce(try_strptime(trim(date), '%d/%m/%Y'), "
        f"try_strptime(trim(date), '%m/%d/%Y')) END AS DATE) AS pd, {_lenient('trx')} AS t, {_lenient('nrx')} AS n, {_lenient('units')} AS u FROM feed)",
        "feed",
    ),
)
def _(spark, sf):
    return ops.storage_clean(feed(spark, sf)).drop("raw_payload")


@query("dedupe_first", sql.over_feed("SELECT raw_id, is_duplicate FROM marked", "marked"))
def _(spark, sf):
    keyed = stage(derived(spark, sf).select("raw_id", *ops.DUPLICATE_KEYS), "derived-keys")  # read twice, parsed once
    return ops.mark_duplicates(keyed, materialise=True).select("raw_id", "is_duplicate")


_PROCESSED = (
    "raw_id", "iso_date", "year_week", "clean_region", "clean_therapeutic_area", "clean_product", "clean_brand",
    "clean_trx", "clean_nrx", "clean_units", "is_missing_categorical", "is_negative_trx", "is_missing_numeric",
    "is_nrx_gt_trx_error", "is_week_mismatch", "is_duplicate", "is_quarantined", "rejection_reason",
)


@query("split_quarantine", sql.over_feed(f"SELECT {', '.join(_PROCESSED)} FROM processed"))
def _(spark, sf):
    return processed(spark, sf).select(*_PROCESSED)


@query(
    "rejection_reason",
    sql.over_feed(
        "SELECT rejection_reason, count(*) AS rows, count(DISTINCT raw_id) AS ids FROM processed WHERE is_quarantined GROUP BY 1"
    ),
)
def _(spark, sf):
    rejected = ops.quarantine_rows(processed(spark, sf, materialise=False))
    return rejected.groupBy("rejection_reason").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("raw_id").alias("ids")
    )


@query(
    "impute_group_median",
    sql.over_feed("SELECT raw_id, clean_trx, clean_nrx, clean_units FROM cleaned", "cleaned"),
)
def _(spark, sf):
    valid = ops.valid_rows(processed(spark, sf)).select("raw_id", *SERIES_KEYS, *MEASURES)
    return ops.impute_group_median(stage(valid, "valid")).select("raw_id", *MEASURES)


@query(
    "audit_counts",
    sql.over_feed(
        "SELECT count(*) AS total_raw_records, count_if(NOT is_quarantined) AS clean_records_retained, "
        "count_if(is_quarantined) AS quarantined_records_count, count_if(is_duplicate) AS duplicate_composite_keys_count, "
        "count_if(is_missing_categorical) AS missing_categorical_count, count_if(is_negative_trx) AS negative_trx_chargebacks_count, "
        "count_if(is_nrx_gt_trx_error) AS nrx_gt_trx_errors_count, count_if(is_week_mismatch) AS week_mismatch_count FROM processed"
    ),
)
def _(spark, sf):
    return quality.audit_counts(processed(spark, sf))


_DQ = (
    "SELECT count(*) AS total_raw_records, count_if(NOT is_quarantined) AS valid_cleaned_records, "
    "round(count_if(NOT is_quarantined) / count(*) * 100.0, 2) AS valid_percentage, count_if(is_quarantined) AS quarantined_records, "
    "round(count_if(is_quarantined) / count(*) * 100.0, 2) AS quarantine_percentage, count_if(clean_trx IS NULL) AS missing_trx_count, "
    "count_if(clean_nrx IS NULL) AS missing_nrx_count, count_if(clean_units IS NULL) AS missing_units_count, "
    "count_if(is_negative_trx) AS negative_trx_count, count_if(is_nrx_gt_trx_error) AS nrx_gt_trx_violations, "
    "count_if(is_duplicate) AS duplicate_records_count, "
    "count(DISTINCT CASE WHEN NOT is_quarantined THEN clean_region END) AS canonical_regions_count, "
    "count(DISTINCT CASE WHEN NOT is_quarantined THEN clean_brand END) AS unique_brands_count, "
    "count(DISTINCT CASE WHEN NOT is_quarantined THEN clean_therapeutic_area END) AS therapeutic_areas_count FROM processed"
)


@query("dq_summary", sql.over_feed(_DQ))
def _(spark, sf):
    return quality.dq_summary(processed(spark, sf))


@query(
    "dq_report_long",
    sql.over_feed(
        "SELECT unnest(['Total Raw Records','Valid Cleaned Records','Quarantined Invalid Records','Missing TRX Values',"
        "'Negative TRX Records','NRx > TRx Violations','Duplicate Composite Keys']) AS \"Metric\", "
        "unnest([total_raw_records, valid_cleaned_records, quarantined_records, missing_trx_count, negative_trx_count, "
        "nrx_gt_trx_violations, duplicate_records_count]) AS \"Count\" FROM dq",
        extra=f"dq AS ({_DQ})",
    ),
)
def _(spark, sf):
    return quality.dq_report_long(quality.dq_summary(processed(spark, sf))).select("Metric", "Count")


@query(
    "fn_string_clean",
    "SELECT p_partkey, upper(p_name[1]) || p_name[2:] AS first_upper, "
    f"{sql.title('p_brand')} AS brand, {sql.title('p_name')} AS product FROM part",
)
def _(spark, sf):
    parts = st.table(spark, sf, "part")
    first = F.concat(F.upper(F.left("p_name", F.lit(1))), F.substr("p_name", F.lit(2)))
    return parts.select(
        "p_partkey",
        first.alias("first_upper"),
        text.title_case(F.col("p_brand")).alias("brand"),
        text.title_case(F.col("p_name")).alias("product"),
    )


@query(
    "fn_iso_week",
    f"SELECT event_id, {sql.label('ts', clamp=False)} AS year_week, CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS monday FROM events",
)
def _(spark, sf):
    label = dates.year_week(F.col("ts").cast("date"), clamp53=False)
    return st.table(spark, sf, "events").select(
        "event_id", label.alias("year_week"), dates.monday_of(label).alias("monday")
    )


@query("fn_payload_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(spark, sf):
    parsed = F.from_json("props", "k bigint")
    return st.table(spark, sf, "events").select("event_id", parsed["k"].alias("k"))
