"""Streaming queries, run over what is available now; the result table is returned."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharetide.functions.dates import year_week
from sharetide.operators.cleaning import DUPLICATE_KEYS, derive_columns
from sharetide.registry import query, sql
from sharetide.registry.cleaning import S, _lenient
from sharetide.registry.storage import _COLUMNS
from sharetide.session import fresh_path
from sharetide.sources import star_tables as st
from sharetide.streaming import feed_stream as fs


def line_stream(spark, sf):
    """Line items as a stream; the dimension tables are joined statically."""
    stream = fs.stream_feed(
        spark, sf, spark.createDataFrame([], st.SCHEMAS["lineitem"]).schema, "parquet", pathGlobFilter="lineitem.parquet"
    )
    return st.attach_dimensions(stream, spark, sf)


def event_stream(spark, sf):
    stream = fs.stream_feed(
        spark, sf, spark.createDataFrame([], st.SCHEMAS["events"]).schema, "parquet", pathGlobFilter="events.parquet"
    )
    return st.event_facts(stream)


@query("stream_feed", sql.over_feed(f"SELECT {', '.join(sql.FEED_COLUMNS)} FROM feed", "feed"))
def _(spark, sf):
    root = fresh_path(spark, "stream-feed")
    stream = st.feed_of(line_stream(spark, sf))
    fs.run_batches(stream, f"{root}/_checkpoint", lambda b, i: fs.write_batch(b, root, "rows", i)).awaitTermination()
    return spark.read.parquet(f"{root}/rows").drop("batch_id")


_ROUTED = sql.over_feed(
    "SELECT raw_id, nullif(concat_ws(' | ', CASE WHEN pd IS NULL THEN 'INVALID_DATE' END, CASE WHEN "
    f"{sql.clean('brand')} IS NULL OR {sql.clean('region')} IS NULL THEN 'MISSING_CATEGORICAL_FIELD' END), '') AS rejection_reason, "
    f"{_lenient('trx')} AS clean_trx FROM (SELECT *, CASE "
    "WHEN regexp_full_match(trim(date), '\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}') THEN try_strptime(replace(trim(date), '/', '-'), '%Y-%m-%d') "
    "WHEN regexp_full_match(trim(date), '\\d{1,2}/\\d{1,2}/\\d{4}') THEN coalesce(try_strptime(trim(date), '%d/%m/%Y'), "
    "try_strptime(trim(date), '%m/%d/%Y')) END AS pd FROM feed)",
    "feed",
)


@query("stream_clean_quarantine", f"SELECT raw_id, rejection_reason, CASE WHEN rejection_reason IS NULL THEN clean_trx END AS clean_trx FROM ({_ROUTED})")
def _(spark, sf):
    root = fresh_path(spark, "stream-route")
    fs.route(st.feed_of(line_stream(spark, sf)), root).awaitTermination()
    good = spark.read.parquet(f"{root}/clean").select("raw_id", F.lit(None).cast("string").alias("rejection_reason"), "clean_trx")
    bad = spark.read.parquet(f"{root}/quarantine").select("raw_id", "rejection_reason")
    return good.unionByName(bad, allowMissingColumns=True)


_ARRIVAL = 3  # a row comes with delivery raw_id % 3; the fourth brings rows of all three again


@query(
    "stream_dedupe",
    sql.over_feed(
        "SELECT raw_id, iso_date FROM (SELECT *, row_number() OVER (PARTITION BY iso_date, clean_region, clean_therapeutic_area, "
        f"clean_product, clean_brand ORDER BY raw_id % {_ARRIVAL}, raw_id) AS r FROM flagged) WHERE r = 1",
        "flagged",
    ),
)
def _(spark, sf):
    """Copies of a key lie in several deliveries, of which the first to arrive stays."""
    root, number = fresh_path(spark, "stream-dedupe"), st.row_id()
    lines = st.table(spark, sf, "lineitem")
    again = lines.filter((number % 7 == 0) | (F.col("l_returnflag") == "R"))

    def run(stream):
        rows = derive_columns(st.feed_of(stream), S, st.FEED_ALIASES)
        return fs.dedupe_stream(rows.select("raw_id", *DUPLICATE_KEYS), root)

    _delivered(spark, sf, run, [*[lines.filter(number % _ARRIVAL == k) for k in range(_ARRIVAL)], again])
    return spark.read.parquet(f"{root}/rows").select("raw_id", "iso_date")


@query(
    "stream_week_totals",
    "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS week_start, 'R' || CAST(user_id % 5 AS VARCHAR) AS clean_region, "
    "event_type AS clean_brand, round(sum(value), 6) AS brand_trx, count(*) AS rows FROM events GROUP BY ALL",
)
def _(spark, sf):
    root = fresh_path(spark, "stream-totals")
    totals = fs.week_totals(event_stream(spark, sf))
    (
        totals.writeStream.outputMode("complete")
        .foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{root}/totals"))
        .option("checkpointLocation", f"{root}/_checkpoint")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.parquet(f"{root}/totals")


def _deliveries(spark, sf):
    """Four deliveries of the line items, as (rows with a delivery number, ...) in order of arrival.

    Week 1999-W15 first comes incomplete and is delivered again in the third; the facts of week 2000-W20 come in
    two parts of one delivery, in the second and third.
    """
    week = year_week(F.col("l_shipdate").cast("date"))
    lines = st.table(spark, sf, "lineitem").withColumn("_week", week)
    redone, split = F.col("_week") == "1999-W15", F.col("_week") == "2000-W20"
    part = F.col("l_returnflag") == "R"
    early, middle = F.col("_week") < "2000-W01", (F.col("_week") >= "2000-W01") & (F.col("_week") < "2001-W01")
    numbered = lambda rows, n: rows.withColumn("delivery", F.when(split, "02").otherwise(n)).drop("_week")
    return [
        numbered(lines.filter(early & ~(redone & part)), "01"),
        numbered(lines.filter(middle & ~(split & part)), "02"),
        numbered(lines.filter(redone | (split & part)), "03"),
        numbered(lines.filter((F.col("_week") >= "2001-W01") | F.col("_week").isNull()), "04"),
    ]


def _delivered(spark, sf, run, deliveries=None):
    """Write one delivery after the other and let ``run(stream)`` take in each before the next arrives."""
    path, schema = fresh_path(spark, "deliveries"), None
    for rows in deliveries or _deliveries(spark, sf):
        schema = schema or rows.schema
        rows.write.mode("append").parquet(path)
        run(st.attach_dimensions(fs.stream_feed(spark, path, schema, "parquet"), spark, sf)).awaitTermination()


def _kept_current(spark, sf, name: str):
    root = fresh_path(spark, "stream-gold")

    def facts(batch):
        return st.facts_of(batch, "p_type", None, keep=("delivery",))

    _delivered(spark, sf, lambda stream: fs.update_gold(stream, root, facts, delivery="delivery"))
    return fs.stored(spark, root, name)


@query("stream_gold", sql.analytics(f"SELECT {sql.pick(sql.GOLD_TEXT, sql.GOLD_NUMBERS)} FROM gold", upto="gold"))
def _(spark, sf):
    return _kept_current(spark, sf, fs.GOLD)


@query("stream_alerts", sql.analytics(f"SELECT {sql.pick(sql.ALERT_TEXT, sql.ALERT_NUMBERS)} FROM alerts WHERE alert_category <> 'NORMAL'"))
def _(spark, sf):
    return _kept_current(spark, sf, fs.ALERTS).drop("executive_brief")


@query("stream_replace_week", sql.analytics(f"SELECT {', '.join(_COLUMNS)} FROM facts", upto="brands"))
def _(spark, sf):
    """Batches of whole weeks: week 1999-W15, incomplete at first, is replaced by the third."""
    root, week = fresh_path(spark, "stream-weeks"), F.col("_week")
    lines = st.table(spark, sf, "lineitem").withColumn("_week", year_week(F.col("l_shipdate").cast("date")))
    batches = [week < "2000-W01", (week >= "2000-W01") & (week < "2001-W01"), week == "1999-W15", (week >= "2001-W01") | week.isNull()]
    batches[0] = batches[0] & ((week != "1999-W15") | (F.col("l_returnflag") != "R"))
    facts = lambda stream: st.facts_of(stream).select(*_COLUMNS)
    _delivered(spark, sf, lambda stream: fs.replace_delivered_weeks(facts(stream), root, whole=True), [lines.filter(b).drop("_week") for b in batches])
    return fs.stored(spark, root, "facts").select(*_COLUMNS)


@query("stream_replace_delivery", sql.analytics(f"SELECT {', '.join(_COLUMNS)} FROM facts", upto="brands"))
def _(spark, sf):
    """Every delivery replaces its weeks, and the two parts of week 2000-W20 are put together."""
    root = fresh_path(spark, "stream-parts")
    facts = lambda stream: st.facts_of(stream, keep=("delivery",)).select(*_COLUMNS, "delivery")
    _delivered(spark, sf, lambda stream: fs.replace_delivered_weeks(facts(stream), root, delivery="delivery"))
    return fs.stored(spark, root, "facts").select(*_COLUMNS)
