"""Queries on sources and sinks: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from sharetide.operators import share
from sharetide.operators.alerts import generate_alerts
from sharetide.operators.cleaning import impute_group_median, valid_rows
from sharetide.plans.incremental import refresh
from sharetide.plans.weekly import gold_from_clean, layer_pieces, load_or_compute, recompute_from_store, weekly_run, write_layers
from sharetide.registry import query, sql
from sharetide.registry.cleaning import S, feed, processed
from sharetide.schemas import CLEAN_STORE, FEED_FIELDS
from sharetide.session import fresh_path, stage
from sharetide.sources import feeds, sinks
from sharetide.sources import star_tables as st
from sharetide.sources.versioned import DeliveryStore, WeekStore

_FEED = ", ".join(sql.FEED_COLUMNS)


def _blank(c: str) -> str:
    return f"nullif({c}, '') AS {c}"


@query(
    "read_feed_csv",
    sql.over_feed(
        "SELECT raw_id, " + ", ".join(_blank(c) for c in FEED_FIELDS) + " FROM feed", "feed"
    ),
)
def _(spark, sf):
    path = fresh_path(spark, "feed-csv")
    feed(spark, sf).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    rows = feeds.read_feed_csv(spark, path, with_id=True)
    return rows.select("raw_id", *[F.nullif(F.col(c), F.lit("")).alias(c) for c in FEED_FIELDS])


def _records(number: bool = True):
    """One delivery body per line item, holding the item and a half-volume copy of it."""

    def record(scale: float):
        volume = F.floor(F.col("l_quantity") * scale)
        trx = volume.cast("double")
        if not number:
            trx = F.when(F.col("l_orderkey") % 31 == 0, F.lit("many")).otherwise(volume.cast("string"))
        day = F.col("l_shipdate").cast("date")
        return F.struct(
            F.when(F.lit(number) | (F.col("l_partkey") % 97 != 0), F.date_format(day, "yyyy-MM-dd")).alias("date"),
            F.weekofyear(day).alias("week_number"),
            F.year(day).alias("year"),
            F.col("r_name").alias("region"),
            st.category_of_type().alias("therapeutic_area"),
            F.col("p_name").alias("product"),
            F.col("p_type").alias("brand"),
            trx.alias("trx"),
            F.lit(1.0).alias("nrx"),
            F.floor("l_extendedprice").cast("double").alias("units"),
        )

    return F.array(record(1.0), record(0.5))


def bodies(spark, sf, number: bool = True):
    lines = st.attach_dimensions(st.line_items(spark, sf), spark, sf)
    from sharetide.functions.dates import year_week

    delivery = F.struct(
        year_week(F.col("l_shipdate").cast("date")).alias("year_week"),
        F.lit("weekly feed").alias("source_vendor"),
        _records(number).alias("records"),
    )
    return lines.select("l_orderkey", F.to_json(delivery).alias("body"))


@query(
    "read_feed_records",
    f"SELECT l_orderkey, {sql.label('l_shipdate')} AS year_week, 'weekly feed' AS source_vendor, strftime(l_shipdate, '%Y-%m-%d') AS date, "
    "CAST(weekofyear(l_shipdate) AS BIGINT) AS week_number, CAST(year(l_shipdate) AS BIGINT) AS year, r_name AS region, "
    f"{sql.CATEGORY} AS therapeutic_area, p_name AS product, p_type AS brand, floor(l_quantity * scale) AS trx, 1.0 AS nrx, "
    f"floor(l_extendedprice) AS units FROM {sql.STAR}, (SELECT unnest([1.0, 0.5]) AS scale)",
)
def _(spark, sf):
    return feeds.parse_deliveries(bodies(spark, sf))


_BAD = "(CASE WHEN l_orderkey % 31 = 0 OR l_partkey % 97 = 0 THEN 2 ELSE 0 END)"


@query(
    "validate_records",
    f"SELECT l_orderkey, count(*) * 2 AS records, CAST(sum({_BAD}) AS BIGINT) AS bad_records, sum({_BAD}) = 0 AS accepted "
    "FROM lineitem GROUP BY 1",
)
def _(spark, sf):
    return feeds.batch_verdict(feeds.validate_records(bodies(spark, sf, number=False), "l_orderkey"), "l_orderkey")


@query(
    "read_stored_tables",
    sql.analytics(f"SELECT {sql.pick(sql.GOLD_TEXT, sql.GOLD_NUMBERS)} FROM gold", upto="gold"),
)
def _(spark, sf):
    root = fresh_path(spark, "store")
    facts = stage(st.facts(spark, sf), "facts")
    detected = stage(gold_from_clean(facts), "gold")
    sinks.write_table(facts, f"{root}/{sinks.CLEAN_TABLE}", weekly=False)
    sinks.write_table(detected, f"{root}/{sinks.GOLD_TABLE}")
    return load_or_compute(spark, root, lambda: {})["gold"].select(*detected.columns)


@query(
    "read_stored_tables_no_alerts",
    sql.analytics(f"SELECT {sql.pick(sql.ALERT_TEXT, sql.ALERT_NUMBERS)} FROM alerts WHERE alert_category <> 'NORMAL'"),
)
def _(spark, sf):
    """The store holds clean and gold rows but no alerts; they are worked out from gold."""
    root = fresh_path(spark, "store")
    facts = stage(st.facts(spark, sf), "facts")
    sinks.write_table(facts, f"{root}/{sinks.CLEAN_TABLE}", weekly=False)
    sinks.write_table(gold_from_clean(facts), f"{root}/{sinks.GOLD_TABLE}")
    return load_or_compute(spark, root, lambda: {})["active_alerts"].drop("executive_brief")


_RANGES = ("1996-W30", "1998-W01", "1999-W40", "2001-W10")


@query(
    "read_paged",
    sql.analytics(
        "SELECT year_week, clean_region, count(*) AS rows, sum(clean_trx) AS clean_trx FROM facts GROUP BY ALL", upto="brands"
    ),
)
def _(spark, sf):
    path = fresh_path(spark, "facts")
    sinks.write_table(st.facts(spark, sf), path)
    paged = feeds.read_key_ranges(lambda p: spark.read.parquet(path).filter(p), "year_week", _RANGES)
    return paged.groupBy("year_week", "clean_region").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("clean_trx").alias("clean_trx")
    )


@query(
    "restandardise",
    sql.over_feed(
        "SELECT raw_id, CASE WHEN lower(raw_region) = 'middleeast' THEN 'MIDDLE EAST' "
        f"ELSE {sql.title('raw_region')} END AS clean_region, CASE WHEN pd IS NULL THEN '1900-W01' ELSE {sql.label('pd')} END AS year_week FROM dated",
        "dated",
    ),
)
def _(spark, sf):
    from sharetide.operators.cleaning import derive_columns

    old = derive_columns(feed(spark, sf), S, st.FEED_ALIASES).select(
        "raw_id",
        F.col("raw_region").alias("clean_region"),
        F.when(F.col("iso_date").isNotNull(), F.concat("iso_date", F.lit(" 00:00:00"))).otherwise("?").alias("iso_date"),
        F.lit("1900-W01").alias("year_week"),
    )
    return feeds.restandardise(old, st.FEED_ALIASES).drop("iso_date")


_COUNTS = (
    "SELECT 'prescriptions_raw' AS table_name, (SELECT count(*) FROM feed) AS rows UNION ALL "
    "SELECT 'prescriptions_clean', (SELECT count(*) FROM cleaned) UNION ALL "
    "SELECT 'quarantine_records', (SELECT count(*) FROM processed WHERE is_quarantined) UNION ALL "
    "SELECT 'market_share_gold', (SELECT count(*) FROM gold) UNION ALL "
    "SELECT 'threshold_alerts', (SELECT count(*) FROM alerts WHERE alert_category <> 'NORMAL')"
)


def _run(spark, sf):
    return weekly_run(st.feed_parts(spark, sf), s=S, aliases=st.FEED_ALIASES, staged=True)


@query("write_layers", sql.cleaned_analytics(_COUNTS, "alerts"))
def _(spark, sf):
    stored = write_layers(_run(spark, sf), fresh_path(spark, "layers"), release=True)
    counted = None
    for name, df in stored.items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        counted = one if counted is None else counted.unionByName(one)
    return counted


@query("export_csv", sql.cleaned_analytics(_COUNTS, "alerts"))
def _(spark, sf):
    return sinks.export_csv(layer_pieces(_run(spark, sf), release=True), fresh_path(spark, "export"))


def _appended_twice(spark, rows, part):
    """Deliver ``rows`` in parts, and each part again as a sender does that got no answer: the store has them once."""
    store, rows = DeliveryStore(spark, fresh_path(spark, "deliveries")), stage(rows.withColumn("_part", part.cast("string")), "sent")
    for _ in range(2):
        for name in [r[0] for r in rows.select("_part").distinct().orderBy("_part").collect()]:
            store.append(rows.where(F.col("_part").eqNullSafe(F.lit(name))).drop("_part"), f"delivery-{name}")
    return store.read()


@query(
    "append_raw",
    sql.over_feed(
        "SELECT raw_id, coalesce(date, '') AS date_str, coalesce(TRY_CAST(week_number AS BIGINT), 1) AS week_number, coalesce(year, '') AS year_str, "
        "region, therapeutic_area, product, brand, coalesce(TRY_CAST(trx AS DOUBLE), 0.0) AS trx, coalesce(TRY_CAST(nrx AS DOUBLE), 0.0) AS nrx, "
        "coalesce(TRY_CAST(units AS DOUBLE), 0.0) AS units FROM feed",
        "feed",
    ),
)
def _(spark, sf):
    return _appended_twice(spark, sinks.raw_store_rows(feed(spark, sf)), F.pmod("raw_id", F.lit(3)))


@query(
    "append_clean",
    sql.over_feed(
        "SELECT raw_id, iso_date, year_week, clean_region, clean_therapeutic_area, clean_product, clean_brand, "
        "round(clean_trx, 2) AS clean_trx, round(clean_nrx, 2) AS clean_nrx, round(clean_units, 2) AS clean_units, "
        "coalesce(clean_trx < 0, false) AS is_negative_trx, false AS is_missing_flag, "
        "coalesce(clean_nrx > clean_trx AND clean_trx > 0, false) AS is_nrx_gt_trx_error FROM cleaned",
        "cleaned",
    ),
)
def _(spark, sf):
    valid = valid_rows(processed(spark, sf))
    valid = stage(valid.select(*[c for c in CLEAN_STORE.names if c in valid.columns]), "valid")  # read three times, worked out once
    return _appended_twice(spark, sinks.clean_store_rows(impute_group_median(valid)), F.left("year_week", F.lit(4)) < "1999")


_REPLACED = (
    "SELECT year_week, clean_region, clean_brand, clean_product, clean_trx FROM facts WHERE l_returnflag <> 'R' "
    "OR year_week BETWEEN '1999-W10' AND '1999-W20'"
)


def _delivery(facts):
    return facts.filter(F.col("year_week").between("1999-W10", "1999-W20"))


_COLUMNS = ("year_week", "clean_region", "clean_brand", "clean_product", "clean_trx")


@query("anti_replace_week", sql.analytics(_REPLACED, upto="brands"))
def _(spark, sf):
    facts = st.facts(spark, sf)
    existing = facts.filter(F.col("l_returnflag") != "R").select(*_COLUMNS)
    return sinks.replace_weeks(existing, _delivery(facts).select(*_COLUMNS))


@query("replace_week", sql.analytics(_REPLACED, upto="brands"))
def _(spark, sf):
    store, facts = WeekStore(spark, fresh_path(spark, "weeks")), stage(st.facts(spark, sf), "facts")
    store.replace(facts.filter(F.col("l_returnflag") != "R").select(*_COLUMNS))
    for _ in range(2):
        store.replace(_delivery(facts).select(*_COLUMNS))
    return store.read()


@query(
    "store_versions",
    sql.analytics(
        "SELECT 1 AS version, year_week, count(*) AS rows, sum(clean_trx) AS clean_trx FROM facts WHERE l_returnflag <> 'R' GROUP BY ALL UNION ALL "
        "SELECT 2, year_week, count(*), sum(clean_trx) FROM facts WHERE l_returnflag <> 'R' OR year_week BETWEEN '1999-W10' AND '1999-W20' GROUP BY ALL UNION ALL "
        "SELECT 3, year_week, count(*), sum(clean_trx) FROM facts WHERE (l_returnflag <> 'R' OR year_week BETWEEN '1999-W10' AND '1999-W20') "
        "AND year_week NOT IN ('1999-W12', '1999-W15') GROUP BY ALL",
        upto="brands",
    ),
)
def _(spark, sf):
    """All versions of a store by week stay readable: the first load, a delivery, and two weeks withdrawn."""
    store, facts = WeekStore(spark, fresh_path(spark, "versions")), stage(st.facts(spark, sf), "facts")
    store.replace(facts.filter(F.col("l_returnflag") != "R").select(*_COLUMNS))
    store.replace(_delivery(facts).select(*_COLUMNS))
    store.replace(facts.select(*_COLUMNS).limit(0), weeks=["1999-W12", "1999-W15"])
    counted = [
        store.read(n).groupBy("year_week").agg(F.count("*").alias("rows"), F.sum("clean_trx").alias("clean_trx")).withColumn("version", F.lit(n)) for n in store.numbers()
    ]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query(
    "union_feeds",
    sql.analytics(
        "SELECT year_week, clean_region, clean_brand, clean_product, clean_trx, NULL AS note FROM facts UNION ALL "
        "SELECT year_week, clean_region, clean_brand, clean_product, clean_trx, 'again' FROM facts WHERE year_week BETWEEN '1999-W10' AND '1999-W20'",
        upto="brands",
    ),
)
def _(spark, sf):
    facts = st.facts(spark, sf).select(*_COLUMNS)
    return facts.unionByName(_delivery(facts).withColumn("note", F.lit("again")), allowMissingColumns=True)


@query(
    "upsert_by_key",
    sql.analytics(
        "SELECT year_week, clean_region, clean_therapeutic_area, clean_brand, CASE WHEN year_week >= '2001-W01' THEN clean_units ELSE brand_trx END AS brand_trx "
        "FROM shares",
        upto="shares",
    ),
)
def _(spark, sf):
    shares = stage(share.market_share(st.facts(spark, sf)), "shares")
    keys = ("year_week", "clean_region", "clean_therapeutic_area", "clean_brand")
    stored = shares.select(*keys, "brand_trx").filter(F.col("year_week") < "2001-W20")
    incoming = shares.filter(F.col("year_week") >= "2001-W01").select(*keys, F.col("clean_units").alias("brand_trx"))
    return sinks.upsert_by_key(stored, incoming, keys)


@query(
    "ingest_summary",
    sql.over_feed(
        "SELECT 'SUCCESS' AS status, '2001-W44' AS year_week, count(*) AS raw_inserted, count_if(NOT is_quarantined) AS clean_inserted, "
        "count_if(is_quarantined) AS quarantined_records_count, 'COMPLETED_SUCCESSFULLY' AS run_status FROM processed"
    ),
)
def _(spark, sf):
    return sinks.ingest_summary(processed(spark, sf), "2001-W44")


@query(
    "run_summary",
    sql.analytics(
        "SELECT (SELECT count(*) FROM gold) AS total_gold_records, (SELECT count(*) FROM alerts WHERE alert_category <> 'NORMAL') AS active_alerts"
    ),
)
def _(spark, sf):
    detected = stage(gold_from_clean(st.facts(spark, sf)), "gold")
    return sinks.run_summary(detected, generate_alerts(detected)[1])


@query(
    "recompute_from_store",
    sql.analytics(f"SELECT {sql.pick(sql.GOLD_TEXT, sql.GOLD_NUMBERS)} FROM gold", upto="gold"),
)
def _(spark, sf):
    old = st.facts(spark, sf).withColumns(
        {"clean_region": F.lower("clean_region"), "iso_date": F.lit(None).cast("string")}
    )
    aliases = {r.lower(): r for r in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")}
    return recompute_from_store(old, aliases=aliases)["gold"]


@query(
    "end_to_end_gold",
    sql.cleaned_analytics(f"SELECT {sql.pick(sql.GOLD_TEXT, sql.GOLD_NUMBERS)} FROM gold"),
)
def _(spark, sf):
    return _run(spark, sf).gold


@query(
    "incremental_gold",
    sql.analytics(f"SELECT {sql.pick(sql.GOLD_TEXT, sql.GOLD_NUMBERS)} FROM gold", upto="gold"),
)
def _(spark, sf):
    """The store lacks the last weeks and holds an incomplete week of 1999; the delivery brings both."""
    facts = st.facts(spark, sf)
    late, redone = F.col("year_week") >= "2001-W40", F.col("year_week") == "1999-W15"
    known = facts.filter(~late & (~redone | (F.col("l_returnflag") != "R")))
    totals = stage(share.category_totals(known), "totals")
    from sharetide.operators.detectors import gold
    from sharetide.operators.shift import share_shifts

    stored_gold = stage(gold(share_shifts(share.shares_from_totals(totals))), "gold")
    return refresh(totals, stored_gold, facts.filter(late | redone)).gold
