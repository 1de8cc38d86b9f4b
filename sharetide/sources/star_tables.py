"""The given star-schema tables seen as market-share facts and as a dirty weekly feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.functions.dates import iso_week, iso_year, running_week, year_week
from sharetide.session import slice_count, slice_of, spread

EPOCH_YEAR = 1995
FEED_ALIASES = {"middleeast": "MIDDLE EAST"}
COMPETITIVE_SET = ("ECONOMY", "SMALL", "PROMO")


# The given tables' columns, so that no file is opened just to learn its schema.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_returnflag", "l_shipdate",
    )
    return table(spark, sf_dir, "lineitem").select(*used)


def _region_of_order(spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """(o_orderkey, r_name) of all orders or of those given.  Only nation and region, of fixed size, are hinted as broadcast."""
    places = (
        table(spark, sf_dir, "nation")
        .join(F.broadcast(table(spark, sf_dir, "region")), F.expr("n_regionkey = r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    customers = (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(places), F.expr("c_nationkey = n_nationkey"))
        .select("c_custkey", "r_name")
    )
    orders = table(spark, sf_dir, "orders") if orders is None else orders
    return (
        orders.select("o_orderkey", "o_custkey")
        .join(customers, F.expr("o_custkey = c_custkey"))
        .select("o_orderkey", "r_name")
    )


def attach_dimensions(lines: DataFrame, spark: SparkSession, sf_dir: str, orders: DataFrame | None = None) -> DataFrame:
    """Join line items (batch or stream) to product and region; ``orders`` may be just those of the line items."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return lines.join(parts, F.expr("l_partkey = p_partkey")).join(
        _region_of_order(spark, sf_dir, orders), F.expr("l_orderkey = o_orderkey")
    )


def category_of_type() -> Column:
    t = F.col("p_type")
    return (
        F.when(t.isin("ECONOMY", "SMALL"), "A").when(t.isin("MEDIUM", "LARGE"), "B").otherwise("C")
    )


def facts_of(lines: DataFrame, brand: str = "p_type", category: str | None = None, chargebacks: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    quantity = F.col("l_quantity")
    if chargebacks:
        quantity = F.when(F.col("l_orderkey") % 61 == 0, -quantity).otherwise(quantity)
    day = F.col("l_shipdate").cast("date")
    return lines.select(
        year_week(day).alias("year_week"),
        F.col("r_name").alias("clean_region"),
        F.col(brand).alias("clean_brand"),
        (F.col(category) if category else category_of_type()).alias("clean_therapeutic_area"),
        F.col("p_name").alias("clean_product"),
        quantity.alias("clean_trx"),
        F.when(F.col("l_returnflag") == "N", quantity).otherwise(F.lit(0.0)).alias("clean_nrx"),
        F.floor("l_extendedprice").cast("double").alias("clean_units"),
        F.col("l_returnflag"),
        *keep,
    )


def facts(spark: SparkSession, sf_dir: str, **kind) -> DataFrame:
    """Clean facts.  ``brand='p_brand'`` gives sparse series; with ``category='p_type'`` every
    brand has several categories; ``chargebacks`` flips the sign of some orders."""
    return facts_of(attach_dimensions(line_items(spark, sf_dir), spark, sf_dir), **kind)


def row_id() -> Column:
    """Unique row number made from the row itself, so no global ordering is needed and a
    stream gives a row the same number as a batch."""
    identity = F.concat_ws(
        "|",
        F.col("l_orderkey"),
        F.col("l_linenumber"),
        F.col("l_partkey"),
        F.col("l_suppkey"),
        F.date_format(F.col("l_shipdate").cast("date"), "yyyy-MM-dd"),
    )
    return F.conv(F.substring(F.md5(identity), 1, 15), 16, 10).cast("bigint")


def feed_of(lines: DataFrame) -> DataFrame:
    """A dirty feed row per line item: eight date shapes, wrong hints, missing labels, aliases,
    chargebacks, impossible new volumes and thousands separators."""
    n = F.col("raw_id")
    day = F.col("l_shipdate").cast("date")
    q = F.col("l_quantity").cast("int")
    units = F.floor("l_extendedprice").cast("bigint")

    def every(k: int) -> Column:
        return n % k == 0

    shape = n % 10
    date = (
        F.when(n % 100 == 99, "not-a-date")
        .when(shape <= 3, F.date_format(day, "yyyy-MM-dd"))
        .when(shape == 4, F.date_format(day, "yyyy/MM/dd"))
        .when(shape == 5, F.date_format(day, "dd-MMM-yyyy"))
        .when(shape == 6, F.date_format(day, "MMM dd, yyyy"))
        .when(shape == 7, F.date_format(day, "MM/dd/yyyy"))
        .when(shape == 8, F.date_format(day, "dd/MM/yyyy"))
        .otherwise(F.date_format(day, "dd-MM-yyyy"))
    )
    hint = (
        F.when(every(41), F.lit(None))
        .when(every(43), "wk")
        .when(every(37), (iso_week(day, False) + 9).cast("string"))
        .when(every(2), iso_week(day, False).cast("string"))
        .otherwise(running_week(day, EPOCH_YEAR).cast("string"))
    )
    region = (
        F.when(every(53), "nan")
        .when((F.col("r_name") == "MIDDLE EAST") & every(5), "middleeast")
        .when(every(3), F.lower("r_name"))
        .when(every(7), F.concat(F.lit("  "), F.col("r_name"), F.lit(" ")))
        .otherwise(F.col("r_name"))
    )
    trx = F.when(every(67), "").when(every(61), (-q).cast("string")).otherwise(q.cast("string"))
    nrx = (
        F.when(every(71), (q + 5).cast("string"))
        .when(F.col("l_returnflag") == "N", q.cast("string"))
        .otherwise(F.floor(q / 2).cast("string"))
    )
    return lines.withColumn("raw_id", row_id()).select(
        "raw_id",
        date.alias("date"),
        hint.alias("week_number"),
        iso_year(day).cast("string").alias("year"),
        region.alias("region"),
        category_of_type().alias("therapeutic_area"),
        F.col("p_name").alias("product"),
        F.when(every(59), "").otherwise(F.col("p_type")).alias("brand"),
        trx.alias("trx"),
        nrx.alias("nrx"),
        F.when(every(5), F.format_number(units, 0)).otherwise(units.cast("string")).alias("units"),
    )


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line items as a feed, spread evenly ahead of the parsing, which is what costs.

    They are dealt out by order; where orders are joined by a shuffle, the rows lie so already and Spark leaves it out.
    """
    return feed_of(spread(attach_dimensions(line_items(spark, sf_dir), spark, sf_dir), "l_orderkey"))


# The line items are shuffled twice on their way into the feed; so many parts at most, as each part reads the tables again.
MOST_PARTS = 4


def feed_parts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """The feed in parts, dealt by order, so that the line items of one part are shuffled at a time; a small feed is one part."""
    lines, orders = line_items(spark, sf_dir), table(spark, sf_dir, "orders")
    n = min(MOST_PARTS, slice_count(lines))
    if n == 1:
        return [feed(spark, sf_dir)]

    def part(i: int) -> DataFrame:
        own = lines.filter(slice_of(n, "l_orderkey") == i)
        return feed_of(spread(attach_dimensions(own, spark, sf_dir, orders.filter(slice_of(n, "o_orderkey") == i)), "l_orderkey"))

    return [part(i) for i in range(n)]


def event_facts(events: DataFrame) -> DataFrame:
    """Site events as facts: region from the user, brand from the event type."""
    return events.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat(F.lit("R"), (F.col("user_id") % 5).cast("string")).alias("clean_region"),
        F.col("event_type").alias("clean_brand"),
        F.col("value").alias("clean_trx"),
    )
