"""Reading feeds, deliveries and stored tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharetide.config import REGION_ALIASES
from sharetide.functions.dates import year_week
from sharetide.functions.numbers import PLAIN_NUMBER
from sharetide.functions.text import region_or_null, trimmed
from sharetide.schemas import DELIVERY, FEED, FEED_WITH_ID, LOOSE_DELIVERY, RECORD
from sharetide.session import path_exists, stage


def read_feed_csv(spark: SparkSession, path: str, with_id: bool = False) -> DataFrame:
    """CSV feed with a header, every field as text.

    Without a delivered ``raw_id`` one is made: rows are numbered from 0 by the file's modification
    time, its path and the row's place in it, which fixes which of two duplicates is first.
    """
    rows = (
        spark.read.schema(FEED_WITH_ID if with_id else FEED)
        .option("header", True)
        .option("enforceSchema", False)
        .csv(path)
    )
    return rows if with_id else with_ingest_order(rows)


def with_ingest_order(rows: DataFrame) -> DataFrame:
    """Add ``raw_id``, the place of a row in the order of its files.

    Spark may read the splits in any order, but numbers the rows of a split one after the other.  The
    scan is written once; a table of splits (one row each) then gives every split its first number.
    """
    split = [F.col(f"_metadata.{c}").alias(f"_{c}") for c in ("file_modification_time", "file_path", "file_block_start")]
    keys = ["_file_modification_time", "_file_path", "_file_block_start"]
    seen = stage(rows.select("*", *split, F.monotonically_increasing_id().alias("_at")), "ingest")
    splits = seen.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = seen.join(starts, keys).withColumn("raw_id", F.col("_start") + F.col("_at") - F.col("_first"))
    return numbered.select(*rows.columns, "raw_id")


def parse_deliveries(bodies: DataFrame, body: str = "body") -> DataFrame:
    """JSON bodies to one typed row per record; a body that does not parse yields no rows and
    is found by :func:`corrupt_deliveries`.

    Empty bodies leave by the position that they lack: for a plain explode Spark sets a filter before it, for which every
    body is parsed again.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    keep = [c for c in bodies.columns if c != body]
    return (
        bodies.withColumn("_d", F.from_json(F.col(body), DELIVERY, options))
        .select(*keep, "_d.year_week", "_d.source_vendor", F.posexplode_outer("_d.records").alias("_at", "_r"))
        .filter(F.col("_at").isNotNull())
        .select(*keep, "year_week", "source_vendor", "_r.*")
    )


def corrupt_deliveries(bodies: DataFrame, body: str = "body") -> DataFrame:
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    parsed = F.from_json(F.col(body), DELIVERY, options)
    return bodies.withColumn("_d", parsed).filter(F.col("_d._corrupt").isNotNull()).drop("_d")


def record_errors(record: str) -> Column:
    """Names of the fields of one loosely read record that are missing or of the wrong type."""
    checks = []
    for field in RECORD.fields:
        text = F.col(f"{record}.{field.name}")
        bad = text.isNull()
        if isinstance(field.dataType, T.LongType):
            bad = bad | ~trimmed(text).rlike(r"^[+-]?\d+(\.0*)?$")
        elif isinstance(field.dataType, T.DoubleType):
            bad = bad | ~trimmed(text).rlike(PLAIN_NUMBER) | trimmed(text).try_cast("double").isNull()
        checks.append(F.when(bad, F.array(F.lit(field.name))).otherwise(F.array().cast("array<string>")))
    return F.concat(*checks)  # compiled, which array_compact and the checks inside it would not be


def validate_records(bodies: DataFrame, batch: str, body: str = "body") -> DataFrame:
    """Every record of every batch with its ``errors``.

    A body that does not parse, or has no records, gives one row with the error ``body``; a missing
    ``year_week`` is an error of each record.
    """
    label = F.coalesce(F.trim("_week") == "", F.lit(True))
    errors = F.when(F.col("_r").isNull(), F.array(F.lit("body"))).otherwise(
        F.concat(F.when(label, F.array(F.lit("year_week"))).otherwise(F.array().cast("array<string>")), record_errors("_r"))
    )
    return (
        bodies.withColumn("_d", F.from_json(F.col(body), LOOSE_DELIVERY))
        .select(batch, F.col("_d.year_week").alias("_week"), F.explode_outer("_d.records").alias("_r"))
        .select(batch, "_r.*", errors.alias("errors"))
    )


def batch_verdict(validated: DataFrame, batch: str) -> DataFrame:
    """A batch is accepted only if all of its records are sound."""
    sound, no_record = F.size("errors") == 0, F.array_contains("errors", "body")
    return validated.groupBy(batch).agg(
        F.count_if(~no_record).alias("records"),
        F.count_if(~sound).alias("bad_records"),
        F.bool_and(sound).alias("accepted"),
    )


def accepted_records(bodies: DataFrame, batch: str, body: str = "body") -> DataFrame:
    """Records of the batches that pass whole."""
    checked = validate_records(bodies, batch, body)
    refused = checked.filter(F.size("errors") > 0).select(batch).distinct()
    return checked.join(refused, batch, "left_anti").drop("errors")


def read_key_ranges(
    read: Callable[[str], DataFrame] | DataFrame, key: str, bounds: Sequence[str]
) -> DataFrame:
    """A table read in key ranges ``(-inf, b0), [b0, b1), ... [bn, inf)`` and put together.

    Stable under concurrent inserts, unlike paging by row offset.  ``read`` is a table, or a
    function from a predicate to one (a remote store that filters on its own side).
    """
    if isinstance(read, DataFrame):  # one scan: only a source that answers each range alone gains by the ranges
        return read
    cuts = sorted(bounds)
    edges = [f"{key} < '{cuts[0]}' OR {key} IS NULL"] if cuts else ["true"]
    edges += [f"{key} >= '{a}' AND {key} < '{b}'" for a, b in zip(cuts, cuts[1:])]
    edges += [f"{key} >= '{cuts[-1]}'"] if cuts else []
    parts = [read(e) for e in edges]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def read_jdbc_ranges(
    spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, partitions: int, **options: str
) -> DataFrame:
    """The same for a database: Spark issues one ranged query per partition."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url, dbtable=table, partitionColumn=key, lowerBound=str(lower),
            upperBound=str(upper), numPartitions=str(partitions), **{"fetchsize": "2000", **options},
        )
        .load()
    )


def restandardise(stored: DataFrame, aliases: Mapping[str, str] = REGION_ALIASES) -> DataFrame:
    """Re-map regions and recompute the week label of rows cleaned by an older rule set.

    The stored label stays where the date cannot be read; a missing region stays missing.
    """
    text = F.left(trimmed(F.col("iso_date").cast("string")), F.lit(10))
    day = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))
    return stored.withColumns(
        {
            "clean_region": region_or_null(trimmed(F.col("clean_region")), aliases),
            "year_week": F.coalesce(year_week(day), F.col("year_week")),
        }
    )


def table_or_none(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame | None:
    """The Parquet table at ``path`` if it exists and has rows; any other trouble is an error."""
    if not path_exists(spark, path):
        return None
    stored = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return None if stored.isEmpty() else stored
