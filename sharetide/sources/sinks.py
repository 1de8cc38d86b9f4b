"""Writing layers, replacing weeks and upserting by key."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharetide.functions.numbers import flag
from sharetide.schemas import CLEAN_STORE, GOLD_KEYS, RAW_STORE, conform
from sharetide.session import FREED_SHUFFLES, setting

RAW_TABLE = "prescriptions_raw"
CLEAN_TABLE = "prescriptions_clean"
QUARANTINE_TABLE = "quarantine_records"
GOLD_TABLE = "market_share_gold"
ALERT_TABLE = "threshold_alerts"


def by_week(df: DataFrame, week: str = "year_week") -> DataFrame:
    """Bring the rows of a week together, so that a week is a few files and not one per task; Spark
    splits a week that is too big for one file."""
    return df.hint("rebalance", week)


# Stored tables hold long texts, such as the payload of a rejected row; this level takes no longer to write than the default.
STORED_AS = {"compression": "zstd", "parquet.compression.codec.zstd.level": "6"}
# Clean rows are brought together by week about so many at a time, as all of them would be shuffled at once else.
CLEAN_ROWS = 8_000_000


def _groups_of_weeks(df: DataFrame, rows: int, week: str = "year_week") -> list[list[str | None]]:
    """The weeks of the table in order, in groups of at most ``rows`` rows or of one week."""
    groups, held = [], rows
    for label, n in df.groupBy(week).count().orderBy(week).collect():
        if held + n > rows:
            groups.append([])
            held = 0
        groups[-1].append(label)
        held += n
    return groups


def write_table(df: DataFrame, path: str, weekly: bool = True, mode: str = "overwrite", rows: int | None = None) -> None:
    """Replace the table, partitioned by week unless told otherwise; with the mode ``append`` add to it.

    With ``rows`` a table by week is written some weeks at a time, about so many rows; the table is then read as often, so
    it should be a staged one.
    """
    parts = [df]
    if weekly and rows and len(groups := _groups_of_weeks(df, rows)) > 1:
        week = F.col("year_week")
        parts = [df.filter(week.isin([w for w in g if w is not None]) | (week.isNull() if None in g else F.lit(False))) for g in groups]
    with setting(df.sparkSession, *FREED_SHUFFLES):
        for n, part in enumerate(parts):
            writer = by_week(part).write.partitionBy("year_week") if weekly else part.write
            writer.mode("append" if n else mode).options(**STORED_AS).parquet(path)


# A file of CSV whose fields may hold line breaks can't be split for reading: it has at most so many rows.
CSV_FILE_ROWS = 200_000


def export_csv(
    tables: Mapping[str, DataFrame] | Iterable[tuple[str, DataFrame]], root: str, file_rows: int = CSV_FILE_ROWS
) -> DataFrame:
    """One CSV directory per table, and a (table, row count) summary read from what was written.

    A file has at most ``file_rows`` rows, so no task that reads the export has more than that at once.  Tables given as
    (name, rows) may come in several pieces; each is asked for when the one before is written.
    """
    summary, written = None, {}
    for name, df in tables.items() if isinstance(tables, Mapping) else tables:
        spark = df.sparkSession
        flat = df.select(
            *[
                F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else f.name
                for f in df.schema.fields
            ]
        )
        writer = flat.write.mode("append" if name in written else "overwrite").option("header", True).option("escape", '"')
        with setting(spark, *FREED_SHUFFLES):
            writer.option("maxRecordsPerFile", file_rows).csv(f"{root}/{name}.csv")
        written[name] = spark
    for name, spark in written.items():
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{root}/{name}.csv")
        counted = rows.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        summary = counted if summary is None else summary.unionByName(counted)
    return summary


def raw_store_rows(records: DataFrame) -> DataFrame:
    """Delivered records in the raw store's columns, with defaults for what is absent.

    Accepts ``date`` or ``date_str`` and ``year`` or ``year_str``.
    """

    def first_of(*names: str, default: object) -> Column:
        present = [F.col(n) for n in names if n in records.columns]
        return F.coalesce(*present, F.lit(default)) if present else F.lit(default)

    def number(name: str) -> Column:
        return F.coalesce(first_of(name, default=None).try_cast("double"), F.lit(0.0))

    text = {n: first_of(n, default="") for n in ("region", "therapeutic_area", "product", "brand")}
    shaped = records.select(
        (F.col("raw_id") if "raw_id" in records.columns else F.lit(None)).alias("raw_id"),
        first_of("date", "date_str", default="").alias("date_str"),
        F.coalesce(first_of("week_number", default=None).try_cast("bigint"), F.lit(1)).alias("week_number"),
        first_of("year", "year_str", default="").cast("string").alias("year_str"),
        *[c.alias(n) for n, c in text.items()],
        *[number(n).alias(n) for n in ("trx", "nrx", "units")],
    )
    return conform(shaped, RAW_STORE)


def clean_store_rows(cleaned: DataFrame) -> DataFrame:
    """Cleaned rows in the clean store's columns; the nrx flag keeps its ``trx > 0`` guard."""
    trx, nrx = F.col("clean_trx"), F.col("clean_nrx")
    shaped = cleaned.withColumns(
        {
            "iso_date": F.col("iso_date").cast("date"),
            "is_negative_trx": flag(trx < 0),
            "is_missing_flag": F.lit(False),
            "is_nrx_gt_trx_error": flag((nrx > trx) & (trx > 0)),
        }
    )
    return conform(shaped, CLEAN_STORE)


def replace_weeks(existing: DataFrame, delivered: DataFrame, week: str = "year_week") -> DataFrame:
    """``existing`` without the delivered weeks, plus the delivery."""
    weeks = delivered.select(week).distinct()
    return existing.join(weeks, week, "left_anti").unionByName(delivered, allowMissingColumns=True)


def overwrite_weeks(delivered: DataFrame, path: str) -> None:
    """Replace only the delivered weeks of a stored table: other partitions are not touched,
    and repeating the call changes nothing."""
    (
        by_week(delivered)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year_week")
        .parquet(path)
    )


def upsert_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = GOLD_KEYS) -> DataFrame:
    """Incoming rows win over stored rows of the same natural key."""
    return existing.join(incoming.select(*keys).distinct(), list(keys), "left_anti").unionByName(
        incoming, allowMissingColumns=True
    )


def latest_by_key(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Keep the newest row of each key; the rank limit runs before the shuffle as well."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(version))
    return rows.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") == 1).drop("_r")


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 500, **options: str) -> None:
    """Append to a database table in batches of ``batch`` rows per task."""
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode("append").save()


def ingest_summary(processed: DataFrame, label: str | None = None) -> DataFrame:
    """Counts reported back after a delivery."""
    return processed.agg(
        F.count(F.lit(1)).alias("raw_inserted"),
        F.count_if(~F.col("is_quarantined")).alias("clean_inserted"),
        F.count_if(F.col("is_quarantined")).alias("quarantined_records_count"),
    ).select(
        F.lit("SUCCESS").alias("status"),
        F.lit(label).cast("string").alias("year_week"),
        "raw_inserted",
        "clean_inserted",
        "quarantined_records_count",
        F.lit("COMPLETED_SUCCESSFULLY").alias("run_status"),
    )


def run_summary(gold: DataFrame, active_alerts: DataFrame) -> DataFrame:
    counted = gold.select(F.lit(1).alias("g"), F.lit(0).alias("a")).unionByName(
        active_alerts.select(F.lit(0).alias("g"), F.lit(1).alias("a"))
    )
    return counted.agg(
        F.coalesce(F.sum("g"), F.lit(0)).alias("total_gold_records"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("active_alerts"),
    )
