"""Weekly deliveries as a stream: clean, route, dedupe, total and alert per micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sharetide.config import Settings
from sharetide.operators.alerts import generate_alerts
from sharetide.operators.cleaning import DUPLICATE_KEYS, storage_clean
from sharetide.operators.detectors import gold as detect
from sharetide.operators.share import BRAND_KEYS, category_totals, shares_from_totals
from sharetide.operators.shift import share_shifts
from sharetide.plans.incremental import refresh
from sharetide.schemas import FEED_WITH_ID, MEASURES
from sharetide.session import path_exists, setting, stage
from sharetide.sources.versioned import NO_WEEK, Manifest, WeekStore

TOTALS, GOLD, ALERTS = "category_totals", "gold", "alerts"
STREAM = "stream"  # under this name the stores note the batches taken in


def stream_feed(
    spark: SparkSession,
    path: str,
    schema: T.StructType = FEED_WITH_ID,
    fmt: str = "csv",
    files_per_batch: int | None = None,
    **options: str,
) -> DataFrame:
    """New files of a directory as they arrive."""
    reader = spark.readStream.schema(schema).format(fmt).options(**options)
    if fmt == "csv":
        reader = reader.option("header", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def run_batches(
    stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]
) -> StreamingQuery:
    """Apply ``step`` to every micro-batch available now."""
    return (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def batch_path(root: str, name: str, batch_id: int) -> str:
    return f"{root}/{name}/batch_id={batch_id}"


def write_batch(df: DataFrame, root: str, name: str, batch_id: int, *partition_by: str) -> None:
    """Write one batch's output under its own number; a replay overwrites the same folder."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(batch_path(root, name, batch_id))


def route(stream: DataFrame, root: str, order: str = "raw_id") -> StreamingQuery:
    """Stateless storage-profile cleaning with clean rows and quarantine written separately."""

    def step(batch: DataFrame, batch_id: int) -> None:
        done = storage_clean(batch, order).persist()
        good = F.col("rejection_reason").isNull()
        write_batch(done.filter(good).drop("rejection_reason", "raw_payload"), root, "clean", batch_id)
        write_batch(
            done.filter(~good).select(order, "rejection_reason", "raw_payload"), root, "quarantine", batch_id
        )
        done.unpersist()

    return run_batches(stream, f"{root}/_checkpoint", step)


def read_output(spark: SparkSession, root: str, name: str, schema: T.StructType | None = None) -> DataFrame | None:
    if not path_exists(spark, f"{root}/{name}"):
        return None
    return (spark.read.schema(schema) if schema else spark.read).parquet(f"{root}/{name}")


# Keyed state on disk, so it may outgrow the memory; holds for queries started while it is set.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Counting the keys of the state would look each one up again at its writing.
NO_KEY_COUNT = ("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
# A stateful stream is planned without measured sizes: sides whose partitions are estimated below the broadcast limit are hashed, not sorted.
HASHED_JOINS = ("spark.sql.join.preferSortMergeJoin", "false")


def first_arrivals(stream: DataFrame, keys: Sequence[str], order: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """A running aggregate by key (null keys are equal): when the key came first and last, and its least row.

    A row comes with its micro-batch, whose time Spark logs, so a replay gives it the same.  Where a key came first and last in
    one batch, all its rows are of that batch and the least by ``order`` is the first; a null is least.  Only keys and ``carried``
    are kept as state, combined before they are shuffled; a single column beside the keys is compared as it is, so rows are
    hashed and not sorted.
    """
    rows, kept = stream.withColumn("_arrival", F.current_timestamp()), [*order, *carried]
    least = F.col(kept[0]) if len(kept) == 1 else F.struct(*kept)
    return rows.groupBy(*keys).agg(
        F.min("_arrival").alias("_first"), F.max("_arrival").alias("_last"), F.min(least).alias("_least"), F.max(least.isNull()).alias("_absent")
    )


def dedupe_stream(
    stream: DataFrame,
    root: str,
    keys: Sequence[str] = DUPLICATE_KEYS,
    order: Sequence[str] = ("raw_id",),
) -> StreamingQuery:
    """Of rows with equal keys keep the one that arrived first, in this or in any earlier delivery, without a time limit.

    Rows of one micro-batch are taken in ``order``.  The state by key lives with the checkpoint: a batch costs as much as it
    brings, whatever was stored before.  New rows go to the batch's own folder, which a replay overwrites with the
    same rows.  Columns outside ``keys`` and ``order`` are carried along and must be comparable.
    """
    spark, columns = stream.sparkSession, stream.columns
    if path_exists(spark, f"{root}/rows") and not path_exists(spark, f"{root}/_checkpoint"):
        raise RuntimeError(f"{root} holds rows but no checkpoint: what has arrived before is no longer known")
    carried = [c for c in columns if c not in (*keys, *order)]
    seen = first_arrivals(stream, keys, order, carried)

    least = F.when(~F.col("_absent"), F.col("_least"))

    def step(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter(F.col("_first") == F.col("_last"))
        write_batch(new.select(*[c if c in keys else (least if [c] == [*order, *carried] else F.col("_least")[c]).alias(c) for c in columns]), root, "rows", batch_id)

    with setting(spark, *ROCKSDB), setting(spark, *NO_KEY_COUNT), setting(spark, *HASHED_JOINS):
        return (
            seen.writeStream.outputMode("update")
            .foreachBatch(step)
            .option("checkpointLocation", f"{root}/_checkpoint")
            .trigger(availableNow=True)
            .start()
        )


def dedupe_within(stream: DataFrame, keys: Sequence[str], event_time: str, delay: str) -> DataFrame:
    """Bounded variant: state is dropped once the watermark passes."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def week_totals(events: DataFrame, event_time: str = "ts", watermark: str | None = None) -> DataFrame:
    """Totals per Monday week, region and brand, on a stream or a batch.

    Spark counts weeks from a Thursday, hence the four-day start.  No watermark by default, so
    no late row is dropped.
    """
    if watermark:
        events = events.withWatermark(event_time, watermark)
    return (
        events.groupBy(
            F.window(event_time, "1 week", "1 week", "4 days").alias("w"), "clean_region", "clean_brand"
        )
        .agg(F.sum("clean_trx").alias("brand_trx"), F.count(F.lit(1)).alias("rows"))
        .select(
            F.date_format("w.start", "yyyy-MM-dd").alias("week_start"),
            "clean_region",
            "clean_brand",
            "brand_trx",
            "rows",
        )
    )


def update_gold(
    stream: DataFrame,
    root: str,
    to_facts: Callable[[DataFrame], DataFrame],
    s: Settings = Settings(),
    forest=None,
    delivery: str | None = None,
) -> StreamingQuery:
    """Keep category totals, gold and alerts current, one micro-batch at a time.

    Each table is a store by week: a batch writes the weeks it changes and publishes them with its number, so a replay changes
    nothing and readers never see a half-written table.  A batch that failed between two tables goes on from the
    versions before it.

    A batch replaces the weeks that it holds.  Batches are cut by files, so name the facts' column that tells
    ``delivery`` from delivery wherever a week may come in several files: a part of the
    delivery that is already stored is added to it, another delivery replaces it.  Within a batch the
    greatest delivery of a week counts.  ``forest`` is None or a fitted model.
    """
    if isinstance(forest, str):
        raise ValueError("a stream needs a fitted forest: fit it on stored rows first")

    def step(batch: DataFrame, batch_id: int) -> None:
        totals, gold, alerts = (WeekStore(batch.sparkSession, f"{root}/{n}") for n in (TOTALS, GOLD, ALERTS))
        base = totals.before(STREAM, batch_id)
        known, known_gold = totals.rows(base), gold.rows(gold.before(STREAM, batch_id))
        facts, newest = to_facts(batch), {}
        if delivery:
            facts = stage(facts.select(*dict.fromkeys([*BRAND_KEYS, "clean_therapeutic_area", *MEASURES, delivery])), "batch-facts")
            newest = _newest_deliveries(facts, delivery)
            facts = _one_delivery(facts, delivery, newest, known, base)
        if known is None:
            changed, weeks = stage(category_totals(facts), "totals"), None
            rows = detect(share_shifts(shares_from_totals(changed, s.on_multi)), s, forest)
        else:
            done = refresh(known, known_gold, facts, s, forest)
            changed, weeks = done.delivered, done.weeks()
            rows = done.gold.where(F.col("year_week").isin(weeks))
        totals.replace(changed, source=STREAM, token=batch_id, facts=newest)
        gold.replace(rows, weeks, STREAM, batch_id)
        alerts.replace(generate_alerts(gold.read(weeks=weeks), s)[1], weeks, STREAM, batch_id)

    return run_batches(stream, f"{root}/_checkpoint", step)


def _newest_deliveries(facts: DataFrame, delivery: str) -> dict[str, dict[str, object]]:
    """The greatest delivery of each week of a batch; as many entries as weeks."""
    newest = facts.filter(F.col("year_week").isNotNull()).groupBy("year_week").agg(F.max(delivery).alias("delivery"))
    return {r[0]: {"delivery": r[1]} for r in newest.collect()}


def _one_delivery(facts: DataFrame, delivery: str, newest: dict, stored: DataFrame | None, base: Manifest) -> DataFrame:
    """The newest delivery of each week of the batch, with the totals that are stored of the same delivery."""
    columns = [*BRAND_KEYS, "clean_therapeutic_area", *MEASURES]
    if not newest:
        return facts.select(*columns).limit(0)
    chosen = facts.sparkSession.createDataFrame([(w, f["delivery"]) for w, f in newest.items()], ["year_week", "_newest"])
    own = facts.join(chosen, "year_week").filter(F.col(delivery) == F.col("_newest")).select(*columns)
    again = [w for w, f in newest.items() if dict(base.facts.get(w, {})) == f]
    if stored is None or not again:
        return own
    return own.unionByName(stored.where(F.col("year_week").isin(again)).select(*columns))


def stored(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The newest version of a table that a stream keeps; None before its first batch."""
    return WeekStore(spark, f"{root}/{name}").read()


def replace_delivered_weeks(stream: DataFrame, root: str, name: str = "facts", delivery: str | None = None, whole: bool = False) -> StreamingQuery:
    """Each micro-batch replaces the weeks it contains in a store by week, and writes no others.

    Batches are cut by files, so name the column that tells ``delivery`` from delivery wherever a week may come in
    several files: a part of the delivery that is stored is added to the week, another delivery replaces it.
    Within a batch the greatest delivery of a week counts.  Without that column a batch that brings a stored week is refused,
    as its rows may be the rest of the week or all of it; ``whole`` says that batches hold whole weeks.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        store = WeekStore(batch.sparkSession, f"{root}/{name}")
        base = store.before(STREAM, batch_id)
        if delivery:  # the batch is read twice, and its joins are worked out once; the rows themselves are written by the store alone
            batch = _with_stored_parts(stage(batch, "batch-rows"), store.rows(base), delivery)
        elif not whole:
            batch = stage(batch, "weeks")
            there = {r[0] for r in batch.select(F.coalesce("year_week", F.lit(NO_WEEK))).distinct().collect()} & base.folders.keys()
            if there:
                raise ValueError(f"stored weeks come again and no delivery column tells what they replace: {sorted(there)[:5]}")
        store.replace(batch, source=STREAM, token=batch_id)

    return run_batches(stream, f"{root}/_checkpoint", step)


def _with_stored_parts(batch: DataFrame, stored: DataFrame | None, delivery: str) -> DataFrame:
    """The newest delivery of each week of the batch, with what is stored of the same delivery."""
    newest = batch.groupBy(F.col("year_week").alias("_week")).agg(F.max(delivery).alias("_newest"))
    same = F.col("year_week").eqNullSafe(F.col("_week")) & F.col(delivery).eqNullSafe(F.col("_newest"))
    own = batch.join(newest, same, "left_semi")
    return own if stored is None else own.unionByName(stored.join(newest, same, "left_semi"))
