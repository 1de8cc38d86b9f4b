"""The whole weekly run: feed -> clean and quarantine -> shares -> shifts -> gold -> alerts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sharetide.config import REGION_ALIASES, Settings
from sharetide.operators.alerts import generate_alerts
from sharetide.operators.cleaning import (
    fill_gaps_from,
    fill_values,
    quarantine_rows,
    stage_processed,
    valid_rows,
)
from sharetide.operators.detectors import gold
from sharetide.operators.quality import audit_counts, dq_report_long, dq_summary
from sharetide.operators.share import market_share, share_sum_check
from sharetide.operators.shift import share_shifts
from sharetide.schemas import enforced
from sharetide.session import SlicedTable, discard, slices_read, stage
from sharetide.sources.feeds import restandardise, table_or_none
from sharetide.sources.sinks import (
    ALERT_TABLE,
    CLEAN_ROWS,
    CLEAN_TABLE,
    GOLD_TABLE,
    QUARANTINE_TABLE,
    RAW_TABLE,
    write_table,
)


@dataclass(frozen=True)
class WeeklyRun:
    """Tables of one run; all are read from its staged feed."""

    raw: DataFrame
    processed: DataFrame
    cleaned: DataFrame
    quarantine: DataFrame
    audit: DataFrame
    dq_summary: DataFrame
    dq_report: DataFrame
    market_share: DataFrame
    sum_check: DataFrame
    share_shift: DataFrame
    gold: DataFrame
    all_alerts: DataFrame
    active_alerts: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def weekly_run(
    raw: DataFrame | Sequence[DataFrame],
    brands: Iterable[str] | None = None,
    s: Settings = Settings(),
    aliases: Mapping[str, str] = REGION_ALIASES,
    order: str = "raw_id",
    forest=None,
    staged: bool = False,
    slices: int | None = None,
) -> WeeklyRun:
    """Build every table of the run from a feed, or from the parts that make one up.

    The processed feed is written once, apart by verdict, and all tables are read from it: the
    feed is parsed and its duplicates found once.  With ``staged`` the cleaned rows and
    the gold table are written too; without, they are worked out whenever a table is asked for.
    A large feed is worked off in ``slices``, by default as many as its files call for.
    """
    parts = [raw] if isinstance(raw, DataFrame) else list(raw)
    feed_slices = stage_processed(parts, s, order, aliases, slices)
    processed = feed_slices.read()
    medians = stage(fill_values(valid_rows(processed), salts=s.salts), "group-medians")

    def filled(rows: DataFrame) -> DataFrame:
        return fill_gaps_from(medians, valid_rows(rows), order, salts=s.salts)

    if staged:
        kept = SlicedTable(processed.sparkSession, "cleaned")
        for rows in feed_slices.slices():
            kept.add(filled(rows))
        cleaned = kept.read()
    else:
        cleaned = filled(processed)
    summary = dq_summary(processed)
    shares = market_share(cleaned, brands, s, staged)
    shifts = share_shifts(shares)
    detected = gold(shifts, s, forest)
    if staged:
        detected = stage(detected, "gold")
    everything, active = generate_alerts(detected, s)
    return WeeklyRun(
        raw=processed.select(*parts[0].columns),
        processed=processed,
        cleaned=cleaned,
        quarantine=quarantine_rows(processed),
        audit=audit_counts(processed),
        dq_summary=summary,
        dq_report=dq_report_long(summary),
        market_share=shares,
        sum_check=share_sum_check(shares, s),
        share_shift=shifts,
        gold=detected,
        all_alerts=everything,
        active_alerts=active,
    )


def gold_from_clean(
    cleaned: DataFrame, brands: Iterable[str] | None = None, s: Settings = Settings(), forest=None
) -> DataFrame:
    return gold(share_shifts(market_share(cleaned, brands, s)), s, forest)


def layers(run: WeeklyRun) -> dict[str, DataFrame]:
    """The five stored tables by name."""
    return {
        RAW_TABLE: run.raw,
        CLEAN_TABLE: run.cleaned,
        QUARANTINE_TABLE: run.quarantine,
        GOLD_TABLE: run.gold,
        ALERT_TABLE: run.active_alerts,
    }


def layer_pieces(run: WeeklyRun, release: bool = False) -> Iterator[tuple[str, DataFrame]]:
    """The five stored tables by name, to be written one after the other; a name may come again with more rows.

    With ``release`` what is written takes the place of the run's staged rows: they are removed slice by slice, each when
    the next piece is asked for, and the run's own tables of rows can't be read afterwards.
    """
    if not release:
        yield from layers(run).items()
        return
    tables = layers(run)
    for name in (CLEAN_TABLE, GOLD_TABLE, ALERT_TABLE):
        yield name, tables[name]
    if set(run.cleaned.inputFiles()).isdisjoint(run.processed.inputFiles()):
        discard(run.cleaned)
    for rows in slices_read(run.processed):
        yield RAW_TABLE, rows.select(*run.raw.columns)
        yield QUARANTINE_TABLE, quarantine_rows(rows)
        discard(rows)


def write_layers(run: WeeklyRun, root: str, release: bool = False) -> dict[str, DataFrame]:
    """Replace the five stored tables under ``root`` and return them as stored.

    A layer with a wrong type is refused before anything is written, and a null key stops its writing.
    Quarantined rows may lack a week, and the raw feed has none, so only clean, gold and alerts
    are partitioned by week.  For ``release`` see :func:`layer_pieces`.
    """
    spark = run.raw.sparkSession
    tables, begun = {n: enforced(df, n) for n, df in layers(run).items()}, set()
    for name, df in layer_pieces(run, release):
        weekly = name in (CLEAN_TABLE, GOLD_TABLE, ALERT_TABLE)
        mode, rows = "append" if name in begun else "overwrite", CLEAN_ROWS if name == CLEAN_TABLE else None
        write_table(enforced(df, name), f"{root}/{name}", weekly, mode, rows)
        begun.add(name)
    return {n: spark.read.schema(df.schema).parquet(f"{root}/{n}").select(*df.columns) for n, df in tables.items()}


def load_or_compute(
    spark: SparkSession, root: str, compute, force: bool = False, s: Settings = Settings()
) -> dict[str, DataFrame]:
    """Stored clean, gold and alert tables if clean and gold exist and have rows; otherwise (or
    when forced) whatever ``compute()`` returns.  Alerts that are not stored are worked out from gold."""
    if not force:
        clean = table_or_none(spark, f"{root}/{CLEAN_TABLE}")
        detected = table_or_none(spark, f"{root}/{GOLD_TABLE}")
        if clean is not None and detected is not None:
            alerts = table_or_none(spark, f"{root}/{ALERT_TABLE}")
            if alerts is None:
                alerts = generate_alerts(detected, s)[1]
            return {"cleaned": clean, "gold": detected, "active_alerts": alerts}
    return compute()


def recompute_from_store(
    stored_clean: DataFrame,
    s: Settings = Settings(),
    aliases: Mapping[str, str] = REGION_ALIASES,
    forest=None,
) -> dict[str, DataFrame]:
    """Re-standardise stored clean rows and run the analytics on them."""
    clean = restandardise(stored_clean, aliases)
    numbers = {m: F.col(m).cast("double") for m in ("clean_trx", "clean_nrx", "clean_units")}
    clean = clean.withColumns(numbers)
    detected = gold_from_clean(clean, None, s, forest)
    return {"cleaned": clean, "gold": detected, "active_alerts": generate_alerts(detected, s)[1]}
