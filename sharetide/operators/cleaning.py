"""Cleaning of the raw feed: typed columns, quality flags, duplicates, quarantine, imputation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sharetide.config import REGION_ALIASES, UNKNOWN, Settings
from sharetide.functions.dates import (
    add_feed_date,
    numeric_date_readings,
    parse_date_multi,
    year_week,
)
from sharetide.functions.numbers import flag, parse_number, parse_number_lenient
from sharetide.functions.text import clean_string, normalise_label, normalise_region, trimmed
from sharetide.operators.selection import covers, ranked
from sharetide.schemas import FEED_FIELDS, MEASURES, SERIES_KEYS, require
from sharetide.session import SlicedTable, discard, slice_count, stage

DUPLICATE_KEYS = ("iso_date", "clean_region", "clean_therapeutic_area", "clean_product", "clean_brand")
# Brand spellings that count as unknown, and the reason codes in their order.
UNKNOWN_BRANDS = ("Unknown", "Nan", "nan", "")
REASONS = (
    "INVALID_DATE",
    "MISSING_CATEGORICAL_FIELD",
    "UNKNOWN_REGION",
    "UNKNOWN_BRAND",
    "NRX_GREATER_THAN_TRX",
    "DUPLICATE_RECORD",
    "WEEK_DATE_MISMATCH",
)
FALLBACK_REASON = "DATA_QUALITY_ERROR"
REASON_SEPARATOR = " | "


def derive_columns(
    raw: DataFrame, s: Settings = Settings(), aliases: Mapping[str, str] = REGION_ALIASES
) -> DataFrame:
    """Everything that depends on one row only: a single projection, no shuffle."""
    require(raw, *FEED_FIELDS)
    labels = {"region": "region", "therapeutic_area": "ta", "product": "product", "brand": "brand"}
    numbers = ("trx", "nrx", "units")
    texts = {f"raw_{short}": clean_string(F.col(c)) for c, short in labels.items()}
    texts |= {f"_{m}": clean_string(F.col(m)) for m in numbers}
    cleaned = {"clean_region": normalise_region(F.col("raw_region"), aliases)}
    cleaned |= {
        f"clean_{c}": normalise_label(F.col(f"raw_{short}"))
        for c, short in labels.items()
        if c != "region"
    }
    cleaned |= {f"clean_{m}": parse_number(F.col(f"_{m}")) for m in numbers}
    return (
        add_feed_date(
            raw.withColumns(texts).withColumns(cleaned),
            epoch_year=s.epoch_year,
            clamp53=s.clamp53,
            strict_hint=s.strict_hint,
        )
        .withColumns(quality_flags())
        .drop(*[f"_{m}" for m in numbers])
    )


def quality_flags() -> dict[str, Column]:
    trx, nrx, units = (F.col(m) for m in MEASURES)
    missing = [F.col(c).isNull() for c in ("raw_region", "raw_ta", "raw_product", "raw_brand")]
    return {
        "is_missing_categorical": missing[0] | missing[1] | missing[2] | missing[3],
        "is_negative_trx": flag(trx < 0),
        "is_missing_numeric": trx.isNull() | nrx.isNull() | units.isNull(),
        "is_nrx_gt_trx_error": flag((nrx > trx) & (trx > 0)),
    }


def _same_key(keys: Sequence[str]) -> list[Column]:
    """The columns of a key in the form in which keys are compared; NULL is a value like others."""
    return [F.coalesce(F.col(k).cast("string"), F.lit("\x00")) for k in keys]


def mark_duplicates(
    df: DataFrame,
    order: str = "raw_id",
    keys: Sequence[str] = DUPLICATE_KEYS,
    salts: int = 32,
    among: Column | None = None,
    materialise: bool = False,
) -> DataFrame:
    """Add ``is_duplicate``: true for all but the first row (by ``order``) of each key.

    NULL keys count as equal.  ``order`` must be a unique number.  The first row per key comes
    from one hash aggregation, which collapses hot keys on the map side; only keys seen more
    than once come back to the rows.  That way back is joined on (key, salt), with each key
    present for just the salts its rows carry, so a key holding a third of the table is spread
    over ``salts`` tasks.  ``among`` restricts which rows can count as first or duplicate.
    ``materialise`` writes the repeated keys out first: when they are few, the planner then
    sees a small table and broadcasts it, and the rows are not shuffled at all.
    """
    if not 1 <= salts <= 63:
        raise ValueError("salts must lie in 1..63")
    names = [f"_key{i}" for i in range(len(keys))]
    key_columns = dict(zip(names, _same_key(keys)))
    salt = F.pmod(F.xxhash64(F.col(order)), F.lit(salts)).cast("int")
    keyed = df.withColumns({**key_columns, "_salt": salt})
    counted = keyed if among is None else keyed.filter(among)
    repeated = (
        counted.groupBy(*names)
        .agg(
            F.min(order).alias("_first"),
            F.count(F.lit(1)).alias("_copies"),
            F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_salt"))).alias("_mask"),
        )
        .filter(F.col("_copies") > 1)
    )
    has_salt = F.filter(
        F.sequence(F.lit(0), F.lit(salts - 1)),
        lambda i: F.call_function("getbit", F.col("_mask"), i) == 1,
    )
    first_rows = repeated.select(*names, F.explode(has_salt).alias("_salt"), "_first")
    if materialise:
        first_rows = stage(first_rows, "repeated-keys")
    later = F.col(order) > F.col("_first")
    if among is not None:
        later = later & among
    return (
        keyed.join(first_rows, [*names, "_salt"], "left")
        .withColumn("is_duplicate", flag(later))
        .drop(*names, "_salt", "_first")
    )


def rejection_conditions(with_duplicates: bool = True) -> list[Column]:
    duplicate = F.col("is_duplicate") if with_duplicates else F.lit(False)
    return [
        F.col("parsed_date").isNull(),
        F.col("is_missing_categorical"),
        F.col("clean_region") == UNKNOWN,
        F.col("clean_brand").isin(*UNKNOWN_BRANDS),
        F.col("is_nrx_gt_trx_error"),
        duplicate,
        F.col("is_week_mismatch"),
    ]


def _any(conditions: Sequence[Column]) -> Column:
    result = F.lit(False)
    for c in conditions:
        result = result | c
    return result


def assign_reasons(df: DataFrame) -> DataFrame:
    """Add ``is_quarantined``, ``rejection_reasons`` (array) and ``rejection_reason`` (text)."""
    conditions = rejection_conditions()
    none = F.array().cast("array<string>")
    hits = F.concat(*[F.when(c, F.array(F.lit(r))).otherwise(none) for c, r in zip(conditions, REASONS)])
    text = F.coalesce(
        F.nullif(F.array_join(F.col("rejection_reasons"), REASON_SEPARATOR), F.lit("")),
        F.lit(FALLBACK_REASON),
    )
    return (
        df.withColumn("is_quarantined", _any(conditions))
        .withColumn("rejection_reasons", F.when(F.col("is_quarantined"), hits))
        .withColumn("rejection_reason", F.when(F.col("is_quarantined"), text))
    )


def process_feed(
    raw: DataFrame,
    s: Settings = Settings(),
    order: str = "raw_id",
    aliases: Mapping[str, str] = REGION_ALIASES,
    materialise: bool = False,
) -> DataFrame:
    """All rows of the feed with derived columns, flags, duplicates and rejection reasons.

    ``Settings.dedupe = 'after_validation'`` looks for duplicates only among rows that pass
    every other rule, so a good second copy of a bad row is kept.

    Finding duplicates reads the derived keys before the rows themselves are read.
    ``materialise`` writes the derived rows once, so that the parsing is not done twice.
    """
    derived = derive_columns(raw, s, aliases)
    if materialise:
        derived = stage(derived, "derived")
    return _judged(derived, s, order, materialise)


def _judged(derived: DataFrame, s: Settings, order: str, materialise: bool) -> DataFrame:
    among = ~_any(rejection_conditions(False)) if s.dedupe == "after_validation" else None
    marked = mark_duplicates(derived, order, salts=s.salts, among=among, materialise=materialise)
    return assign_reasons(marked)


def stage_processed(
    parts: Sequence[DataFrame],
    s: Settings = Settings(),
    order: str = "raw_id",
    aliases: Mapping[str, str] = REGION_ALIASES,
    slices: int | None = None,
) -> SlicedTable:
    """:func:`process_feed` over a feed that comes in parts, written once in slices, each apart by verdict.

    Copies of a row lie in one slice, as slices are dealt by the key of duplicates.  A part's shuffles are gone before the
    next part is read; a slice's shuffles, derived rows and repeated keys before the next slice is judged.
    """
    slices = slices or slice_count(*parts)
    spark = parts[0].sparkSession
    derived, processed = SlicedTable(spark, "derived"), SlicedTable(spark, "processed")
    for part in parts:
        derived.deal(derive_columns(part, s, aliases), slices, *_same_key(DUPLICATE_KEYS))
    for rows in derived.slices():
        judged = _judged(rows, s, order, materialise=True)
        processed.add(judged, "is_quarantined")
        discard(judged)
    return processed


def valid_rows(processed: DataFrame) -> DataFrame:
    return processed.filter(~F.col("is_quarantined")).drop(
        "is_quarantined", "rejection_reasons", "rejection_reason"
    )


def quarantine_rows(processed: DataFrame) -> DataFrame:
    """Rejected rows with the delivered fields kept as a JSON payload."""
    payload = F.to_json(F.struct(*[c for c in processed.columns if c in FEED_FIELDS or c == "raw_id"]))
    return (
        processed.filter(F.col("is_quarantined"))
        .withColumn("raw_payload", payload)
        .drop("is_quarantined")
    )


def group_medians(
    df: DataFrame, keys: Sequence[str] = SERIES_KEYS, measures: Sequence[str] = MEASURES
) -> DataFrame:
    """Exact median of every measure per group, as columns ``_median_<measure>``.

    Rows are first collapsed to (group, measure, value, copies) with a map-side combine, which
    spreads a hot group over its distinct values; those are ranked in ranges, so no task has all
    values of a large group.
    """
    pairs = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]
    )
    values = (
        df.select(*keys, F.explode(pairs).alias("pair"))
        .select(*keys, "pair.measure", "pair.value")
        .filter(F.col("value").isNotNull())
        .groupBy(*keys, "measure", "value")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    placed = ranked(values, [*keys, "measure"])
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = placed.filter(covers(low) | covers(high)).groupBy(*keys, "measure").agg(
        F.avg("value").alias("median")
    )
    picked = [F.max(F.when(F.col("measure") == m, F.col("median"))).alias(f"_median_{m}") for m in measures]
    return middle.groupBy(*keys).agg(*picked)


def impute_group_median(
    valid: DataFrame,
    order: str = "raw_id",
    keys: Sequence[str] = SERIES_KEYS,
    measures: Sequence[str] = MEASURES,
    salts: int = 32,
    materialise: bool = False,
) -> DataFrame:
    """Fill a missing measure with its group's median; a group with no value stays missing.

    Medians are worked out only for groups that miss something, and are joined on (group, salt)
    so that one huge group does not land in one task.
    """
    medians = fill_values(valid, keys, measures, salts)
    if materialise:
        medians = stage(medians, "group-medians")
    return fill_gaps_from(medians, valid, order, keys, measures, salts)


def fill_values(
    valid: DataFrame, keys: Sequence[str] = SERIES_KEYS, measures: Sequence[str] = MEASURES, salts: int = 32
) -> DataFrame:
    """Medians of the groups that miss something, once per salt."""
    gap = F.lit(False)
    for m in measures:
        gap = gap | F.col(m).isNull()
    gaps = valid.filter(gap).select(*keys).distinct()
    medians = group_medians(valid.join(gaps, list(keys), "left_semi"), keys, measures)
    return medians.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def fill_gaps_from(
    medians: DataFrame,
    valid: DataFrame,
    order: str = "raw_id",
    keys: Sequence[str] = SERIES_KEYS,
    measures: Sequence[str] = MEASURES,
    salts: int = 32,
) -> DataFrame:
    """``valid`` with its gaps filled from :func:`fill_values` of all valid rows."""
    salted = valid.withColumn("_salt", F.pmod(F.xxhash64(F.col(order)), F.lit(salts)).cast("int"))
    fills = {m: F.coalesce(F.col(m), F.col(f"_median_{m}")) for m in measures}
    return (
        salted.join(medians, [*keys, "_salt"], "left")
        .withColumns(fills)
        .drop("_salt", *[f"_median_{m}" for m in measures])
        .select(*valid.columns)
    )


def split_feed(processed: DataFrame, s: Settings = Settings(), order: str = "raw_id") -> tuple[DataFrame, DataFrame]:
    """(clean rows with imputed measures, quarantine)."""
    return (
        impute_group_median(valid_rows(processed), order, salts=s.salts),
        quarantine_rows(processed),
    )


def storage_clean(raw: DataFrame, order: str = "raw_id", s: Settings = Settings()) -> DataFrame:
    """The storage layer's own cleaning: stateless, so the same on a batch and on a stream.

    Differs from :func:`derive_columns` in reading ``a/b/yyyy`` day-first, in checking only
    brand and region, in the lenient number rule and in keeping product and brand spelling.
    """
    text = F.nullif(trimmed(F.col("date")), F.lit(""))
    month_first, day_first = numeric_date_readings(text)
    slashed = text.contains("/")
    iso_shapes = F.when(text.rlike(r"^\d{4}[-/]"), parse_date_multi(text))
    parsed = F.coalesce(iso_shapes, F.when(slashed, day_first), F.when(slashed, month_first))
    numbers = {f"clean_{m}": parse_number_lenient(F.col(m)) for m in ("trx", "nrx", "units")}
    missing = clean_string(F.col("brand")).isNull() | clean_string(F.col("region")).isNull()
    trx, nrx = F.col("clean_trx"), F.col("clean_nrx")
    reason = F.nullif(
        F.concat_ws(
            REASON_SEPARATOR,
            F.when(F.col("iso_date").isNull(), F.lit(REASONS[0])),
            F.when(F.col("_missing"), F.lit(REASONS[1])),
        ),
        F.lit(""),
    )
    return (
        raw.withColumns({"iso_date": parsed, "_missing": missing, **numbers})
        .select(
            order,
            "iso_date",
            year_week(F.col("iso_date"), clamp53=False).alias("year_week"),
            trimmed(F.initcap("region")).alias("clean_region"),
            trimmed(F.initcap("therapeutic_area")).alias("clean_therapeutic_area"),
            trimmed(F.col("product")).alias("clean_product"),
            trimmed(F.col("brand")).alias("clean_brand"),
            trx,
            nrx,
            F.col("clean_units"),
            flag(trx < 0).alias("is_negative_trx"),
            flag((nrx > trx) & (trx > 0)).alias("is_nrx_gt_trx_error"),
            reason.alias("rejection_reason"),
            F.to_json(F.struct(*[c for c in raw.columns if c in FEED_FIELDS])).alias("raw_payload"),
        )
    )
