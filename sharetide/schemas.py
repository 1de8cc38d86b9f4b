"""One explicit schema per layer; nothing is ever inferred from the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STR, DBL, LNG, BOOL = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FEED_FIELDS = (
    "date", "week_number", "year", "region", "therapeutic_area",
    "product", "brand", "trx", "nrx", "units",
)
FEED = _struct(*[(n, STR) for n in FEED_FIELDS])
FEED_WITH_ID = _struct(("raw_id", LNG), *[(n, STR) for n in FEED_FIELDS])

RECORD = _struct(
    ("date", STR), ("week_number", LNG), ("year", LNG), ("region", STR),
    ("therapeutic_area", STR), ("product", STR), ("brand", STR),
    ("trx", DBL), ("nrx", DBL), ("units", DBL),
)
DELIVERY = _struct(
    ("year_week", STR), ("source_vendor", STR), ("records", T.ArrayType(RECORD)),
    ("_corrupt", STR),
)
# Every field as text: lets the validator say which field is wrong instead of dropping the record.
LOOSE_DELIVERY = _struct(
    ("year_week", STR), ("source_vendor", STR), ("records", T.ArrayType(FEED)),
)

RAW_STORE = _struct(
    ("raw_id", LNG), ("date_str", STR), ("week_number", LNG), ("year_str", STR),
    ("region", STR), ("therapeutic_area", STR), ("product", STR), ("brand", STR),
    ("trx", DBL), ("nrx", DBL), ("units", DBL),
)
CLEAN_STORE = _struct(
    ("raw_id", LNG), ("iso_date", T.DateType()), ("year_week", STR), ("clean_region", STR),
    ("clean_therapeutic_area", STR), ("clean_product", STR), ("clean_brand", STR),
    ("clean_trx", T.DecimalType(12, 2)), ("clean_nrx", T.DecimalType(12, 2)),
    ("clean_units", T.DecimalType(12, 2)), ("is_negative_trx", BOOL),
    ("is_missing_flag", BOOL), ("is_nrx_gt_trx_error", BOOL),
)
GOLD_STORE = _struct(
    ("year_week", STR), ("clean_region", STR), ("clean_therapeutic_area", STR),
    ("clean_brand", STR), ("brand_trx", T.DecimalType(14, 2)),
    ("total_segment_trx", T.DecimalType(14, 2)),
    ("market_share_trx_pct", T.DecimalType(6, 3)), ("market_share_nrx_pct", T.DecimalType(6, 3)),
    ("prev_market_share_pp", T.DecimalType(6, 3)), ("share_shift_pp", T.DecimalType(6, 3)),
    ("share_shift_bps", T.DecimalType(8, 2)), ("momentum_ratio", T.DecimalType(12, 3)),
    ("prev_3wk_rolling_mean_pp", T.DecimalType(6, 3)),
    ("statistical_z_score", T.DecimalType(6, 3)),
)
ALERT_STORE = _struct(
    ("year_week", STR), ("clean_region", STR), ("clean_therapeutic_area", STR),
    ("clean_brand", STR), ("alert_type", STR), ("severity_level", STR),
    ("previous_share_pp", T.DecimalType(6, 3)), ("current_share_pp", T.DecimalType(6, 3)),
    ("share_shift_pp", T.DecimalType(6, 3)), ("share_shift_bps", T.DecimalType(8, 2)),
    ("statistical_z_score", T.DecimalType(6, 3)),
    ("isolation_forest_score", T.DecimalType(6, 3)),
    ("triggered_techniques", STR), ("executive_brief", STR),
)

SERIES_KEYS = ("clean_region", "clean_therapeutic_area", "clean_brand")
SEGMENT_KEYS = ("year_week", "clean_region")
GOLD_KEYS = ("year_week", "clean_region", "clean_therapeutic_area", "clean_brand")
MEASURES = ("clean_trx", "clean_nrx", "clean_units")


# What the stored layers must hold at least: columns with their types, and those of them that are never null.
LAYERS: dict[str, tuple[T.StructType, tuple[str, ...]]] = {
    "prescriptions_raw": (FEED, ()),
    "prescriptions_clean": (
        _struct(*[(n, STR) for n in ("iso_date", *GOLD_KEYS)], *[(m, DBL) for m in MEASURES]),
        ("iso_date", *GOLD_KEYS),
    ),
    "quarantine_records": (_struct(("rejection_reason", STR), ("raw_payload", STR)), ("rejection_reason", "raw_payload")),
    "market_share_gold": (
        _struct(
            *[(n, STR) for n in GOLD_KEYS],
            *[(n, DBL) for n in ("market_share_trx_pct", "share_shift_pp", "prev_market_share_pp", "statistical_z_score")],
            ("combined_anomaly", BOOL), ("triggered_techniques", STR),
        ),
        (*GOLD_KEYS, "triggered_techniques"),
    ),
    "threshold_alerts": (
        _struct(*[(n, STR) for n in GOLD_KEYS], ("alert_category", STR), ("share_shift_pp", DBL), ("executive_brief", STR)),
        (*GOLD_KEYS, "alert_category", "share_shift_pp"),
    ),
}


def enforced(df: DataFrame, layer: str) -> DataFrame:
    """``df`` if it has the layer's columns in their types; writing it then fails at a null where none may be.

    Columns beyond the layer's own are let through.
    """
    schema, never_null = LAYERS[layer]
    types = {f.name: f.dataType for f in df.schema.fields}
    wrong = [f"{f.name} ({types[f.name].simpleString() if f.name in types else 'missing'}, not {f.dataType.simpleString()})" for f in schema.fields if types.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"{layer} has wrong columns: {', '.join(wrong)}")
    checks = {n: F.coalesce(F.col(n), F.raise_error(F.lit(f"{layer}: {n} is null"))) for n in never_null}
    return df.withColumns(checks) if checks else df


def require(df: DataFrame, *names: str) -> None:
    """Fail at plan time, with a readable message, when an input column is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing input columns: {', '.join(missing)}")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema``: cast what exists, add typed NULLs for what does not."""

    def field(f: T.StructField) -> Column:
        source = F.col(f.name) if f.name in df.columns else F.lit(None)
        return source.cast(f.dataType).alias(f.name)

    return df.select(*[field(f) for f in schema.fields])


def no_nan(df: DataFrame, *names: str) -> DataFrame:
    """Turn NaN into NULL; Spark would otherwise order NaN above every number."""
    types = {f.name: f.dataType for f in df.schema.fields}
    fixes = {
        n: F.when(~F.isnan(n), F.col(n))
        for n in names
        if isinstance(types.get(n), (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df
