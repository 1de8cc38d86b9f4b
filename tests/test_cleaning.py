"""Cleaning rules on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.functions import dates, numbers, text
from sharetide.operators import cleaning, quality
from sharetide.schemas import FEED_WITH_ID

GOOD = ("2025-01-06", "2", "2025", "Tamil Nadu", "Cardiology", "Vascolin", "Brand A", "100.0", "20.0", "300.0")
FIELDS = [f.name for f in FEED_WITH_ID.fields]


def feed(spark, *changes):
    """Rows equal to GOOD but for the given changes; each row its own product unless given."""
    rows = []
    for i, change in enumerate(changes):
        row = dict(zip(FIELDS, (i, *GOOD)), product=f"Product {i}")
        row.update(change)
        rows.append(tuple(row[f] for f in FIELDS))
    return spark.createDataFrame(rows, FEED_WITH_ID)


def processed(spark, *changes, s=Settings(), **kw):
    rows = cleaning.process_feed(feed(spark, *changes), s, **kw).orderBy("raw_id").collect()
    return rows


def one(spark, column, value, type_="string"):
    return spark.createDataFrame([(value,)], f"v {type_}").select(column(F.col("v")).alias("x")).first().x


def test_negative_volume_is_kept_and_flagged(spark):
    (row,) = processed(spark, {"trx": "-150.0"})
    assert row.clean_trx == -150.0 and row.is_negative_trx and not row.is_quarantined


def test_literal_nan_region_is_quarantined(spark):
    (row,) = processed(spark, {"region": "nan"})
    assert row.is_quarantined
    assert row.rejection_reason == "MISSING_CATEGORICAL_FIELD | UNKNOWN_REGION"
    assert row.rejection_reasons == ["MISSING_CATEGORICAL_FIELD", "UNKNOWN_REGION"]


def test_invalid_date_has_no_fallback(spark):
    (row,) = processed(spark, {"date": "invalid-date-string"})
    assert row.rejection_reason == "INVALID_DATE"
    assert row.year_week is None and row.iso_week is None and row.is_week_mismatch is False


@pytest.mark.parametrize(
    "date, hint, expected",
    [
        ("10/03/2025", "167", "2025-03-10"),
        ("10/03/2025", None, "2025-10-03"),
        ("10/03/2025", "wk", "2025-10-03"),
        ("10-03-2025", "11", "2025-03-10"),
        ("25/03/2025", "1", "2025-03-25"),
        ("03/25/2025", "1", "2025-03-25"),
        ("13/13/2025", "1", None),
        ("2024-02-30", None, None),
        ("2024/2/9", None, "2024-02-09"),
        ("05-FEB-2024", None, "2024-02-05"),
        ("Feb  5,  2024", None, "2024-02-05"),
        ("5-Feb-24", None, None),
        ("05-Xyz-2024", None, None),
        ("10/03-2025", "1", None),
        ("0000-01-01", None, None),
        ("  2024-12-30 ", None, "2024-12-30"),
        ("", None, None),
        ("12024-01-01", None, None),
    ],
)
def test_dates(spark, date, hint, expected):
    rows = feed(spark, {"date": date, "week_number": hint})
    assert dates.add_feed_date(rows).first().iso_date == expected


@pytest.mark.parametrize(
    "day, clamped, true",
    [
        ("2024-12-30", "2025-W01", "2025-W01"),
        ("2021-01-03", "2020-W52", "2020-W53"),
        ("2020-12-28", "2020-W52", "2020-W53"),
        ("2023-01-01", "2022-W52", "2022-W52"),
    ],
)
def test_week_labels(spark, day, clamped, true):
    d = F.lit(day).cast("date")
    row = spark.range(1).select(dates.year_week(d).alias("a"), dates.year_week(d, clamp53=False).alias("b")).first()
    assert (row.a, row.b) == (clamped, true)


@pytest.mark.parametrize(
    "hint, strict, mismatch",
    [
        ("2", False, False), ("3", False, False), ("4", False, True), ("158", False, False),
        ("161", False, True), ("2.0", False, False), ("2.0", True, True), ("2.5", False, True),
        ("wk", False, True), (None, False, False), (" nan ", False, False), ("+2", False, False),
    ],
)
def test_week_mismatch(spark, hint, strict, mismatch):
    # 2025-01-06 is ISO week 2, running week (2025 - 2022) * 52 + 2 = 158.
    (row,) = processed(spark, {"week_number": hint}, s=Settings(strict_hint=strict))
    assert row.is_week_mismatch is mismatch


@pytest.mark.parametrize(
    "raw, value",
    [
        ("1,234", 1234.0), ("-150.0", -150.0), ("1e3", 1000.0), ("inf", float("inf")), ("1d", None), ("abc", None),
        ("1_000", 1000.0), (" 7 ", 7.0), (".5", 0.5), ("5.", 5.0), ("", None), ("NULL", None), ("+3", 3.0), ("1 2", None),
    ],
)
def test_numbers(spark, raw, value):
    assert one(spark, lambda c: numbers.parse_number(text.clean_string(c)), raw) == value


@pytest.mark.parametrize("raw, value", [("1,234.50", 1234.5), ("$-7", -7.0), ("1-2", None), ("abc", None)])
def test_lenient_numbers(spark, raw, value):
    got = one(spark, numbers.parse_number_lenient, raw)
    assert (None if got is None else float(got)) == value


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("o'neil b2b", "O'Neil B2B"), ("b-c d_e", "B-C D_E"), ("MSD Pharma", "Msd Pharma"), ("x  y", "X  Y"),
        ("élan über", "Élan Über"), ("", ""),
    ],
)
def test_title_case(spark, raw, expected):
    assert one(spark, text.title_case, raw) == expected


@pytest.mark.parametrize(
    "raw, expected",
    [("TN", "Tamil Nadu"), (" w. bengal ", "West Bengal"), ("goa north", "Goa North"), ("None", "Unknown"), (None, "Unknown")],
)
def test_regions(spark, raw, expected):
    assert one(spark, lambda c: text.normalise_region(text.clean_string(c)), raw) == expected


def test_volume_rule_needs_positive_total(spark):
    rows = processed(
        spark, {"trx": "10", "nrx": "11"}, {"trx": "0", "nrx": "5"}, {"trx": "-5", "nrx": "5"}, {"trx": "", "nrx": "5"}
    )
    assert [r.is_nrx_gt_trx_error for r in rows] == [True, False, False, False]
    assert [r.is_quarantined for r in rows] == [True, False, False, False]
    assert rows[3].is_missing_numeric


@pytest.mark.parametrize("materialise", [False, True])
def test_first_copy_wins_and_nulls_are_equal(spark, materialise):
    same = {"product": "P"}
    rows = processed(spark, same, same, {"product": "p "}, {"product": "Q", "date": "?"}, {"product": "Q", "date": "!"}, materialise=materialise)
    assert [r.is_duplicate for r in rows] == [False, True, True, False, True]


def test_duplicate_of_a_rejected_row(spark):
    bad, good = {"product": "P", "nrx": "999"}, {"product": "P"}
    assert [r.is_quarantined for r in processed(spark, bad, good)] == [True, True]
    rows = processed(spark, bad, good, s=Settings(dedupe="after_validation"))
    assert [r.is_quarantined for r in rows] == [True, False]


@pytest.mark.parametrize("salts", [1, 32, 63])
def test_hot_key_is_deduplicated_exactly(spark, salts):
    """A third of the rows share one key; the answer must not depend on the salting."""
    rows = spark.range(3000).select(
        F.col("id").alias("raw_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 500).cast("string")).alias("k"),
    )
    marked = cleaning.mark_duplicates(rows.repartition(7), keys=["k"], salts=salts).toPandas()
    expected = marked.sort_values("raw_id").duplicated(subset="k", keep="first")
    got = marked.sort_values("raw_id")["is_duplicate"]
    assert (got == expected).all() and len(marked) == 3000


def test_imputation_uses_group_median_of_valid_rows(spark):
    rows = [
        (1, "A", "C", "X", 1.0, 1.0, None), (2, "A", "C", "X", 2.0, None, None), (3, "A", "C", "X", 10.0, 3.0, None),
        (4, "A", "C", "X", None, 5.0, None), (5, "B", "C", "X", None, 1.0, 1.0), (6, "A", "C", "X", 2.0, 4.0, None),
    ]
    schema = "raw_id long, clean_region string, clean_therapeutic_area string, clean_brand string, clean_trx double, clean_nrx double, clean_units double"
    got = {r.raw_id: r for r in cleaning.impute_group_median(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == 6
    assert got[4].clean_trx == 2.0 and got[2].clean_nrx == 3.5
    assert got[5].clean_trx is None and got[1].clean_units is None


def test_group_medians_match_numpy(spark):
    df = spark.range(5000).select(
        F.lit("r").alias("clean_region"), (F.col("id") % 2).cast("string").alias("clean_therapeutic_area"),
        F.lit("b").alias("clean_brand"), F.pmod(F.xxhash64("id"), F.lit(997)).cast("double").alias("clean_trx"),
        F.rand(3).alias("clean_nrx"), F.lit(None).cast("double").alias("clean_units"),
    ).cache()
    pdf = df.toPandas().groupby("clean_therapeutic_area")[["clean_trx", "clean_nrx"]].median()
    for r in cleaning.group_medians(df).collect():
        assert r._median_clean_trx == pdf.loc[r.clean_therapeutic_area, "clean_trx"]
        assert abs(r._median_clean_nrx - pdf.loc[r.clean_therapeutic_area, "clean_nrx"]) < 1e-12
        assert r._median_clean_units is None


def test_split_is_a_partition_of_the_feed_and_report_counts_it(spark):
    changes = [{}, {"product": "P"}, {"product": "P"}, {"brand": " "}, {"date": "x"}, {"trx": "-1"}, {"units": "?"}]
    done = cleaning.process_feed(feed(spark, *changes)).cache()
    clean, bad = cleaning.split_feed(done)
    assert clean.count() + bad.count() == len(changes)
    assert '"brand":" "' in bad.filter("is_missing_categorical").first().raw_payload
    summary = quality.dq_summary(done).first()
    assert summary.total_raw_records == 7 and summary.quarantined_records == 3 and summary.missing_units_count == 1
    assert summary.valid_percentage == 57.14
    report = {r.Metric: r for r in quality.dq_report_long(quality.dq_summary(done)).collect()}
    assert len(report) == 7 and report["Valid Cleaned Records"].Details == "57.14% Silver Layer Retention"
    empty = quality.dq_summary(done.limit(0)).first()
    assert empty.total_raw_records == 0 and empty.valid_percentage == 0.0


def test_storage_profile_reads_day_first(spark):
    got = cleaning.storage_clean(feed(spark, {"date": "10/03/2025"}, {"date": "03/25/2025"}, {"date": "5-Jan-2025"}, {"brand": "nan"}))
    rows = got.orderBy("raw_id").collect()
    assert [r.iso_date for r in rows[:3]] == [dt.date(2025, 3, 10), dt.date(2025, 3, 25), None]
    assert rows[2].rejection_reason == "INVALID_DATE" and rows[3].rejection_reason == "MISSING_CATEGORICAL_FIELD"
    assert rows[0].clean_product == "Product 0" and rows[0].clean_brand == "Brand A"
