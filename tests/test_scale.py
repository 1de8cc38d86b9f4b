"""Work is done once: no second parse, no second join, no file that one task must read whole."""

import os
import time

import pytest
from paths import SF_SMALL
from pyspark.sql import functions as F

from sharetide import registry, session
from sharetide.functions.dates import next_year_weeks
from sharetide.operators.cleaning import mark_duplicates
from sharetide.plans import weekly
from sharetide.session import apply_sql_defaults, fresh_path, setting, shared_folder, slices_read, stage
from sharetide.sources import feeds, sinks
from sharetide.sources.versioned import DeliveryStore
from sharetide.streaming import feed_stream as fs
from test_cleaning import feed
from test_storage import make_facts, same, write_files

registry.load_all()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exported_files_have_a_bounded_number_of_rows(spark):
    path, rows = fresh_path(spark, "bounded"), spark.range(0, 1000, 1, 1).selectExpr("id", "concat('a\n', id) AS note")
    counted = sinks.export_csv({"t": rows, "none": rows.where("false")}, path, file_rows=300)
    assert {r.table_name: r.rows for r in counted.collect()} == {"t": 1000, "none": 0}
    assert len([f for f in os.listdir(f"{path}/t.csv") if f.endswith(".csv")]) == 4


def test_following_weeks_are_compiled(spark):
    labels = spark.createDataFrame([("2020-W52",), ("2021-W52",), ("bad",), (None,)], "label string")
    ahead = labels.select(next_year_weeks(F.col("label"), 2).alias("w"))
    assert "lambda" not in plan(ahead)
    assert [r.w for r in ahead.collect()] == [["2020-W53", "2021-W01"], ["2022-W01", "2022-W02"], [None, None], [None, None]]


@pytest.mark.parametrize("name, again", [("dedupe_first", "lineitem"), ("impute_group_median", "/derived-")])
def test_rows_read_more_than_once_are_worked_out_once(spark, name, again):
    assert not [f for f in registry.QUERIES[name](spark, SF_SMALL).inputFiles() if again in f]


def test_the_cleaned_delivery_is_worked_out_once(spark, monkeypatch):
    from sharetide.registry import storage

    read = []
    monkeypatch.setattr(storage, "impute_group_median", lambda valid: read.extend(valid.inputFiles()) or valid)
    registry.QUERIES["append_clean"](spark, SF_SMALL)
    assert read and all("/valid-" in f for f in read)


def test_a_known_delivery_is_not_written_again(spark, monkeypatch):
    store, rows = DeliveryStore(spark, fresh_path(spark, "known")), spark.range(5)
    assert store.append(rows, "d1")
    monkeypatch.setattr(DeliveryStore, "new_folder", lambda *_: pytest.fail("written again"))
    assert not store.append(rows, "d1")
    with pytest.raises(ValueError, match="other rows"):
        store.append(spark.range(6), "d1")


def test_a_body_is_parsed_once(spark):
    bodies = ['{"year_week": "w", "records": [{"brand": "A"}, null]}', '{"records": []}', '{"year_week": "v"}', "broken", None]
    rows = feeds.parse_deliveries(spark.createDataFrame(list(enumerate(bodies)), "n int, body string"))
    assert plan(rows).count("from_json(") == 1
    assert sorted(((r.n, r.year_week, r.brand) for r in rows.collect()), key=str) == [(0, "w", "A"), (0, "w", None)]


def test_record_checks_are_compiled(spark):
    bodies = spark.createDataFrame([(1, '{"records": [{"brand": "A", "trx": "x"}]}')], "n int, body string")
    checked = feeds.validate_records(bodies, "n")
    assert "lambda" not in plan(checked)
    assert checked.first().errors == ["year_week", "date", "week_number", "year", "region", "therapeutic_area", "product", "trx", "nrx", "units"]


def test_reasons_are_compiled(spark):
    from sharetide.operators.cleaning import assign_reasons

    flags = spark.sql("SELECT DATE'2024-01-01' AS parsed_date, 'X' AS clean_region, 'Unknown' AS clean_brand, true AS is_missing_categorical, "
                      "false AS is_nrx_gt_trx_error, id = 1 AS is_duplicate, false AS is_week_mismatch FROM range(2)")
    found = assign_reasons(flags)
    assert "lambda" not in plan(found)
    reasons = ["MISSING_CATEGORICAL_FIELD", "UNKNOWN_BRAND"]
    assert sorted(r.rejection_reasons for r in found.collect()) == [reasons, [*reasons, "DUPLICATE_RECORD"]]


def test_impossible_months_are_not_cast(spark):
    from sharetide.functions.dates import numeric_date_readings

    texts = spark.createDataFrame([("13/12/2020",), ("12-13-2020",), ("1/2/2020",), ("00/01/2020",), ("31/31/2020",)], "t string")
    month_first, day_first = numeric_date_readings(F.col("t"))
    found = texts.select(month_first.cast("string").alias("m"), day_first.cast("string").alias("d"))
    assert [tuple(r) for r in found.collect()] == [(None, "2020-12-13"), ("2020-12-13", None), ("2020-01-02", "2020-02-01"), (None, None), (None, None)]
    assert "0?[1-9]|1[0-2]" in plan(found)


def test_a_batch_of_deliveries_is_worked_out_once(spark):
    part = make_facts(spark, [1, 2]).withColumn("delivery", F.lit("a"))
    seen, root = spark.sparkContext.accumulator(0), fresh_path(spark, "once")

    @F.udf("string")
    def counted(week):
        seen.add(1)
        return week

    stream = fs.stream_feed(spark, write_files([part]), part.schema, "parquet").withColumn("year_week", counted.asNondeterministic()("year_week"))
    fs.replace_delivered_weeks(stream, root, delivery="delivery").awaitTermination()
    same(fs.stored(spark, root, "facts"), part)
    assert seen.value == part.count()


def test_a_batch_for_gold_keeps_only_what_its_totals_need(spark, monkeypatch):
    part, kept, stage = make_facts(spark, [1, 2]).withColumns({"delivery": F.lit("a"), "note": F.lit("long text")}), {}, fs.stage
    monkeypatch.setattr(fs, "stage", lambda df, label, *a: kept.update({label: df.columns}) or stage(df, label, *a))
    fs.update_gold(fs.stream_feed(spark, write_files([part]), part.schema, "parquet"), fresh_path(spark, "narrow"), lambda b: b, delivery="delivery").awaitTermination()
    assert "note" not in kept["batch-facts"] and "delivery" in kept["batch-facts"]


def test_joins_beyond_a_broadcast_hash_their_smaller_side(spark):
    """Duplicates of wide rows are marked without sorting the rows."""
    rows = apply_sql_defaults(spark).range(20_000).selectExpr("id AS raw_id", "CAST(id % 5000 AS string) AS k", "repeat('x', 50) AS wide")
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        marked = mark_duplicates(rows, keys=["k"], materialise=True)
        assert marked.filter("is_duplicate").count() == 15_000
        marked.collect()
        final = marked._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in final.split("Initial Plan")[0]


WEEKS = [{"product": f"P{i}", "date": f"2025-0{1 + i % 4}-{6 + i % 7:02d}", "week_number": None, "brand": "nan" if i % 6 == 5 else f"B{i % 3}", "trx": None if i % 5 == 0 else str(i)} for i in range(40)]


def folders(path):
    return sorted(os.listdir(path.removeprefix("file:"))) if os.path.exists(path.removeprefix("file:")) else []


def test_a_write_leaves_no_shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        return {str(b) for b in iterate(local.getAllBlocks()) if str(b).startswith("shuffle_")}

    def iterate(blocks):
        return [blocks.apply(i) for i in range(blocks.size())]

    before = kept()
    staged = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "summed")
    until = time.time() + 10
    while kept() - before and time.time() < until:  # they are removed in the background
        time.sleep(0.2)
    assert not kept() - before
    assert staged.count() == 7


@pytest.fixture(scope="module")
def weeks_feed(spark):
    return feed(spark, *WEEKS, *WEEKS[:15], {"region": None, "brand": None, "date": "x"})


@pytest.fixture(scope="module")
def whole(spark, weeks_feed):
    return weekly.weekly_run(weeks_feed, staged=True, slices=1)


def plain(table):
    return table.select(*[c for c, t in table.dtypes if "array" not in t])


def gone(paths):
    return paths and not [f for f in paths if os.path.exists(f.removeprefix("file://"))]


def test_layers_of_a_run_in_slices_and_parts_take_the_place_of_its_work_tables(spark, weeks_feed, whole):
    before = set(folders(shared_folder(spark)))
    run = weekly.weekly_run([weeks_feed.filter(f"raw_id % 2 = {i}") for i in range(2)], staged=True, slices=3)
    assert whole.processed.filter("is_duplicate").count() == 15 and len(slices_read(run.processed)) > 1
    for name in ("processed", "audit", "gold"):
        same(plain(getattr(whole, name)), plain(getattr(run, name)))
    work = [f for f in set(folders(shared_folder(spark))) - before if f.startswith(("derived", "repeated-keys"))]
    assert not [f for name in work for f in folders(f"{shared_folder(spark)}/{name}") if f.startswith(("_slice", "part"))]
    paths = [f for t in (run.processed, run.cleaned) for f in t.inputFiles()]
    stored = weekly.write_layers(run, fresh_path(spark, "released"), release=True)
    for name, table in weekly.layers(whole).items():
        same(plain(table), plain(stored[name]))
    assert gone(paths)


def test_an_export_in_pieces_has_all_rows(spark, weeks_feed, whole):
    run = weekly.weekly_run(weeks_feed, slices=2)
    paths = run.processed.inputFiles()
    exported = sinks.export_csv(weekly.layer_pieces(run, release=True), (root := fresh_path(spark, "csv")))
    assert {r.table_name: r.rows for r in exported.collect()} == {n: t.count() for n, t in weekly.layers(whole).items()}
    rows = spark.read.schema(whole.raw.schema).option("header", True).csv(f"{root}/{sinks.RAW_TABLE}.csv")
    same(rows, whole.raw)
    assert gone(paths)


def test_an_empty_feed_in_slices(spark, weeks_feed):
    run = weekly.weekly_run(weeks_feed.where("false"), staged=True, slices=3)
    stored = weekly.write_layers(run, fresh_path(spark, "nothing"), release=True)
    assert not any(df.count() for df in stored.values())


def test_weeks_are_written_some_at_a_time(spark):
    rows = make_facts(spark, [1, 2, 3]).unionByName(make_facts(spark, [4]).withColumn("year_week", F.lit(None).cast("string")))
    for n in (7, 1000):
        sinks.write_table(rows, path := fresh_path(spark, "weeks"), rows=n)
        same(spark.read.schema(rows.schema).parquet(path), rows)
    assert sinks._groups_of_weeks(rows, 12) == [[None, "2024-W01"], ["2024-W02", "2024-W03"]]


def test_a_feed_in_parts_is_the_feed(spark, monkeypatch):
    from sharetide.sources import star_tables as st

    assert len(st.feed_parts(spark, SF_SMALL)) == 1
    monkeypatch.setattr(session, "SLICE_BYTES", 20_000)
    parts = st.feed_parts(spark, SF_SMALL)
    assert len(parts) == 4 and all(p.head(1) for p in parts)
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    same(union, st.feed(spark, SF_SMALL))
