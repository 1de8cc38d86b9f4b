"""Sources, sinks, the weekly run, the incremental refresh and the streams."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from sharetide.operators import share
from sharetide.operators.cleaning import DUPLICATE_KEYS, derive_columns
from sharetide.plans import incremental, weekly
from sharetide.schemas import FEED_FIELDS, GOLD_STORE, conform
from sharetide.session import fresh_path, stage
from sharetide.sources import feeds, sinks
from sharetide.sources.versioned import WeekStore
from sharetide.streaming import feed_stream as fs
from test_cleaning import feed

FACT = "year_week string, clean_region string, clean_therapeutic_area string, clean_brand string, clean_trx double, clean_nrx double, clean_units double"


def make_facts(spark, weeks, brands="ABC", skip=(), bump=None):
    rows = []
    for w in weeks:
        for r in ("N", "S"):
            for j, b in enumerate(brands):
                if (w, r, b) in skip:
                    continue
                trx = float(10 + (w * 7 + j * 5 + len(r)) % 11 + (3 if r == "S" else 0))
                category = "X"
                if bump and bump.get((w, b)):
                    trx, category = bump[(w, b)]
                rows.append((f"2024-W{w:02d}", r, category, b, trx, trx / 2, trx * 3))
    return spark.createDataFrame(rows, FACT)


def same(a, b):
    columns = sorted(a.columns)

    def plain(df):
        return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes)])

    assert columns == sorted(b.columns)
    x, y = plain(a), plain(b)
    assert x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def refreshed(spark, before, delivery):
    totals = stage(share.category_totals(before), "t")
    return incremental.refresh(totals, stage(weekly.gold_from_clean(before), "g"), delivery)


@pytest.mark.parametrize(
    "case",
    ["new_week", "late_week", "gap_week", "brand_gone", "new_brand", "new_category", "category_gone", "several"],
)
def test_incremental_equals_full(spark, case):
    base = [w for w in range(1, 21) if w != 9]
    before, delivery = make_facts(spark, base), None
    if case == "new_week":
        delivery = make_facts(spark, [21])
    elif case == "late_week":
        delivery = make_facts(spark, [7], bump={(7, "A"): (99.0, "X")})
    elif case == "gap_week":
        delivery = make_facts(spark, [9])
    elif case == "brand_gone":
        delivery = make_facts(spark, [6], brands="AB")
    elif case == "new_brand":
        delivery = make_facts(spark, [10], brands="ABCD")
    elif case == "new_category":
        delivery = make_facts(spark, [20], bump={(20, "B"): (44.0, "Y")})
    elif case == "category_gone":
        before = make_facts(spark, base, bump={(5, "B"): (44.0, "Y")})
        delivery = make_facts(spark, [5])
    else:
        delivery = make_facts(spark, [3, 9, 21, 22], bump={(3, "C"): (1.0, "X")})
    done = refreshed(spark, before, delivery)
    weeks = [r.year_week for r in delivery.select("year_week").distinct().collect()]
    after = before.filter(~F.col("year_week").isin(weeks)).unionByName(delivery)
    same(done.gold, weekly.gold_from_clean(after))
    same(done.totals, share.category_totals(after))
    if case == "new_week":
        assert done.rows.count() == 6


def test_incremental_touches_only_the_rows_it_must(spark):
    before = make_facts(spark, range(1, 31))
    done = refreshed(spark, before, make_facts(spark, [10], bump={(10, "A"): (50.0, "X")}))
    touched = {r.year_week for r in done.rows.select("year_week").distinct().collect()}
    assert touched == {f"2024-W{w}" for w in range(10, 15)}


def test_csv_feed_round_trip(spark):
    path = fresh_path(spark, "csv")
    feed(spark, {"units": "1,200"}, {"brand": ""}, {"product": 'a "b", c'}).select(*FEED_FIELDS).coalesce(1).write.option(
        "header", True
    ).option("escape", '"').csv(path)
    rows = feeds.read_feed_csv(spark, path).collect()
    assert len(rows) == 3 and len({r.raw_id for r in rows}) == 3 and rows[0].units == "1,200"


RECORD = {
    "date": "2026-01-05", "week_number": 1, "year": 2026, "region": "TN", "therapeutic_area": "R", "product": "P",
    "brand": "B", "trx": 10.0, "nrx": 1.0, "units": 5.0,
}


def deliveries(spark):
    def body(*records):
        return json.dumps({"year_week": "2026-W01", "source_vendor": "v", "records": list(records)})

    without = {k: v for k, v in RECORD.items() if k != "brand"}
    rows = [
        (1, body(RECORD, dict(RECORD, trx=7))), (2, body(RECORD, without)), (3, body(dict(RECORD, trx="many"))), (4, "{not json"),
        (5, body(dict(RECORD, week_number="2", units="3.5"))),
    ]
    return spark.createDataFrame(rows, "batch int, body string")


def test_deliveries_are_flattened_and_corrupt_ones_found(spark):
    rows = feeds.parse_deliveries(deliveries(spark).filter("batch IN (1, 4)")).orderBy("trx").collect()
    assert [(r.batch, r.trx, r.brand) for r in rows] == [(1, 7.0, "B"), (1, 10.0, "B")]
    assert [r.batch for r in feeds.corrupt_deliveries(deliveries(spark)).filter("batch = 4").collect()] == [4]


def test_one_bad_record_refuses_its_batch(spark):
    checked = feeds.validate_records(deliveries(spark), "batch")
    verdict = {r.batch: (r.records, r.bad_records, r.accepted) for r in feeds.batch_verdict(checked, "batch").collect()}
    assert verdict == {1: (2, 0, True), 2: (2, 1, False), 3: (1, 1, False), 4: (0, 1, False), 5: (1, 0, True)}
    errors = [r.errors for r in checked.filter("size(errors) > 0").orderBy("batch").collect()]
    assert errors == [["brand"], ["trx"], ["body"]]
    assert {r.batch for r in feeds.accepted_records(deliveries(spark), "batch").collect()} == {1, 5}


def test_edge_cases_of_deliveries(spark):
    def body(label, *records):
        return json.dumps({"year_week": label, "source_vendor": "v", "records": list(records)})

    rows = [(1, body("2026-W01", dict(RECORD, trx="1d"))), (2, body(None, RECORD)), (3, body("2026-W01")), (4, None), (5, body(" ", RECORD))]
    checked = feeds.validate_records(spark.createDataFrame(rows, "batch int, body string"), "batch")
    assert {r.batch: r.errors for r in checked.collect()} == {1: ["trx"], 2: ["year_week"], 3: ["body"], 4: ["body"], 5: ["year_week"]}
    assert not any(r.accepted for r in feeds.batch_verdict(checked, "batch").collect())


def test_ingest_order_follows_files_not_splits(spark, tmp_path):
    """An older small file before a newer large one: Spark reads the large one first."""
    header = ",".join(feeds.FEED.fieldNames())
    for name, n, stamp in (("b-old.csv", 3, 1_000_000), ("a-new.csv", 400, 2_000_000)):
        lines = [",".join([f"{name[0]}{i}"] + ["x"] * (len(feeds.FEED.fieldNames()) - 1)) for i in range(n)]
        (tmp_path / name).write_text("\n".join([header, *lines]) + "\n")
        os.utime(tmp_path / name, (stamp, stamp))
    first = feeds.FEED.fieldNames()[0]
    rows = feeds.read_feed_csv(spark, str(tmp_path)).orderBy("raw_id").collect()
    assert [r.raw_id for r in rows] == list(range(403))
    assert [r[first] for r in rows] == [f"b{i}" for i in range(3)] + [f"a{i}" for i in range(400)]


def test_key_ranges_keep_null_keys_and_bounds(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "k string")
    assert feeds.read_key_ranges(lambda p: df.filter(p), "k", ["c", "b"]).count() == 4
    assert feeds.read_key_ranges(df, "k", ["c", "b"]).count() == 4
    assert feeds.read_key_ranges(df, "k", []).count() == 4


def test_raw_store_rows_fill_defaults_and_accept_aliases(spark):
    rows = spark.createDataFrame([("2025-01-06", None, "x")], "date_str string, week_number string, trx string")
    row = sinks.raw_store_rows(rows).first()
    assert (row.date_str, row.week_number, row.trx, row.units, row.region, row.year_str) == ("2025-01-06", 1, 0.0, 0.0, "", "")


def test_replace_weeks_is_idempotent(spark):
    path = fresh_path(spark, "weeks")
    sinks.write_table(make_facts(spark, [1, 2, 3]), path)
    delivery = make_facts(spark, [2], brands="A")
    for _ in range(2):
        sinks.overwrite_weeks(delivery, path)
        assert spark.read.parquet(path).count() == 6 + 2 + 6


def test_latest_by_key(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("j", 1, "only")], "key string, version int, v string")
    assert {(r.key, r.v) for r in sinks.latest_by_key(rows, ["key"], "version").collect()} == {("k", "new"), ("j", "only")}


def test_weekly_run_stores_loads_and_recomputes(spark):
    changes = [
        {"date": f"2025-0{1 + i // 4}-{6 + 7 * (i % 4):02d}", "week_number": None, "brand": b, "trx": str(50 + (i * j) % 17), "product": b}
        for i in range(12)
        for j, b in enumerate(("Brand A", "Brand B", "nan"), 1)
    ]
    run = weekly.weekly_run(feed(spark, *changes), staged=True, forest="fit")
    assert set(run.tables()) >= {"raw", "cleaned", "quarantine", "gold", "active_alerts", "dq_report", "sum_check"}
    root = fresh_path(spark, "run")
    stored = weekly.write_layers(run, root)
    counts = {k: v.count() for k, v in stored.items()}
    assert counts["prescriptions_raw"] == 36 and counts["prescriptions_clean"] == 24 and counts["quarantine_records"] == 12
    same(stored["market_share_gold"], run.gold)
    loaded = weekly.load_or_compute(spark, root, lambda: {"fresh": True})
    assert loaded["gold"].count() == run.gold.count() == 24
    assert weekly.load_or_compute(spark, root, lambda: {"fresh": True}, force=True) == {"fresh": True}
    assert weekly.load_or_compute(spark, root + "-none", lambda: {"fresh": True}) == {"fresh": True}
    again = weekly.recompute_from_store(stored["prescriptions_clean"])
    assert again["gold"].count() == 24
    assert conform(run.gold, GOLD_STORE).count() == 24
    exported = sinks.export_csv(weekly.layers(run), fresh_path(spark, "csv"))
    assert {r.table_name: r.rows for r in exported.collect()} == counts
    summary = sinks.run_summary(run.gold, run.active_alerts).first()
    assert summary.total_gold_records == 24


# --- streams ----------------------------------------------------------------------------------


def test_read_paged_reads_the_ranges(spark, monkeypatch):
    from sharetide import registry

    asked, read = [], feeds.read_key_ranges

    def noted(source, key, bounds):
        return read(lambda p: (asked.append(p), source(p))[1], key, bounds)

    monkeypatch.setattr(feeds, "read_key_ranges", noted)
    registry.QUERIES["read_paged"](spark, "/root/testdata/sf0.001")
    assert len(asked) == 5 and "IS NULL" in asked[0]


def write_files(batches, fmt="parquet"):
    """One file per batch, in order."""
    spark = batches[0].sparkSession
    path = fresh_path(spark, "in")
    for b in batches:
        b.coalesce(1).write.mode("append").option("header", True).format(fmt).save(path)
    return path


def test_stream_routing_equals_batch_over_many_files(spark):
    from sharetide.operators.cleaning import storage_clean

    rows = feed(spark, {}, {"date": "x"}, {"brand": "nan"}, {"trx": "-4"}, {"date": "1/2/2025"}, {"region": ""})
    path = write_files([rows.filter(F.col("raw_id") % 3 == k) for k in range(3)], "csv")
    root = fresh_path(spark, "route")
    stream = fs.stream_feed(spark, path, files_per_batch=1)
    fs.route(stream, root).awaitTermination()
    batch = storage_clean(rows)
    good = fs.read_output(spark, root, "clean")
    assert good.select("batch_id").distinct().count() >= 2
    same(good.drop("batch_id"), batch.filter("rejection_reason IS NULL").drop("rejection_reason", "raw_payload"))
    bad = fs.read_output(spark, root, "quarantine")
    assert {r.raw_id for r in bad.collect()} == {1, 2, 5}


def first_kept(parts):
    """raw_id of the first row of each key, by delivery and raw_id."""
    kept = {}
    for p in parts:
        for r in sorted(p.collect(), key=lambda r: r.raw_id):
            kept.setdefault(tuple(r[k] for k in DUPLICATE_KEYS), r.raw_id)
    return sorted(kept.values())


def test_stream_dedupe_keeps_what_arrived_first_and_survives_restart_and_replay(spark, tmp_path):
    changes = [{"product": f"P{i % 5}"} | ({"date": "?"} if i % 4 == 0 else {}) for i in range(24)]
    rows = derive_columns(feed(spark, *changes)).select("raw_id", *DUPLICATE_KEYS)
    parts = [rows.filter(F.col("raw_id").isin(ids)) for ids in ([9, 14, 4, 20], [1, 2, 3, 9, 5], [6, 7, 8, 10, 11, 12, 24], list(range(25)))]
    root, path = str(tmp_path / "dedupe"), fresh_path(spark, "in")

    def deliver(upto):
        fs.dedupe_stream(fs.stream_feed(spark, path, rows.schema, "parquet", files_per_batch=1), root).awaitTermination()
        found = fs.read_output(spark, root, "rows")
        assert sorted(r.raw_id for r in found.collect()) == first_kept(parts[:upto])
        return {(r.batch_id, r.raw_id) for r in found.collect()}

    for k, p in enumerate(parts):  # a new query, from the checkpoint, for each delivery
        p.coalesce(1).write.mode("append").parquet(path)
        done = deliver(k + 1)
    # The last batch failed after writing: its commit mark is gone and its rows are half there.
    last = max(int(f.name) for f in (tmp_path / "dedupe" / "_checkpoint" / "commits").iterdir() if f.name.isdigit())
    for mark in (tmp_path / "dedupe" / "_checkpoint" / "commits").glob(f"*{last}*"):
        mark.unlink()
    fs.write_batch(rows.limit(1), root, "rows", last)
    assert deliver(4) == done
    shutil.rmtree(tmp_path / "dedupe" / "_checkpoint")
    with pytest.raises(RuntimeError, match="no checkpoint"):
        fs.dedupe_stream(fs.stream_feed(spark, path, rows.schema, "parquet"), root)


def test_bounded_stream_dedupe(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    stream = fs.stream_feed(spark, write_files([rows]), rows.schema, "parquet")
    root = fresh_path(spark, "bounded")
    unique = fs.dedupe_within(stream, ["k"], "ts", "1 hour")
    fs.run_batches(unique, f"{root}/_c", lambda b, i: fs.write_batch(b, root, "rows", i)).awaitTermination()
    assert fs.read_output(spark, root, "rows").count() == 2


def test_stream_keeps_gold_and_alerts_current(spark):
    weeks = [[1, 2, 3, 4, 5], [6], [4, 7], [8, 9]]
    parts = [make_facts(spark, w, bump={(4, "A"): (60.0 + k, "X")}) for k, w in enumerate(weeks)]
    stream = fs.stream_feed(spark, write_files(parts), parts[0].schema, "parquet", files_per_batch=1)
    root = fresh_path(spark, "gold")
    fs.update_gold(stream, root, lambda b: b).awaitTermination()
    after = parts[0].filter("year_week <> '2024-W04'").unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    expected = weekly.gold_from_clean(after)
    same(fs.stored(spark, root, fs.GOLD), expected)
    from sharetide.operators.alerts import generate_alerts

    same(fs.stored(spark, root, fs.ALERTS), generate_alerts(expected)[1])


def test_stream_puts_parts_of_a_week_together_and_replaces_redeliveries(spark):
    def delivered(facts, name):
        return facts.withColumn("delivery", F.lit(name))

    whole = make_facts(spark, [1, 2, 3])
    late = make_facts(spark, [2], bump={(2, "A"): (75.0, "X")})
    parts = [
        delivered(whole.filter("year_week <> '2024-W03'"), "1"),
        delivered(whole.filter("year_week = '2024-W03' AND clean_brand = 'A'"), "2"),
        delivered(whole.filter("year_week = '2024-W03' AND clean_brand <> 'A'"), "2"),
        delivered(late, "3"),
    ]
    stream = fs.stream_feed(spark, write_files(parts), parts[0].schema, "parquet", files_per_batch=1)
    root = fresh_path(spark, "parts")
    fs.update_gold(stream, root, lambda b: b, delivery="delivery").awaitTermination()
    expected = weekly.gold_from_clean(whole.filter("year_week <> '2024-W02'").unionByName(late))
    same(fs.stored(spark, root, fs.GOLD), expected)


def test_stream_of_weeks_puts_parts_together_and_replaces_redeliveries(spark):
    whole, late = make_facts(spark, [1, 2, 3]), make_facts(spark, [2], bump={(2, "A"): (75.0, "X")})
    split = whole.filter("year_week = '2024-W03'")
    parts = [
        f.withColumn("delivery", F.lit(n))
        for n, f in (("1", whole.filter("year_week <> '2024-W03'")), ("2", split.filter("clean_brand = 'A'")), ("2", split.filter("clean_brand <> 'A'")), ("3", late))
    ]
    stream = fs.stream_feed(spark, write_files(parts), parts[0].schema, "parquet", files_per_batch=1)
    root = fresh_path(spark, "week-parts")
    fs.replace_delivered_weeks(stream, root, delivery="delivery").awaitTermination()
    same(fs.stored(spark, root, "facts").drop("delivery"), whole.filter("year_week <> '2024-W02'").unionByName(late))
    store = WeekStore(spark, f"{root}/facts")
    assert store.numbers() == [1, 2, 3, 4] and store.before(fs.STREAM, 3).number == 3 and store.before(fs.STREAM, 4).number == 4


def test_weeks_that_come_again_need_a_delivery_column_or_whole_batches(spark):
    parts = [make_facts(spark, [1, 2]), make_facts(spark, [2, 3], brands="A")]
    path = write_files(parts)
    for whole in (True, False):
        root = fresh_path(spark, "whole")
        stream = fs.stream_feed(spark, path, parts[0].schema, "parquet", files_per_batch=1)
        if not whole:
            with pytest.raises(Exception, match="stored weeks come again"):
                fs.replace_delivered_weeks(stream, root).awaitTermination()
        else:
            fs.replace_delivered_weeks(stream, root, whole=True).awaitTermination()
            same(fs.stored(spark, root, "facts"), parts[0].filter("year_week = '2024-W01'").unionByName(parts[1]))


def test_a_batch_of_the_stream_writes_the_weeks_it_changes(spark):
    parts = [make_facts(spark, range(1, 41)), make_facts(spark, [41])]
    stream = fs.stream_feed(spark, write_files(parts), parts[0].schema, "parquet", files_per_batch=1)
    root = fresh_path(spark, "small")
    fs.update_gold(stream, root, lambda b: b).awaitTermination()
    for name in (fs.TOTALS, fs.GOLD, fs.ALERTS):
        store = WeekStore(spark, f"{root}/{name}")
        first, second = (store.manifest(n).folders for n in (1, 2))
        assert {w for w, f in second.items() if first.get(w) != f} <= {"2024-W41"}
    same(fs.stored(spark, root, fs.GOLD), weekly.gold_from_clean(parts[0].unionByName(parts[1])))


def test_a_batch_that_failed_between_two_tables_goes_on(spark, monkeypatch):
    parts = [make_facts(spark, [1, 2, 3, 4]), make_facts(spark, [4, 5], bump={(4, "A"): (75.0, "X")})]
    path, root, real = write_files(parts), fresh_path(spark, "halfway"), fs.generate_alerts
    stream = lambda: fs.stream_feed(spark, path, parts[0].schema, "parquet", files_per_batch=1)
    calls = []

    def failing(gold, s):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return real(gold, s)

    monkeypatch.setattr(fs, "generate_alerts", failing)
    with pytest.raises(Exception, match="lost"):
        fs.update_gold(stream(), root, lambda b: b).awaitTermination()
    fs.update_gold(stream(), root, lambda b: b).awaitTermination()
    expected = weekly.gold_from_clean(parts[0].filter("year_week <> '2024-W04'").unionByName(parts[1]))
    same(fs.stored(spark, root, fs.GOLD), expected)
    same(fs.stored(spark, root, fs.ALERTS), real(expected)[1])


def test_a_lost_version_or_a_reset_checkpoint_is_an_error(spark):
    store = WeekStore(spark, fresh_path(spark, "lost"))
    facts = make_facts(spark, [1])
    assert store.before(fs.STREAM, 0).number == 0
    store.replace(facts, source=fs.STREAM, token=0)
    assert store.before(fs.STREAM, 0).number == 0  # the first batch, replayed
    store.replace(facts, source=fs.STREAM, token=1)
    for batch_id in (0, 3):
        with pytest.raises(RuntimeError):
            store.before(fs.STREAM, batch_id)


def test_fitted_forest_is_stored_and_used_by_the_refresh(spark):
    from sharetide.operators import detectors, forest
    from sharetide.operators.share import category_totals, shares_from_totals
    from sharetide.operators.shift import share_shifts
    from sharetide.plans.incremental import refresh

    old, new = make_facts(spark, range(1, 9)), make_facts(spark, [9], bump={(9, "A"): (90.0, "X")})
    totals = category_totals(old)
    ruled = detectors.rules_only(share_shifts(shares_from_totals(totals)))
    model, _ = forest.fit_and_score(ruled)
    path = fresh_path(spark, "forest")
    model.save(spark, path)
    loaded = forest.ForestModel.load(spark, path)
    stored_gold = detectors.combine(loaded.transform(ruled))
    done = refresh(totals, stored_gold, new, forest=loaded)
    same(done.gold, weekly.gold_from_clean(old.unionByName(new), forest=model))
    with pytest.raises(ValueError):
        refresh(totals, stored_gold, new, forest="fit")


def test_weekly_run_modes_agree(spark):
    raw = feed(spark, *[{"date": f"2025-0{1 + i % 4}-0{1 + i % 7}", "trx": None if i % 5 == 0 else str(i)} for i in range(40)])
    lazy, staged = weekly.weekly_run(raw), weekly.weekly_run(raw, staged=True)
    for name, table in lazy.tables().items():
        same(table, staged.tables()[name])


def test_work_folder_is_shared_or_local_only(spark, monkeypatch):
    from sharetide import session

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError):
        session.shared_folder(Session())


def test_week_totals_start_on_monday_with_and_without_watermark(spark):
    rows = spark.createDataFrame([("2024-01-07 23:59:59", "R", "B", 1.0), ("2024-01-08 00:00:00", "R", "B", 2.0)], "t string, clean_region string, clean_brand string, clean_trx double")
    events = rows.withColumn("ts", F.to_timestamp("t"))
    for watermark in (None, "1 day"):
        got = {r.week_start: r.brand_trx for r in fs.week_totals(events, watermark=watermark).collect()}
        assert got == {"2024-01-01": 1.0, "2024-01-08": 2.0}


def test_layers_are_checked_when_they_are_written(spark):
    import dataclasses

    run = weekly.weekly_run(feed(spark, *[{"date": f"2025-01-{6 + 7 * i:02d}", "week_number": None, "trx": str(5000 + i)} for i in range(4)]), staged=True)
    wrong = dataclasses.replace(run, cleaned=run.cleaned.withColumn("clean_trx", F.col("clean_trx").cast("string")).drop("iso_date"))
    root = fresh_path(spark, "refused")
    with pytest.raises(ValueError, match="iso_date .missing, not string.*clean_trx .string, not double"):
        weekly.write_layers(wrong, root)
    assert not os.path.exists(root.removeprefix("file:"))
    holes = dataclasses.replace(run, gold=run.gold.withColumn("clean_brand", F.when(F.col("year_week") != "2025-W03", F.col("clean_brand"))))
    with pytest.raises(Exception, match="clean_brand is null"):
        weekly.write_layers(holes, fresh_path(spark, "holes"))
    assert weekly.write_layers(run, fresh_path(spark, "good"))["market_share_gold"].count() == 4


def test_keys_of_a_stream_are_hashed_and_a_null_order_comes_first(spark):
    rows = spark.createDataFrame([(5, "a"), (None, "a"), (7, "b"), (3, "b"), (4, None), (2, None)], "raw_id bigint, k string")
    seen = fs.first_arrivals(rows, ["k"], ["raw_id"], [])
    assert "SortAggregate" not in seen._jdf.queryExecution().executedPlan().toString()
    root, path = fresh_path(spark, "first"), fresh_path(spark, "first-in")
    rows.write.parquet(path)
    fs.dedupe_stream(fs.stream_feed(spark, path, rows.schema, "parquet"), root, ["k"]).awaitTermination()
    assert {r.k: r.raw_id for r in fs.read_output(spark, root, "rows").collect()} == {"a": None, "b": 3, None: 2}
