"""Copy-on-write by week and exactly-once deliveries."""

import pytest
from pyspark.sql import functions as F

from sharetide.session import fresh_path
from sharetide.sources.versioned import Conflict, DeliveryStore, WeekStore, fingerprint

SCHEMA = "year_week string, brand string, trx double"


def rows(spark, *found):
    return spark.createDataFrame(list(found), SCHEMA)


def told(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_a_change_writes_only_its_weeks_and_versions_stay_readable(spark):
    store = WeekStore(spark, fresh_path(spark, "weeks"))
    assert store.read() is None and store.manifest().number == 0
    store.replace(rows(spark, *[(f"2024-W{w:02d}", b, float(w)) for w in range(1, 41) for b in "abcdefgh"]))
    first = store.read()
    whole = store.size("data")
    store.replace(rows(spark, ("2024-W03", "a", 9.0), ("2024-W41", "b", 8.0)))
    assert store.size("data") - whole < whole / 10
    assert first.count() == 320 == store.read(1).count()
    assert store.read().count() == 320 - 8 + 2
    assert told(store.read(weeks=["2024-W03", "2024-W41", "1999-W01"])) == [("2024-W03", "a", 9.0), ("2024-W41", "b", 8.0)]
    store.replace(rows(spark), weeks=["2024-W41"])
    assert told(store.read(weeks=["2024-W41"])) == [] and store.read().columns == ["year_week", "brand", "trx"]


def test_old_versions_and_leftovers_can_be_dropped(spark):
    store = WeekStore(spark, fresh_path(spark, "weeks"))
    store.replace(rows(spark, ("w1", "a", 1.0), ("w2", "a", 2.0)))
    store.replace(rows(spark, ("w2", "a", 3.0)))
    rows(spark, ("w3", "lost", 4.0)).write.partitionBy("year_week").parquet(f"{store.root}/{store.new_folder(3)}")  # its writer failed
    gone = store.drop_old(keep=1)
    assert len(gone) == 2 and store.numbers() == [2]
    assert told(store.read()) == [("w1", "a", 1.0), ("w2", "a", 3.0)]
    with pytest.raises(ValueError, match="no version 1"):
        store.read(1)
    assert store.drop_old(keep=1) == []


def test_two_writers_and_replayed_changes(spark):
    store = WeekStore(spark, fresh_path(spark, "weeks"))
    store.replace(rows(spark, ("w1", "a", 1.0), (None, "n", 5.0)), source="s", token=0)
    store.replace(rows(spark, ("w1", "again", 2.0)), source="s", token=0)
    assert told(store.read()) == [("w1", "a", 1.0), (None, "n", 5.0)] and store.taken("s", 0) and not store.taken("s", 1)
    stale = store.manifest()
    store.replace(rows(spark, ("w1", "b", 2.0)), source="s", token=1)
    with pytest.raises(Conflict):
        store.publish(type(stale)(number=stale.number + 1))
    assert told(store.read()) == [("w1", "b", 2.0), (None, "n", 5.0)]


def test_deliveries_are_appended_once(spark):
    store = DeliveryStore(spark, fresh_path(spark, "deliveries"))
    one, two = rows(spark, ("w1", "a", 1.0), ("w1", "a", 1.0)), rows(spark, ("w2", "b", 2.0))
    assert store.read() is None
    assert [store.append(one, "d1"), store.append(one.repartition(3), "d1"), store.append(two, "d2"), store.append(two, "d2")] == [True, False, True, False]
    assert told(store.read()) == [("w1", "a", 1.0), ("w1", "a", 1.0), ("w2", "b", 2.0)]
    assert {d: f["rows"] for d, f in store.deliveries().items()} == {"d1": 2, "d2": 1}
    for bad, name, said in ((two, "d1", "other rows"), (one, "d3", "rows of delivery d1"), (one.drop("trx"), "d4", "other columns")):
        with pytest.raises(ValueError, match=said):
            store.append(bad, name)
    assert store.append(rows(spark), "empty") and store.append(rows(spark).filter("false"), "empty too")
    assert store.read().count() == 3


def test_a_half_written_delivery_is_never_read_and_can_be_tried_again(spark):
    store = DeliveryStore(spark, fresh_path(spark, "deliveries"))
    boom = F.udf(lambda x: 1 / 0 if x == "bad" else x, "string")
    broken = rows(spark, ("w1", "a", 1.0), ("w2", "bad", 2.0)).repartition(2).withColumn("brand", boom("brand"))
    with pytest.raises(Exception, match="ZeroDivision"):
        store.append(broken, "d1")
    assert store.read() is None
    good = rows(spark, ("w1", "a", 1.0), ("w2", "fine", 2.0))
    assert store.append(good, "d1") and told(store.read()) == told(good)
    assert fingerprint(good) == fingerprint(good.orderBy(F.desc("brand")))
