"""Ranks within groups of any size."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sharetide.operators import cleaning, quantile
from sharetide.operators.selection import covers, ranked


def skewed(spark):
    """One group with most values, one with a single value, one whose values all tie."""
    r = np.random.default_rng(4)
    rows = [("big", float(x)) for x in r.normal(0, 1, 6000).round(3)] + [("one", 7.0)] + [("tie", 2.0)] * 40 + [("neg", float(x)) for x in range(-9, 8)]
    return spark.createDataFrame(rows, "g string, v double")


def test_ranks_equal_a_sort_and_a_large_group_is_spread(spark):
    df = skewed(spark)
    values = df.groupBy("g", F.col("v").alias("value")).agg(F.count("*").alias("copies"))
    found = ranked(values, ["g"])
    for g, part in df.toPandas().groupby("g"):
        x = np.sort(part["v"].to_numpy())
        for r in found.where(F.col("g") == g).collect():
            assert (r.upto, r.total) == (np.searchsorted(x, r.value, "right"), len(x))
    counts = [r["count"] for r in values.repartitionByRange(8, "g", "value").groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) <= 2 * np.median(counts)
    assert [r.value for r in found.where(covers(F.lit(8))).where("g = 'neg'").collect()] == [-1.0]
    assert ranked(values.where("false"), ["g"]).count() == 0


def test_medians_of_a_group_with_most_rows(spark):
    df = skewed(spark).selectExpr("g AS clean_region", "'t' AS clean_therapeutic_area", "'b' AS clean_brand", "v AS clean_trx", "CAST(NULL AS DOUBLE) AS clean_nrx", "v * 2 AS clean_units")
    expected = df.toPandas().groupby("clean_region")["clean_trx"].median()
    for r in cleaning.group_medians(df).collect():
        assert r._median_clean_trx == expected[r.clean_region] and r._median_clean_nrx is None
        assert r._median_clean_units == 2 * expected[r.clean_region]


@pytest.mark.parametrize("p", [0.0, 0.013, 0.5, 0.9, 1.0])
def test_quantile_of_values_that_tie(spark, p):
    x = np.repeat(np.random.default_rng(1).normal(0, 1, 50), np.arange(1, 51))
    df = spark.createDataFrame([(float(v),) for v in x], "v double").repartition(4)
    assert quantile.exact_quantile(df, "v", p) == pytest.approx(np.quantile(x, p), abs=1e-12)
