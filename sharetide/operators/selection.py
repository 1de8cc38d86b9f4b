"""Ranks of values within groups of any size, without a task that holds a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sharetide.session import stage


def ranked(values: DataFrame, keys: Sequence[str], value: str = "value", copies: str = "copies") -> DataFrame:
    """``values`` (one row per group and value, with its number of copies) with ``upto``, how many lie at or below the value in its
    group, and ``total``, how many the group has.

    Rows are dealt into ranges of (group, value) of about equal size, so a large group takes many tasks.  Each range
    sums up what it has of a group; these sums, at most one per range and group, give every range what lies below it; within
    a range the copies are added up in order.  Rows with a null key are left out.
    """
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = stage(values.repartitionByRange(parts, *keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    group = Window.partitionBy(F.lit(0), *keys)
    below = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range", *keys).agg(F.sum(copies).alias("_n"))
    sums = sums.select("_range", *keys, F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_below"), F.sum("_n").over(group).alias("total"))
    added = dealt.withColumn("_added", F.sum(copies).over(inside))
    return added.join(sums, ["_range", *keys]).withColumn("upto", F.col("_added") + F.col("_below")).drop("_range", "_added", "_below")


def covers(rank: Column, copies: str = "copies") -> Column:
    """Whether a row of :func:`ranked` holds the value of this rank, counted from 0."""
    return (F.col("upto") > rank) & (F.col("upto") - F.col(copies) <= rank)
