"""Connected components of a large graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharetide.session import discard, stage


def components(edges: DataFrame) -> DataFrame:
    """``v``, ``root`` for every vertex of ``edges`` (a, b): root is the least vertex of its component.

    Alternating star contraction: neighbours are hung on the least vertex around, first the larger ones of each
    vertex, then the smaller, until only stars are left.  Each round is one aggregate and one join over edges that
    never grow in number; a table written in the shared folder cuts the lineage.
    """

    def neat(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if larger else pairs
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.join(least, "a")
        if larger:
            return neat(hung.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        return neat(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))))

    now = stage(neat(edges), "edges")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before, last = mark, now
        now = stage(star(star(last, True), False), "edges")
        discard(last)
    return now.select(F.col("a").alias("v"), F.col("b").alias("root")).union(now.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())
