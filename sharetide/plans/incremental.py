"""Bring the stored gold table up to date after a delivery, without reading the facts again.

Kept between runs: the category totals (week, region, brand, category) and the gold table.  A
delivery replaces whole weeks.  What can change is

* every brand's share in a delivered week, of every region;
* in each series, the shift of the next row, the baselines of the next ``lookback + 1`` rows and
  the erosion flag of the next two -- counted in rows of the series, not in calendar weeks;
* the whole history of a brand whose set of categories changed.

Those rows are recomputed from the totals and from the few rows before them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.operators.detectors import combine, no_forest, rules_only
from sharetide.operators.share import (
    BRAND_KEYS,
    brand_categories,
    category_totals,
    shares_from_totals,
)
from sharetide.operators.shift import series_window, share_shifts
from sharetide.schemas import GOLD_KEYS
from sharetide.session import stage
from sharetide.sources.sinks import replace_weeks


@dataclass(frozen=True)
class Refresh:
    """``totals``: the new totals; ``rows``: recomputed gold rows; ``gold``: the new gold table; ``delivered``: the totals of the
    delivered weeks."""

    totals: DataFrame
    rows: DataFrame
    gold: DataFrame
    delivered: DataFrame

    def weeks(self) -> list[str]:
        """Weeks whose totals or gold rows differ from what was stored; as many as a table has weeks at most."""
        found = self.rows.select("year_week").union(self.delivered.select("year_week")).distinct()
        return sorted(r[0] for r in found.collect())


def refresh(
    stored_totals: DataFrame,
    stored_gold: DataFrame,
    delivery: DataFrame,
    s: Settings = Settings(),
    forest=None,
) -> Refresh:
    """Replace the delivered weeks in the totals and recompute the gold rows this affects.

    ``delivery`` holds clean facts.  Segment totals are recomputed from the totals table, which
    has one row per week, region, brand and category and so does not grow with the facts.
    ``forest`` is the fitted model of the run that made the stored gold table, or None for a run without one.
    """
    if isinstance(forest, str):
        raise ValueError("a refresh needs the fitted forest of the stored gold table")
    delivered = stage(category_totals(delivery), "delivered-totals")
    totals = stage(replace_weeks(stored_totals, delivered), "totals")
    weeks = delivered.select("year_week").distinct()

    before = brand_categories(stored_totals, s.on_multi)
    after = brand_categories(totals, s.on_multi)
    sides = before.withColumn("_side", F.lit(1)).unionByName(after.withColumn("_side", F.lit(2)))
    one_sided = sides.groupBy(*before.columns).agg(F.sum("_side").alias("_sides")).filter("_sides <> 3")
    changed = stage(one_sided.select("clean_brand").distinct(), "changed-brands")

    shares = (
        shares_from_totals(totals, s.on_multi)
        .join(weeks.withColumn("_touched", F.lit(True)), "year_week", "left")
        .join(changed.withColumn("_changed", F.lit(True)), "clean_brand", "left")
        .withColumn("_dirty", F.coalesce("_touched", "_changed", F.lit(False)))
        .drop("_touched", "_changed")
    )
    # A brand missing from a replaced week has no row there, yet its next row changes; a marker
    # row stands in for it while the affected rows are found.
    markers = (
        stored_totals.join(weeks, "year_week", "left_semi")
        .select(*BRAND_KEYS)
        .distinct()
        .join(delivered.select(*BRAND_KEYS).distinct(), list(BRAND_KEYS), "left_anti")
        .join(after, "clean_brand")
        .withColumns({"_dirty": F.lit(True), "_marker": F.lit(True)})
    )
    w = series_window()
    reach, history = max(s.lookback + 1, 3), s.lookback + 2
    affected = F.max(F.col("_dirty").cast("int")).over(w.rowsBetween(-reach, 0)) == 1
    needed = F.max(F.col("_affected").cast("int")).over(w.rowsBetween(0, history)) == 1
    scope = (
        shares.unionByName(markers, allowMissingColumns=True)
        .withColumn("_affected", affected)
        .filter(F.col("_marker").isNull())
        .withColumn("_needed", needed)
        .filter("_needed")
        .drop("_dirty", "_marker", "_needed")
    )
    ruled = rules_only(share_shifts(scope), s).filter("_affected").drop("_affected")
    rows = combine(no_forest(ruled)) if forest is None else combine(forest.transform(ruled))
    rows = stage(rows, "affected-gold")
    kept = (
        stored_gold.join(weeks, "year_week", "left_anti")
        .join(changed, "clean_brand", "left_anti")
        .join(rows.select(*GOLD_KEYS), list(GOLD_KEYS), "left_anti")
    )
    return Refresh(totals, rows, kept.select(*rows.columns).unionByName(rows), delivered)
