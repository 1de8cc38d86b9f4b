"""Isolation forest (Liu, Ting and Zhou, 2008) fitted and scored as Spark jobs.

Sampling is by hash of the row key, so the same rows and seed give the same forest whatever the
partitioning.  Each tree is grown in its own group from at most ``tree_sample`` rows; the forest
(at most ``n_trees * (2 * tree_sample - 1)`` nodes, independent of the data) is broadcast for
scoring.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sharetide.config import Settings
from sharetide.operators.quantile import exact_quantile
from sharetide.schemas import GOLD_KEYS, no_nan
from sharetide.session import spread, stage

FEATURES = ("clean_trx", "market_share_trx_pct", "share_shift_pp", "momentum_ratio")
_NODE_SCHEMA = "tree int, node int, feature int, threshold double, lower int, upper int, depth double"
_HASH_SPAN = 1 << 40
_ARRAYS = ("feature", "threshold", "lower", "upper", "depth")
_MODEL_SCHEMA = (
    "feature array<array<int>>, threshold array<array<double>>, lower array<array<int>>, upper array<array<int>>, "
    "depth array<array<double>>, sample int, levels int, columns array<string>, offset double"
)


def expected_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one random tree: (node, feature, threshold, lower, upper, depth at a leaf)."""
    nodes: list[tuple] = []
    waiting = [(0, points, 0)]
    made = 1
    while waiting:
        node, part, level = waiting.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if level >= limit or len(part) < 2 or not len(splittable):
            nodes.append((node, -1, 0.0, -1, -1, level + expected_depth(len(part))))
            continue
        feature = int(rng.choice(splittable))
        cut = float(rng.uniform(low[feature], high[feature]))
        goes_low = part[:, feature] <= cut
        nodes.append((node, feature, cut, made, made + 1, 0.0))
        waiting.append((made, part[goes_low], level + 1))
        waiting.append((made + 1, part[~goes_low], level + 1))
        made += 2
    return nodes


def _features(df: DataFrame, features: Sequence[str]) -> DataFrame:
    cleaned = no_nan(df, *features)
    return cleaned.withColumns(
        {f"_x{i}": F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for i, c in enumerate(features)}
    )


@dataclass(frozen=True)
class ForestModel:
    """A fitted forest: one padded array per node attribute, indexed [tree, node]."""

    feature: np.ndarray
    threshold: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    depth: np.ndarray
    sample: int
    levels: int
    columns: tuple[str, ...]
    offset: float = 0.0

    def raw_score(self, df: DataFrame, name: str) -> DataFrame:
        """Add the anomaly score in (0, 1], higher meaning easier to isolate."""
        shared = df.sparkSession.sparkContext.broadcast(
            (self.feature, self.threshold, self.lower, self.upper, self.depth)
        )
        levels, scale = self.levels, max(expected_depth(self.sample), 1e-12)

        @F.pandas_udf("double")
        def score(points: pd.DataFrame) -> pd.Series:
            feature, threshold, lower, upper, depth = shared.value
            x = points.to_numpy(dtype=np.float64)
            row = np.arange(len(x))
            total = np.zeros(len(x))
            for t in range(len(feature)):
                at = np.zeros(len(x), dtype=np.int32)
                for _ in range(levels):
                    f = feature[t, at]
                    down = np.where(x[row, np.maximum(f, 0)] <= threshold[t, at], lower[t, at], upper[t, at])
                    at = np.where(f < 0, at, down)
                total += depth[t, at]
            return pd.Series(np.power(2.0, -total / len(feature) / scale))

        inputs = F.struct(*[F.col(f"_x{i}") for i in range(len(self.columns))])
        scored = _features(df, self.columns).withColumn(name, score(inputs))
        return scored.drop(*[f"_x{i}" for i in range(len(self.columns))])

    def label(self, df: DataFrame, raw: str) -> DataFrame:
        """Turn the raw score into decision score, label (-1 anomalous, 1 normal) and flag."""
        decision = -F.col(raw) - F.lit(self.offset)
        return (
            df.withColumn("isolation_forest_score", decision)
            .withColumn("isolation_forest_anomaly", F.col("isolation_forest_score") < 0)
            .withColumn("isolation_forest_label", F.when(F.col("isolation_forest_anomaly"), -1).otherwise(1))
            .drop(raw)
        )

    def transform(self, df: DataFrame) -> DataFrame:
        return self.label(self.raw_score(df, "_raw"), "_raw")

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the model as one row; its size depends on the settings only."""
        arrays = [getattr(self, n).tolist() for n in _ARRAYS]
        row = (*arrays, self.sample, self.levels, list(self.columns), float(self.offset))
        spark.createDataFrame([row], _MODEL_SCHEMA).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ForestModel:
        r = spark.read.schema(_MODEL_SCHEMA).parquet(path).first()
        kinds = [np.float64 if n in ("threshold", "depth") else np.int32 for n in _ARRAYS]
        return cls(*[np.asarray(r[n], k) for n, k in zip(_ARRAYS, kinds)], r["sample"], r["levels"], tuple(r["columns"]), r["offset"])


def _hash(keys: Sequence[str], *extra: Column) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k) for k in keys], *extra), F.lit(_HASH_SPAN))


def fit_forest(
    df: DataFrame,
    s: Settings = Settings(),
    keys: Sequence[str] = GOLD_KEYS,
    columns: Sequence[str] = FEATURES,
) -> ForestModel:
    """Grow the trees.  ``df`` is read twice (count, sample), so hand in a stored table.

    Every tree takes the ``tree_sample`` rows with the smallest hash of (key, tree), whatever their
    number.  A limit on that hash keeps most other rows from being ranked at all: it leaves a tree
    ``tree_sample`` rows and ten standard deviations more.  Spark applies the rank limit before the shuffle
    as well.
    """
    n = df.count()
    if n == 0:
        raise ValueError("an isolation forest needs at least one row")
    sample = min(s.tree_sample, n)
    levels = max(int(np.ceil(np.log2(max(sample, 2)))), 1)
    share = min(1.0, (sample + 10 * np.sqrt(sample)) / n)
    pool = _features(df, columns).select(*keys, *[f"_x{i}" for i in range(len(columns))])
    draw = _hash(keys, F.col("tree"), F.lit(s.seed))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(draw, *keys))
    drawn = (
        pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(s.n_trees - 1))))
        .filter(draw < int(_HASH_SPAN * share) + 1)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= sample)
        .drop(*keys)
    )
    width, seed = len(columns), s.seed

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank")
        tree = int(rows["tree"].iloc[0])
        points = rows[[f"_x{i}" for i in range(width)]].to_numpy(dtype=np.float64)
        nodes = grow_tree(points, np.random.default_rng([seed, tree]), levels)
        return pd.DataFrame(
            [(tree, *n) for n in nodes],
            columns=["tree", "node", "feature", "threshold", "lower", "upper", "depth"],
        )

    nodes = spread(drawn, "tree").groupBy("tree").applyInPandas(grow, _NODE_SCHEMA).toPandas()
    shape = (s.n_trees, int(nodes["node"].max()) + 1)
    where = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())

    def table(name: str, dtype, fill) -> np.ndarray:
        out = np.full(shape, fill, dtype=dtype)
        out[where] = nodes[name].to_numpy()
        return out

    return ForestModel(
        table("feature", np.int32, -1),
        table("threshold", np.float64, 0.0),
        table("lower", np.int32, -1),
        table("upper", np.int32, -1),
        table("depth", np.float64, 0.0),
        sample,
        levels,
        tuple(columns),
    )


def fit_and_score(
    df: DataFrame,
    s: Settings = Settings(),
    keys: Sequence[str] = GOLD_KEYS,
    columns: Sequence[str] = FEATURES,
) -> tuple[ForestModel, DataFrame]:
    """Fit on all rows, set the offset so that ``contamination`` of them lie below it, and
    return the model with the labelled rows.  Features and scores are each written once."""
    rows = stage(df, "forest-rows")
    grown = fit_forest(rows, s, keys, columns)
    scored = stage(grown.raw_score(rows, "_raw"), "forest-scores")
    cut = exact_quantile(scored.select((-F.col("_raw")).alias("v")), "v", s.contamination)
    model = ForestModel(**{**grown.__dict__, "offset": float(cut)})
    return model, model.label(scored, "_raw")


def isolation_forest(
    df: DataFrame, s: Settings = Settings(), keys: Sequence[str] = GOLD_KEYS
) -> DataFrame:
    """Add label, score and flag; neutral values when there are no rows to fit on."""
    from sharetide.operators.detectors import no_forest

    if df.isEmpty():
        return no_forest(df)
    return fit_and_score(df, s, keys)[1]
