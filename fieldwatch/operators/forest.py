"""Isolation forest on Spark: trees grown as groups, rows scored as partitions.

Liu, Ting, Zhou (2008).  Each tree sees at most 256 rows, so a fitted forest is a table of
bounded size (trees x 511 nodes) whatever the training data.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldwatch.config import FEATURES
from fieldwatch.ranks import quantiles

TREE_ROWS = 256
NODE_SCHEMA = "tree int, node int, feature int, split double, size int, leaf boolean"


def _tree_samples(train: DataFrame, columns: Sequence[str], trees: int, seed: int, max_samples: int) -> DataFrame:
    """At most `max_samples` rows per tree, by hash order: the same rows for the same data and seed.

    One rule at every size: about four samples' worth of (row, tree) pairs are drawn by
    hash, a row never twice for one tree, and each tree keeps its first ones.
    """
    wanted = 4 * max_samples * trees
    key = F.xxhash64(*columns, "station_id", "timestamp", F.lit(seed))
    rows = train.crossJoin(F.broadcast(train.agg(F.count(F.lit(1)).alias("_total"))))  # one row
    rows = rows.withColumn("_key", key)
    share = F.pmod(F.col("_key"), F.lit(1_000_003)) / 1_000_003.0
    copies = F.least(F.lit(trees), F.ceil(F.lit(wanted) / F.col("_total"))).cast("int")
    spread = (
        rows.where(share < F.lit(float(wanted)) / F.col("_total"))
        .withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1)))
        .withColumn("tree", F.pmod(F.xxhash64("_key") + F.col("_copy"), F.lit(trees)).cast("int"))
        .withColumn("_order", F.xxhash64("_key", "tree"))
    )
    w = Window.partitionBy("tree").orderBy("_order", "_key")
    return (
        spread.withColumn("_rank", F.row_number().over(w))
        .where(F.col("_rank") <= max_samples)
        .select("tree", *columns)
    )


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One tree as (node, feature, split, size, leaf); children of n are 2n+1 and 2n+2."""
    nodes, todo = [], [(0, 0, np.arange(len(x)))]
    while todo:
        node, depth, idx = todo.pop()
        part = x[idx]
        low, high = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(idx) <= 1 or len(usable) == 0:
            nodes.append((node, -1, 0.0, len(idx), True))
            continue
        f = int(rng.choice(usable))
        # Below the highest value even after rounding, so that neither side is empty.
        cut = float(min(rng.uniform(low[f], high[f]), np.nextafter(high[f], low[f])))
        nodes.append((node, f, cut, len(idx), False))
        left = part[:, f] <= cut
        todo.append((2 * node + 1, depth + 1, idx[left]))
        todo.append((2 * node + 2, depth + 1, idx[~left]))
    return nodes


def fit_forest(
    train: DataFrame, columns: Sequence[str] = FEATURES, trees: int = 100, seed: int = 42, max_samples: int = TREE_ROWS
) -> DataFrame:
    """The forest as a node table.  Rows with a missing feature take no part.

    max_samples: rows a tree is grown on at most; the published algorithm needs few, and
    256 is its usual value.  A tree has at most 2 * max_samples - 1 nodes.
    """
    columns = list(columns)
    limit = int(np.ceil(np.log2(max_samples)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        # Row order within a group is not fixed by Spark; sort for a repeatable tree.
        x = pdf[columns].sort_values(columns).to_numpy(dtype=float)
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit)
        out = pd.DataFrame(nodes, columns=["node", "feature", "split", "size", "leaf"])
        out.insert(0, "tree", tree)
        return out

    sample = _tree_samples(train.dropna(subset=columns), columns, trees, seed, max_samples)
    return sample.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def average_path(n):
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    m = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(m - 1.0) + np.euler_gamma) - 2.0 * (m - 1.0) / m, out)


def score_forest(df: DataFrame, forest: DataFrame, columns: Sequence[str] = FEATURES) -> DataFrame:
    """Adds `raw_score` = -2^(-E[depth] / c): the lower, the more anomalous; null where a
    feature is missing.

    The node table (bounded: 511 rows per tree) is fetched once and broadcast.
    """
    columns = list(columns)
    nodes = forest.toPandas()
    trees = {t: i for i, t in enumerate(sorted(nodes["tree"].unique()))}
    width = 2 ** int(np.ceil(np.log2(nodes["node"].max() + 2))) - 1
    feature = np.full((len(trees), width), -1, dtype=np.int32)
    split = np.zeros((len(trees), width))
    length = np.zeros((len(trees), width))
    t = nodes["tree"].map(trees).to_numpy()
    n = nodes["node"].to_numpy()
    feature[t, n], split[t, n] = nodes["feature"], nodes["split"]
    depth = np.floor(np.log2(n + 1.0))
    length[t, n] = depth + average_path(nodes["size"].to_numpy())
    root = nodes.loc[nodes["node"] == 0, "size"]
    norm = float(np.mean(average_path(root.to_numpy()))) or 1.0
    model = df.sparkSession.sparkContext.broadcast((feature, split, length, norm))
    names = df.columns

    def score(batches):
        feature, split, length, norm = model.value
        deepest = int(np.log2(feature.shape[1] + 1))
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float)
            ok = ~np.isnan(x).any(axis=1)
            total = np.zeros(len(pdf))
            for f, s, depth in zip(feature, split, length):
                at = np.zeros(len(pdf), dtype=np.int64)
                for _ in range(deepest):
                    inner = f[at] >= 0
                    if not inner.any():
                        break
                    value = x[np.arange(len(pdf)), np.maximum(f[at], 0)]
                    at = np.where(inner, 2 * at + 1 + (value > s[at]), at)
                total += depth[at]
            raw = -np.exp2(-(total / len(feature)) / norm)
            yield pdf.assign(raw_score=np.where(ok, raw, np.nan))

    schema = df.select(*names).schema.add("raw_score", "double")
    out = df.mapInPandas(score, schema)
    return out.withColumn("raw_score", F.nanvl("raw_score", F.lit(None)))


def decision_offset(train_scored: DataFrame, contamination: float | None) -> DataFrame:
    """One row: the score below which a row is an anomaly.  None: the fixed value -0.5."""
    if contamination is None:
        return train_scored.sparkSession.range(1).select(F.lit(-0.5).alias("offset"))
    return quantiles(train_scored, [], "raw_score", {"offset": contamination})


def decide(scored: DataFrame, offset: DataFrame) -> DataFrame:
    """`decision_score` (raw - offset), `prediction` (-1 / 1) and `anomaly_flag`."""
    out = scored.crossJoin(F.broadcast(offset))  # one row
    out = out.withColumn("decision_score", F.col("raw_score") - F.col("offset")).drop("offset")
    return out.withColumns(
        {
            "prediction": F.when(F.col("decision_score") < 0, -1).when(F.col("decision_score") >= 0, 1),
            "anomaly_flag": F.coalesce(F.col("decision_score") < 0, F.lit(False)),
        }
    )


def score_bounds(train: DataFrame, score: str) -> DataFrame:
    """One row: the 0.5th and 99.5th percentile of the training scores."""
    return quantiles(train, [], score, {"score_low": 0.005, "score_high": 0.995})


def normalize_scores(df: DataFrame, bounds: DataFrame, score: str, out: str) -> DataFrame:
    """(high - score) / (high - low), within [0, 1]."""
    width = F.greatest(F.col("score_high") - F.col("score_low"), F.lit(1e-6))
    x = (F.col("score_high") - F.col(score)) / width
    return (
        df.crossJoin(F.broadcast(bounds))  # one row
        .withColumn(out, F.when(x < 0, 0.0).when(x > 1, 1.0).otherwise(x))
        .drop("score_low", "score_high")
    )
