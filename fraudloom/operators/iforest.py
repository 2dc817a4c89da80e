"""Isolation forest (Liu, Ting & Zhou 2008) trained on small hashed samples.

Training moves about ``2 * trees * psi`` rows whatever the table's size. The
model has at most ``trees * (2 * psi - 1)`` nodes, which is checked, and scoring
walks all trees at once over Arrow batches.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fraudloom.schemas import KEY_COLS

AUTO_SAMPLES = 256
MAX_NODES = 4_000_000
_OVERDRAW = 2
#: Rows that go down the trees together; all that they need fits a processor's cache.
BATCH = 8192
_NODE_SCHEMA = "tree_id int, node_id int, feature int, threshold double, left int, right int, size int, depth int"


@dataclass(frozen=True)
class ForestModel:
    """``nodes`` is a pandas table of ``_NODE_SCHEMA``, sorted by tree and node."""

    features: list[str]
    psi: int
    seed: int
    nodes: pd.DataFrame

    @property
    def n_trees(self) -> int:
        return int(self.nodes["tree_id"].max()) + 1

    def prefix(self, n_trees: int) -> ForestModel:
        return ForestModel(self.features, self.psi, self.seed, self.nodes[self.nodes["tree_id"] < n_trees])

    def save(self, spark: SparkSession, path: str, mode: str = "errorifexists") -> None:
        header = json.dumps({"features": self.features, "psi": self.psi, "seed": self.seed})
        table = spark.createDataFrame(self.nodes, _NODE_SCHEMA).withColumn("header", F.lit(header))
        table.coalesce(1).write.mode(mode).parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        nodes = spark.read.parquet(path).toPandas()
        header = json.loads(nodes["header"].iloc[0])
        nodes = nodes.drop(columns="header").sort_values(["tree_id", "node_id"], ignore_index=True)
        return ForestModel(header["features"], header["psi"], header["seed"], nodes)


def average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of ``n`` rows."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    grown = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


def isolation_forest_fit(
    df: DataFrame,
    features: list[str],
    n_estimators: int = 100,
    max_samples: int | str = "auto",
    bootstrap: bool = False,
    seed: int = 42,
    key_cols: list[str] | None = None,
    n_rows: int | None = None,
    max_nodes: int = MAX_NODES,
) -> ForestModel:
    """Train on the complete rows of ``df``; the same seed gives the same forest
    under any partitioning. ``n_rows`` skips the count when it is known.

    ``max_nodes`` bounds what the driver collects and broadcasts; raise it with
    the driver's memory. Trees that drew too few candidates are drawn again from
    twice as many, until all have their full sample.
    """
    key_cols = key_cols or KEY_COLS
    n = df.count() if n_rows is None else n_rows
    if n == 0:
        raise ValueError("cannot train on an empty frame")
    psi = min(AUTO_SAMPLES if max_samples == "auto" else int(max_samples), n)
    if n_estimators * (2 * psi - 1) > max_nodes:
        raise ValueError(f"{n_estimators} trees on {psi} rows exceed {max_nodes} nodes")
    narrow = df.select(*key_cols, *features)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        pdf = pdf.sort_values(["_draw", *features], kind="stable").drop_duplicates(key_cols)
        rows = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        return _grow(tree, _draw(rows, psi, n, bootstrap, rng), math.ceil(math.log2(max(psi, 2))), rng)

    overdraw = _OVERDRAW
    while True:
        sample = _sample(narrow, key_cols, n, n_estimators, psi, seed, overdraw)
        nodes = sample.groupBy("_tree").applyInPandas(grow, _NODE_SCHEMA).toPandas()
        roots = nodes[nodes["depth"] == 0]
        whole = n <= 4 * overdraw * psi  # every row was a candidate of every tree
        if whole or (len(roots) == n_estimators and (roots["size"] >= psi).all()):
            break
        overdraw *= 2
    nodes = nodes.sort_values(["tree_id", "node_id"], ignore_index=True)
    return ForestModel(list(features), psi, seed, nodes)


def _sample(df, key_cols, n, trees, psi, seed, overdraw) -> DataFrame:
    """Candidate rows per tree, each with a hash to draw by.

    Large tables: a row is given to as many random trees as its share of the
    overdrawn samples. Small tables: every row is a candidate of every tree.
    """
    if n <= 4 * overdraw * psi:
        spread = df.withColumn("_tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    else:
        share = overdraw * trees * psi / n
        copies = math.ceil(share)
        cut = int(share / copies * 2**31)
        spread = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        taken = F.pmod(F.xxhash64(F.lit(seed), F.lit("take"), "_copy", *key_cols), F.lit(2**31)) < cut
        tree = F.pmod(F.xxhash64(F.lit(seed), F.lit("tree"), "_copy", *key_cols), F.lit(trees)).cast("int")
        spread = spread.filter(taken).withColumn("_tree", tree).drop("_copy")
    draw = F.xxhash64(F.lit(seed), F.lit("draw"), "_tree", *key_cols)
    return spread.withColumn("_draw", draw)


def _draw(rows: np.ndarray, psi: int, n: int, bootstrap: bool, rng: np.random.Generator) -> np.ndarray:
    """The first ``psi`` candidates, or a with-replacement draw of ``psi`` out of ``n``."""
    if not bootstrap:
        return rows[:psi]
    _, times = np.unique(rng.integers(0, n, psi), return_counts=True)
    times = times[: len(rows)]
    return np.repeat(rows[: len(times)], times, axis=0)


def _grow(tree: int, rows: np.ndarray, limit: int, rng: np.random.Generator) -> pd.DataFrame:
    nodes: list[list] = []
    stack = [(np.arange(len(rows)), 0, -1, False)]
    while stack:
        at, depth, parent, is_right = stack.pop()
        node = len(nodes)
        if parent >= 0:
            nodes[parent][5 if is_right else 4] = node
        nodes.append([tree, node, -1, 0.0, node, node, len(at), depth])
        if depth >= limit or len(at) <= 1:
            continue
        low, high = rows[at].min(axis=0), rows[at].max(axis=0)
        open_features = np.flatnonzero(high > low)
        if not len(open_features):
            continue
        feature = int(rng.choice(open_features))
        cut = rng.uniform(low[feature], high[feature])
        goes_left = rows[at, feature] <= cut
        if goes_left.all():
            cut, goes_left = low[feature], rows[at, feature] <= low[feature]
        nodes[node][2:4] = [feature, cut]
        stack.append((at[~goes_left], depth + 1, node, True))
        stack.append((at[goes_left], depth + 1, node, False))
    names = ["tree_id", "node_id", "feature", "threshold", "left", "right", "size", "depth"]
    return pd.DataFrame(nodes, columns=names)


def _flatten(model: ForestModel) -> dict[str, np.ndarray]:
    """All trees in one array, children as absolute positions, leaves looping."""
    nodes = model.nodes
    tree = nodes["tree_id"].to_numpy()
    starts = np.searchsorted(tree, np.arange(model.n_trees))
    base = starts[tree]
    leaf = nodes["feature"].to_numpy() < 0
    return {
        "roots": starts,
        "feature": np.where(leaf, 0, nodes["feature"]).astype(np.int32),
        "threshold": np.where(leaf, np.inf, nodes["threshold"]),
        "left": (nodes["left"].to_numpy() + base).astype(np.int32),
        "right": (nodes["right"].to_numpy() + base).astype(np.int32),
        "length": nodes["depth"].to_numpy() + average_path(nodes["size"].to_numpy()),
        "depth": np.int32(nodes["depth"].max()),
    }


def _path_lengths(flat: dict[str, np.ndarray], rows: np.ndarray) -> np.ndarray:
    """(rows, trees) path lengths: each tree takes all rows one level down at a time, by flat look-ups."""
    columns, line = np.ascontiguousarray(rows.T).ravel(), np.arange(len(rows))
    starts = flat["feature"].astype(np.int64) * len(rows)
    children = np.stack([flat["right"], flat["left"]], axis=1).ravel().astype(np.int64)
    out = np.empty((len(rows), len(flat["roots"])))
    for tree, root in enumerate(flat["roots"]):
        at = np.full(len(rows), root, np.int64)
        for _ in range(int(flat["depth"])):
            # all positions are inside; clipping only spares numpy a second look at them
            value = starts.take(at, mode="clip")
            value += line
            goes_left = columns.take(value, mode="clip") <= flat["threshold"].take(at, mode="clip")
            at += at
            at += goes_left
            at = children.take(at, mode="clip")
        out[:, tree] = flat["length"].take(at)
    return out


def isolation_forest_score(
    model: ForestModel, df: DataFrame, keep: list[str] | None = None, out: str = "anomaly_score",
    prefixes: dict[str, int] | None = None,
) -> DataFrame:
    """``keep`` columns (the row key by default) and a score in [-1, 0]; lower is stranger.

    ``prefixes`` scores with the first trees only: {output column: trees}. Rows
    with a missing feature get a null score.
    """
    keep = KEY_COLS if keep is None else keep
    prefixes = prefixes or {out: model.n_trees}
    scale = float(average_path(model.psi)) or 1.0
    shared = df.sparkSession.sparkContext.broadcast(_flatten(model))
    n_keep, width = len(keep), len(model.features)
    kept = [f for f in df.select(*keep).schema.fields]
    narrow = df.select(*keep, *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(model.features)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = shared.value
        for batch in batches:
            columns = [batch.column(n_keep + i).to_numpy(zero_copy_only=False) for i in range(width)]
            rows = np.column_stack(columns).astype(float)
            lengths = np.concatenate(
                [_path_lengths(flat, rows[i:i + BATCH]) for i in range(0, len(rows), BATCH)] or [np.zeros((0, 1))]
            )
            missing = np.isnan(rows).any(axis=1)
            scores = [
                pa.array(-np.exp2(-lengths[:, :k].mean(axis=1) / scale), mask=missing) for k in prefixes.values()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(n_keep)] + scores, names=[*keep, *prefixes]
            )

    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{p}` double" for p in prefixes])
    return narrow.mapInArrow(score, fields)
