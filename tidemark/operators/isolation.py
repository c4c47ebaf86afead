"""Isolation forests over tables of any length.

Every tree has a sample of rows of its own: those with the least hashes of their id and the tree's number, so that
a table gives the same samples however its rows are dealt. Trees grow in tasks of their own, a tree from a few
hundred rows; the forest, whose size is bounded by trees and sample, is broadcast, and one pass scores all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import number

TREES, SAMPLE = 100, 256
#: Rows that are scored at once, so that what a level needs stays in a core's cache.
_AT_ONCE = 4096
_NODES = "tree int, node int, feature int, cut double, low int, high int, depth double, points int"


def mean_depth(n: float) -> float:
    """Mean depth of a search without success among n points; what a leaf of n points adds to a path."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Nodes of all trees, one tree after the other: feature (-1 for a leaf), cut, children, and a leaf's depth. roots: each tree's first node."""

    feature: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    sample: int

    def _levels(self, root: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A tree level by level: feature, cut and the place of the lower child on the next level, where the upper one comes behind it. A leaf stands again on every level below its own, the last of which tells the nodes."""
        now, out = np.array([root]), []
        while (self.feature[now] >= 0).any():
            inner = self.feature[now] >= 0
            width = np.where(inner, 2, 1)
            first = np.cumsum(width) - width
            below = np.empty(width.sum(), np.int64)
            below[first] = np.where(inner, self.low[now], now)
            below[first[inner] + 1] = self.high[now[inner]]
            out.append((np.where(inner, self.feature[now], 0), np.where(inner, self.cut[now], -np.inf), first - ~inner))
            now = below
        return [*out, (now, now, now)]

    def scores(self, points: np.ndarray) -> np.ndarray:
        """From 0 to 1; the larger the sooner random cuts set a point apart."""
        total = np.zeros(len(points))
        trees = [self._levels(root) for root in self.roots]
        for lo in range(0, len(points), _AT_ONCE):
            own = points[lo : lo + _AT_ONCE]
            flat, row = np.ascontiguousarray(own.T).reshape(-1), np.arange(len(own))
            for *levels, (nodes, _, _) in trees:
                at = np.zeros(len(own), np.int64)
                for feature, cut, first in levels:
                    above = flat[(feature * len(own))[at] + row] >= cut[at]
                    at = first[at]
                    at += above
                total[lo : lo + _AT_ONCE] += self.depth[nodes[at]]
        return 2 ** (-total / max(1, len(self.roots)) / max(mean_depth(self.sample), 1e-9))


def _grow(dim: int, seed: int):
    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        tree = int(rows["tree"].iloc[0])
        points = np.array(rows.sort_values("rank")["point"].tolist(), float).reshape(-1, dim)
        rng = np.random.default_rng([seed, tree])
        most = int(np.ceil(np.log2(max(len(points), 2))))
        nodes: list[list] = [[tree, 0, -1, 0.0, -1, -1, 0.0, 0]]
        stack = [(0, points, 0)]
        while stack:
            at, own, depth = stack.pop()
            nodes[at][7] = len(own)
            low, high = own.min(axis=0), own.max(axis=0)
            varied = np.flatnonzero(high > low)
            if len(own) <= 1 or depth >= most or not len(varied):
                nodes[at][6] = depth + mean_depth(len(own))
                continue
            k = int(rng.choice(varied))
            cut = float(rng.uniform(np.nextafter(low[k], high[k]), high[k]))  # so that both sides have points
            side = own[:, k] < cut
            nodes[at][2:6] = [k, cut, len(nodes), len(nodes) + 1]
            for part in (own[side], own[~side]):
                nodes.append([tree, len(nodes), -1, 0.0, -1, -1, 0.0, 0])
                stack.append((len(nodes) - 1, part, depth + 1))
        return pd.DataFrame(nodes, columns=[c.split()[0] for c in _NODES.split(", ")])

    return grow


def _least(trees: int, sample: int, seed: int):
    """Of each task's rows (h long, point) the ``sample`` with the least hashes for each tree."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            points = b.column("point").flatten().to_numpy(zero_copy_only=False).reshape(len(h), -1)
            for t in range(trees):
                x = (h ^ np.uint64((seed * 1_000_003 + t + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xFF51AFD7ED558CCD)
                x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC4CEB9FE1A85EC53)
                x ^= x >> np.uint64(29)
                if t == len(held):
                    held.append((np.zeros(0, np.uint64), np.zeros((0, points.shape[1]))))
                if len(held[t][0]) == sample:  # few rows of later batches can still be among the least
                    some = np.flatnonzero(x < held[t][0][-1])
                    if not len(some):
                        continue
                    keys, kept = np.concatenate([held[t][0], x[some]]), np.concatenate([held[t][1], points[some]])
                else:
                    keys, kept = np.concatenate([held[t][0], x]), np.concatenate([held[t][1], points])
                first = np.argsort(keys, kind="stable")[:sample]
                held[t] = keys[first], kept[first]
        for t, (keys, kept) in enumerate(held):
            ends = pa.array(np.arange(0, kept.size + 1, max(1, kept.shape[1]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), t, np.int32)), pa.array((keys >> np.uint64(1)).astype(np.int64)), pa.ListArray.from_arrays(ends, pa.array(kept.reshape(-1)))], names=["tree", "key", "point"])

    return task


def _points(df: DataFrame, id_cols: list[str], features: list[str]) -> DataFrame:
    """id columns as a struct, a hash of them and the features, and the point; rows that lack a feature are left out."""
    point = F.array(*[number(df, f) for f in features])
    identity = F.struct(*[F.col(f"`{c}`") for c in id_cols]).alias("id")
    rows = df.select(identity, point.alias("point")).filter(~F.exists("point", lambda x: x.isNull() | F.isnan(x)))
    return rows.select("id", F.xxhash64("id", "point").alias("h"), "point")


def fit(df: DataFrame, id_cols: list[str], features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> Forest:
    """A forest over the rows that have all features. id_cols tell rows apart; rows equal in these and in features are drawn alike."""
    rows = _points(df, id_cols, features)
    drawn = rows.select("h", "point").mapInArrow(_least(trees, sample, seed), "tree int, key long, point array<double>")
    by = Window.partitionBy("tree").orderBy("key", "point")
    best = drawn.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= sample)
    grown = best.groupBy("tree").applyInPandas(_grow(len(features), seed), _NODES).orderBy("tree", "node").toPandas()  # at most 2 * trees * sample nodes
    if not len(grown):
        return Forest(*(np.zeros(0, t) for t in (int, float, int, int, float)), np.zeros(0, int), 1)
    base = grown.groupby("tree").cumcount().rsub(pd.Series(range(len(grown)))).to_numpy()
    moved = [np.where(grown[c] >= 0, grown[c] + base, -1).astype(np.int64) for c in ("low", "high")]
    return Forest(grown["feature"].to_numpy(), grown["cut"].to_numpy(), *moved, grown["depth"].to_numpy(), np.unique(base), int(grown["points"].max()))


def isolation_scores(df: DataFrame, id_cols: list[str], features: list[str], trees: int = TREES, sample: int = SAMPLE, seed: int = 42, forest: Forest | None = None) -> DataFrame:
    """The id columns and score (four decimals) of every row that has all features; without such rows there are none."""
    forest = forest or fit(df, id_cols, features, trees, sample, seed)
    held = df.sparkSession.sparkContext.broadcast(forest)
    dim = len(features)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = b.column("point").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.round(held.value.scores(points), 4))], names=["id", "score"])

    rows = _points(df, id_cols, features).select("id", "point")
    found = rows.mapInArrow(task, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return found.select("id.*", "score")
