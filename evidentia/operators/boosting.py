"""Second-order boosting of regression trees over histograms of gradients.

Features are cut at quantiles once (at all values, if there are no more than bins).
A level of a tree is one pass: tasks add up gradients by node, feature and bin, Spark
adds up the tasks', and at most nodes x features x bins sums reach the driver, which
chooses the splits with L1 and L2 penalties.  A leaf's value comes from the sums of the
split that made it.  Rows carry the margin of the trees so far, renewed every
``RENEW`` trees; the few since then are added on the way.  Rows and features are
sampled for each tree by hashes, so a rerun takes the same.

Gradients are whole multiples of 2^-32, so sums don't depend on their order.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..cluster import ship, staged

RENEW = 25
#: Rows of a task, at least.
LEAST_ROWS = 20_000
#: Tasks up to which their sums go to the driver as they are.
FEW = 16
UNIT = float(1 << 32)


@dataclass
class Tree:
    """Nodes by number: a split has a feature, a bin (rows up to it go left) and two children; a leaf has -1 as feature."""

    feature: list[int] = field(default_factory=lambda: [-1])
    upto: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def grow(self, node: int, feature: int, upto: int, values: tuple[float, float], gain: float) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[node], self.upto[node], self.left[node], self.right[node], self.gain[node] = feature, upto, at, at + 1, gain
        for v in values:
            for held, new in ((self.feature, -1), (self.upto, 0), (self.left, 0), (self.right, 0), (self.value, v), (self.gain, 0.0)):
                held.append(new)
        return at, at + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """Where each row of bins ends up."""
        feature, upto, left, right = (np.array(x) for x in (self.feature, self.upto, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(bins[rows, feature[node]] <= upto[node], left[node], right[node])
        return at

    def values(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


def _binned(values: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    """For each value how many of its feature's edges are below it; what is no number is below all."""
    out = np.zeros(values.shape, np.int16)
    for k, own in enumerate(edges):
        out[:, k] = np.searchsorted(np.array(own), np.nan_to_num(values[:, k], nan=-np.inf), "left")
    return out


@dataclass
class Boosted:
    edges: list[list[float]]
    base: float
    trees: list[Tree] = field(default_factory=list)

    @property
    def getNumTrees(self) -> int:
        return len(self.trees)

    def importances(self) -> list[float]:
        """Each feature's share of all gain per split, as the mean gain of its splits."""
        gain, count = np.zeros(len(self.edges)), np.zeros(len(self.edges))
        for t in self.trees:
            for f, g in zip(t.feature, t.gain):
                if f >= 0:
                    gain[f], count[f] = gain[f] + g, count[f] + 1
        mean = gain / np.maximum(count, 1)
        return (mean / mean.sum() if mean.sum() else mean).tolist()

    def predict(self, features: Column) -> Column:
        edges, base, trees = self.edges, self.base, self.trees

        @F.pandas_udf("double")
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.array([np.full(len(edges), np.nan) if v is None else np.asarray(v, np.float64) for v in part]).reshape(-1, len(edges))
                bins = _binned(x, edges)
                yield pd.Series(base + sum((t.values(bins) for t in trees), np.zeros(len(x))))

        return run(features)

    def save(self, spark: SparkSession, path: str) -> None:
        text = json.dumps({"edges": self.edges, "base": self.base, "trees": [asdict(t) for t in self.trees]})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        held = json.loads(spark.read.option("wholetext", True).text(path).first().value)
        return cls(held["edges"], held["base"], [Tree(**t) for t in held["trees"]])


def shrunk(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(g: np.ndarray, h: np.ndarray, features: list[int], alpha: float, lam: float, least_child: float, least_gain: float) -> tuple[float, int, int, tuple[float, float], tuple[float, float]] | None:
    """(gain, feature, bin, left g and h, right g and h) of a node's sums by feature and bin;
    of equal gains the first feature's lowest bin."""
    best = None
    for f in features:
        left_g, left_h = np.cumsum(g[f])[:-1], np.cumsum(h[f])[:-1]
        right_g, right_h = g[f].sum() - left_g, h[f].sum() - left_h
        score = shrunk(left_g, alpha) ** 2 / (left_h + lam) + shrunk(right_g, alpha) ** 2 / (right_h + lam)
        gain = score - shrunk(g[f].sum(), alpha) ** 2 / (h[f].sum() + lam)
        gain = np.where((left_h >= least_child) & (right_h >= least_child), gain, -np.inf)
        if len(gain) and gain.max() > max(least_gain, best[0] * (1 + 1e-12) if best else 0.0):
            b = int(np.flatnonzero(gain >= gain.max() * (1 - 1e-12))[0])
            best = (float(gain[b]), f, b, (float(left_g[b]), float(left_h[b])), (float(right_g[b]), float(right_h[b])))
    return best


def edges_of(rows: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Each feature's cuts: its values but the largest, if these are fewer than ``bins``, else quantiles."""
    values = [F.col("x")[k] for k in range(width)]
    shares = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.struct(F.approx_count_distinct(v).alias("n"), F.percentile_approx(v, shares, 10_000).alias("q")).alias(f"f{k}") for k, v in enumerate(values)]).first()
    few = [k for k in range(width) if found[k].n < bins * 0.8]
    every = rows.agg(*[F.sort_array(F.collect_set(values[k])).alias(f"f{k}") for k in few]).first() if few else ()  # fewer than bins each, or nearly
    out: list[list[float]] = [sorted({float(q) for q in found[k].q or [] if q == q}) for k in range(width)]
    for k, own in zip(few, every):
        out[k] = [float(v) for v in own if v == v][:-1] if len(own) <= bins else out[k]
    return out


def train(
    vectors: DataFrame,
    features: str = "features",
    label: str = "label",
    trees: int = 200,
    depth: int = 4,
    rate: float = 0.05,
    alpha: float = 0.1,
    lam: float = 1.0,
    rows_share: float = 0.8,
    features_share: float = 0.8,
    least_child: float = 3.0,
    bins: int = 64,
    base: float | None = None,
    seed: int = 42,
) -> Boosted:
    """Trees for the squared error; rows without a label, and vectors of another length than most, are left out."""
    some = vectors.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(F.col(features).cast("array<double>").alias("x"), F.col(label).cast("double").alias("y"))
    found = some.groupBy(F.size("x").alias("w")).agg(F.count("*").alias("n"), (F.sum(F.col("y").cast("decimal(38,18)")) / F.count("*")).cast("double").alias("mean")).orderBy(F.desc("n")).first()
    width, start = found.w, float(found["mean"] if base is None else base)
    some = staged(some.where(F.size("x") == width))
    model = Boosted(edges_of(some, width, bins), start)
    most = max(len(e) for e in model.edges) + 1

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            packed = [r.tobytes() for r in _binned(x, model.edges)]
            keys = [zlib.crc32(p + np.float64(y).tobytes()) << 16 for p, y in zip(packed, batch.column(1).to_pylist())]  # the same wherever a row is read
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), batch.column(1), pa.array(np.full(len(x), start)), pa.array(keys, pa.int64())], ["bins", "y", "margin", "key"])

    ship(some.sparkSession)
    loaded = some.mapInArrow(load, "bins binary, y double, margin double, key long")
    rows = staged(loaded.coalesce(max(1, found.n // LEAST_ROWS)) if found.n < LEAST_ROWS * FEW else loaded)  # few rows: few tasks, as each level is a job
    tasks = rows.rdd.getNumPartitions()
    rng = np.random.default_rng(seed)
    fresh: list[Tree] = []
    for number in range(trees):
        mine = sorted(rng.choice(width, max(1, round(features_share * width)), replace=False).tolist())
        tree, frontier, held = Tree(), [0], None
        for _ in range(depth):
            sums = _histograms(rows, fresh, tree, frontier, width, most, number, rows_share, seed, tasks)
            if held is None:  # the root's sums, for a tree that has no split
                held = sums[0][0][0].sum(), sums[0][1][0].sum()
                tree.value[0] = float(-rate * shrunk(held[0], alpha) / (held[1] + lam)) if held[1] else 0.0
            after = []
            for node, (g, h) in zip(frontier, sums):
                split = best_split(g, h, mine, alpha, lam, least_child, 0.0)
                if split:
                    gain, f, b, left, right = split
                    values = tuple(float(-rate * shrunk(np.float64(s[0]), alpha) / (s[1] + lam)) for s in (left, right))
                    after += tree.grow(node, f, b, values, gain)
            frontier = after
            if not frontier:
                break
        model.trees.append(tree)
        fresh.append(tree)
        if len(fresh) == RENEW and number + 1 < trees:
            rows, fresh = staged(_renewed(rows, fresh, width)), []
    return model


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int16).reshape(-1, width)


def _renewed(rows: DataFrame, fresh: list[Tree], width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _matrix(batch, width)
            margin = batch.column(2).to_numpy() + sum((t.values(bins) for t in fresh), np.zeros(len(bins)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin), batch.column(3)], ["bins", "y", "margin", "key"])

    return rows.mapInArrow(run, "bins binary, y double, margin double, key long")


def _histograms(rows: DataFrame, fresh: list[Tree], tree: Tree, frontier: list[int], width: int, most: int, number: int, share: float, seed: int, tasks: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each node of the frontier the sums of gradients and of second derivatives, by feature and bin."""
    size = len(frontier) * width * most
    place = np.full(len(tree.feature), -1)
    place[frontier] = np.arange(len(frontier))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, h = np.zeros(size), np.zeros(size)
        for batch in batches:
            bins = _matrix(batch, width)
            margin = batch.column(2).to_numpy() + sum((t.values(bins) for t in fresh), np.zeros(len(bins)))
            node = place[tree.nodes(bins)]
            keep = node >= 0
            if share < 1:  # a row's draw for this tree
                draw = batch.column(3).to_numpy().astype(np.uint64) + np.uint64(number * 0x9E3779B97F4A7C15 + seed & (1 << 64) - 1)
                draw = (draw ^ (draw >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                draw = (draw ^ (draw >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                keep &= (draw >> np.uint64(11)).astype(np.float64) / (1 << 53) < share
            gradient = np.round((margin - batch.column(1).to_numpy()) * UNIT)[keep]
            slot = ((node[keep, None] * width + np.arange(width)) * most + bins[keep]).ravel()
            g += np.bincount(slot, np.repeat(gradient, width), size)
            h += np.bincount(slot, minlength=size)
        there = np.flatnonzero(h)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(g[there].astype(np.int64)), pa.array(h[there].astype(np.int64))], ["slot", "g", "h"])

    found = rows.mapInArrow(run, "slot long, g long, h long")
    if tasks > FEW:  # the sums of a few tasks are added up here
        found = found.groupBy("slot").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    told = found.toArrow()
    g, h = np.zeros(size), np.zeros(size)
    slot = told["slot"].to_numpy()
    np.add.at(g, slot, told["g"].to_numpy() / UNIT)
    np.add.at(h, slot, told["h"].to_numpy())
    shape = (len(frontier), width, most)
    return list(zip(g.reshape(shape), h.reshape(shape)))
