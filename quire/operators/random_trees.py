"""Extra-random trees (M10) and the selection of features by them.

A node draws features in random order, takes the first few that vary among
its rows, draws one threshold for each uniformly between the feature's least
and greatest value there, and keeps the split that lowers the entropy most.
All rows are used, there is no bootstrap.

A level of all trees takes two aggregates over the rows: least and greatest
values by (tree, node, feature), then class counts left of the drawn
thresholds. Tasks add up their rows, Spark adds up the tasks, and the driver
holds only trees, whose depth bounds them. Draws are hashes of (seed, tree,
node, feature), so neither partitions nor retries change a tree.

A block of rows holds, for each value, its rank among the feature's values in
the block: two bytes instead of eight, and thresholds become ranks as well.
Rows walk down a tree again at each level, all at once, one step for each of
its levels; what they would need to keep instead is rows times trees.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.boosting import spread

#: (node, feature) cells of one aggregate; the trees of a level are worked on in groups of so many.
MAX_CELLS = 2_000_000
#: Bytes of the training table in one partition.
PARTITION_BYTES = 32 << 20
#: Fewer rows are not worth a task; above that the blocks fill the cores.
MIN_ROWS = 5_000


def uniform(*parts) -> np.ndarray:
    """Numbers in [0, 1) that depend on whole numbers or arrays of them."""
    x = np.zeros(1, np.uint64)
    for p in parts:
        x = (x ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / float(1 << 53)


def entropy_mass(counts: np.ndarray) -> np.ndarray:
    """Rows times entropy of class counts (..., 2)."""
    total = counts.sum(axis=-1, keepdims=True)
    share = counts / np.maximum(total, 1)
    return -(counts * np.log(np.where(share > 0, share, 1))).sum(axis=-1)


@dataclass
class RandomTree:
    """Nodes in order of their levels; the children of a split node are
    ``child`` (value <= threshold) and ``child`` + 1; a leaf has feature -1.
    ``path`` numbers nodes as in a full binary tree."""
    number: int
    held: int
    feature: np.ndarray = field(default_factory=lambda: np.full(1, -1, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.zeros(1))
    child: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(1))
    gain: np.ndarray = field(default_factory=lambda: np.zeros(1))
    path: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    start: int = 0

    @property
    def width(self) -> int:
        """Nodes of the last level."""
        return len(self.feature) - self.start

    def nodes(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        moving = np.arange(len(x))
        while len(moving):
            moving = moving[self.feature[at[moving]] >= 0]
            here = at[moving]
            at[moving] = self.child[here] + (x[moving, self.feature[here]] > self.threshold[here])
        return at

    def grow(self, splits: np.ndarray, feature, threshold, gain, left: np.ndarray, right: np.ndarray) -> None:
        """Split the nodes ``splits`` of the last level into children with
        the class counts ``left`` and ``right``."""
        size, n = len(self.feature), 2 * len(splits)
        self.feature[splits], self.threshold[splits], self.gain[splits] = feature, threshold, gain
        self.child[splits] = size + 2 * np.arange(len(splits))
        counts = np.stack([left, right], axis=1).reshape(-1, 2)
        paths = np.stack([2 * self.path[splits] + 1, 2 * self.path[splits] + 2], axis=1).reshape(-1)
        for name, more in (("feature", np.full(n, -1, np.int32)), ("threshold", np.zeros(n)), ("child", np.zeros(n, np.int32)),
                           ("value", counts[:, 1] / np.maximum(counts.sum(axis=1), 1)), ("gain", np.zeros(n)), ("path", paths)):
            setattr(self, name, np.concatenate([getattr(self, name), more]))
        self.start = size

    def importances(self, width: int) -> np.ndarray:
        own = self.feature >= 0
        out = np.bincount(self.feature[own], self.gain[own], width)
        return out / out.sum() if out.sum() > 0 else out


@dataclass
class Group:
    """Trees that grow in the same aggregates, end to end: leaves have
    feature 0 and are their own child; all have the same number of levels."""
    levels: int
    held: list[int]
    starts: list[int]
    widths: list[int]
    ends: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    child: np.ndarray

    @staticmethod
    def of(trees: list[RandomTree], levels: int) -> "Group":
        feature = np.concatenate([t.feature for t in trees]).astype(np.int64)
        leaf = feature < 0
        child = np.concatenate([np.where(t.feature < 0, np.arange(len(t.feature)), t.child) for t in trees])
        return Group(levels, [t.held for t in trees], [t.start for t in trees], [t.width for t in trees],
                     np.cumsum([0] + [len(t.feature) for t in trees]), np.where(leaf, 0, feature),
                     np.concatenate([t.threshold for t in trees]), leaf, child)


def ranked(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The values (row, feature) as ranks among the distinct values of their feature, and these."""
    found = [np.unique(column, return_inverse=True) for column in x.T]
    kind = np.uint16 if max(len(v) for v, _ in found) < 1 << 16 else np.uint32
    return np.stack([ranks.reshape(-1) for _, ranks in found], axis=1).astype(kind), [v for v, _ in found]


def rank_cuts(values: list[np.ndarray], features: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """For each threshold the rank from which on a block's values are greater."""
    out = np.zeros(features.shape, np.int64)
    for f, v in enumerate(values):
        own = features == f
        out[own] = np.searchsorted(v, thresholds[own], "right")
    return out


def last_level(group: Group, x, y, fold, values):
    """For each tree (its number, the rows it is fitted on that reach its last
    level, their places there, the tree's rows by feature and by row, classes)."""
    cuts = np.where(group.leaf, np.iinfo(np.int64).max, rank_cuts(values, group.feature, group.threshold))
    held, rows, cols, cls, every = None, x, None, y, np.arange(len(x))
    for t, (out, start) in enumerate(zip(group.held, group.starts)):
        if cols is None or out != held:
            own = fold != out
            rows, cls = (x, y) if own.all() else (x[own], y[own])
            held, cols, every = out, np.ascontiguousarray(rows.T), np.arange(len(rows))
        tree = slice(group.ends[t], group.ends[t + 1])
        feature, cut, child = group.feature[tree], cuts[tree], group.child[tree]
        flat, width = rows.reshape(-1), rows.shape[1]
        if not group.levels:
            yield t, every, np.zeros(len(rows), np.int64), cols, flat, cls
            continue
        moving, at = every, child[0] + (cols[feature[0]] >= cut[0])
        for level in range(1, group.levels):
            if level % 3 == 1:  # rows in leaves of earlier levels need not walk on
                live = np.flatnonzero(child.take(at) != at)
                moving, at = moving.take(live), at.take(live)
            at = child.take(at) + (flat.take(moving * width + feature.take(at)) >= cut.take(at))
        live = np.flatnonzero(at >= start)
        yield t, moving.take(live), at.take(live) - start, cols, flat, cls


def value_ranges(group: Group, x, y, fold, values) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least and greatest values (node, feature) and class counts (node, 2) of the last levels, tree after tree."""
    size = sum(group.widths)
    low, high = np.full((size, x.shape[1]), np.inf), np.full((size, x.shape[1]), -np.inf)
    counts, bases = np.zeros((size, 2)), np.cumsum([0] + group.widths)
    for t, rows, at, cols, _, cls in last_level(group, x, y, fold, values):
        if not len(rows):
            continue
        width, base = group.widths[t], bases[t]
        counts[base:base + width] = np.bincount(2 * at + cls.take(rows), minlength=2 * width).reshape(-1, 2)
        if width > 1:  # a stable sort of 16-bit numbers takes linear time
            rows = rows.take(np.argsort(at.astype(np.uint16 if width < 1 << 16 else np.int64), kind="stable"))
        n = counts[base:base + width].sum(axis=1).astype(np.int64)
        places = np.flatnonzero(n)
        first = (np.cumsum(n) - n)[places]
        for f, v in enumerate(values):
            own = cols[f].take(rows)
            low[base + places, f] = v.take(np.minimum.reduceat(own, first))
            high[base + places, f] = v.take(np.maximum.reduceat(own, first))
    return low, high, counts


def left_counts(group: Group, features: np.ndarray, thresholds: np.ndarray, x, y, fold, values) -> np.ndarray:
    """Class counts (node, candidate, 2) of the rows at or under each drawn threshold."""
    out, bases = np.zeros((*features.shape, 2)), np.cumsum([0] + group.widths)
    cuts = rank_cuts(values, features, thresholds)
    for t, rows, at, _, flat, cls in last_level(group, x, y, fold, values):
        width, base = group.widths[t], bases[t]
        key, first = 2 * at + cls.take(rows), rows * x.shape[1]
        for j in range(features.shape[1]):
            own = slice(base, base + width)
            under = flat.take(first + features[own, j].take(at)) < cuts[own, j].take(at)
            out[own, j] = np.bincount(key, under, 2 * width).reshape(-1, 2)
    return out


def draw(seed: int, tree: int, path: np.ndarray, low: np.ndarray, high: np.ndarray, k: int):
    """Candidates of nodes: (features, thresholds, which are real), (node, k) each."""
    features = np.arange(low.shape[1])[None, :]
    place = (seed, tree, path[:, None], features)
    order = np.where(high > low, uniform(*place, 0), np.inf)
    chosen = np.argsort(order, axis=1, kind="stable")[:, :k]
    take = lambda a: np.take_along_axis(a, chosen, axis=1)
    lo, hi, real = take(low), take(high), np.isfinite(take(order))
    lo, hi = np.where(real, lo, 0), np.where(real, hi, 0)
    cut = lo + take(uniform(*place, 1)) * (hi - lo)
    return chosen, np.where(cut < hi, cut, lo), real


class RandomTrees(Estimator, HasLabelCol, HasFeaturesCol, HasSeed):
    """``numTrees`` extra-random trees of at most ``maxDepth`` levels for labels 0 and 1.

    ``candidates`` features that vary are tried at a node, by default the
    square root of their number. A node of one class, or with rows that are
    all alike, is a leaf. Rows without a label stay out; NaN counts as 0."""

    numTrees = Param(Params._dummy(), "numTrees", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    candidates = Param(Params._dummy(), "candidates", "features tried at a node, 0: the square root", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, labelCol="label", featuresCol="features", numTrees=1000, maxDepth=18, candidates=0, seed=0):
        super().__init__()
        self._setDefault(labelCol="label", featuresCol="features", numTrees=1000, maxDepth=18, candidates=0, seed=0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "RandomTreesModel":
        return self._forests(dataset, F.lit(-1), [-2])[0]

    def fit_folds(self, dataset: DataFrame, fold_col: str, n_folds: int) -> list["RandomTreesModel"]:
        """The forests of all folds, forest k fitted on the rows of the other folds, grown in the same jobs."""
        return self._forests(dataset, F.coalesce(F.col(fold_col).cast("int"), F.lit(-1)), list(range(n_folds)))

    def _forests(self, dataset: DataFrame, fold, held: list[int]) -> list["RandomTreesModel"]:
        get = self.getOrDefault
        rows = dataset.select(vector_to_array(get("featuresCol")).alias("a"), F.col(get("labelCol")).cast("int").alias("y"),
                              fold.alias("fold")).where("y is not null")
        first = rows.first()
        if first is None:
            raise ValueError("no labelled rows to fit on")
        width = len(first["a"])

        def block(part):
            part = list(part)
            if part:
                x, values = ranked(np.nan_to_num(np.array([r["a"] for r in part], float)))
                yield x, np.array([r["y"] for r in part], np.int64), np.array([r["fold"] for r in part], np.int64), values
        n_rows = rows.count()
        parts = max(1, -(-n_rows * (8 * width + 16) // PARTITION_BYTES),
                    min(dataset.sparkSession.sparkContext.defaultParallelism, n_rows // MIN_ROWS))
        blocks = spread(rows, parts).rdd.mapPartitions(block).persist(StorageLevel.MEMORY_AND_DISK_DESER)
        trees = [RandomTree(i, h) for h in held for i in range(get("numTrees"))]
        open_trees = trees
        for level in range(get("maxDepth")):
            grown = []
            for group in self._groups(open_trees, width):
                grown += self._grow(blocks, group, width, level)
            open_trees = grown
        blocks.unpersist()
        n = get("numTrees")
        return [self._copyValues(RandomTreesModel(trees[i:i + n], width)) for i in range(0, len(trees), n)]

    @staticmethod
    def _groups(trees: list[RandomTree], width: int):
        group, cells = [], 0
        for t in trees:
            if group and cells + t.width * width > MAX_CELLS:
                yield group
                group, cells = [], 0
            group.append(t)
            cells += t.width * width
        if group:
            yield group

    def _grow(self, blocks, trees: list[RandomTree], width: int, level: int) -> list[RandomTree]:
        """One more level; the trees that have split nodes."""
        sent = blocks.context.broadcast(Group.of(trees, level))
        low, high, counts = blocks.map(lambda b: value_ranges(sent.value, *b)).treeReduce(
            lambda a, b: (np.minimum(a[0], b[0]), np.maximum(a[1], b[1]), a[2] + b[2]))
        k = min(width, self.getOrDefault("candidates") or max(1, int(width ** 0.5)))
        bases = np.cumsum([0] + [t.width for t in trees])
        drawn = [draw(self.getOrDefault("seed"), t.number, t.path[t.start:], low[b:b + t.width], high[b:b + t.width], k)
                 for t, b in zip(trees, bases)]
        features, thresholds, real = (np.concatenate([d[i] for d in drawn]) for i in range(3))
        left = blocks.map(lambda b: left_counts(sent.value, features, thresholds, *b)).treeReduce(np.add)
        sent.destroy()
        right = counts[:, None, :] - left
        gain = np.where(real, entropy_mass(counts)[:, None] - entropy_mass(left) - entropy_mass(right), -np.inf)
        best = gain.argmax(axis=1)
        split = (counts.min(axis=1) > 0) & real.any(axis=1)
        out = []
        for t, b in zip(trees, bases):
            if t.start == 0:
                t.value[0] = counts[b, 1] / max(counts[b].sum(), 1)
            own = np.flatnonzero(split[b:b + t.width])
            if len(own):
                at, j = b + own, best[b + own]
                t.grow(t.start + own, features[at, j], thresholds[at, j], np.maximum(gain[at, j], 0), left[at, j], right[at, j])
                out.append(t)
        return out


class RandomTreesModel(Model, HasFeaturesCol, HasLabelCol):
    """Mean share of class 1 in the trees' leaves; ``transform`` adds
    ``probability`` and ``prediction``."""

    def __init__(self, trees=None, width=0):
        super().__init__()
        self.trees, self.width = trees or [], width

    @property
    def importances(self) -> np.ndarray:
        """Entropy that the splits on each feature take away, one in sum, mean of the trees."""
        out = np.mean([t.importances(self.width) for t in self.trees], axis=0)
        return out / out.sum() if out.sum() > 0 else out

    def _transform(self, dataset: DataFrame) -> DataFrame:
        # trees are bounded by their depth; sent once to each executor, not with each task
        sent = dataset.sparkSession.sparkContext.broadcast([(t.feature, t.threshold, t.child, t.value) for t in self.trees])

        @F.pandas_udf("double")
        def share(a: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series([], dtype=float)
            x, total = np.nan_to_num(np.stack(a.to_numpy())), np.zeros(len(a))
            for feature, threshold, child, value in sent.value:
                total += value[RandomTree(0, 0, feature, threshold, child).nodes(x)]
            return pd.Series(total / len(sent.value))
        out = dataset.withColumn("_p", share(vector_to_array(self.getOrDefault("featuresCol"))))
        p = F.col("_p")
        return (out.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
                .withColumn("prediction", (p > 0.5).cast("double")).drop("_p"))


def select_per_fold(train: DataFrame, label: str, fold_col: str, n_folds: int, trees: int = 500, depth: int = 6,
                    seed: int = 0) -> list[tuple[list[int], np.ndarray]]:
    """For each fold, the features whose importance in extra-random trees
    fitted on the other folds is at least the mean, and all importances."""
    found = RandomTrees(labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit_folds(train, fold_col, n_folds)
    return [(np.flatnonzero(m.importances >= m.importances.mean()).tolist(), m.importances) for m in found]
