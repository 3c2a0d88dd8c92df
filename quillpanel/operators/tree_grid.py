"""Boosted and forest screens of a whole grid, grown together from counts of binned rows.

A tree sees of a value only the bin it falls into, so training rows with the same
bins are one cell with two counts, downs and ups.  One pass over the samples makes
the cells of all fits; they lie, by a hash of their bins, in cached blocks.  A
level of the trees is one Spark job for all fits: every task adds up the histograms
of its blocks, a block at a time, and only sums or chosen splits come to the driver.
With few columns the cells stop growing with the rows: bins to the power of columns
is their bound.

Bins, splits, leaves and scores follow ``pyspark.ml``.  A bootstrap sample gives a
row a Poisson weight of mean 1, so a cell gets one with the mean of its count, drawn
from a seed and its bins: equal on any cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import frozen

#: Parts of the cells that share a stream of random draws, cells of a block, and rounds between cached scores.
BUCKETS, BLOCK_CELLS, STORED_ROUNDS = 1024, 100_000, 8
#: Cells whose bootstrap counts for all trees of a forest are held at a time.
DRAWN_CELLS = 10_000
#: Steps of the quantiles that make the bins of a column with too many values to be listed.
ACCURACY = 20_000


@dataclass
class Fit:
    """One fit: its names, columns, settings and, once made, the edges of the bins and the trees."""

    names: dict[str, str]
    columns: tuple[str, ...]
    fold: str
    settings: dict
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    rates: list[float] = field(default_factory=list)

    @property
    def bins(self) -> int:
        return self.settings.get("maxBins", 32)


@dataclass
class Tree:
    """Nodes in heap order: column of the split (-1: leaf), last bin that goes left, and value."""

    column: np.ndarray
    last: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, depth: int) -> Tree:
        n = 2 ** (depth + 1) - 1
        return cls(np.full(n, -1, dtype=np.int16), np.zeros(n, dtype=np.int16), np.zeros(n))

    def nodes(self, bins: np.ndarray, depth: int) -> np.ndarray:
        """The node of each row of ``bins`` after at most ``depth`` steps."""
        at, flat, first = np.zeros(len(bins), dtype=np.intp), bins.ravel(), np.arange(len(bins)) * bins.shape[1]
        # A leaf goes to itself: no bin is beyond its last one.
        leaf, every = self.column < 0, np.arange(len(self.column))
        column, last, next_ = np.where(leaf, 0, self.column).astype(np.intp), np.where(leaf, 255, self.last), np.where(leaf, every, 2 * every + 1)
        for _ in range(depth):
            right = flat[first + column[at]] > last[at]
            at = next_[at]
            at += right
        return at

    def depth(self) -> int:
        return (len(self.column) + 1).bit_length() - 2


def edges_of_counts(values: np.ndarray, counts: np.ndarray, splits: int) -> np.ndarray:
    """Thresholds of ``pyspark.ml`` between sorted distinct values: bins of about equal weight."""
    middle = (values[:-1] + values[1:]) / 2
    if len(middle) <= splits:
        return middle
    out, upto, target = [], np.cumsum(counts), counts.sum() / (splits + 1)
    stride = target
    for i in range(1, len(values)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            out.append(middle[i - 1])
            target += stride
    return np.array(out)


def _usable(df: DataFrame, fit: Fit, split: str) -> DataFrame:
    return df.where((F.col("split") == split) & (F.col("fold") == F.lit(fit.fold))).dropna(subset=list(fit.columns))


def _set_edges(samples: DataFrame, fits: list[Fit]) -> None:
    """Bins of every fit: from all values where they are few, from quantiles of all rows otherwise."""
    alike: dict[tuple, list[Fit]] = {}
    for f in fits:
        alike.setdefault((f.fold, f.columns, f.bins), []).append(f)
    for same in alike.values():
        f = same[0]
        rows = _usable(samples, f, "train").select(*[F.col(c).cast("double").alias(c) for c in f.columns])
        n = rows.count()
        most = max(f.bins ** 2, 10_000)
        if n <= most:  # few enough to be listed
            table = rows.toArrow()
            edges = [edges_of_counts(*np.unique(table.column(c).to_numpy(), return_counts=True), min(f.bins, n) - 1) if n else
                     np.zeros(0) for c in f.columns]
        else:
            shares = [i / f.bins for i in range(1, f.bins)]
            found = rows.agg(*[F.percentile_approx(c, shares, ACCURACY).alias(f"q{i}") for i, c in enumerate(f.columns)],
                             *[F.max(c).alias(f"m{i}") for i, c in enumerate(f.columns)]).first()
            edges = [np.array(sorted({v for v in found[f"q{i}"] if v < found[f"m{i}"]})) for i in range(len(f.columns))]
        for s in same:
            s.edges = edges


def _binned(fit: Fit, values: list[np.ndarray]) -> np.ndarray:
    """Numbers of the bins, a row each."""
    return np.column_stack([np.searchsorted(e, v, side="left") for e, v in zip(fit.edges, values)]).astype(np.uint8)


def _values(batch: pa.RecordBatch, fit: Fit) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of a batch that a fit can use, and their values."""
    values = [batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in fit.columns]
    good = ~np.isnan(np.column_stack(values)).any(axis=1)
    good &= pa.compute.equal(batch.column("fold"), fit.fold).fill_null(False).to_numpy(zero_copy_only=False)
    return good, values


def _cells(samples: DataFrame, fits: list[Fit], label: str) -> DataFrame:
    """(fit, bucket, bins, n, ups): training rows of every fit counted by their bins."""
    columns = sorted({c for f in fits for c in f.columns})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column("_y").to_numpy(zero_copy_only=False)
            for k, fit in enumerate(fits):
                good, values = _values(batch, fit)
                if not good.any():
                    continue
                bins = np.ascontiguousarray(_binned(fit, [v[good] for v in values]))
                found, at = np.unique(bins.view(f"V{bins.shape[1]}").ravel(), return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), k, dtype=np.int32)), pa.array([v.tobytes() for v in found], pa.binary()),
                     pa.array(np.bincount(at, minlength=len(found)).astype(float)),
                     pa.array(np.bincount(at, weights=y[good], minlength=len(found)))], names=["fit", "bins", "n", "ups"])

    rows = samples.where((F.col("split") == "train") & F.col(label).isNotNull()).select(
        F.col("fold").cast("string").alias("fold"), F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in columns])
    part = rows.mapInArrow(run, "fit int, bins binary, n double, ups double")
    counted = part.groupBy("fit", "bins").agg(F.sum("n").alias("n"), F.sum("ups").alias("ups"))
    return frozen(counted.withColumn("bucket", F.pmod(F.xxhash64("bins"), F.lit(BUCKETS)).cast("int")))


def _blocks(cells: DataFrame) -> RDD:
    """Cached blocks (fit, numbers of buckets, bins, downs, ups, scores), sorted; a bucket of a fit lies in one block."""
    tasks = cells.sparkSession.sparkContext.defaultParallelism
    rows = cells.repartition(tasks, "bucket").sortWithinPartitions("fit", "bucket", "bins").select("fit", "bucket", "n", "ups", "bins")

    def blocks(batches: Iterator[tuple]) -> Iterator[tuple]:
        def made(fit, held):
            bucket, n, ups, bins = zip(*held)
            n, ups = np.array(n), np.array(ups)
            return (fit, np.array(bucket), np.frombuffer(b"".join(bins), dtype=np.uint8).reshape(len(n), -1), n - ups, ups, np.zeros(len(n)))

        fit, held = None, []
        for row in batches:
            if held and (row[0] != fit or len(held) >= BLOCK_CELLS and row[1] != held[-1][0]):
                yield made(fit, held)
                held = []
            fit = row[0]
            held.append((row[1], row[2], row[3], bytes(row[4])))
        if held:
            yield made(fit, held)

    return rows.rdd.mapPartitions(blocks).persist(StorageLevel.MEMORY_AND_DISK)


def _histogram(at: np.ndarray, bins: np.ndarray, nodes: int, many: int, *weights: np.ndarray) -> np.ndarray:
    """Sums of each weight by (node, column, bin); ``at`` numbers the nodes, from 0."""
    out = np.empty((len(weights), nodes, bins.shape[1], many))
    for j in range(bins.shape[1]):
        key = at * many + bins[:, j]
        for i, w in enumerate(weights):
            out[i, :, j] = np.bincount(key, weights=w, minlength=nodes * many).reshape(nodes, many)
    return out


def _best(left: np.ndarray, gain: np.ndarray, least: float, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(column, last bin, gain) of each node's best split; ``left`` counts rows by (node, column, last bin)."""
    total = left[:, :, -1:]
    good = (left >= least) & (total - left >= least) & allowed[:, :, None]
    gain = np.where(good, gain, -np.inf).reshape(len(gain), -1)
    best = gain.argmax(axis=1)
    return best // left.shape[2], best % left.shape[2], np.take_along_axis(gain, best[:, None], 1)[:, 0]


def _square(total: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.divide(total ** 2, count, out=np.zeros_like(total), where=count > 0)


def _set_means(tree: Tree, level: int, sums: np.ndarray, least: float) -> None:
    """Least-squares splits of a level's nodes and the mean residuals of the nodes and of those below."""
    first, nodes = 2 ** level - 1, 2 ** level
    count, total = sums.cumsum(axis=3)
    n, s = count[:, 0, -1], total[:, 0, -1]
    rest = total[:, :, -1:] - total, count[:, :, -1:] - count
    gain = _square(total, count) + _square(*rest) - _square(s, n)[:, None, None]
    column, last, best = _best(count, gain, least, np.ones(gain.shape[:2], dtype=bool))
    split = best > 1e-14 * np.maximum(n, 1)
    tree.column[first:first + nodes] = np.where(split, column, -1)
    tree.last[first:first + nodes] = last
    if level == 0:
        tree.value[0] = s[0] / n[0]
    at = np.flatnonzero(split)
    for i, side in enumerate(((total, count), rest)):
        sums_there, n_there = (x[at, column[at], last[at]] for x in side)
        tree.value[2 * (first + at) + 1 + i] = sums_there / n_there


def _boost(blocks: RDD, fits: dict[int, Fit]) -> None:
    """Rounds of all boosted fits together: a job for each level of a round."""
    settings = next(iter(fits.values())).settings
    depth, rounds, rate = settings["maxDepth"], settings["maxIter"], settings["stepSize"]
    many = {k: f.bins for k, f in fits.items()}
    state, before, pending = blocks.filter(lambda b: b[0] in many), None, []
    for r in range(rounds):
        if len(pending) == STORED_ROUNDS:
            old, state, before = before, _advanced(state, pending), state
            pending = []
            if old is not None:
                old.unpersist()
        trees = {k: Tree.empty(depth) for k in fits}
        left = state.map(_residuals(pending, r == 0)).persist(StorageLevel.MEMORY_AND_DISK)
        for level in range(depth):
            sums: dict[int, np.ndarray] = {}
            for k, part in left.mapPartitions(_residual_sums(trees, level, many)).collect():
                sums[k] = sums[k] + part if k in sums else part
            for k, part in sums.items():
                _set_means(trees[k], level, part, settings.get("minInstancesPerNode", 1))
            if all((t.column[2 ** level - 1:2 ** (level + 1) - 1] < 0).all() for t in trees.values()):
                break
        left.unpersist()
        weight = 1.0 if r == 0 else rate
        pending.append((trees, weight))
        for k, fit in fits.items():
            fit.trees.append(trees[k])
            fit.rates.append(weight)
    for used in (state, before):
        if used is not None:
            used.unpersist()


def _score(score: np.ndarray, k: int, bins: np.ndarray, pending: list) -> np.ndarray:
    for trees, weight in pending:
        tree = trees[k]
        score = score + weight * tree.value[tree.nodes(bins, tree.depth())]
    return score


def _advanced(state: RDD, pending: list) -> RDD:
    """The blocks with the scores of more rounds."""
    return state.map(lambda b: (*b[:5], _score(b[5], b[0], b[2], pending))).persist(StorageLevel.MEMORY_AND_DISK)


def _residuals(pending: list, plain: bool):
    """A block's fit, bins, rows and residuals of the labels -1 and 1: the labels if ``plain``, the slope of the log loss after."""
    pending = list(pending)

    def run(block: tuple) -> tuple:
        k, _, bins, downs, ups, score = block
        if plain:
            return k, bins, downs + ups, ups - downs
        score = _score(score, k, bins, pending)
        return k, bins, downs + ups, 4 * ups / (1 + np.exp(2 * score)) - 4 * downs / (1 + np.exp(-2 * score))

    return run


def _residual_sums(trees: dict[int, Tree], level: int, many: dict[int, int]):
    """A task's sums of (rows, residuals) of each fit, by (node of the level, column, bin)."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple[int, np.ndarray]]:
        total: dict[int, np.ndarray] = {}
        for k, bins, *weights in blocks:
            at = trees[k].nodes(bins, level) - (2 ** level - 1)
            here = at >= 0
            if not here.all():
                at, bins, weights = at[here], bins[here], [w[here] for w in weights]
            found = _histogram(at, bins, 2 ** level, many[k], *weights)
            total[k] = total[k] + found if k in total else found
        yield from total.items()

    return run


def _grow(blocks: RDD, fits: dict[int, Fit], class_weights: dict[int, tuple[float, float]]) -> None:
    """All trees of all forests together: a job for each level."""
    settings = next(iter(fits.values())).settings
    depth, many = settings["maxDepth"], settings["numTrees"]
    shape = {k: (len(f.columns), f.bins) for k, f in fits.items()}
    counts = {k: np.zeros((many, 2 ** (depth + 1) - 1, 2)) for k in fits}
    for k, fit in fits.items():
        fit.trees = [Tree.empty(depth) for _ in range(many)]
        fit.rates = [1.0 / many] * many
    for level in range(depth):
        trees = {k: fit.trees for k, fit in fits.items()}
        sums = blocks.mapPartitions(_bagged_sums(trees, level, shape, settings["seed"])).reduceByKey(np.add)
        nodes, below = slice(2 ** level - 1, 2 ** (level + 1) - 1), slice(2 ** (level + 1) - 1, 2 ** (level + 2) - 1)
        chosen = sums.map(_chosen(level, class_weights, settings)).collect()
        for (k, t), column, last, found, children in chosen:
            fits[k].trees[t].column[nodes] = column
            fits[k].trees[t].last[nodes] = last
            counts[k][t, below] = children
            if level == 0:
                counts[k][t, 0] = found[0]
        if all((column < 0).all() for _, column, *_ in chosen):
            break
    for k, fit in fits.items():
        for t, tree in enumerate(fit.trees):
            _pruned(tree, counts[k][t] * class_weights[k])


def _bagged_sums(trees: dict[int, list[Tree]], level: int, shape: dict[int, tuple[int, int]], seed: int):
    """A task's sums of the drawn (downs, ups) of each (fit, tree), by (node of the level, column, bin)."""

    def run(blocks: Iterator[tuple]) -> Iterator[tuple]:
        total: dict[int, np.ndarray] = {}
        nodes = 2 ** level
        done = None
        for k, bucket, bins, downs, ups, _ in blocks:
            if k not in trees:
                continue
            if done is not None and done != k:  # blocks come by fit
                yield from (((done, t), part) for t, part in enumerate(total.pop(done)))
            done = k
            columns, many = shape[k]
            if k not in total:
                total[k] = np.zeros((len(trees[k]), 2, nodes, columns, many))
            for rows, down, up in _drawn(bucket, bins, downs, ups, [seed, k], len(trees[k])):
                for t, tree in enumerate(trees[k]):
                    at = tree.nodes(rows, level) - (nodes - 1)
                    here = at >= 0
                    if here.any():
                        total[k][t] += _histogram(at[here], rows[here], nodes, many, down[t][here], up[t][here])
        if done is not None:
            yield from (((done, t), part) for t, part in enumerate(total.pop(done)))

    return run


def _drawn(bucket: np.ndarray, bins: np.ndarray, downs: np.ndarray, ups: np.ndarray, seed: list[int], trees: int) -> Iterator[tuple]:
    """Runs of cells (bins, downs, ups) with their bootstrap counts, a row a tree; the draws of a bucket have a seed of their own."""
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    begin, down, up = 0, [], []
    for a, b in zip(edges, edges[1:]):
        draw = np.random.default_rng([*seed, int(bucket[a])])
        down.append(draw.poisson(downs[a:b], (trees, b - a)).astype(np.int32))
        up.append(draw.poisson(ups[a:b], (trees, b - a)).astype(np.int32))
        if b - begin >= DRAWN_CELLS or b == len(bucket):
            yield bins[begin:b], np.concatenate(down, axis=1), np.concatenate(up, axis=1)
            begin, down, up = b, [], []


def _chosen(level: int, class_weights: dict[int, tuple[float, float]], settings: dict):
    """Splits of a tree's nodes of one level, least Gini impurity of columns drawn for each node, and the counts of nodes and of those below."""

    def run(item: tuple) -> tuple:
        (k, t), sums = item
        left = sums.cumsum(axis=3)
        found = left[:, :, 0, -1].T
        nodes, columns = sums.shape[1:3]
        w = [c * s for c, s in zip(class_weights[k], left)]
        all_ = [x[:, :, -1:] for x in w]
        rest = [a - x for a, x in zip(all_, w)]
        purity = sum(_square(x, w[0] + w[1]) for x in w) + sum(_square(x, rest[0] + rest[1]) for x in rest)
        whole = sum(_square(a, all_[0] + all_[1]) for a in all_)
        draw = np.random.default_rng([settings["seed"], k, t, level]).random((nodes, columns))
        allowed = draw.argsort(axis=1).argsort(axis=1) < math.ceil(math.sqrt(columns))
        column, last, gain = _best(left.sum(axis=0), purity - whole, settings.get("minInstancesPerNode", 1), allowed)
        at = np.arange(nodes)
        under = left[:, at, column, last].T
        children = np.stack([under, found - under], axis=1).reshape(2 * nodes, 2)
        return (k, t), np.where(gain > 1e-12 * np.maximum((all_[0] + all_[1])[:, 0, 0], 1), column, -1), last, found, children

    return run


def _pruned(tree: Tree, weights: np.ndarray) -> None:
    """Values of the nodes (share of ups); two leaves that vote alike become one, as in ``pyspark.ml``."""
    total = weights.sum(axis=1)
    tree.value = np.divide(weights[:, 1], total, out=np.zeros(len(total)), where=total > 0)
    vote = weights[:, 1] > weights[:, 0]
    for i in reversed(range(len(tree.column) // 2)):
        a, b = 2 * i + 1, 2 * i + 2
        if tree.column[i] >= 0 and tree.column[a] < 0 and tree.column[b] < 0 and vote[a] == vote[b]:
            tree.column[i] = -1
            vote[i] = vote[a]


def fit_trees(samples: DataFrame, fits: list[Fit], label: str = "y_true") -> None:
    """Set the bins and trees of every fit; boosted fits have ``maxIter`` and forests ``numTrees`` in their settings."""
    _set_edges(samples, fits)
    cells = _cells(samples, fits, label)
    kinds: dict[tuple, dict[int, Fit]] = {}
    for k, f in enumerate(fits):
        kinds.setdefault(tuple(sorted(f.settings.items())), {})[k] = f
    blocks = _blocks(cells)
    totals = {r["fit"]: (r["n"] - r["ups"], r["ups"]) for r in cells.groupBy("fit").agg(
        F.sum("n").alias("n"), F.sum("ups").alias("ups")).collect()}
    empty = [f.names for k, f in enumerate(fits) if k not in totals]
    if empty:
        raise ValueError(f"no training rows for {empty}")
    for group in kinds.values():
        if "numTrees" in next(iter(group.values())).settings:
            # Of both classes the same total weight.
            weights = {k: tuple(sum(totals[k]) / (sum(c > 0 for c in totals[k]) * c) if c else 0.0 for c in totals[k]) for k in group}
            _grow(blocks, group, weights)
        else:
            _boost(blocks, group)
    blocks.unpersist()


def score_trees(samples: DataFrame, fits: list[Fit], name: str = "p_up") -> DataFrame:
    """Validation rows of every fit with its names and score."""
    rows = samples.where(F.col("split") == "val")
    held = samples.sparkSession.sparkContext.broadcast(fits)  # the trees of a few fits
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType()),
                           *[T.StructField(n, T.StringType()) for n in fits[0].names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fit in held.value:
                good, values = _values(batch, fit)
                if not good.any():
                    continue
                part = batch.filter(pa.array(good))
                bins = np.ascontiguousarray(_binned(fit, [v[good] for v in values]))
                _, first, at = np.unique(bins.view(f"V{bins.shape[1]}").ravel(), return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(_scored(fit, bins[first])[at]), *[pa.array([v] * part.num_rows) for v in fit.names.values()]],
                    names=schema.names)

    return rows.mapInArrow(run, schema)


def _scored(fit: Fit, bins: np.ndarray) -> np.ndarray:
    total = np.zeros(len(bins))
    for tree, rate in zip(fit.trees, fit.rates):
        total += rate * tree.value[tree.nodes(bins, tree.depth())]
    return total if "numTrees" in fit.settings else 1 / (1 + np.exp(-2 * total))
