"""Explanations of a tree ensemble: exact Shapley values, path attributions, importance, and the nearest flip along a feature.

An ensemble is a list of leaves. A leaf's path names, for each feature it splits on, the interval a row must lie in and the share of
training rows that go the leaf's way at those splits. A row whose features S are known reaches the leaf with weight 1 or 0 for those
in S, by its intervals, and by the shares for the others; so the value of S is a sum over leaves of a product over the path's
features, and a feature's Shapley value sums its leaf's products over subsets by their size: the coefficients of a polynomial of the
path's length.

Between the thresholds of a tree nothing changes: its cells (one stretch of each feature it splits on) are explained once on the driver, and
rows look their cells up, with numpy on Arrow batches. Work is rows x trees; a tree of too many cells is explained row by row instead, in
rows x leaves x path squared."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Leaf:
    """value: the leaf's part of the margin; path: feature to (low, high, share); steps: change of the mean by feature along the path."""

    tree: int
    value: float
    path: dict[int, tuple[float, float, float]]
    steps: dict[int, float] = field(default_factory=dict)


@dataclass
class Ensemble:
    """Leaves of all trees and the gain of each feature's splits; base is the margin's mean over the training rows."""

    n_features: int
    leaves: list[Leaf]
    gains: np.ndarray
    base: float

    def thresholds(self, feature: int) -> np.ndarray:
        return np.unique([x for leaf in self.leaves for f, (low, high, _) in leaf.path.items() if f == feature for x in (low, high) if np.isfinite(x)])

    def reached(self, x: np.ndarray, leaf: Leaf) -> np.ndarray:
        """For each row, whether it lies in the interval of each feature of the leaf's path; NaN lies above all thresholds."""
        out = np.ones((len(x), len(leaf.path)), bool)
        for j, (f, (low, high, _)) in enumerate(leaf.path.items()):
            v = np.where(np.isnan(x[:, f]), np.inf, x[:, f])
            out[:, j] = (v > low) & (v <= high)
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        for leaf in self.leaves:
            out += leaf.value * self.reached(x, leaf).all(axis=1)
        return out

    def shapley(self, x: np.ndarray) -> np.ndarray:
        """Rows x features: contributions that, with base, add up to the margin."""
        out = np.zeros((len(x), self.n_features))
        for leaf in self.leaves:
            inside, d = self.reached(x, leaf).astype(float), len(leaf.path)
            shares = [s for _, _, s in leaf.path.values()]
            for i, f in enumerate(leaf.path):
                # Coefficient k: the sum over subsets of k other features of their products.
                sums = np.zeros((d, len(x)))
                sums[0] = 1.0
                for n, j in enumerate(j for j in range(d) if j != i):
                    sums[1 : n + 2] = sums[1 : n + 2] * shares[j] + sums[: n + 1] * inside[:, j]
                    sums[0] *= shares[j]
                weight = np.array([factorial(k) * factorial(d - 1 - k) / factorial(d) for k in range(d)])
                out[:, f] += leaf.value * (inside[:, i] - shares[i]) * (weight @ sums)
        return out

    def path_attributions(self, x: np.ndarray) -> np.ndarray:
        """The changes of the mean along each row's own path, by the feature split on: linear in depth, additive, not fair to interactions."""
        out = np.zeros((len(x), self.n_features))
        for leaf in self.leaves:
            here = self.reached(x, leaf).all(axis=1)
            for f, step in leaf.steps.items():
                out[here, f] += step
        return out

    def nearest_flip(self, x: np.ndarray, feature: int) -> np.ndarray:
        """The value of the feature nearest to the row's own at which the margin's sign changes, NaN if it does nowhere. The margin is
        constant between thresholds: each stretch is tried at its nearest point."""
        cut, own, sign = self.thresholds(feature), x[:, feature], self.margin(x) > 0
        best = np.full(len(x), np.nan)
        for low, high in zip([-np.inf, *cut], [*cut, np.inf], strict=True):
            # The stretch (low, high]: from above its nearest point is high, from below the next number above low.
            tried = np.where(own > high, high, np.where(own <= low, np.nextafter(low, np.inf), own))
            moved = x.copy()
            moved[:, feature] = tried
            flips = np.isfinite(tried) & ((self.margin(moved) > 0) != sign)
            better = flips & (np.isnan(best) | (np.abs(tried - own) < np.abs(best - own)))
            best[better] = tried[better]
        return best


#: Cells of a tree that are worth a table; all arrays of one take 8 (2 n_features + 1) bytes a cell.
CELLS = 1 << 16


class Tables:
    """The margin, Shapley values and path attributions of every cell of every tree, and what rows of inputs find in them. A feature's
    stretches are numbered by its thresholds in the whole ensemble; places has, for each tree and feature it splits on, what a stretch
    adds to the number of the tree's cell."""

    def __init__(self, e: Ensemble):
        self.n, self.cuts, self.trees, wide = e.n_features, [e.thresholds(f) for f in range(e.n_features)], [], []
        own: dict[int, list[Leaf]] = {}
        for leaf in e.leaves:
            own.setdefault(leaf.tree, []).append(leaf)
        for leaves in own.values():
            tree = Ensemble(e.n_features, leaves, e.gains, 0.0)
            cuts = [tree.thresholds(f) for f in range(self.n)]
            size, places = 1, {}
            for f, cut in enumerate(cuts):
                if len(cut):
                    # The stretch (low, high] of the ensemble lies in one of the tree's.
                    places[f] = size * np.searchsorted(cut, np.append(self.cuts[f], np.inf))
                    size *= len(cut) + 1
            if size > CELLS:
                wide += leaves
                continue
            # One row in each cell: the upper ends of its stretches.
            at, rows = np.arange(size), np.zeros((size, self.n))
            for f in places:
                rows[:, f] = np.append(cuts[f], np.inf)[at % (len(cuts[f]) + 1)]
                at //= len(cuts[f]) + 1
            self.trees.append((places, tree.margin(rows), tree.shapley(rows), tree.path_attributions(rows)))
        self.rest = Ensemble(e.n_features, wide, e.gains, 0.0)

    def stretches(self, x: np.ndarray) -> list[np.ndarray]:
        """For each feature, the number of each row's stretch; NaN lies above all thresholds."""
        return [np.searchsorted(cut, x[:, f]) for f, cut in enumerate(self.cuts)]

    def cells(self, at: list[np.ndarray]) -> list[np.ndarray]:
        """For each tree, the number of each row's cell."""
        out = []
        for places, *_ in self.trees:
            cell = np.zeros(len(at[0]) if at else 0, np.int64)
            for f, place in places.items():
                cell += place[at[f]]
            out.append(cell)
        return out

    def margin(self, x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(x))
        for (_, margin, _, _), cell in zip(self.trees, cells, strict=True):
            out += margin[cell]
        return out + self.rest.margin(x)

    def shapley(self, x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        """Rows x features: contributions that, with the ensemble's base, add up to the margin."""
        out = np.zeros((len(x), self.n))
        for (_, _, shapley, _), cell in zip(self.trees, cells, strict=True):
            out += shapley[cell]
        return out + self.rest.shapley(x)

    def path_attributions(self, x: np.ndarray, cells: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(x), self.n))
        for (_, _, _, steps), cell in zip(self.trees, cells, strict=True):
            out += steps[cell]
        return out + self.rest.path_attributions(x)

    def nearest_flip(self, x: np.ndarray, feature: int, at: list[np.ndarray], cells: list[np.ndarray]) -> np.ndarray:
        """The value of the feature nearest to the row's own at which the margin's sign changes, the lower of two as near, NaN if it does
        nowhere. The margin is constant within a stretch (low, high]: from above its nearest point is high, from below the next number
        above low, so the nearest stretches below and above that change the sign decide."""
        cut, own, here, sign = self.cuts[feature], x[:, feature], at[feature], self.margin(x, cells) > 0
        below, above = np.full(len(x), -1), np.full(len(x), len(cut) + 1)
        moved = x.copy()
        for j in range(len(cut) + 1):
            there = [cell + (places[feature][j] - places[feature][here]) if feature in places else cell for (places, *_), cell in zip(self.trees, cells, strict=True)]
            moved[:, feature] = cut[j] if j < len(cut) else np.inf
            flips = (self.margin(moved, there) > 0) != sign
            below[flips & (j < here)] = j
            above[flips & (j > here) & (above > j)] = j
        ends = np.append(cut, np.nan)
        low = np.where(below >= 0, ends[below], np.nan)
        high = np.where(above <= len(cut), np.nextafter(ends[above - 1], np.inf), np.nan)
        best = np.where(np.isnan(high) | (np.abs(low - own) <= np.abs(high - own)), low, high)
        return np.where(np.isnan(own), np.nan, best)


def of_spark(model, n_features: int) -> Ensemble:
    """The ensemble of a fitted model of Spark's boosted trees: its nodes are few, and read on the driver."""
    leaves, gains, base = [], np.zeros(n_features), 0.0
    for t, (tree, weight) in enumerate(zip(model.trees, model.treeWeights, strict=True)):
        root = tree._java_obj.rootNode()
        means: dict[int, tuple[float, float]] = {}

        def mean(node, means=means):
            """(rows, mean prediction) of a node, from its leaves."""
            key = node.hashCode()
            if key not in means:
                if node.subtreeDepth():
                    (n, a), (m, b) = mean(node.leftChild()), mean(node.rightChild())
                    means[key] = (n + m, (n * a + m * b) / (n + m))
                else:
                    means[key] = (float(node.impurityStats().count()), float(node.prediction()))
            return means[key]

        def walk(node, path, steps, t=t, weight=weight):
            if not node.subtreeDepth():
                leaves.append(Leaf(t, weight * float(node.prediction()), path, steps))
                return
            f, at, (rows, own) = int(node.split().featureIndex()), float(node.split().threshold()), mean(node)
            gains[f] += weight * float(node.gain()) * rows
            low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
            for child, a, b in ((node.leftChild(), low, min(high, at)), (node.rightChild(), max(low, at), high)):
                n, m = mean(child)
                walk(child, path | {f: (a, b, share * n / rows)}, steps | {f: steps.get(f, 0.0) + weight * (m - own)})

        walk(root, {}, {})
        base += weight * mean(root)[1]
    return Ensemble(n_features, leaves, gains, base)


def explained(rows: DataFrame, inputs: list[str], ensemble: Ensemble, flips: tuple[str, ...] = (), parts: tuple[str, ...] = ("contributions", "path_attributions"), show: int = 0) -> DataFrame:
    """rows with margin, those asked for of contributions and path_attributions (arrays in order of inputs), waterfall of the `show`
    largest contributions if there are to be any, and flip_<input> for those asked for; inputs are taken as doubles, null as NaN."""
    shared = rows.sparkSession.sparkContext.broadcast(Tables(ensemble))
    at, base = [rows.columns.index(c) for c in inputs], ensemble.base
    names = [*rows.columns, "margin", *parts, *["waterfall"][: min(show, 1)], *[f"flip_{c}" for c in flips]]

    def run(batches):
        t = shared.value
        for batch in batches:
            x = np.column_stack([batch.column(j).cast(pa.float64()).to_numpy(zero_copy_only=False) for j in at]) if batch.num_rows else np.zeros((0, len(at)))
            where = t.stretches(x)
            cells = t.cells(where)
            made = {"contributions": t.shapley(x, cells)} if show or "contributions" in parts else {}
            made |= {"path_attributions": t.path_attributions(x, cells)} if "path_attributions" in parts else {}
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(made[p].ravel()), len(at)).cast(pa.list_(pa.float64())) for p in parts]
            lists += [waterfall(made["contributions"], inputs, base, show)] if show else []
            own = [pa.array(t.nearest_flip(x, inputs.index(c), where, cells), from_pandas=True) for c in flips]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t.margin(x, cells)), *lists, *own], names=names)

    schema = rows.select("*", F.lit(0.0).alias("margin"), *[F.array(F.lit(0.0)).alias(p) for p in parts], *[F.lit(None).cast("array<struct<feature:string,contribution:double,upto:double>>").alias(c) for c in ["waterfall"][: min(show, 1)]], *[F.lit(None).cast("double").alias(f"flip_{c}") for c in flips]).schema
    for f in schema.fields:
        f.nullable = True
    return rows.mapInArrow(run, schema)


def waterfall(contributions: np.ndarray, inputs: list[str], base: float, show: int) -> pa.Array:
    """For each row, structs (feature, contribution, upto): the `show` largest contributions in order of size, of equals those first whose
    names are, then the others together; upto is the margin so far, from base on."""
    named = sorted(range(len(inputs)), key=lambda i: inputs[i])
    own = contributions[:, named]
    order = np.argsort(-np.abs(own), axis=1, kind="stable")
    own, rest = np.take_along_axis(own, order, axis=1), np.zeros(len(own))
    for j in range(show, len(inputs)):
        rest += own[:, j]
    more = show < len(inputs)
    feature, shown = order[:, :show], own[:, :show]
    if more:
        feature, shown = np.column_stack([feature, np.full(len(own), len(inputs))]), np.column_stack([shown, rest])
    feature = pa.array([*[inputs[i] for i in named], "others"]).take(pa.array(feature.ravel()))
    upto = base + np.cumsum(shown, axis=1)
    made = pa.StructArray.from_arrays([feature, pa.array(shown.ravel()), pa.array(upto.ravel())], names=["feature", "contribution", "upto"])
    return pa.FixedSizeListArray.from_arrays(made, shown.shape[1]).cast(pa.list_(made.type))
