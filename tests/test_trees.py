"""Explanations of tree ensembles against subsets written out, and of Spark's trees against the model itself."""

from __future__ import annotations

import itertools
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import trees
from larkspur.plans import explanations
from larkspur.plans.signals import LINE_INPUTS, fitted_trees

SF = "/root/testdata/sf0.001"


def grown(rng, depth, cover=1000.0):
    """A random tree as nested tuples (feature, threshold, left, right, cover) or (value, cover)."""
    if not depth or rng.random() < 0.15:
        return float(rng.normal()), cover
    left = cover * rng.uniform(0.1, 0.9)
    return int(rng.integers(3)), float(rng.uniform(-1, 1)), grown(rng, depth - 1, left), grown(rng, depth - 1, cover - left), cover


def leaves_of(tree, t, path=None, steps=None):
    path, steps = path or {}, steps or {}
    if len(tree) == 2:
        return [trees.Leaf(t, tree[0], path, steps)]
    f, at, left, right, cover = tree
    low, high, share = path.get(f, (-np.inf, np.inf, 1.0))
    out = []
    for child, a, b in ((left, low, min(high, at)), (right, max(low, at), high)):
        out += leaves_of(child, t, path | {f: (a, b, share * child[-1] / cover)}, steps | {f: steps.get(f, 0.0) + mean(child) - mean(tree)})
    return out


def mean(tree):
    return tree[0] if len(tree) == 2 else (mean(tree[2]) * tree[2][-1] + mean(tree[3]) * tree[3][-1]) / tree[-1]


def value(tree, x, known):
    """The tree's value where only the features `known` are: both ways by their covers at other splits."""
    if len(tree) == 2:
        return tree[0]
    f, at, left, right, cover = tree
    if f in known:
        return value(left if x[f] <= at else right, x, known)
    return (value(left, x, known) * left[-1] + value(right, x, known) * right[-1]) / cover


@pytest.mark.parametrize("seed", range(6))
def test_shapley_values_equal_enumerated_subsets(seed):
    rng = np.random.default_rng(seed)
    forest = [grown(rng, 4) for _ in range(3)]
    e = trees.Ensemble(3, [leaf for t, tree in enumerate(forest) for leaf in leaves_of(tree, t)], np.zeros(3), sum(map(mean, forest)))
    x = np.vstack([rng.uniform(-1.2, 1.2, (20, 3)), [[np.nan, 0.0, 5.0]]])
    asked = np.where(np.isnan(x), np.inf, x)
    v = lambda row, known: sum(value(tree, row, known) for tree in forest)
    for row, got in zip(asked, e.shapley(x), strict=True):
        for i in range(3):
            others = [j for j in range(3) if j != i]
            want = sum(factorial(k) * factorial(2 - k) / 6 * (v(row, {*s, i}) - v(row, {*s})) for k in range(3) for s in itertools.combinations(others, k))
            assert abs(got[i] - want) < 1e-9
    assert np.allclose(e.base + e.shapley(x).sum(axis=1), e.margin(x)) and np.allclose(e.base + e.path_attributions(x).sum(axis=1), e.margin(x))
    assert np.allclose(e.margin(x), [v(r, {0, 1, 2}) for r in asked])


@pytest.mark.parametrize("seed", range(4))
def test_nearest_flip_against_a_fine_search(seed):
    rng = np.random.default_rng(seed)
    forest = [grown(rng, 3) for _ in range(4)]
    e = trees.Ensemble(3, [leaf for t, tree in enumerate(forest) for leaf in leaves_of(tree, t)], np.zeros(3), 0.0)
    x = rng.uniform(-1, 1, (30, 3))
    sign, grid = e.margin(x) > 0, np.unique([*np.linspace(-1.5, 1.5, 401), *e.thresholds(1), *np.nextafter(e.thresholds(1), 9)])
    for row, s, got in zip(x, sign, e.nearest_flip(x, 1), strict=True):
        tried = np.repeat(row[None], len(grid), 0)
        tried[:, 1] = grid
        hits = grid[(e.margin(tried) > 0) != s]
        assert (np.isnan(got) and not len(hits)) or abs(abs(got - row[1]) - np.abs(hits - row[1]).min()) < 1e-12


def test_sparks_trees_are_read_right(spark):
    from pyspark.ml.functions import vector_to_array

    ready, model = fitted_trees(spark, SF)
    e = trees.of_spark(model, len(LINE_INPUTS))
    own = trees.explained(model.transform(ready).select(*LINE_INPUTS, vector_to_array("rawPrediction")[1].alias("raw")), LINE_INPUTS, e)
    assert own.where(F.abs(F.col("raw") - F.col("margin")) > 1e-9).count() == 0
    train = trees.explained(ready.where("not held_out").select(*LINE_INPUTS), LINE_INPUTS, e).agg(F.avg("margin")).first()[0]
    assert abs(train - e.base) < 1e-6


def test_queries_of_trees(spark):
    rows = explanations.tree_contributions(spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/lineitem.parquet").count() and all(r.adds_up for r in rows)
    assert all(len(r.waterfall) == 3 and abs(r.waterfall[-1].upto - r.margin) < 1e-5 for r in rows)
    shares = explanations.tree_importance(spark, SF).collect()
    assert abs(sum(r.gain for r in shares) - 1) < 1e-4 and {r.input for r in shares} == set(LINE_INPUTS) and all(r.shapley >= 0 for r in shares)
    flips = explanations.line_counterfactuals(spark, SF).collect()
    assert all(r.verified is not False for r in flips) and {r.verified for r in flips} <= {True, None}
    some = explanations.background_rows(spark, SF).collect()
    assert len(some) == explanations.BACKGROUND and abs(sum(r.weight for r in some) - 1) < 1e-4


def test_explained_of_no_rows(spark):
    e = trees.Ensemble(1, [trees.Leaf(0, 1.0, {0: (-np.inf, 2.0, 0.5)}), trees.Leaf(0, -1.0, {0: (2.0, np.inf, 0.5)})], np.ones(1), 0.0)
    rows = spark.createDataFrame([(1, 1.0), (2, None)], "i int, q double")
    assert trees.explained(rows.limit(0), ["q"], e, ("q",)).count() == 0
    got = {r.i: (r.margin, r.contributions, r.flip_q) for r in trees.explained(rows, ["q"], e, ("q",)).collect()}
    assert got[1] == (1.0, [1.0], np.nextafter(2.0, 9)) and got[2][:2] == (-1.0, [-1.0])


@pytest.mark.parametrize("wide", [False, True])
def test_tables_equal_leaves_and_do_not_visit_them_by_row(monkeypatch, wide):
    """Rows find in the cells of trees what the leaves give row by row, at thresholds, beside them and without a value; trees of too many cells too."""
    rng = np.random.default_rng(5)
    forest = [grown(rng, 4) for _ in range(5)]
    e = trees.Ensemble(4, [leaf for t, tree in enumerate(forest) for leaf in leaves_of(tree, t)], np.zeros(4), 0.0)
    if wide:
        monkeypatch.setattr(trees, "CELLS", 30)
    t, cut = trees.Tables(e), np.concatenate([e.thresholds(f) for f in range(3)])
    assert bool(t.rest.leaves) == wide and t.trees
    x = rng.choice(np.concatenate([cut, np.nextafter(cut, 9), np.nextafter(cut, -9), rng.uniform(-1.5, 1.5, 50), [np.nan, np.inf]]), (3000, 4))
    at = t.stretches(x)
    cells = t.cells(at)
    assert np.allclose(t.margin(x, cells), e.margin(x), atol=1e-12) and np.allclose(t.shapley(x, cells), e.shapley(x), atol=1e-12) and np.allclose(t.path_attributions(x, cells), e.path_attributions(x), atol=1e-12)
    for f in range(4):
        known = ~np.isinf(x[:, f])
        assert np.array_equal(t.nearest_flip(x, f, at, cells)[known], e.nearest_flip(x, f)[known], equal_nan=True)
    seen = []
    monkeypatch.setattr(trees.Ensemble, "reached", lambda self, x, leaf: seen.append(leaf) or np.zeros((len(x), len(leaf.path)), bool))
    t.margin(x, cells), t.shapley(x, cells), t.nearest_flip(x, 0, at, cells)
    assert bool(seen) == wide
