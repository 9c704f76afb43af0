"""Copulas: distribution functions against known values, densities against integrals and differences, families found again."""

from __future__ import annotations

import math

import numpy as np
import pytest

from larkspur.operators import copulas as c
from larkspur.plans import explanations

SOME = [c.Copula("gaussian", 0.6), c.Copula("gaussian", -0.4), c.Copula("student", 0.5, 4.0), c.Copula("clayton", 2.0), c.Copula("gumbel", 2.0), c.Copula("frank", 5.0), c.Copula("frank", -4.0), c.Copula()]
NAMES = [f"{x.family}{x.theta}" for x in SOME]


def test_distributions_have_known_values():
    assert abs(float(c.t_distribution(1.0, 1.0)) - 0.75) < 1e-12  # Cauchy
    assert abs(float(c.t_distribution(2.0, 2.0)) - (0.5 + 2 / (2 * math.sqrt(2 + 4)))) < 1e-12
    assert abs(float(c.t_distribution(2.228138852, 10.0)) - 0.975) < 1e-9
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.9999])
    assert all(np.abs(c.t_distribution(c.t_inverse(p, n), n) - p).max() < 1e-10 for n in (1.0, 3.0, 4.5, 30.0))
    assert all(np.abs(c.t_scores(p, n) / np.where(p == 0.5, 1, c.t_inverse(p, n)) - (p != 0.5)).max() < 1e-6 for n in (3.0, 15.0))
    assert abs(float(c.normal_pair_distribution(0.0, 0.0, 0.5)) - 1 / 3) < 1e-12 and abs(float(c.normal_pair_distribution(0.0, 0.0, -0.8)) - (0.25 + math.asin(-0.8) / (2 * math.pi))) < 1e-12
    assert abs(float(c.normal_pair_distribution(1.0, 9.0, 0.3)) - 0.8413447460685429) < 1e-12


@pytest.mark.parametrize("copula", SOME, ids=NAMES)
def test_density_conditional_and_distribution_agree(copula):
    u, v, h = np.array([0.15, 0.5, 0.8, 0.3]), np.array([0.3, 0.6, 0.75, 0.9]), 1e-5
    slope = (copula.distribution(u, v + h) - copula.distribution(u, v - h)) / (2 * h)
    assert np.abs(slope - copula.conditional(u, v)).max() < 2e-4
    bend = (copula.conditional(u + h, v) - copula.conditional(u - h, v)) / (2 * h)
    assert np.abs(bend / np.exp(copula.log_density(u, v)) - 1).max() < 1e-4
    assert np.abs(copula.conditional(copula.conditional_inverse(u, v), v) - u).max() < 1e-9


@pytest.mark.parametrize("copula", [x for x in SOME if x.family != "independence"], ids=NAMES[:-1])
def test_density_integrates_to_one(copula):
    nodes, weights = np.polynomial.legendre.leggauss(80)
    # Nodes crowd at the borders.
    x = (nodes + 1) / 2
    x, w = x**3 / (x**3 + (1 - x) ** 3), weights / 2 * 3 * x**2 * (1 - x) ** 2 / (x**3 + (1 - x) ** 3) ** 2
    assert abs(float(w @ np.exp(copula.log_density(x[:, None], x[None, :])) @ w) - 1) < 0.01


@pytest.mark.parametrize("copula", [c.Copula("gaussian", 0.7), c.Copula("student", 0.6, 3.0), c.Copula("clayton", 3.0), c.Copula("gumbel", 2.5), c.Copula("frank", 8.0), c.Copula("frank", -8.0)], ids=lambda x: f"{x.family}{x.theta}")
def test_families_are_found_again(copula):
    rng = np.random.default_rng(12)
    v, p = rng.uniform(size=900), rng.uniform(size=900)
    found, total, aic, tau = c.select(c.ranks(copula.conditional_inverse(p, v)), c.ranks(v))
    assert found.family == copula.family and abs(found.theta - copula.theta) < 0.15 * max(1, abs(copula.theta)) and total > 50 and aic < -90 and np.sign(tau) == np.sign(copula.theta)


def test_independence_and_short_groups():
    rng = np.random.default_rng(5)
    assert c.select(np.arange(9) / 10, np.arange(9) / 10)[0] == c.Copula() and c.select(np.zeros(0), np.zeros(0))[1:3] == (0.0, 0.0)
    assert abs(c.kendall(rng.uniform(size=400), rng.uniform(size=400))) < 0.1
    assert c.ranks(np.array([5.0, 1.0, 5.0])).tolist() == [0.625, 0.25, 0.625]


def test_vine_conditions_on_its_root(spark):
    """y and z depend on x only: the second tree has nearly nothing left."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=600)
    y, z = x + 0.5 * rng.normal(size=600), x + 0.5 * rng.normal(size=600)
    rows = [("a", x.tolist(), y.tolist(), z.tolist()), ("b", [1.0, None], [2.0, 3.0], [float("nan"), 1.0]), ("c", None, None, None)]
    df = spark.createDataFrame(rows, "k string, x array<double>, y array<double>, z array<double>")
    got = {r.k: r for r in c.fitted_vines(df, ["x", "y", "z"]).collect()}
    assert [(e.tree, e.root, e.other) for e in got["a"].edges][:2] == [(1, "x", "y"), (1, "x", "z")] and got["a"].edges[2].given == ["x"]
    assert abs(got["a"].edges[2].tau) < 0.08 < 0.5 < got["a"].edges[0].tau and got["a"].loglik > 400
    assert (got["b"].n, got["c"].n) == (0, 0) and got["b"].loglik == got["c"].loglik == 0.0
    assert c.fitted_vines(df.limit(0), ["x", "y", "z"]).count() == 0


def test_vines_of_the_tables(spark):
    rows = explanations.fitted_vines(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 100 and all(len(r.edges) == 3 and r.loglik >= 0 for r in rows) and {e.family for r in rows for e in r.edges} > {"gaussian"}
