"""Smiles: parameters found again from quotes with and without noise, skew against a search, awkward rows."""

from __future__ import annotations

import math

import numpy as np

from larkspur.operators import smiles


def test_parameters_are_found_again():
    rng = np.random.default_rng(3)
    n = 300
    forward, tau = rng.uniform(5, 2000, n), rng.uniform(0.05, 2, n)
    alpha, rho, nu = rng.uniform(0.1, 0.5, n) * np.sqrt(forward), rng.uniform(-0.8, 0.6, n), rng.uniform(0.2, 1.2, n)
    strikes = forward[:, None] * np.linspace(0.7, 1.3, 9)
    vols = smiles.volatility(forward[:, None], strikes, tau[:, None], alpha[:, None], rho[:, None], nu[:, None])
    a, r, v, error = smiles.fit(forward, tau, strikes, vols, np.ones_like(vols, bool))
    assert np.abs(a / alpha - 1).max() < 1e-3 and np.abs(r - rho).max() < 1e-3 and np.abs(v - nu).max() < 1e-3 and error.max() < 1e-6
    noisy = vols * (1 + 0.002 * rng.normal(size=vols.shape))
    a, r, v, error = smiles.fit(forward, tau, strikes, noisy, np.ones_like(vols, bool))
    own = np.sqrt(((noisy - vols) ** 2).mean(axis=1))
    assert (error <= own + 1e-9).all()


def test_skew_against_the_normal_distribution():
    f, t, a, r, v = (np.array([x]) for x in (100.0, 0.5, 2.5, -0.4, 0.7))
    call, put, at, reversal, butterfly, normalised = (float(x[0]) for x in smiles.skew(f, t, a, r, v))
    for k, delta in ((call, 0.25), (put, 0.75)):
        vol = float(smiles.volatility(100.0, k, 0.5, 2.5, -0.4, 0.7))
        d1 = math.log(100 / k) / (vol * math.sqrt(0.5)) + vol * math.sqrt(0.5) / 2
        assert abs((1 + math.erf(d1 / math.sqrt(2))) / 2 - delta) < 1e-9
    assert put < 100 < call and reversal < 0 < butterfly and abs(normalised - reversal / at) < 1e-12


def test_awkward_smiles(spark):
    rows = [(1, 100.0, 1.0, [90.0, 100.0, 110.0, 120.0], [0.3, 0.25, 0.24, 0.25]), (2, 100.0, 1.0, [90.0, None, float("nan"), -5.0], [0.3, 0.2, 0.2, 0.2]), (3, None, 1.0, [90.0], [0.3]), (4, 100.0, 1.0, [], []), (5, 100.0, 1.0, None, None), (6, 100.0, 1.0, [100.0] * 4, [0.2] * 4)]
    df = spark.createDataFrame(rows, "i int, forward double, tau double, strikes array<double>, vols array<double>")
    got = {r.i: r for r in smiles.fitted_smiles(df).collect()}
    assert got[1].n_quotes == 4 and got[1].rmse < 0.01 and -1 < got[1].rho < 1
    assert [got[i].n_quotes for i in (2, 3, 4, 5)] == [1, 0, 0, 0] and all(got[i].alpha is None and got[i].risk_reversal is None for i in (2, 3, 4, 5))
    assert abs(got[6].at_the_money - 0.2) < 1e-6
    assert smiles.fitted_smiles(df.limit(0)).count() == 0
