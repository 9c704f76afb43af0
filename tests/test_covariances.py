"""Covariances and explained variance against numpy; no rows, one row."""

from __future__ import annotations

import numpy as np

from larkspur.operators import covariances


def test_covariances_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)) @ rng.normal(size=(6, 6)) + 1e4
    df = spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>").repartition(5)
    c = covariances.covariance(df, "v")
    got, want = {(r.i, r.j): r.covariance for r in c.collect()}, np.cov(x.T)
    assert len(got) == 21 and all(abs(v - want[i - 1, j - 1]) < 1e-7 for (i, j), v in got.items())
    e = covariances.explained(c)
    rows = sorted(e.collect(), key=lambda r: r.component)
    assert np.allclose([r.variance for r in rows], np.linalg.eigvalsh(want)[::-1]) and abs(rows[-1].cumulative - 1) < 1e-9
    k = covariances.components_for(e, 0.9)
    assert rows[k - 1].cumulative >= 0.9 and (k == 1 or rows[k - 2].cumulative < 0.9) and covariances.components_for(e, 1.1) == 6


def test_few_rows(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>")
    assert {r.covariance for r in covariances.covariance(df, "v").collect()} == {0.0}
    none = covariances.covariance(df.limit(0), "v")
    assert none.count() == 0 and covariances.explained(none).count() == 0
