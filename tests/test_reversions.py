"""The filter's bands against its matrix form, over small batches, and the strategies that read it."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np

from larkspur.operators import kalman
from larkspur.plans import reversions

START = dt.datetime(2024, 1, 1)


def by_matrices(x):
    unit = max(abs(x[0]), 1.0) ** 2
    f, h = np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([[1.0, 0.0]])
    state, p, r, q = np.array([x[0], 0.0]), np.diag([1e-2, 1e-4]) * unit, 1e-2 * unit, np.diag([1e-4, 1e-6]) * unit
    for v in x:
        state, p = f @ state, f @ p @ f.T + q
        y, hph = v - (h @ state)[0], (h @ p @ h.T)[0, 0]
        s = hph + r
        k = (p @ h.T / s)[:, 0]
        state = state + k * y
        ikh = np.eye(2) - np.outer(k, h)
        p = ikh @ p @ ikh.T + np.outer(k, k) * r
        r = max(0.98 * r + 0.02 * (y * y - hph), 1e-10)
        yield state[0], y / np.sqrt(s), 1e4 * np.sqrt(s) / state[0], 1e4 * state[1] / state[0]


def test_bands_equal_matrices(spark):
    rng = random.Random(3)
    series = {k: [100 + n * i * 0.1 + rng.gauss(0, 2) for i in range(60)] for n, k in enumerate("abc")} | {"one": [0.5], "flat": [7.0] * 30}
    rows = [(k, START + dt.timedelta(hours=i), v, "clash") for k, own in series.items() for i, v in enumerate(own)]
    rows += [("a", START, None, ""), (None, START, 1.0, ""), ("a", None, 1.0, "")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = kalman.innovation_bands(spark.createDataFrame(rng.sample(rows, len(rows)), "key string, t timestamp, close double, level string")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == sum(map(len, series.values()))
    for k, own in series.items():
        rows_of = sorted((r for r in got if r.key == k), key=lambda r: r.t)
        assert [r.i for r in rows_of] == list(range(1, len(own) + 1))
        for r, want in zip(rows_of, by_matrices(own), strict=True):
            assert np.allclose((r.level, r.z, r.sigma_bps, r.slope_bps), want, rtol=1e-7, atol=1e-9)
            assert np.isclose(r.upper - r.lower, 4e-4 * r.sigma_bps * r.level) and -0.5 <= r.band_place <= 1.5
    assert kalman.innovation_bands(spark.createDataFrame([], "key string, t timestamp, close double")).count() == 0


def test_skew_fires_on_a_stretched_reversal(spark, monkeypatch):
    rng = random.Random(8)
    calm = [rng.gauss(0, 0.01) for _ in range(30)]
    series = {"puts": [*calm, -0.2], "calls": [*calm, 0.2], "short": [*calm[:10], -0.2], "flat": [0.5] * 40}
    rows = [(b, START.date() + dt.timedelta(days=i), v) for b, own in series.items() for i, v in enumerate(own)]
    monkeypatch.setattr(reversions, "reversal_history", lambda spark, sf: spark.createDataFrame(rows, "p_brand string, day date, risk_reversal double"))
    got = {(r.p_brand, r.day): r for r in reversions.skew_reversion(spark, "").collect()}
    last = {b: got[b, START.date() + dt.timedelta(days=len(own) - 1)] for b, own in series.items()}
    assert (last["puts"].fired, last["puts"].direction) == (True, "long") and (last["calls"].fired, last["calls"].direction) == (True, "short")
    z = (-0.2 - np.mean(series["puts"])) / np.std(series["puts"], ddof=1)
    assert abs(last["puts"].z - z) < 1e-5 and last["puts"].conviction == 0.8 and not last["puts"].unwound
    # Too few days, and a series that does not move.
    assert not last["short"].fired and last["short"].conviction is None and (last["flat"].z, last["flat"].fired, last["flat"].unwound) == (0.0, False, True)
