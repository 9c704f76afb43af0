"""Each regime on a market that shows it, its confidence by hand, nulls, and the factors of the families."""

from __future__ import annotations

import math

from larkspur.operators import regimes

ROWS = "name string, hurst double, adf double, adx double, di_spread double, vol_share double, liquidity double, primary_trend double, label string"


def test_each_regime(spark):
    rows = [
        ("dry", 0.5, 0.0, 40.0, 9.0, 0.99, 0.15, 1.0), ("stress", 0.7, 0.0, 40.0, 9.0, 0.94, 0.8, 1.0), ("edge", 0.5, 0.0, 0.0, 0.0, 0.85, 0.3, 0.0),
        ("bull", 0.65, 0.0, 40.0, 9.0, 0.5, 0.8, -1.0), ("bear", 0.65, 0.0, 40.0, -9.0, 0.5, 0.8, 1.0), ("near", 0.65, 0.0, 40.0, -1.0, 0.5, 0.8, 1.0),
        ("reverting", 0.35, -5.0, 5.0, 0.0, 0.5, 0.8, 0.0), ("drift", 0.5, -2.0, 22.0, 0.0, 0.1, 0.8, 0.0), ("closer", 0.5, 0.0, 22.0, 3.0, 0.5, 0.8, 0.0), ("none", None, None, None, None, None, None, None),
    ]
    x = spark.createDataFrame([(*r, "clash") for r in rows], ROWS)
    got = {r.name: r for r in regimes.regimes(x).collect()}
    want = {"dry": "illiquid", "stress": "high_volatility", "edge": "high_volatility", "bull": "trending_bull", "bear": "trending_bear", "near": "trending_bull", "reverting": "mean_reverting", "drift": "low_volatility_drift", "closer": "trending_bull", "none": "mean_reverting"}
    assert {n: r.label for n, r in got.items()} == want
    assert got["dry"].beneath == "high_volatility" and math.isclose(got["dry"].confidence, 0.5) and math.isclose(got["stress"].confidence, 0.6) and got["edge"].confidence == 0.4
    assert math.isclose(got["bull"].trend_score, 1.0) and got["bull"].confidence == 0.97 and math.isclose(got["reverting"].reversion_score, 1.0)
    assert math.isclose(got["drift"].confidence, 0.7) and got["closer"].confidence == 0.35
    # Without any finding: no strength of trend weighs less than no stationarity.
    assert math.isclose(got["none"].trend_score, -0.6) and math.isclose(got["none"].reversion_score, -0.55)


def test_factors(spark):
    x = spark.createDataFrame([(1, "illiquid"), (2, "mean_reverting"), (3, None), (4, "other")], "k int, label string")
    got = {(r.k, r.family): r.factor for r in regimes.factors(x).collect()}
    assert len(got) == 10 and got[1, "skew"] == 0.4 and got[2, "reversion"] == 1.3 and got[2, "event"] == 1.0
    assert all(len(v) == len(regimes.FAMILIES) for v in regimes.FACTORS.values())
