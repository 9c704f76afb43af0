"""Features by hand and against plain loops: warm-up, defaults, states at the edges of bands, variants over time and across keys."""

from __future__ import annotations

import datetime as dt
import math
import random
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from larkspur.operators import features
from larkspur.plans.features import QUERIES

BARS = "key string, t timestamp, open double, high double, low double, close double, volume double, value string"
START = dt.datetime(2024, 1, 1)


def made(rng, key, n):
    rows, close = [], 100.0
    for i in range(n):
        open_ = close * math.exp(rng.gauss(0, 0.01))
        close = open_ * math.exp(rng.gauss(0, 0.02))
        rows.append((key, START + dt.timedelta(days=i), open_, max(open_, close) * 1.01, min(open_, close) * 0.99, close, 100.0 + rng.randrange(50), "clash"))
    return rows


def test_features_by_hand(spark):
    rng = random.Random(4)
    rows = made(rng, "a", 90) + made(rng, "b", 90)
    got = {(r.key, r.t): r for r in features.wide_features(spark.createDataFrame(rng.sample(rows, len(rows)), BARS)).collect()}
    a = [r for r in rows if r[0] == "a"]
    b = [r for r in rows if r[0] == "b"]
    assert len(got) == 2 * 61
    r = got["a", a[89][1]]
    close, volume = [x[5] for x in a], [x[6] for x in a]
    pct = [[x[i][5] / x[i - 1][5] - 1 for i in range(30, 90)] for x in (a, b)]
    market = [(x + y) / 2 for x, y in zip(*pct, strict=True)]
    beta = statistics.covariance(pct[0], market) / statistics.variance(market)
    logs = [math.log(close[i] / close[i - 1]) for i in range(70, 90)]
    obv = [0.0]
    for i in range(1, 90):
        obv.append(obv[-1] + math.copysign(volume[i], close[i] - close[i - 1]))
    turnover = [c * v for c, v in zip(close, volume, strict=True)][-60:]
    want = {
        "roc_10": 100 * (close[89] / close[79] - 1), "dist_from_20d_high": 100 * (close[89] / max(x[3] for x in a[70:]) - 1), "bb_width_20": 4 * statistics.pstdev(close[70:]) / statistics.mean(close[70:]),
        "realised_vol_20": 100 * math.sqrt(252) * statistics.stdev(logs), "vol_ratio_5_20": statistics.stdev(logs[-5:]) / statistics.stdev(logs), "gap_pct": 100 * (a[89][2] / close[88] - 1),
        "beta_60": beta, "idio_alpha_60": 1e4 * (statistics.mean(pct[0]) - beta * statistics.mean(market)), "corr_bench_60": statistics.correlation(pct[0], market),
        "obv_slope_20": statistics.linear_regression(range(20), obv[70:]).slope / statistics.mean(map(abs, obv[70:])), "trend_slope_20": 100 * statistics.linear_regression(range(20), close[70:]).slope / statistics.mean(close[70:]),
        "adv_ratio": volume[89] / statistics.mean(volume[60:]), "dollar_volume_z": (turnover[-1] - statistics.mean(turnover)) / statistics.stdev(turnover),
        "rel_strength_20d": 100 * ((close[89] / close[69] - 1) - (b[89][5] / b[69][5] - 1)) / 2,
    }
    for name, value in want.items():
        assert math.isclose(r[name], value, abs_tol=2e-6), name
    # At the 30th bar what needs 60 returns has its default.
    first = got["a", a[29][1]]
    assert (first.beta_60, first.idio_alpha_60, first.corr_bench_60) == (1.0, 0.0, 0.5)


def test_flat_and_odd_bars(spark):
    flat = [("a", START + dt.timedelta(days=i), 5.0, 5.0, 5.0, 5.0, 0.0, "") for i in range(40)]
    flat += [("z", START + dt.timedelta(days=i), None, None, None, None, None, "") for i in range(31)] + [("few", START, 1.0, 1.0, 1.0, 1.0, 1.0, ""), (None, START, 1.0, 1.0, 1.0, 1.0, 1.0, ""), ("a", None, 1.0, 1.0, 1.0, 1.0, 1.0, "")]
    got = features.wide_features(spark.createDataFrame(flat, BARS)).collect()
    assert len(got) == 13
    for r in got:
        neutral = {n: float(f.default) for n, f in features.FEATURES.items()}
        own = {n: r[n] for n in neutral}
        if r.key == "a":
            # Without movement the oscillators stand in the middle.
            assert own == neutral
        assert all(math.isfinite(v) for v in own.values())
    assert features.wide_features(spark.createDataFrame([], BARS)).count() == 0


def test_states_at_edges(spark):
    rows = [("k", "roc_10", v) for v in (-9.0, -8.0, -2.0, 1.999, 2.0, 8.0, 1e9, None)] + [("k", "unknown", 1.0)]
    got = [r.state for r in features.states(spark.createDataFrame(rows, "key string, feature string, value double").coalesce(1)).collect()]
    assert got == ["SHARP_DECLINE", "DECLINE", "FLAT", "FLAT", "ADVANCE", "SHARP_ADVANCE", "SHARP_ADVANCE", None, None]
    assert features.BANDS.keys() == features.FEATURES.keys()


@pytest.mark.parametrize("year", [4, 252])
def test_variants_equal_loops(spark, year):
    rng = random.Random(year)
    series = {(k, f): [rng.choice([1.0, 2.0, 3.5, rng.random()]) for _ in range(40)] for k in "abc" for f in "xy"}
    rows = [(k, i, f, v) for (k, f), own in series.items() for i, v in enumerate(own)]
    long = spark.createDataFrame(rng.sample(rows, len(rows)), "key string, t int, feature string, value double")
    got = {(r.key, r.feature, r.t): r for r in features.variants(long, (1, 5), year).collect()}
    assert len(got) == len(rows)
    for (k, f), own in series.items():
        for i, v in enumerate(own):
            r, seen = got[k, f, i], own[max(0, i - year + 1) : i + 1]
            assert r["rank"] == 1 + sum(series[o, f][i] > v for o in "abc")
            assert r.percentile == (None if len(seen) == 1 else sum(x < v for x in seen) / (len(seen) - 1))
            for n in (1, 5):
                changes = [own[j] - own[j - n] if j >= n else None for j in range(len(own))]
                assert r[f"delta_{n}"] == changes[i]
                past = [c for c in changes[max(0, i - year + 1) : i + 1] if c is not None]
                sd = statistics.pstdev(past) if past else 0
                z = (changes[i] - statistics.mean(past)) / sd if changes[i] is not None and sd > 1e-6 else None
                assert r[f"z_{n}"] is z is None or math.isclose(r[f"z_{n}"], z, abs_tol=1e-9)
    assert features.variants(long.where(F.lit(False))).count() == 0


def test_queries_equal_sql_after_prices_of_zero(spark, tmp_path):
    """Quotients and logarithms of zero prices are infinite or not a number in both; rounded values are compared, NaN apart from null."""
    rng = random.Random(11)
    ticks = [(60 * h + m, key, 0.0 if rng.random() < (0.004 if h > 20 else 0) else 10 + 5 * rng.random()) for h in range(330) for key in "abc" for m in range(rng.randint(1, 9))]
    rows = [(i, START + dt.timedelta(minutes=at), key, v) for i, (at, key, v) in enumerate(ticks)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    same = lambda v: repr(float(f"{v:.9g}") + 0.0) if isinstance(v, float) else v
    for query, sql in QUERIES.values():
        found = query(spark, str(tmp_path))
        cur = db.execute(sql)
        names = [d[0] for d in cur.description]
        want = {(r["key"], r["feature"], r["t"]): r for r in ({n: same(v) for n, v in zip(names, row, strict=True)} for row in cur.fetchall())}
        got = {(r["key"], r["feature"], r["t"]): {n: same(r[n]) for n in names} for r in found.collect()}
        assert got.keys() == want.keys()
        assert not [(k, n, got[k][n], want[k][n]) for k in got for n in names if got[k][n] != want[k][n]]
        assert {"inf", "nan"} <= {v for r in got.values() for v in r.values()}
