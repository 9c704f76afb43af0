"""Recursive indicators: first-order recurrences per key, seeded with the mean of the first n values.

Catalyst has no scan, so each key's series is one group of a grouped Arrow function; keys run in parallel."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def smooth(x: np.ndarray, n: int, alpha: float) -> np.ndarray:
    """NaN until n values from the first finite one; then their mean, then alpha * x + (1 - alpha) * before."""
    out = np.full(len(x), np.nan)
    first = int(np.argmax(np.isfinite(x))) if np.isfinite(x).any() else len(x)
    if len(x) - first < n:
        return out
    now = out[first + n - 1] = x[first : first + n].mean()
    for i in range(first + n, len(x)):
        now = out[i] = now + alpha * (x[i] - now)
    return out


def ema(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 2 / (n + 1))


def wilder(x: np.ndarray, n: int) -> np.ndarray:
    return smooth(x, n, 1 / n)


def true_range(p: pd.DataFrame) -> np.ndarray:
    h, lo, before = p.high.to_numpy(), p.low.to_numpy(), p.close.shift().to_numpy()
    return np.fmax(h - lo, np.fmax(np.abs(h - before), np.abs(lo - before)))


def _ema(p):
    return {"ema": ema(p.close.to_numpy(), 20)}


def _rsi(p):
    d = np.diff(p.close.to_numpy(), prepend=np.nan)
    up, down = wilder(np.where(np.isnan(d), np.nan, np.maximum(d, 0)), 14), wilder(np.where(np.isnan(d), np.nan, np.maximum(-d, 0)), 14)
    with np.errstate(all="ignore"):
        out = 100 - 100 / (1 + up / down)
    out = np.where((up < 1e-9) & (down < 1e-9), 50.0, np.where(down < 1e-9, 100.0, np.where(up < 1e-9, 0.0, out)))
    return {"rsi": np.where(np.isnan(up), np.nan, out)}


def _macd(p):
    x = p.close.to_numpy()
    line = ema(x, 12) - ema(x, 26)
    signal = ema(line, 9)
    return {"macd": line, "signal": signal, "histogram": line - signal}


def _atr(p):
    out = wilder(true_range(p), 14)
    return {"atr": out, "atr_percent": 100 * out / p.close.to_numpy()}


def _keltner(p):
    mid, width = ema(p.close.to_numpy(), 20), 2 * wilder(true_range(p), 10)
    with np.errstate(all="ignore"):
        inside = np.where(width < 5e-10, 0.5, (p.close.to_numpy() - mid + width) / (2 * width))
        wide = np.where(mid < 1e-9, 0.0, 2 * width / mid)
    unknown = np.isnan(mid) | np.isnan(width)
    return {"middle": mid, "upper": mid + width, "lower": mid - width, "width": np.where(unknown, np.nan, wide), "percent_b": np.where(unknown, np.nan, inside)}


def _adx(p):
    """Movements are 0 and the range is the bar's own at the first bar; without a range there is no value."""
    up, down = np.diff(p.high.to_numpy(), prepend=p.high.iloc[:1]), -np.diff(p.low.to_numpy(), prepend=p.low.iloc[:1])
    plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
    a, b, c = wilder(plus, 14), wilder(minus, 14), wilder(true_range(p), 14)
    with np.errstate(all="ignore"):
        di = [np.where(c >= 1e-9, 100 * x / c, np.nan) for x in (a, b)]
        both = di[0] + di[1]
        dx = np.where(np.isnan(both), np.nan, np.where(both < 1e-9, 0.0, 100 * np.abs(di[0] - di[1]) / both))
    first = np.flatnonzero(np.isfinite(dx))[:1]
    if len(first):
        dx[first[0] :] = np.nan_to_num(dx[first[0] :])
    return {"plus_di": di[0], "minus_di": di[1], "adx": wilder(dx, 14)}


def _supertrend(p):
    """The trend begins upwards and turns where the close passes the band of the bar before."""
    atr, mid, close = wilder(true_range(p), 10), ((p.high + p.low) / 2).to_numpy(), p.close.to_numpy()
    line, way = np.full(len(p), np.nan), np.full(len(p), np.nan)
    upper = lower = None
    now = 1
    for i in np.flatnonzero(np.isfinite(atr)):
        a, b, before = mid[i] + 3 * atr[i], mid[i] - 3 * atr[i], close[max(i - 1, 0)]
        if upper is not None:
            a = a if a < upper or before > upper else upper
            b = b if b > lower or before < lower else lower
            now = 1 if close[i] > upper else -1 if close[i] < lower else now
        upper, lower = a, b
        line[i], way[i] = (b if now == 1 else a), now
    return {"line": line, "direction": way}


def _kalman(p):
    """A local level with drift; the innovation's z score."""
    x = p.close.to_numpy()
    state, cov = np.array([x[0], 0.0]), np.eye(2) * 10.0
    step, noise, r = np.array([[1.0, 1.0], [0.0, 1.0]]), np.diag([1e-2, 1e-4]), max(1e-6, float(np.var(np.diff(x))) if len(x) > 1 else 1e-6)
    level, z = np.empty(len(x)), np.empty(len(x))
    for i, v in enumerate(x):
        state, cov = step @ state, step @ cov @ step.T + noise
        s = cov[0, 0] + r
        z[i] = (v - state[0]) / np.sqrt(s)
        gain = cov[:, 0] / s
        state = state + gain * (v - state[0])
        cov = cov - np.outer(gain, cov[0])
        level[i] = state[0]
    return {"level": level, "z": z}


def _hedge(p):
    """A close as alpha + beta times the market's, both wandering; the noise of observation follows the innovations."""
    y, x = p.close.to_numpy(), p.market.to_numpy()
    state, cov, r, walk = np.array([y[0], 0.0]), np.eye(2), 1e-3, 1e-5
    out = np.empty((len(y), 4))
    for i in range(len(y)):
        h = np.array([1.0, x[i]])
        cov = cov + walk * np.eye(2)
        seen = cov @ h
        explained = h @ seen
        spread, s = y[i] - h @ state, explained + r
        gain = seen / s
        state, cov = state + gain * spread, cov - np.outer(gain, seen)
        r = max(0.99 * r + 0.01 * (spread * spread - explained), 1e-10)
        out[i] = *state, spread, spread / np.sqrt(max(s, 1e-12))
    return dict(zip(("alpha", "beta", "spread", "z"), out.T))


#: Recurrences of a key against another series: bars also have its column market.
RELATIVE = {"hedge": (_hedge, "alpha beta spread z")}
RECURRENCES = {"ema": (_ema, "ema"), "rsi": (_rsi, "rsi"), "macd": (_macd, "macd signal histogram"), "atr": (_atr, "atr atr_percent"), "keltner": (_keltner, "middle upper lower width percent_b"), "adx": (_adx, "plus_di minus_di adx"), "supertrend": (_supertrend, "line direction"), "kalman_trend": (_kalman, "level z")}


def recurrence(bars: DataFrame, name: str, places: int = 6) -> DataFrame:
    """(key, t, the recurrence's columns, rounded to so many places, NULL in the warm-up)."""
    function, columns = (RECURRENCES | RELATIVE)[name]
    key = bars.schema["key"].dataType.simpleString()

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t", ignore_index=True)
        values = {k: pd.Series(np.round(v, places)).astype(object).where(np.isfinite(v), None) for k, v in function(p).items()}
        return pd.DataFrame({"key": p.key, "t": p.t, **values})

    return bars.groupBy("key").applyInPandas(run, f"key {key}, t timestamp, " + ", ".join(f"{c} double" for c in columns.split()))
