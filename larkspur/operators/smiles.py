"""Volatility smiles of a stochastic-volatility model: fitting its parameters to quotes, and the skew it implies.

A row is a smile: forward, time, and its quotes as arrays. All smiles of an Arrow batch are fitted side by side by damped least
squares in parameters that can't leave their ranges (log level, inverse hyperbolic tangent of the correlation, log of the volatility
of volatility), a bounded number of steps; the elasticity is given, since it and the correlation can't be told apart from one smile.

Defined results: quotes that are null, not finite or not positive are left out; a smile with fewer than three others has null
parameters; an equal quote twice counts twice."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

STEPS, HALVINGS = 120, 60
#: The normal quantile of 0.75: a call of delta 0.25 has minus this as its d1, a put of delta -0.25 has this.
QUARTILE = 0.6744897501960817
FIT = "alpha double, rho double, nu double, rmse double, n_quotes bigint"
SKEW = "call_strike double, put_strike double, at_the_money double, risk_reversal double, butterfly double, normalised_skew double"


def volatility(forward, strike, tau, alpha, rho, nu, beta: float = 0.5):
    """Implied volatility by the expansion in small time, for arrays of one shape."""
    free, m = 1 - beta, np.log(forward / strike)
    mid = (forward * strike) ** (free / 2)
    z = nu / alpha * mid * m
    near = np.abs(z) < 1e-6
    safe = np.where(near, 1.0, z)
    root = np.sqrt(1 - 2 * rho * safe + safe * safe)
    bend = np.where(near, 1 - rho * z / 2, safe / np.log((root + safe - rho) / (1 - rho)))
    later = free**2 / 24 * alpha**2 / mid**2 + rho * beta * nu * alpha / (4 * mid) + (2 - 3 * rho**2) / 24 * nu**2
    return alpha / (mid * (1 + free**2 / 24 * m**2 + free**4 / 1920 * m**4)) * bend * (1 + later * tau)


def fit(forward: np.ndarray, tau: np.ndarray, strikes: np.ndarray, vols: np.ndarray, known: np.ndarray, beta: float = 0.5):
    """(alpha, rho, nu, root mean square error) of each row; strikes, vols and known (which of them count) are rows x quotes."""
    f, t = forward[:, None], tau[:, None]
    k, v = np.where(known, strikes, f), np.where(known, vols, 0.0)
    n = known.sum(axis=1)

    def values(u):
        return volatility(f, k, t, np.exp(u[:, :1]), np.tanh(u[:, 1:2]), np.exp(u[:, 2:]), beta)

    def error(u):
        gap = np.where(known, values(u) - v, 0.0)
        total = (gap**2).sum(axis=1)
        return gap, np.where(np.isfinite(total), total, np.inf)

    nearest = np.argmin(np.where(known, np.abs(np.log(k / f)), np.inf), axis=1)
    level = np.take_along_axis(v, nearest[:, None], axis=1)[:, 0]
    u = np.column_stack([np.log(np.maximum(level * forward ** (1 - beta), 1e-6)), np.full(len(f), -0.3), np.full(len(f), -0.7)])
    with np.errstate(all="ignore"):
        gap, best = error(u)
        damp = np.full(len(f), 1e-3)
        for _ in range(STEPS):
            slope = np.stack([np.where(known, (values(u + h) - values(u - h)) / 2e-5, 0.0) for h in 1e-5 * np.eye(3)], axis=2)
            slope = np.nan_to_num(slope)
            square = np.einsum("ijk,ijl->ikl", slope, slope)
            scale = np.maximum(np.einsum("ikk->ik", square), 1e-14)
            step = np.linalg.solve(square + (damp[:, None] * scale)[:, :, None] * np.eye(3), np.einsum("ijk,ij->ik", slope, np.nan_to_num(gap))[:, :, None])[:, :, 0]
            tried = u - np.clip(step, -1.0, 1.0)
            gap_tried, total = error(tried)
            better = total < best
            u, gap = np.where(better[:, None], tried, u), np.where(better[:, None], gap_tried, gap)
            done = np.abs(step).max(axis=1) < 1e-11
            best, damp = np.where(better, total, best), np.clip(np.where(better, damp / 5, damp * 4), 1e-12, 1e8)
            if done.all():
                break
    return np.exp(u[:, 0]), np.tanh(u[:, 1]), np.exp(u[:, 2]), np.sqrt(best / np.maximum(n, 1))


def strike_of(d1: float, forward, tau, alpha, rho, nu, beta: float = 0.5) -> np.ndarray:
    """The strike whose own volatility gives it this d1: by halving in log strike, which d1 falls with."""
    at = volatility(forward, forward, tau, alpha, rho, nu, beta)
    low, high = -8 * at * np.sqrt(tau), 8 * at * np.sqrt(tau)
    for _ in range(HALVINGS):
        x = (low + high) / 2
        vol = volatility(forward, forward * np.exp(x), tau, alpha, rho, nu, beta)
        above = -x / (vol * np.sqrt(tau)) + vol * np.sqrt(tau) / 2 > d1
        low, high = np.where(above, x, low), np.where(above, high, x)
    return forward * np.exp((low + high) / 2)


def skew(forward, tau, alpha, rho, nu, beta: float = 0.5) -> list[np.ndarray]:
    """The columns of SKEW: strikes of delta 0.25 by their own volatility, what both wings say about slope and curvature."""
    call, put = (strike_of(d, forward, tau, alpha, rho, nu, beta) for d in (-QUARTILE, QUARTILE))
    a, b, at = (volatility(forward, x, tau, alpha, rho, nu, beta) for x in (call, put, forward))
    return [call, put, at, a - b, (a + b) / 2 - at, np.where(at > 1e-12, (a - b) / at, 0.0)]


def _padded(lists: pa.ListArray, width: int) -> np.ndarray:
    out = np.full((len(lists), width), np.nan)
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    out[np.arange(width) < sizes[:, None]] = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return out


def fitted_smiles(smiles: DataFrame, beta: float = 0.5) -> DataFrame:
    """smiles (forward, tau, strikes, vols and any others) with the columns of FIT and of SKEW."""
    at = [smiles.columns.index(c) for c in ("forward", "tau", "strikes", "vols")]
    made = [x.split()[0] for x in f"{FIT}, {SKEW}".split(", ")]
    names = [*smiles.columns, *made]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            f, t = (batch.column(j).cast(pa.float64()).to_numpy(zero_copy_only=False) for j in at[:2])
            width = max(1, *(batch.column(j).value_lengths().fill_null(0).to_numpy().max() for j in at[2:]))
            k, v = (_padded(batch.column(j), int(width)) for j in at[2:])
            usable = np.isfinite(f) & (f > 0) & np.isfinite(t) & (t > 0)
            with np.errstate(all="ignore"):
                known = usable[:, None] & np.isfinite(k) & np.isfinite(v) & (k > 0) & (v > 0)
            enough = known.sum(axis=1) >= 3
            columns = np.full((len(made), batch.num_rows), np.nan)
            if enough.any():
                a, rho, nu, error = fit(f[enough], t[enough], k[enough], v[enough], known[enough], beta)
                columns[:4, enough] = a, rho, nu, error
                columns[5:, enough] = skew(f[enough], t[enough], a, rho, nu, beta)
            arrays = [pa.array(c, from_pandas=True) for c in columns]
            arrays[4] = pa.array(known.sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)

    return smiles.mapInArrow(run, ", ".join([*[f"`{n}` {t}" for n, t in smiles.dtypes], FIT, SKEW]))
