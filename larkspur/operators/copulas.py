"""Pair copulas and canonical vines: densities, conditional distributions and their inverses, choice of a family by likelihood.

A row holds a group's columns as arrays, whose length is bounded by time (a value per period). Parameters begin where Kendall's tau
puts them and are refined by a golden-section search of the likelihood; among families the lowest AIC wins. A vine of d columns takes
as root the column that depends most on the others, joins the others to it, and goes on with their values conditional on the root.

Defined results: rows with a null or NaN in a column are left out of a group; groups of fewer than ten rows, or of columns whose
tau is below 0.02, are independent; ties share their mean rank."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_ROWS, LEAST_TAU = 10, 0.02
FAMILIES = ("gaussian", "student", "clayton", "gumbel", "frank")
#: Degrees of freedom tried for the t copula.
DEGREES = (3.0, 5.0, 8.0, 15.0)
GOLDEN = (math.sqrt(5) - 1) / 2

normal_inverse = np.vectorize(NormalDist().inv_cdf, otypes=[float])
normal_distribution = np.vectorize(lambda x: 0.5 * math.erfc(-x / math.sqrt(2)), otypes=[float])


def _within(u):
    return np.clip(np.asarray(u, float), 1e-10, 1 - 1e-10)


def incomplete_beta(a: float, b: float, x: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function of x = 1 - rest, by its continued fraction (modified Lentz), on the side where it
    converges fast; rest is given apart, to be exact near 0."""
    turned = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, rest, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    out = d.copy()
    for m in range(1, 200):
        for top in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + top * d, 1 + top / c
            d, c = 1 / np.where(np.abs(d) < tiny, tiny, d), np.where(np.abs(c) < tiny, tiny, c)
            step = c * d
            out *= step
        if np.abs(step - 1).max(initial=0) < 1e-14:
            break
    with np.errstate(divide="ignore"):
        front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log(np.where(turned, x, rest))) / p
    return np.where(turned, 1 - front * out, front * out)


def t_distribution(x, nu: float) -> np.ndarray:
    x = np.asarray(x, float)
    tail = incomplete_beta(nu / 2, 0.5, nu / (nu + x * x), x * x / (nu + x * x)) / 2
    return np.where(x > 0, 1 - tail, tail)


def t_inverse(p, nu: float) -> np.ndarray:
    """By halving, in the variable x / (1 + |x|), which covers all of the line, then by Newton's steps."""
    p = np.asarray(p, float)
    low, high = np.full_like(p, -1 + 1e-9), np.full_like(p, 1 - 1e-9)
    for _ in range(24):
        mid = (low + high) / 2
        below = t_distribution(mid / (1 - np.abs(mid)), nu) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    x, (low, high) = mid / (1 - np.abs(mid)), (y / (1 - np.abs(y)) for y in (low, high))
    front = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    for _ in range(4):
        x = np.clip(x - (t_distribution(x, nu) - p) / (front * (1 + x * x / nu) ** (-(nu + 1) / 2)), low, high)
    return x


@lru_cache(16)
def _t_table(nu: float):
    """t quantiles and their slopes over normal scores from -6.5 to 6.5."""
    z = np.linspace(-6.5, 6.5, 1665)
    x = t_inverse(normal_distribution(np.minimum(z, 0)), nu)
    x = np.where(z > 0, -x[::-1], x)
    front = math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi)
    return z, x, np.exp(-z * z / 2) / math.sqrt(2 * math.pi) / (front * (1 + x * x / nu) ** (-(nu + 1) / 2))


def t_scores(u, nu: float) -> np.ndarray:
    """t quantiles for likelihoods, by cubic interpolation over normal scores."""
    z, x, slope = _t_table(nu)
    at = np.clip(normal_inverse(u), z[0], z[-1])
    i = np.clip(np.searchsorted(z, at, "right") - 1, 0, len(z) - 2)
    h = z[i + 1] - z[i]
    s = (at - z[i]) / h
    return x[i] * (1 + 2 * s) * (1 - s) ** 2 + h * slope[i] * s * (1 - s) ** 2 + x[i + 1] * s * s * (3 - 2 * s) + h * slope[i + 1] * s * s * (s - 1)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def normal_pair_distribution(x, y, rho: float) -> np.ndarray:
    """P(X <= x, Y <= y) of two standard normals: independence, and the density's integral over the correlation's arc up to rho."""
    x, y = np.asarray(x, float)[..., None], np.asarray(y, float)[..., None]
    arc = math.asin(min(1.0, max(-1.0, rho)))
    at = arc * (_NODES + 1) / 2
    area = np.exp(-(x * x + y * y - 2 * x * y * np.sin(at)) / (2 * np.cos(at) ** 2)) @ _WEIGHTS * arc / 2 / (2 * math.pi)
    return normal_distribution(x[..., 0]) * normal_distribution(y[..., 0]) + area


@dataclass
class Copula:
    family: str = "independence"
    theta: float = 0.0
    nu: float = 0.0

    def scores(self, u):
        u = _within(u)
        return normal_inverse(u) if self.family == "gaussian" else t_scores(u, self.nu) if self.family == "student" else u

    def log_density(self, u, v) -> np.ndarray:
        return self.log_density_of(self.scores(u), self.scores(v))

    def log_density_of(self, x, y) -> np.ndarray:
        """The same for scores: they don't depend on theta."""
        t = self.theta
        match self.family:
            case "gaussian":
                s = 1 - t * t
                return -0.5 * math.log(s) - (t * t * (x * x + y * y) - 2 * t * x * y) / (2 * s)
            case "student":
                n, s = self.nu, 1 - t * t
                both = math.lgamma(n / 2 + 1) + math.lgamma(n / 2) - 2 * math.lgamma((n + 1) / 2) - 0.5 * math.log(s)
                return both - (n / 2 + 1) * np.log1p((x * x - 2 * t * x * y + y * y) / (n * s)) + (n + 1) / 2 * (np.log1p(x * x / n) + np.log1p(y * y / n))
            case "clayton":
                return math.log1p(t) - (t + 1) * (np.log(x) + np.log(y)) - (2 + 1 / t) * np.log(x**-t + y**-t - 1)
            case "gumbel":
                a, b = -np.log(x), -np.log(y)
                s = a**t + b**t
                r = s ** (1 / t)
                return -r + a + b + (t - 1) * (np.log(a) + np.log(b)) + (1 / t - 2) * np.log(s) + np.log(r + t - 1)
            case "frank":
                g = -np.expm1(-t)
                return np.log(abs(t * g)) - t * (x + y) - 2 * np.log(np.abs(g - np.expm1(-t * x) * np.expm1(-t * y)))
        return np.zeros(np.broadcast(x, y).shape)

    def distribution(self, u, v) -> np.ndarray:
        """C(u, v); for the t copula, the integral of its conditional distribution over the second argument."""
        u, v, t = _within(u), _within(v), self.theta
        match self.family:
            case "gaussian":
                return normal_pair_distribution(normal_inverse(u), normal_inverse(v), t)
            case "student":
                at = v[..., None] * (_NODES + 1) / 2
                return self.conditional(u[..., None], at) @ _WEIGHTS * v / 2
            case "clayton":
                return (u**-t + v**-t - 1) ** (-1 / t)
            case "gumbel":
                return np.exp(-(((-np.log(u)) ** t + (-np.log(v)) ** t) ** (1 / t)))
            case "frank":
                return -np.log1p(np.expm1(-t * u) * np.expm1(-t * v) / math.expm1(-t)) / t
        return u * v

    def conditional(self, u, v) -> np.ndarray:
        """P(U <= u | V = v), the derivative of C by v."""
        u, v, t = _within(u), _within(v), self.theta
        match self.family:
            case "gaussian":
                return normal_distribution((normal_inverse(u) - t * normal_inverse(v)) / math.sqrt(1 - t * t))
            case "student":
                x, y = t_inverse(u, self.nu), t_inverse(v, self.nu)
                return t_distribution((x - t * y) / np.sqrt((self.nu + y * y) * (1 - t * t) / (self.nu + 1)), self.nu + 1)
            case "clayton":
                return v ** (-t - 1) * (u**-t + v**-t - 1) ** (-1 / t - 1)
            case "gumbel":
                a, b = -np.log(u), -np.log(v)
                s = a**t + b**t
                return np.exp(-(s ** (1 / t))) * s ** (1 / t - 1) * b ** (t - 1) / v
            case "frank":
                a, b = np.expm1(-t * u), np.expm1(-t * v)
                return a * (b + 1) / (math.expm1(-t) + a * b)
        return u * np.ones_like(v)

    def conditional_inverse(self, p, v) -> np.ndarray:
        """The u with conditional(u, v) = p, by halving: the conditional distribution rises with u in every family."""
        p = _within(p)
        low, high = np.full(np.broadcast(p, v).shape, 1e-12), np.full(np.broadcast(p, v).shape, 1 - 1e-12)
        for _ in range(60):
            mid = (low + high) / 2
            below = self.conditional(mid, v) < p
            low, high = np.where(below, mid, low), np.where(below, high, mid)
        return (low + high) / 2

    def tails(self) -> tuple[float, float]:
        """Lower and upper tail dependence."""
        match self.family:
            case "clayton":
                return 2 ** (-1 / self.theta), 0.0
            case "gumbel":
                return 0.0, 2 - 2 ** (1 / self.theta)
            case "student":
                both = 2 * float(t_distribution(-math.sqrt((self.nu + 1) * (1 - self.theta) / (1 + self.theta)), self.nu + 1))
                return both, both
        return 0.0, 0.0


def ranks(x: np.ndarray) -> np.ndarray:
    """Mean ranks over n + 1."""
    _, which, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[which] / (len(x) + 1)


def kendall(u: np.ndarray, v: np.ndarray) -> float:
    """Tau-b."""
    a, b = np.sign(u[:, None] - u), np.sign(v[:, None] - v)
    return float((a * b).sum() / max(math.sqrt((a * a).sum() * (b * b).sum()), 1e-300))


def _frank_tau(theta: float) -> float:
    at = theta * (_NODES + 1) / 2
    return 1 - 4 / theta * (1 - float((at / np.expm1(at)) @ _WEIGHTS) / 2)


def _range(family: str, tau: float) -> tuple[float, float] | None:
    """The interval of theta around the value that tau says; none where the family has no such dependence."""
    if family in ("gaussian", "student"):
        r = math.sin(math.pi * tau / 2)
        return max(-0.99, r - 0.35), min(0.99, r + 0.35)
    if family == "frank":
        low, high = 1e-3, 60.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if _frank_tau(mid) < abs(tau) else (low, mid)
        return (low / 3, low * 3 + 1) if tau > 0 else (-low * 3 - 1, -low / 3)
    if tau <= 0:
        return None
    start = 2 * tau / (1 - tau) if family == "clayton" else 1 / (1 - tau)
    return (max(start / 4, 1e-3), start * 4 + 0.5) if family == "clayton" else (1 + max(start - 1, 1e-3) / 4, start * 3)


def _best(u, v, family: str, nu: float, span: tuple[float, float]) -> tuple[float, Copula]:
    x, y = (Copula(family, 0.5, nu).scores(z) for z in (u, v))

    def likelihood(t: float) -> float:
        with np.errstate(all="ignore"):
            total = float(Copula(family, t, nu).log_density_of(x, y).sum())
        return total if math.isfinite(total) else -1e300

    low, high = span
    a, b = high - GOLDEN * (high - low), low + GOLDEN * (high - low)
    fa, fb = likelihood(a), likelihood(b)
    for _ in range(60):
        if fa >= fb:
            high, b, fb = b, a, fa
            a = high - GOLDEN * (high - low)
            fa = likelihood(a)
        else:
            low, a, fa = a, b, fb
            b = low + GOLDEN * (high - low)
            fb = likelihood(b)
    return (fa, Copula(family, a, nu)) if fa >= fb else (fb, Copula(family, b, nu))


def select(u: np.ndarray, v: np.ndarray, families=FAMILIES) -> tuple[Copula, float, float, float]:
    """(copula, log likelihood, AIC, tau) of the family with the lowest AIC; independence has AIC 0."""
    tau = kendall(u, v) if len(u) > 1 else 0.0
    chosen = (Copula(), 0.0, 0.0, tau)
    if len(u) < LEAST_ROWS or abs(tau) < LEAST_TAU:
        return chosen
    fits = []
    for family in families:
        if (span := _range(family, tau)) is not None:
            fits += [(_best(u, v, family, nu, span), 2 if family == "student" else 1) for nu in (DEGREES if family == "student" else (0.0,))]
    (total, copula), k = min(fits, key=lambda f: 2 * f[1] - 2 * f[0][0])
    return copula, total, 2 * k - 2 * total, tau


def vine(columns: dict[str, np.ndarray]) -> list[dict]:
    """The edges of a canonical vine of the columns (ranks), tree by tree, with their log likelihood."""
    left, edges, given = dict(columns), [], []
    while len(left) > 1:
        taus = {a: sum(abs(kendall(left[a], left[b])) for b in left if b != a) for a in left}
        root = max(sorted(taus), key=taus.get)
        fits = {b: select(left[b], left[root]) for b in left if b != root}
        edges += [{"tree": len(given) + 1, "root": root, "other": b, "given": list(given), "copula": c, "loglik": total, "tau": tau} for b, (c, total, _, tau) in sorted(fits.items())]
        left = {b: _within(fits[b][0].conditional(left[b], left[root])) for b in fits}
        given.append(root)
    return edges


EDGES = "array<struct<tree:int,root:string,other:string,given:array<string>,family:string,theta:double,nu:double,loglik:double,tau:double,lower:double,upper:double>>"


def fitted_vines(groups: DataFrame, names: list[str]) -> DataFrame:
    """groups (arrays named in `names`, of one length per row, and any others) with n, edges, loglik and the mean tail dependence of the
    first tree (lower_tail, upper_tail)."""
    at = [groups.columns.index(c) for c in names]
    others = [c for c in groups.columns if c not in names]
    kind = pa.list_(pa.struct([("tree", pa.int32()), ("root", pa.string()), ("other", pa.string()), ("given", pa.list_(pa.string())), ("family", pa.string()), *[(c, pa.float64()) for c in ("theta", "nu", "loglik", "tau", "lower", "upper")]]))

    def run(batches):
        for batch in batches:
            sizes, found, totals, tails = [], [], [], []
            for row in zip(*(batch.column(j).to_pylist() for j in at), strict=True):
                x = np.array([[np.nan if v is None else v for v in (c or [])] for c in row], float)
                x = x[:, np.isfinite(x).all(axis=0)] if x.size else np.zeros((len(names), 0))
                edges = vine({name: ranks(c) for name, c in zip(names, x, strict=True)})
                sizes.append(x.shape[1])
                found.append([{k: v for k, v in e.items() if k != "copula"} | {"family": e["copula"].family, "theta": e["copula"].theta, "nu": e["copula"].nu} | dict(zip(("lower", "upper"), e["copula"].tails(), strict=True)) for e in edges])
                totals.append(sum(e["loglik"] for e in edges))
                first = [e["copula"].tails() for e in edges if e["tree"] == 1] or [(0.0, 0.0)]
                tails.append(np.mean(first, axis=0))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            made = [pa.array(sizes, pa.int64()), pa.array(found, kind), pa.array(totals, pa.float64()), *(pa.array([t[i] for t in tails], pa.float64()) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([*columns, *made], names=[*others, "n", "edges", "loglik", "lower_tail", "upper_tail"])

    kept = ", ".join(f"`{c}` {t}" for c, t in groups.dtypes if c in others)
    return groups.mapInArrow(run, f"{kept}, n bigint, edges {EDGES}, loglik double, lower_tail double, upper_tail double")
