"""Bands of a local level with drift around a series, with a measurement noise that follows the surprises.

The filter's state is six numbers, so a key's bars stream through a task in Arrow batches, sorted by Spark; no series is held."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variances in parts of the first value's square (level, drift, measurement, and both at the start), the pace of the noise, the bands' width.
LEVEL_NOISE, DRIFT_NOISE, SEEN_NOISE, LEVEL_START, DRIFT_START, PACE, WIDTH = 1e-4, 1e-6, 1e-2, 1e-2, 1e-4, 0.98, 2.0
COLUMNS = ("i", "level", "lower", "upper", "z", "sigma_bps", "slope_bps", "band_place")


class Filter:
    def __init__(self, first: float):
        unit = max(abs(first), 1.0) ** 2
        self.level, self.drift, self.noise, self.i = first, 0.0, SEEN_NOISE * unit, 0
        self.p11, self.p12, self.p22 = LEVEL_START * unit, 0.0, DRIFT_START * unit
        self.q11, self.q22 = LEVEL_NOISE * unit, DRIFT_NOISE * unit

    def step(self, seen: float) -> tuple:
        """The values of COLUMNS after one more observation."""
        ahead = self.level + self.drift
        p11, p12, p22 = self.p11 + 2 * self.p12 + self.p22 + self.q11, self.p12 + self.p22, self.p22 + self.q22
        surprise, s = seen - ahead, p11 + self.noise
        self.level, self.drift = ahead + p11 / s * surprise, self.drift + p12 / s * surprise
        self.p11, self.p12, self.p22 = p11 - p11 / s * p11, p12 - p12 / s * p11, p22 - p12 / s * p12
        self.noise = max(PACE * self.noise + (1 - PACE) * (surprise * surprise - p11), 1e-10)
        self.i += 1
        sigma = math.sqrt(max(s, 1e-12))
        half, known = WIDTH * sigma, abs(self.level) > 1e-12
        place = min(max((seen - self.level + half) / (2 * half), -0.5), 1.5)
        return self.i, self.level, self.level - half, self.level + half, surprise / sigma, 1e4 * sigma / self.level if known else 0.0, 1e4 * self.drift / self.level if known else 0.0, place


def innovation_bands(bars: DataFrame) -> DataFrame:
    """(key, t, close, i from 1, level, lower, upper, z of the surprise, sigma_bps, slope_bps, band_place from 0 at the lower band to 1
    at the upper one) of bars (key, t, close). Bars with a null key, time or close do not count; bars of one key and time are taken in order of their closes."""

    def run(batches):
        key, filter_ = None, None
        for batch in batches:
            out = []
            for k, close in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if filter_ is None or k != key:
                    key, filter_ = k, Filter(close)
                out.append(filter_.step(close))
            columns = list(zip(*out, strict=True)) if out else [[] for _ in COLUMNS]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(columns[0], pa.int64()), *[pa.array(c, pa.float64()) for c in columns[1:]]], names=["key", "t", "close", *COLUMNS])

    known = bars.where("key IS NOT NULL AND t IS NOT NULL AND close IS NOT NULL").select("key", "t", F.col("close").cast("double").alias("close"))
    kinds = dict(known.dtypes)
    return known.repartition("key").sortWithinPartitions("key", "t", "close").mapInArrow(run, f"key {kinds['key']}, t {kinds['t']}, close double, i bigint, " + ", ".join(f"{c} double" for c in COLUMNS[1:]))
