"""Queries of the filter's bands and of two strategies of reversion: surprises of the filter, and stretched risk reversals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.kalman import COLUMNS, innovation_bands
from larkspur.plans.surfaces import HISTORY, reversal_history
from larkspur.sources.roles import BARS_SQL, bars

_SHOWN = COLUMNS[1:]


def kalman_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level, bands, surprise, uncertainty and slope of each bar's close."""
    return innovation_bands(bars(spark, sf_dir)).select("key", "t", *[F.round(c, 5).alias(c) for c in _SHOWN])


_FILTERED = f"""WITH RECURSIVE b AS (SELECT key, t, close AS v, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM ({BARS_SQL})),
k AS (SELECT key, NULL::TIMESTAMP AS t, 0::BIGINT AS i, v AS seen, v AS level, 0::DOUBLE AS drift, 1e-2 * u AS a, 0::DOUBLE AS b, 1e-4 * u AS c, 1e-2 * u AS r, u, 0::DOUBLE AS e, 1::DOUBLE AS s FROM (SELECT *, greatest(abs(v), 1) ** 2 AS u FROM b WHERE i = 1)
UNION ALL SELECT key, t, i, v, ahead + a / s * e, drift + b / s * e, a * (1 - a / s), b * (1 - a / s), c - b * b / s, greatest(0.98 * r + 0.02 * (e * e - a), 1e-10), u, e, s
  FROM (SELECT b.key, b.t, b.i, b.v, k.level + k.drift AS ahead, k.drift, k.a + 2 * k.b + k.c + 1e-4 * u AS a, k.b + k.c AS b, k.c + 1e-6 * u AS c, k.r, u, b.v - k.level - k.drift AS e, k.a + 2 * k.b + k.c + 1e-4 * u + k.r AS s FROM k JOIN b ON b.key = k.key AND b.i = k.i + 1)),
f AS (SELECT key, t, i, level, level - 2 * sqrt(s) AS lower, level + 2 * sqrt(s) AS upper, e / sqrt(s) AS z, coalesce(1e4 * sqrt(s) / nullif(level, 0), 0) AS sigma_bps, coalesce(1e4 * drift / nullif(level, 0), 0) AS slope_bps, greatest(-0.5, least(1.5, 0.5 + (seen - level) / (4 * sqrt(s)))) AS band_place FROM k WHERE i > 0)"""
BANDS = f"{_FILTERED} SELECT key, t, {', '.join(f'round({c}, 5) AS {c}' for c in _SHOWN)} FROM f"

#: The surprise that opens a trade, the uncertainty above which the filter is not trusted, the bars it needs.
ENTRY_Z, LEAST_TRUST_BPS, WARM_UP = 1.5, 250.0, 80


def kalman_innovation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each key's 80th bar on: whether the close is a surprise worth a trade back to the level, its side, and its conviction."""
    x = innovation_bands(bars(spark, sf_dir)).where(F.col("i") >= WARM_UP)
    fired = (F.abs("z") >= ENTRY_Z) & (F.col("sigma_bps") < LEAST_TRUST_BPS)
    beyond, doubt = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.abs("z") - ENTRY_Z) / 2)), F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("sigma_bps") / LEAST_TRUST_BPS))
    return x.select("key", "t", F.round("z", 5).alias("z"), F.when(F.col("z") < 0, "long").otherwise("short").alias("direction"), fired.alias("fired"), F.when(fired, F.round(0.38 + 0.3 * beyond + 0.12 * (1 - doubt), 5)).alias("conviction"))


INNOVATION = f"""{_FILTERED} SELECT key, t, round(z, 5) AS z, if(z < 0, 'long', 'short') AS direction, abs(z) >= 1.5 AND sigma_bps < 250 AS fired,
  CASE WHEN abs(z) >= 1.5 AND sigma_bps < 250 THEN round(0.38 + 0.15 * least(2, abs(z) - 1.5) + 0.12 - 0.12 * greatest(0, sigma_bps) / 250, 5) END AS conviction FROM f WHERE i >= 80"""

#: Days looked back on and needed, the z score that opens a trade and the one that closes it.
LOOK_BACK, LEAST_DAYS, SKEW_ENTRY, SKEW_EXIT = 50, 20, 2.0, 0.5


def skew_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand and day: the z score of its risk reversal over 50 days, whether stretched puts (long) or calls (short) are to be faded, with
    what conviction, and whether an open trade of this kind is unwound. A window holds one brand's last days."""
    w = Window.partitionBy("p_brand").orderBy("day").rowsBetween(1 - LOOK_BACK, 0)
    x = reversal_history(spark, sf_dir).withColumn("n", F.count("risk_reversal").over(w)).withColumn("mean", F.avg("risk_reversal").over(w)).withColumn("sd", F.stddev_samp("risk_reversal").over(w))
    x = x.withColumn("z", F.when(F.col("sd") > 1e-9, (F.col("risk_reversal") - F.col("mean")) / F.col("sd")).otherwise(0.0))
    fired = (F.col("n") >= LEAST_DAYS) & (F.abs("z") >= SKEW_ENTRY)
    conviction = 0.5 + 0.3 * F.least(F.lit(1.0), (F.abs("z") - SKEW_ENTRY) / 1.5)
    return x.select("p_brand", "day", F.round("z", 5).alias("z"), F.when(F.col("z") < 0, "long").otherwise("short").alias("direction"), fired.alias("fired"), F.when(fired, F.round(conviction, 5)).alias("conviction"), (F.abs("z") < SKEW_EXIT).alias("unwound"))


SKEW = f"""WITH h AS ({HISTORY}), s AS (SELECT a.p_brand, a.day, any_value(a.risk_reversal) AS rr, count(*) AS n, avg(b.risk_reversal) AS m, stddev_samp(b.risk_reversal) AS sd
  FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY day) AS i FROM h) a JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY day) AS i FROM h) b ON b.p_brand = a.p_brand AND b.i BETWEEN a.i - 49 AND a.i GROUP BY a.p_brand, a.day),
z AS (SELECT *, CASE WHEN sd > 1e-9 THEN (rr - m) / sd ELSE 0 END AS x FROM s)
SELECT p_brand, day, round(x, 5)::DOUBLE AS z, if(x < 0, 'long', 'short') AS direction, n >= 20 AND abs(x) >= 2 AS fired, CASE WHEN n >= 20 AND abs(x) >= 2 THEN round(least(0.8, 0.1 + 0.2 * abs(x)), 5)::DOUBLE END AS conviction, abs(x) < 0.5 AS unwound FROM z"""

QUERIES = {"kalman_bands": (kalman_bands, BANDS), "kalman_innovation": (kalman_innovation, INNOVATION), "skew_reversion": (skew_reversion, SKEW)}
