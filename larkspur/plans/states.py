"""Regimes of the keys of bars, from the other queries' findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.features import YEAR, wide_features
from larkspur.operators.recurrences import recurrence
from larkspur.operators.regimes import FACTORS, FAMILIES, factors, regimes
from larkspur.plans.features import WIDE_FEATURES
from larkspur.plans.series import ADX, LIQUIDITY, liquidity
from larkspur.plans.signals import UNIT_ROOT, unit_root
from larkspur.plans.studies import HURST, hurst
from larkspur.sources.roles import BARS_SQL, bars


def regime_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key at its last bar: the regime, its confidence, the regime beneath illiquidity, and the factor on each family of strategies.
    Every part has one row for each key, so the joins are of small rows; the score of liquidity is of spread, illiquidity and volume."""
    b = bars(spark, sf_dir)
    back = Window.partitionBy("key").orderBy(F.desc("t"))
    year = wide_features(b).select("key", "realised_vol_20", "trend_slope_20", F.row_number().over(back).alias("back")).where(F.col("back") <= YEAR)
    now = year.withColumn("now", F.first("realised_vol_20").over(Window.partitionBy("key").orderBy("back")))
    vol = now.groupBy("key").agg((F.count_if(F.col("realised_vol_20") <= F.col("now")) / F.count("*")).alias("vol_share"), F.max(F.when(F.col("back") == 1, F.col("trend_slope_20"))).alias("primary_trend"))
    directed = recurrence(b, "adx").groupBy("key").agg(F.max_by(F.struct("plus_di", "minus_di", "adx"), "t").alias("d")).select("key", F.col("d.adx").alias("adx"), (F.col("d.plus_di") - F.col("d.minus_di")).alias("di_spread"))
    traded = b.select("key", "close", "volume", F.row_number().over(back).alias("back")).where("back <= 30").groupBy("key").agg(F.avg("volume").alias("adv"), F.max(F.when(F.col("back") == 1, F.col("close"))).alias("close"))
    dry = liquidity(spark, sf_dir).join(traded, "key").withColumn("liquidity", F.expr("(0.32D / (1 + 1e4D * spread / close / 8) + 0.28D / (1 + illiquidity / 0.2D) + 0.28D * least(1.0D, log10(greatest(adv, 1.0D)) / 8)) / 0.88D"))
    x = hurst(spark, sf_dir).join(unit_root(spark, sf_dir).select("key", F.col("statistic").alias("adf")), "key", "left")
    for part in (vol, directed, dry.select("key", "liquidity")):
        x = x.join(part, "key", "left")
    out = factors(regimes(x))
    return out.select("key", "label", "beneath", "family", "factor", *[F.round(c, 4).alias(c) for c in ("confidence", "trend_score", "reversion_score", "vol_share", "liquidity")])


_CLIP = lambda x, low=-1, high=1: f"greatest({low}, least({high}, {x}))"
REGIMES = f"""WITH b AS ({BARS_SQL}), hu AS ({HURST}), ur AS ({UNIT_ROOT}), dx AS ({ADX}), li AS ({LIQUIDITY}), wf AS ({WIDE_FEATURES}),
v AS (SELECT key, avg((rv <= newest)::INT) AS vol_share, arg_max(slope, t) AS slope FROM (SELECT key, t, realised_vol_20 AS rv, trend_slope_20 AS slope, first(realised_vol_20) OVER (PARTITION BY key ORDER BY t DESC) AS newest, row_number() OVER (PARTITION BY key ORDER BY t DESC) AS back FROM wf) WHERE back <= 252 GROUP BY key),
d AS (SELECT key, plus_di - minus_di AS gap, adx FROM dx QUALIFY row_number() OVER (PARTITION BY key ORDER BY t DESC) = 1),
a AS (SELECT key, avg(volume) AS adv, arg_max(close, t) AS c FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC) AS back FROM b) WHERE back <= 30 GROUP BY key),
i AS (SELECT key, coalesce(vol_share, 0.5) AS vs, coalesce(v.slope, 0) AS slope, coalesce(gap, 0) AS gap, coalesce((0.32 / (1 + 1250 * spread / c) + 0.28 / (1 + 5 * illiquidity) + 0.035 * least(8, log10(greatest(adv, 1)))) / 0.88, 0.5) AS liq,
  0.4 * {_CLIP('(hurst - 0.5) / 0.15')} AS hold, 0.6 * {_CLIP('(coalesce(adx, 0) - 25) / 15')} AS strong, 0.55 * {_CLIP('(-2.86 - coalesce(statistic, 0)) / 1.5')} AS still FROM hu LEFT JOIN ur USING (key) LEFT JOIN v USING (key) LEFT JOIN d USING (key) LEFT JOIN li USING (key) LEFT JOIN a USING (key)),
s AS (SELECT *, hold + strong AS ts, still - hold * 1.125 AS rs FROM i),
l AS (SELECT *, CASE WHEN vs >= 0.85 THEN 'high_volatility' WHEN greatest(ts, rs) > 0.2 THEN CASE WHEN rs > ts THEN 'mean_reverting' WHEN gap > 0 OR (gap > -2 AND slope > 0) THEN 'trending_bull' ELSE 'trending_bear' END
  WHEN vs < 0.3 THEN 'low_volatility_drift' WHEN rs > ts THEN 'mean_reverting' WHEN gap > 0 THEN 'trending_bull' ELSE 'trending_bear' END AS beneath FROM s),
r AS (SELECT key, beneath, CASE WHEN liq < 0.3 THEN 'illiquid' ELSE beneath END AS label, CASE WHEN liq < 0.3 THEN {_CLIP('1 - liq / 0.3', 0.35, 0.98)} WHEN vs >= 0.85 THEN {_CLIP('(vs - 0.85) / 0.15', 0.4, 0.98)} WHEN greatest(ts, rs) > 0.2 THEN least(0.97, 0.5 + greatest(ts, rs) / 2) WHEN vs < 0.3 THEN {_CLIP('0.8 - vs', 0.4, 0.9)} ELSE 0.35 END AS confidence, ts, rs, vs, liq FROM l),
f(label, family, factor) AS (VALUES {', '.join(f"('{n}', '{family}', {v}::DOUBLE)" for n, own in FACTORS.items() for family, v in zip(FAMILIES, own, strict=True))})
SELECT key, label, beneath, family, factor, round(confidence, 4)::DOUBLE AS confidence, round(ts, 4)::DOUBLE AS trend_score, round(rs, 4)::DOUBLE AS reversion_score, round(vs, 4)::DOUBLE AS vol_share, round(liq, 4)::DOUBLE AS liquidity FROM r JOIN f USING (label)"""

QUERIES = {"regime_factors": (regime_factors, REGIMES)}
