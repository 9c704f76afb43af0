"""Queries of the features over bars: values with states, and their variants. The SQL is written apart, by named windows and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.features import BANDS, FEATURES, LEAST_BARS, YEAR, long_features, states, variants, wide_features
from larkspur.sources.roles import BARS_SQL, bars


def bar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature of each bar with its group and state. As in the SQL, minus infinity (behind another key's price of zero) lies in no band and has no row."""
    group = F.create_map(*[F.lit(x) for name, f in FEATURES.items() for x in (name, f.group)])
    return states(long_features(wide_features(bars(spark, sf_dir))).where(F.col("value") > float("-inf"))).withColumn("group", group[F.col("feature")])


def feature_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes over 1, 5 and 20 bars, their z scores over a year of bars, the share of the year below, and the rank across keys."""
    x = variants(long_features(wide_features(bars(spark, sf_dir), 4)))
    return x.select("key", "t", "feature", "rank", F.round("percentile", 6).alias("percentile"), *[F.round(f"delta_{n}", 4).alias(f"delta_{n}") for n in (1, 5, 20)], *[F.round(f"z_{n}", 3).alias(f"z_{n}") for n in (1, 5, 20)])


_W = lambda n: f"w{n} AS (PARTITION BY key ORDER BY t ROWS {n - 1} PRECEDING)"
_ALL = ", ".join(["k AS (PARTITION BY key ORDER BY t)", *map(_W, (3, 5, 14, 20, 30, 60, 252))])
_SQL = {
    "stoch_k_14": "avg(raw) OVER w3", "williams_r_14": "CASE WHEN h14 > l14 THEN 100 * (close - h14) / (h14 - l14) ELSE -50 END",
    "roc_10": "100 * (close - c10) / c10", "roc_20": "r20", "mfi_14": "coalesce(100 * sum(greatest(flow, 0)) OVER w14 / nullif(sum(abs(flow)) OVER w14, 0), 50)",
    "cci_20": "coalesce((tp - list_avg(tps)) / nullif(0.015 * list_avg(list_transform(tps, lambda x: abs(x - list_avg(tps)))), 0), 0)",
    "close_location": "coalesce((close - low) / nullif(high - low, 0), 0.5)", "trend_slope_20": "100 * covar_pop(i, close) OVER w20 / var_pop(i) OVER w20 / avg(close) OVER w20",
    "dist_from_20d_high": "100 * (close - max(high) OVER w20) / max(high) OVER w20", "dist_from_252d_high": "100 * (close - max(high) OVER w252) / max(high) OVER w252", "dist_from_20d_low": "100 * (close - min(low) OVER w20) / min(low) OVER w20",
    "realised_vol_20": "100 * sqrt(252 * var_samp(lr) OVER w20)", "gk_vol_20": "100 * sqrt(greatest(avg(gk) OVER w20, 0) * 252)",
    "bb_width_20": "4 * stddev_pop(close) OVER w20 / avg(close) OVER w20", "bb_percent_b": "coalesce(0.5 + (close - avg(close) OVER w20) / nullif(4 * stddev_pop(close) OVER w20, 0), 0.5)",
    "vol_ratio_5_20": "coalesce(stddev_samp(lr) OVER w5 / nullif(stddev_samp(lr) OVER w20, 0), 1)", "gap_pct": "100 * (open - p) / p", "rel_strength_20d": "r20 - mk20",
    "beta_60": "CASE WHEN i > 60 THEN covar_pop(pr, mk) OVER w60 / var_pop(mk) OVER w60 ELSE 1 END",
    "idio_alpha_60": "CASE WHEN i > 60 THEN 1e4 * (avg(pr) OVER w60 - covar_pop(pr, mk) OVER w60 / var_pop(mk) OVER w60 * avg(mk) OVER w60) ELSE 0 END",
    "corr_bench_60": "CASE WHEN i > 60 THEN corr(pr, mk) OVER w60 ELSE 0.5 END", "rel_volume_20": "volume / avg(volume) OVER w20",
    "obv_slope_20": "coalesce(covar_pop(i, obv) OVER w20 / var_pop(i) OVER w20 / nullif(avg(abs(obv)) OVER w20, 0), 0)",
    "cmf_20": "sum(CASE WHEN high > low THEN volume * (2 * close - high - low) / (high - low) ELSE 0 END) OVER w20 / sum(volume) OVER w20",
    "adv_ratio": "volume / avg(volume) OVER w30", "dollar_volume_z": "CASE WHEN stddev_samp(close * volume) OVER w60 > 1e-9 THEN (close * volume - avg(close * volume) OVER w60) / stddev_samp(close * volume) OVER w60 ELSE 0 END",
}
WIDE_FEATURES = f"""WITH a AS (SELECT *, lag(close) OVER k AS p, lag(close, 10) OVER k AS c10, lag(close, 20) OVER k AS c20, row_number() OVER k AS i, (high + low + close) / 3 AS tp, max(high) OVER w14 AS h14, min(low) OVER w14 AS l14 FROM ({BARS_SQL}) WINDOW {_ALL}),
b AS (SELECT *, close / p - 1 AS pr, ln(close) - ln(p) AS lr, 100 * (close - c20) / c20 AS r20, list(tp) OVER w20 AS tps, sign(tp - lag(tp) OVER k) * tp * volume AS flow, sum(coalesce(sign(close - p), 0) * volume) OVER k AS obv,
  CASE WHEN h14 > l14 THEN 100 * (close - l14) / (h14 - l14) ELSE 50 END AS raw, (ln(open) - ln(p)) ** 2 + (ln(high) - ln(low)) ** 2 / 2 - (2 * ln(2) - 1) * (ln(close) - ln(open)) ** 2 AS gk FROM a WINDOW {_ALL}),
m AS (SELECT *, avg(pr) OVER (PARTITION BY t) AS mk, avg(r20) OVER (PARTITION BY t) AS mk20 FROM b), f AS (SELECT key, t, i, {', '.join(f'({v})::DOUBLE AS {k}' for k, v in _SQL.items())} FROM m WINDOW {_ALL})
SELECT key, t, {', '.join(f'round({k}, 6) AS {k}' for k in FEATURES)} FROM f WHERE i >= {LEAST_BARS}"""
_TO_4 = WIDE_FEATURES.replace(", 6) AS", ", 4) AS")
_BAND_ROWS = ", ".join(f"('{name}', {place}, {'-1e308' if not place else own[2 * place - 1]}::DOUBLE, '{own[2 * place]}')" for name, own in BANDS.items() for place in range(len(own) // 2 + 1))
_GROUPS = ", ".join(f"('{name}', '{f.group}')" for name, f in FEATURES.items())
BAR_FEATURES = f"""WITH l AS (UNPIVOT ({WIDE_FEATURES}) ON {', '.join(FEATURES)} INTO NAME feature VALUE value), bands(feature, place, least, state) AS (VALUES {_BAND_ROWS}), groups(feature, "group") AS (VALUES {_GROUPS})
SELECT key, t, feature, any_value(value) AS value, arg_max(state, place) AS state, any_value("group") AS "group" FROM l JOIN bands USING (feature) JOIN groups USING (feature) WHERE value >= least GROUP BY key, t, feature"""
FEATURE_VARIANTS = f"""WITH l AS (UNPIVOT ({_TO_4}) ON {', '.join(FEATURES)} INTO NAME feature VALUE value),
d AS (SELECT *, value - lag(value) OVER w AS d1, value - lag(value, 5) OVER w AS d5, value - lag(value, 20) OVER w AS d20, rank() OVER (PARTITION BY t, feature ORDER BY value DESC) AS r FROM l WINDOW w AS (PARTITION BY key, feature ORDER BY t)),
z AS (SELECT *, {', '.join(f'avg(d{n}) OVER f AS a{n}, stddev_pop(d{n}) OVER f AS s{n}' for n in (1, 5, 20))}, list(value) OVER f AS seen FROM d WINDOW f AS (PARTITION BY key, feature ORDER BY t ROWS {YEAR - 1} PRECEDING))
SELECT key, t, feature, r::INT AS rank, CASE WHEN len(seen) > 1 THEN round(len(list_filter(seen, lambda x: x < value)) / (len(seen) - 1), 6) END AS percentile, {', '.join(f'round(d{n}, 4) AS delta_{n}, CASE WHEN s{n} > 1e-6 THEN round((d{n} - a{n}) / s{n}, 3) END AS z_{n}' for n in (1, 5, 20))} FROM z"""

QUERIES = {"bar_features": (bar_features, BAR_FEATURES), "feature_variants": (feature_variants, FEATURE_VARIANTS)}
