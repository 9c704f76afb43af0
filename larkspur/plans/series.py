"""Queries over bars: indicators, recurrences, resampling, estimators."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.indicators import STEPS, indicator
from larkspur.operators.recurrences import RECURRENCES, recurrence
from larkspur.sources.roles import BARS_SQL, bars, ohlcv, table

SMOOTHED = """, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM x WHERE v IS NOT NULL),
s AS (SELECT key, i, t, (SELECT avg(v) FROM n b WHERE b.key = n.key AND b.i <= {n}) AS e FROM n WHERE i = {n}
      UNION ALL SELECT n.key, n.i, n.t, s.e + {alpha} * (n.v - s.e) FROM s JOIN n ON n.key = s.key AND n.i = s.i + 1)"""


def _recursive(x: str, n: int, alpha: str, out: str) -> str:
    """A recurrence over x (key, t, v): NULL rows of the warm-up are kept."""
    return f"WITH RECURSIVE b AS ({BARS_SQL}), x AS ({x}){SMOOTHED.format(n=n, alpha=alpha)} SELECT x.key, x.t, {out} FROM x LEFT JOIN s ON s.key = x.key AND s.t = x.t"


def _indicator_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicator(bars(spark, sf_dir), name)


def _recurrence_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrence(bars(spark, sf_dir), name)


def _indicator_sql(name: str) -> str:
    sql = BARS_SQL
    for step in STEPS[name]:
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    columns = ", ".join(k if name == "consecutive_closes" else f"round({k}, 6) AS {k}" for k in STEPS[name][-1])
    return f"SELECT key, t, {columns} FROM ({sql})"


def resample_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of four hours, on epoch boundaries, with the volume-weighted typical price."""
    four = F.timestamp_seconds(F.floor(F.unix_timestamp("t") / 14400) * 14400)
    b = bars(spark, sf_dir).withColumn("bucket", four)
    return b.groupBy("key", F.col("bucket").alias("t")).agg(
        F.min_by("open", "t").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "t").alias("close"), F.sum("volume").alias("volume"),
        F.round(F.sum((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")) / F.sum("volume"), 6).alias("vwap"),
    )


RESAMPLE = f"""WITH b AS ({BARS_SQL}) SELECT key, time_bucket(INTERVAL 4 HOUR, t, TIMESTAMP '1970-01-01') AS t, arg_min(open, t) AS open, max(high) AS high, min(low) AS low, arg_max(close, t) AS close,
  sum(volume) AS volume, round(sum((high + low + close) / 3 * volume) / sum(volume), 6) AS vwap FROM b GROUP BY key, time_bucket(INTERVAL 4 HOUR, t, TIMESTAMP '1970-01-01')"""


def series_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample moments per key: adjusted skewness and excess kurtosis, exact quantiles, scaled median deviation."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "value")
    base = e.groupBy("key").agg(
        F.count("*").cast("double").alias("n"), F.avg("value").alias("mean"), F.var_samp("value").alias("variance"), F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
        F.percentile("value", F.lit(0.05)).alias("q05"), F.median("value").alias("med"),
    )
    spread = e.join(base.select("key", "med"), "key").groupBy("key").agg(F.median(F.abs(F.col("value") - F.col("med"))).alias("mad"))
    n = F.col("n")
    return base.join(spread, "key").select(
        "key", F.round("mean", 6).alias("mean"), F.round(F.coalesce("variance", F.lit(0.0)), 6).alias("variance"),
        F.when(n > 2, F.round(F.sqrt(n * (n - 1)) / (n - 2) * F.col("g1"), 6)).alias("skewness"),
        F.when(n > 3, F.round((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6), 6)).alias("kurtosis"),
        F.round("q05", 6).alias("q05"), F.round("med", 6).alias("median"), F.round(1.4826 * F.col("mad"), 6).alias("mad"),
    )


MOMENTS = """WITH m AS (SELECT user_id AS key, median(value) AS med FROM events GROUP BY 1),
a AS (SELECT user_id AS key, median(abs(value - med)) AS mad FROM events JOIN m ON m.key = user_id GROUP BY 1)
SELECT user_id AS key, round(avg(value), 6) AS mean, round(coalesce(var_samp(value), 0), 6) AS variance, CASE WHEN count(*) > 2 THEN round(skewness(value), 6) END AS skewness,
  CASE WHEN count(*) > 3 THEN round(kurtosis(value), 6) END AS kurtosis, round(quantile_cont(value, 0.05), 6) AS q05, round(any_value(med), 6) AS median, round(1.4826 * any_value(mad), 6) AS mad
FROM events JOIN m ON m.key = user_id JOIN a ON a.key = user_id GROUP BY user_id"""


def ou_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reversion of each key's closes: x(t+1) on x(t) by least squares, as speed, mean and half-life."""
    w = Window.partitionBy("key").orderBy("t")
    x = bars(spark, sf_dir).select("key", F.col("close").alias("x"), F.lead("close").over(w).alias("y")).where("y IS NOT NULL")
    fit = x.groupBy("key").agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"))
    reverts = (F.col("b") > 0) & (F.col("b") < 1)
    return fit.select("key", "n", F.round("b", 6).alias("persistence"), F.when(reverts, F.round(F.col("a") / (1 - F.col("b")), 6)).alias("mean"), F.when(reverts, F.round(-F.log("b"), 6)).alias("speed"), F.when(reverts, F.round(F.log(F.lit(2.0)) / -F.log("b"), 6)).alias("half_life"))


OU = f"""WITH b AS ({BARS_SQL}), x AS (SELECT key, close AS x, lead(close) OVER (PARTITION BY key ORDER BY t) AS y FROM b),
f AS (SELECT key, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x WHERE y IS NOT NULL GROUP BY key)
SELECT key, n, round(b, 6) AS persistence, CASE WHEN b > 0 AND b < 1 THEN round(a / (1 - b), 6) END AS mean, CASE WHEN b > 0 AND b < 1 THEN round(-ln(b), 6) END AS speed,
  CASE WHEN b > 0 AND b < 1 THEN round(ln(2.0) / -ln(b), 6) END AS half_life FROM f"""


def pair_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation, slope and rank correlation of the hourly closes of each two keys."""
    b = bars(spark, sf_dir).select("key", "t", "close")
    p = b.toDF("k1", "t", "x").join(b.toDF("k2", "t", "y"), "t").where("k1 < k2")

    def average_rank(c: str):
        w = Window.partitionBy("k1", "k2")
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy("k1", "k2", c)) - 1) / 2

    r = p.withColumn("rx", average_rank("x")).withColumn("ry", average_rank("y"))
    return r.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.round(F.corr("x", "y"), 6).alias("correlation"), F.round(F.regr_slope("y", "x"), 6).alias("beta"), F.round(F.regr_r2("y", "x"), 6).alias("r2"), F.round(F.corr("rx", "ry"), 6).alias("spearman"))


PAIRS = f"""WITH b AS ({BARS_SQL}), p AS (SELECT a.key AS k1, c.key AS k2, a.close AS x, c.close AS y FROM b a JOIN b c ON a.t = c.t AND a.key < c.key),
r AS (SELECT *, rank() OVER (PARTITION BY k1, k2 ORDER BY x) + (count(*) OVER (PARTITION BY k1, k2, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY k1, k2 ORDER BY y) + (count(*) OVER (PARTITION BY k1, k2, y) - 1) / 2.0 AS ry FROM p)
SELECT k1, k2, count(*) AS n, round(corr(x, y), 6) AS correlation, round(regr_slope(y, x), 6) AS beta, round(regr_r2(y, x), 6) AS r2, round(corr(rx, ry), 6) AS spearman FROM r GROUP BY k1, k2"""


def liquidity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per key: effective spread from the autocovariance of price changes, price impact per volume, illiquidity."""
    w = Window.partitionBy("key").orderBy("t")
    b = bars(spark, sf_dir).withColumn("d", F.col("close") - F.lag("close").over(w))
    b = b.withColumn("pd", F.lag("d").over(w)).withColumn("signed", F.signum("d") * F.col("volume"))
    g = b.where("d IS NOT NULL").groupBy("key").agg(F.covar_samp("d", "pd").alias("auto"), F.regr_slope("d", "signed").alias("impact"), F.avg(F.when(F.col("volume") > 0, F.abs(F.col("d")) / (F.col("close") * F.col("volume")))).alias("illiquidity"))
    return g.select("key", F.when(F.col("auto") < 0, F.round(2 * F.sqrt(-F.col("auto")), 6)).otherwise(F.lit(0.0)).alias("spread"), F.round("impact", 6).alias("impact"), F.round("illiquidity", 8).alias("illiquidity"))


LIQUIDITY = f"""WITH b AS ({BARS_SQL}), d AS (SELECT *, close - lag(close) OVER (PARTITION BY key ORDER BY t) AS d FROM b),
e AS (SELECT *, lag(d) OVER (PARTITION BY key ORDER BY t) AS pd, sign(d) * volume AS signed FROM d)
SELECT key, CASE WHEN covar_samp(d, pd) < 0 THEN round(2 * sqrt(-covar_samp(d, pd)), 6) ELSE 0.0 END AS spread, round(regr_slope(d, signed), 6) AS impact,
  round(avg(CASE WHEN volume > 0 THEN abs(d) / (close * volume) END), 8) AS illiquidity FROM e WHERE d IS NOT NULL GROUP BY key"""

OWN = {"resample_ohlcv": (resample_ohlcv, RESAMPLE), "series_moments": (series_moments, MOMENTS), "ou_fit": (ou_fit, OU), "pair_correlation": (pair_correlation, PAIRS), "liquidity": (liquidity, LIQUIDITY)}

QUERIES = {f"ind_{n}": (partial(_indicator_query, n), _indicator_sql(n)) for n in STEPS}
QUERIES |= {f"rec_{n}": (partial(_recurrence_query, n), None) for n in RECURRENCES}
QUERIES |= OWN
_TR = "SELECT key, t, close, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS v FROM b WINDOW w AS (PARTITION BY key ORDER BY t)"
QUERIES["rec_ema"] = (QUERIES["rec_ema"][0], _recursive("SELECT key, t, close AS v FROM b", 20, "2.0 / 21", "round(e, 6) AS ema"))
QUERIES["rec_atr"] = (QUERIES["rec_atr"][0], _recursive(_TR, 14, "1.0 / 14", "round(e, 6) AS atr, round(100 * e / close, 6) AS atr_percent"))


def _smoothed(name: str, source: str, n: int, alpha: str) -> str:
    """CTEs that smooth v of source (key, t, v) from its first value on: the mean of n, then a step of alpha towards each."""
    return f"""{name}_n AS (SELECT key, t, v, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM {source} WHERE v IS NOT NULL),
{name}_r AS (SELECT key, i, t, (SELECT avg(v) FROM {name}_n m WHERE m.key = {name}_n.key AND m.i <= {n}) AS e FROM {name}_n WHERE i = {n}
  UNION ALL SELECT x.key, x.i, x.t, s.e + {alpha} * (x.v - s.e) FROM {name}_r s JOIN {name}_n x ON x.key = s.key AND x.i = s.i + 1),
{name} AS (SELECT key, t, e AS v FROM {name}_r)"""


_BARS = f"WITH RECURSIVE b AS ({BARS_SQL}), closes AS (SELECT key, t, close AS v FROM b), tr AS ({_TR})"
RSI = f"""{_BARS}, moves AS (SELECT key, t, close - lag(close) OVER (PARTITION BY key ORDER BY t) AS d FROM b),
ups AS (SELECT key, t, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END AS v FROM moves), downs AS (SELECT key, t, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END AS v FROM moves),
{_smoothed("u", "ups", 14, "1.0 / 14")}, {_smoothed("w", "downs", 14, "1.0 / 14")}
SELECT b.key, b.t, CASE WHEN u.v IS NULL THEN NULL WHEN u.v < 1e-9 AND w.v < 1e-9 THEN 50 WHEN w.v < 1e-9 THEN 100 WHEN u.v < 1e-9 THEN 0 ELSE round(100 * u.v / (u.v + w.v), 6) END::DOUBLE AS rsi
FROM b LEFT JOIN u USING (key, t) LEFT JOIN w USING (key, t)"""
MACD = f"""{_BARS}, {_smoothed("fast", "closes", 12, "2.0 / 13")}, {_smoothed("slow", "closes", 26, "2.0 / 27")}, gap AS (SELECT key, t, fast.v - slow.v AS v FROM fast JOIN slow USING (key, t)), {_smoothed("sig", "gap", 9, "0.2")}
SELECT b.key, b.t, round(gap.v, 6) AS macd, round(sig.v, 6) AS signal, round(gap.v - sig.v, 6) AS histogram FROM b LEFT JOIN gap USING (key, t) LEFT JOIN sig USING (key, t)"""
KELTNER = f"""{_BARS}, {_smoothed("mid", "closes", 20, "2.0 / 21")}, {_smoothed("atr", "tr", 10, "0.1")}
SELECT b.key, b.t, round(mid.v, 6) AS middle, round(mid.v + 2 * atr.v, 6) AS upper, round(mid.v - 2 * atr.v, 6) AS lower,
  CASE WHEN atr.v IS NULL THEN NULL WHEN mid.v < 1e-9 THEN 0 ELSE round(4 * atr.v / mid.v, 6) END::DOUBLE AS width, CASE WHEN mid.v IS NULL THEN NULL WHEN 4 * atr.v < 1e-9 THEN 0.5 ELSE round(0.5 + (close - mid.v) / (4 * atr.v), 6) END::DOUBLE AS percent_b FROM b LEFT JOIN mid USING (key, t) LEFT JOIN atr USING (key, t)"""
ADX = f"""{_BARS}, step AS (SELECT key, t, coalesce(high - lag(high) OVER w, 0) AS up, coalesce(lag(low) OVER w - low, 0) AS down FROM b WINDOW w AS (PARTITION BY key ORDER BY t)),
plus AS (SELECT key, t, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS v FROM step), minus AS (SELECT key, t, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS v FROM step),
{_smoothed("pa", "plus", 14, "1.0 / 14")}, {_smoothed("ma", "minus", 14, "1.0 / 14")}, {_smoothed("ra", "tr", 14, "1.0 / 14")},
di AS (SELECT key, t, CASE WHEN ra.v >= 1e-9 THEN 100 * pa.v / ra.v END AS p, CASE WHEN ra.v >= 1e-9 THEN 100 * ma.v / ra.v END AS m FROM pa JOIN ma USING (key, t) JOIN ra USING (key, t)),
since AS (SELECT key, min(t) AS since FROM di WHERE p IS NOT NULL GROUP BY key), dx AS (SELECT key, t, CASE WHEN p + m >= 1e-9 THEN 100 * abs(p - m) / (p + m) ELSE 0 END AS v FROM di JOIN since USING (key) WHERE t >= since), {_smoothed("ax", "dx", 14, "1.0 / 14")}
SELECT b.key, b.t, round(p, 6) AS plus_di, round(m, 6) AS minus_di, round(ax.v, 6) AS adx FROM b LEFT JOIN di USING (key, t) LEFT JOIN ax USING (key, t)"""
SUPERTREND = f"""{_BARS}, {_smoothed("atr", "tr", 10, "0.1")}, x AS (SELECT key, t, close, lag(close) OVER (PARTITION BY key ORDER BY t) AS before, (high + low) / 2 AS mid, v AS a FROM b LEFT JOIN atr USING (key, t)),
y AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM x WHERE a IS NOT NULL),
z AS (SELECT key, t, i, mid + 3 * a AS upper, mid - 3 * a AS lower, 1 AS way FROM y WHERE i = 1
  UNION ALL SELECT y.key, y.t, y.i, CASE WHEN mid + 3 * a < upper OR before > upper THEN mid + 3 * a ELSE upper END, CASE WHEN mid - 3 * a > lower OR before < lower THEN mid - 3 * a ELSE lower END,
    CASE WHEN close > upper THEN 1 WHEN close < lower THEN -1 ELSE way END FROM z JOIN y ON y.key = z.key AND y.i = z.i + 1)
SELECT b.key, b.t, round(CASE WHEN way = 1 THEN lower WHEN way = -1 THEN upper END, 6) AS line, way::DOUBLE AS direction FROM b LEFT JOIN z USING (key, t)"""
for _name, _sql in {"rsi": RSI, "macd": MACD, "keltner": KELTNER, "adx": ADX, "supertrend": SUPERTREND}.items():
    QUERIES[f"rec_{_name}"] = (QUERIES[f"rec_{_name}"][0], _sql)

# By neighbours and frames as joins, apart from the windows of the queries.
_NUMBERED = f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM ({BARS_SQL})), j AS (SELECT n.*, o.close AS was FROM b n LEFT JOIN b o ON o.key = n.key AND o.i = n.i - 1)"
GAP = f"{_NUMBERED} SELECT key, t, CASE WHEN i = 1 THEN NULL WHEN was > 0 THEN round(100 * (open / was - 1), 6) ELSE 0 END AS gap FROM j"
RETURNS = f"{_NUMBERED} SELECT key, t, round(close - was, 6) AS diff, round(CASE WHEN i > 1 THEN coalesce(close / nullif(was, 0) - 1, 0) END, 6) AS pct, round(CASE WHEN i > 1 THEN CASE WHEN least(was, close) > 0 THEN ln(close) - ln(was) ELSE 0 END END, 6) AS log FROM j"
GARMAN_KLASS = f"""{_NUMBERED}, x AS (SELECT key, t, i, pow(ln(open) - ln(was), 2) + pow(ln(high) - ln(low), 2) / 2 - (ln(4::DOUBLE) - 1) * pow(ln(close) - ln(open), 2) AS v FROM j WHERE was > 0 AND least(open, high, low, close) > 0)
SELECT b.key, b.t, (SELECT CASE WHEN b.i > 20 AND count(*) >= 10 THEN round(sqrt(252 * greatest(avg(v), 0)), 6) END FROM x WHERE x.key = b.key AND x.i BETWEEN b.i - 19 AND b.i) AS volatility FROM b"""
ROLLING_BETA = f"""{_NUMBERED}, r AS (SELECT key, t, i, close / was - 1 AS r FROM j WHERE was > 0), m AS (SELECT t, avg(r) AS m FROM r GROUP BY t), x AS (SELECT r.*, m FROM r JOIN m USING (t)),
f AS (SELECT b.key, b.t, count(*) AS n, regr_slope(r, m) AS beta, regr_intercept(r, m) AS alpha, corr(r, m) AS correlation, var_samp(m) AS vm, var_samp(r) AS vr FROM x b0 JOIN b ON b.key = b0.key AND b0.i BETWEEN b.i - 59 AND b.i GROUP BY b.key, b.t)
SELECT b.key, b.t, CASE WHEN n = 60 AND vm > 1e-12 THEN round(beta, 6) END AS beta, CASE WHEN n = 60 AND vm > 1e-12 THEN round(alpha, 6) END AS alpha, CASE WHEN n = 60 AND least(vm, vr) > 1e-12 THEN round(correlation, 6) END AS correlation FROM b LEFT JOIN f USING (key, t)"""
for _name, _sql in {"gap_percent": GAP, "returns": RETURNS, "garman_klass": GARMAN_KLASS, "rolling_beta": ROLLING_BETA}.items():
    QUERIES[f"ind_{_name}"] = (QUERIES[f"ind_{_name}"][0], _sql)

# The filter of level and drift, a step per bar; the noise of observation is the variance of the key's differences.
_KALMAN = f"""WITH RECURSIVE b AS (SELECT key, t, close AS v, row_number() OVER (PARTITION BY key ORDER BY t) AS i, close - lag(close) OVER (PARTITION BY key ORDER BY t) AS d FROM ({BARS_SQL})), n AS (SELECT key, greatest(1e-6, coalesce(var_pop(d), 0)) AS r FROM b GROUP BY key),
k AS (SELECT key, NULL::TIMESTAMP AS t, 0::BIGINT AS i, v AS level, 0::DOUBLE AS drift, 10::DOUBLE AS p11, 0::DOUBLE AS p12, 10::DOUBLE AS p22, 0::DOUBLE AS z FROM b WHERE i = 1
UNION ALL SELECT key, t, i, ahead + q11 / s * e, drift + q12 / s * e, q11 - q11 / s * q11, q12 - q11 / s * q12, q22 - q12 / s * q12, e / sqrt(s)
  FROM (SELECT b.key, b.t, b.i, level + drift AS ahead, drift, p11 + 2 * p12 + p22 + 1e-2 AS q11, p12 + p22 AS q12, p22 + 1e-4 AS q22, p11 + 2 * p12 + p22 + 1e-2 + r AS s, b.v - level - drift AS e FROM k JOIN b ON b.key = k.key AND b.i = k.i + 1 JOIN n ON n.key = b.key))
SELECT key, t, round(level, 6) AS level, round(z, 6) AS z FROM k WHERE i > 0"""
QUERIES["rec_kalman_trend"] = (QUERIES["rec_kalman_trend"][0], _KALMAN)
