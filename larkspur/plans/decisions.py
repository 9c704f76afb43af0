"""Queries of implied volatilities, strikes by delta, gated setups, convictions with their levels, regimes, ridge fits and month buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.recurrences import recurrence
from larkspur.plans.signals import DECISION_STEPS, SIGNAL_STEPS, normal_quantile, vectors
from larkspur.plans.valuation import OPTION_STEPS, normal_cdf, staged, staged_sql
from larkspur.sources.roles import BARS_SQL, bars, month_bucket, table

HALVINGS, VOL_LEAST, VOL_MOST, TIME_VALUE = 45, 1e-6, 5.0, 1e-4


def _let(name: str, value: str, body: str) -> str:
    """The body with the name standing for a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def implied_vol(price: str) -> str:
    """The volatility at which a call (columns s, strike, tau, r, df) has this price: a bracket is halved until it is below
    1e-12 wide, all inside one JVM expression. NULL where the price holds less than 1e-4 of the spot over its bounds."""
    call = _let("d", "(ln(s / strike) + r * tau) / (v * sqrt(tau)) + v * sqrt(tau) / 2", f"s * ({normal_cdf('d')}) - strike * df * ({normal_cdf('(d - v * sqrt(tau))')})")
    halve = _let("v", "(b.lo + b.hi) / 2", _let("c", call, f"named_struct('lo', if(c > {price}, b.lo, v), 'hi', if(c > {price}, v, b.hi))"))
    found = f"aggregate(sequence(1, {HALVINGS}), named_struct('lo', {VOL_LEAST}D, 'hi', {VOL_MOST}D), (b, k) -> {halve}, b -> (b.lo + b.hi) / 2)"
    return f"CASE WHEN {price} - greatest(s - strike * df, 0) >= {TIME_VALUE} * s AND {price} < s THEN {found} END"


def implied_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volatility implied by each part's call value, which is priced at a known one: one projection, no shuffle."""
    p = table(spark, sf_dir, "part").where("p_retailprice > 0 AND p_size > 0").select("p_partkey", "p_size", "p_retailprice")
    return staged(p, OPTION_STEPS).selectExpr("p_partkey", "round(call, 5) AS call_value", f"round({implied_vol('call')}, 5) AS implied")


# The SQL does not search: it knows the volatility each call was priced at.
IMPLIED = f"""SELECT p_partkey, round(call, 5) AS call_value, CASE WHEN call - greatest(s - strike * df, 0) >= {TIME_VALUE} * s AND call < s THEN round(0.1 + (p_partkey % 40) / 100.0, 5)::DOUBLE END AS implied
FROM ({staged_sql('SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_retailprice > 0 AND p_size > 0', OPTION_STEPS)})"""


def delta_strikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strikes at which a part's call and put have deltas of 0.25 and -0.25, from the quantile of the normal distribution."""
    p = table(spark, sf_dir, "part").where("p_retailprice > 0 AND p_size > 0").select("p_partkey", "p_size", "p_retailprice")
    x = staged(p, OPTION_STEPS[:1]).selectExpr("*", "CAST(0.25 AS DOUBLE) AS target").selectExpr("*", f"{normal_quantile('target')} AS q", "sigma * sqrt(tau) AS sd")
    return x.selectExpr("p_partkey", "round(s * exp(r * tau + sd * sd / 2 - q * sd), 4) AS call_strike", "round(s * exp(r * tau + sd * sd / 2 + q * sd), 4) AS put_strike")


DELTA_STRIKES = """WITH o AS (SELECT p_partkey, p_retailprice AS s, p_size / 50.0::DOUBLE AS tau, 0.1::DOUBLE + (p_partkey % 40) / 100.0::DOUBLE AS sigma, 0.6744897501960817::DOUBLE AS z FROM part WHERE p_retailprice > 0 AND p_size > 0)
SELECT p_partkey, round(s * exp((0.03 + sigma * sigma / 2) * tau + z * sigma * sqrt(tau)), 4) AS call_strike, round(s * exp((0.03 + sigma * sigma / 2) * tau - z * sigma * sqrt(tau)), 4) AS put_strike FROM o"""

PRICE_CEILING = 20


def _over(n: int, upto: int = 0):
    return Window.partitionBy("key").orderBy("t").rowsBetween(1 - n, upto)


def _gates(*rules: Column) -> Column:
    """How many of the rules hold; unknown ones do not."""
    return sum((F.coalesce(r, F.lit(False)).cast("int") for r in rules), F.lit(0))


def gated_setups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bar and setup (ladder of green bars, bounce from the lower band, continuation of relative strength): how many of
    its gates pass; it fires if all do. Relative strength is held against the mean of all keys at that time."""
    c, w = F.col("close"), Window.partitionBy("key").orderBy("t")
    x = bars(spark, sf_dir).withColumn("roc", F.when(F.lag("close", 20).over(w) > 0, 100 * (c / F.lag("close", 20).over(w) - 1)))
    x = x.withColumn("lead", F.col("roc") - F.avg("roc").over(Window.partitionBy("t")))
    mean = lambda n: F.when(F.count("*").over(_over(n)) == n, F.avg("close").over(_over(n)))
    from_ = lambda level: F.when(level > 0, 100 * (c / level - 1))
    green = F.sum((c > F.col("open")).cast("int")).over(_over(5)) == 5
    x = x.select("key", "t",
        _gates(c < PRICE_CEILING, green, F.col("volume") >= 2 * F.avg("volume").over(_over(11, -1)), mean(20).isNotNull() & from_(F.greatest(mean(8), mean(20))).between(-1.2, 0.8)).alias("ladder_gates"),
        _gates(c <= PRICE_CEILING, (F.stddev_pop("close").over(_over(5)) > 1e-9) & (F.min("low").over(_over(5)) <= F.avg("close").over(_over(5)) - 2 * F.stddev_pop("close").over(_over(5))), c > (F.max("high").over(_over(10)) + F.min("low").over(_over(10))) / 2, F.col("high") >= F.max("high").over(_over(7, -1))).alias("bounce_gates"),
        _gates(F.col("lead") >= 5, from_(F.max("high").over(_over(252))) >= -8, 100 * (mean(50) / mean(200) - 1) >= 1, from_(mean(20)).between(-6, 1)).alias("continuation_gates"),
    )
    fired = F.concat_ws(",", *[F.when(F.col(f"{n}_gates") == 4, F.lit(n)) for n in ("ladder", "bounce", "continuation")])
    return x.withColumn("fired", fired)


_W = lambda n, upto="CURRENT ROW": f"(PARTITION BY key ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND {upto})"
SETUPS = f"""WITH b AS ({BARS_SQL}), r AS (SELECT *, 100 * (close / nullif(lag(close, 20) OVER (PARTITION BY key ORDER BY t), 0) - 1) AS roc FROM b),
m AS (SELECT *, roc - avg(roc) OVER (PARTITION BY t) AS lead, row_number() OVER (PARTITION BY key ORDER BY t) AS i, count(*) FILTER (close > open) OVER {_W(5)} AS greens, avg(volume) OVER {_W(11, "1 PRECEDING")} AS usual, max(high) OVER {_W(7, "1 PRECEDING")} AS hour_high,
  avg(close) OVER {_W(5)} AS m5, stddev_pop(close) OVER {_W(5)} AS s5, min(low) OVER {_W(5)} AS l5, max(high) OVER {_W(10)} AS h10, min(low) OVER {_W(10)} AS l10, avg(close) OVER {_W(8)} AS m8, avg(close) OVER {_W(20)} AS m20, avg(close) OVER {_W(50)} AS m50, avg(close) OVER {_W(200)} AS m200, max(high) OVER {_W(252)} AS year FROM r),
g AS (SELECT key, t, [close < {PRICE_CEILING}, greens = 5, volume >= 2 * usual, i >= 20 AND 100 * (close / greatest(m8, m20) - 1) BETWEEN -1.2 AND 0.8] AS a, [close <= {PRICE_CEILING}, s5 > 1e-9 AND l5 <= m5 - 2 * s5, close > (h10 + l10) / 2, high >= hour_high] AS b,
  [lead >= 5, 100 * (close / year - 1) >= -8, i >= 200 AND 100 * (m50 - m200) / m200 >= 1, i >= 20 AND 100 * (close / m20 - 1) BETWEEN -6 AND 1] AS c FROM m),
n AS (SELECT key, t, len(list_filter(a, lambda x: x))::INT AS ladder_gates, len(list_filter(b, lambda x: x))::INT AS bounce_gates, len(list_filter(c, lambda x: x))::INT AS continuation_gates FROM g)
SELECT *, concat_ws(',', CASE WHEN ladder_gates = 4 THEN 'ladder' END, CASE WHEN bounce_gates = 4 THEN 'bounce' END, CASE WHEN continuation_gates = 4 THEN 'continuation' END) AS fired FROM n"""


def _clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with their decision, the share of rises, how straight the closes run and the mean return over 20 bars."""
    x = staged(bars(spark, sf_dir), SIGNAL_STEPS + DECISION_STEPS)
    rise = F.when(F.col("close") > F.col("prev"), 1.0).otherwise(0.0)
    ret = F.when(F.col("prev") > 0, F.col("close") / F.col("prev") - 1)
    x = x.withColumn("rises", F.avg(rise).over(_over(20))).withColumn("drift20", _clamp(F.coalesce(F.avg(ret).over(_over(20)), F.lit(0.0)), -0.25, 0.25))
    return x.withColumn("straight", F.when(F.count("*").over(_over(20)) == 20, F.regr_r2("close", "i").over(_over(20))).otherwise(0.0))


_DECIDED = f"""SELECT *, avg(CASE WHEN close > prev THEN 1.0 ELSE 0.0 END) OVER {_W(20)} AS rises, greatest(-0.25, least(0.25, coalesce(avg(close / nullif(prev, 0) - 1) OVER {_W(20)}, 0))) AS drift20,
  CASE WHEN i >= 20 THEN pow(corr(close, i) OVER {_W(20)}, 2) ELSE 0 END AS straight FROM ({staged_sql(BARS_SQL, SIGNAL_STEPS + DECISION_STEPS)})"""


def convictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's published conviction (0 to 100), levels and range of expected return. A flat bar has no conviction, both levels
    at its close, and no expectation; the mean return counts towards the expectation only where it points the decision's way."""
    x = _decided(spark, sf_dir)
    way, close = F.col("way"), F.col("close")
    edge = _clamp(2 * F.when(way == 1, F.col("rises")).otherwise(1 - F.col("rises")) - 1, 0.0, 1.0)
    raw = 0.4 * edge + 0.35 * _clamp(F.abs(F.col("up") - F.col("down")), 0.0, 1.0) + 0.25 * _clamp(F.greatest("up", "down"), 0.0, 1.0)
    x = x.withColumn("conviction", F.when(way == 0, 0.0).otherwise(F.round(100 * _clamp(raw * (0.7 + 0.3 * F.col("straight")), 0.0, 1.0), 1)))
    x = x.withColumn("gain", 3 * way * F.col("atr") / close).withColumn("loss", -2 * way * F.col("atr") / close)
    mid = F.when(F.signum("drift20") == way, (F.col("drift20") + F.col("gain")) / 2).otherwise(F.col("gain"))
    spread = F.greatest(F.abs(F.col("gain") - F.col("loss")) / 2, F.abs("drift20") / 2, F.lit(0.002))
    told = lambda v: F.when((way == 0) | (close <= 0), 0.0).otherwise(F.round(v, 6))
    level = lambda d: F.round(F.when(way != 0, close * (1 + F.col(d))).otherwise(close), 6)
    return x.select("key", "t", "conviction", level("loss").alias("stop"), level("gain").alias("target"), told(mid - spread).alias("low"), told(mid).alias("mid"), told(mid + spread).alias("high"))


CONVICTIONS = f"""WITH d AS ({_DECIDED}), f AS (SELECT *, close + 3 * way * atr AS target_at, close - 2 * way * atr AS stop_at, CASE WHEN way = 1 THEN 2 * rises - 1 ELSE 1 - 2 * rises END AS edge FROM d),
e AS (SELECT *, CASE WHEN drift20 * way > 0 THEN 0.5 * drift20 + 0.5 * (target_at - close) / close ELSE (target_at - close) / close END AS m, greatest(abs(target_at - stop_at) / close / 2, 0.5 * abs(drift20), 0.002) AS spread FROM f)
SELECT key, t, CASE WHEN way = 0 THEN 0 ELSE round(100 * least(1, (0.4 * greatest(0, edge) + 0.35 * least(1, abs(up - down)) + 0.25 * least(1, greatest(up, down))) * (0.7 + 0.3 * straight)), 1) END AS conviction,
  round(CASE WHEN way <> 0 THEN stop_at ELSE close END, 6) AS stop, round(CASE WHEN way <> 0 THEN target_at ELSE close END, 6) AS target, CASE WHEN way = 0 OR close <= 0 THEN 0 ELSE round(m - spread, 6) END AS low, CASE WHEN way = 0 OR close <= 0 THEN 0 ELSE round(m, 6) END AS mid, CASE WHEN way = 0 OR close <= 0 THEN 0 ELSE round(m + spread, 6) END AS high FROM e"""


def macro_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's probabilities of a rising, a falling and a directionless market, the likeliest of them, and whether one side
    is inhibited: a clear direction while the band is wider than in four fifths of the last 60 bars."""
    x = _decided(spark, sf_dir).withColumn("chop", _clamp(1 - F.col("straight"), 0.05, 0.9))
    x = x.withColumn("bull", (1 - F.col("chop")) * F.col("rises")).withColumn("bear", (1 - F.col("chop")) * (1 - F.col("rises")))
    x = x.withColumn("widths", F.collect_list("width").over(_over(60)))
    wide = F.coalesce(F.size(F.filter("widths", lambda v: v <= F.col("width"))) / F.nullif(F.size("widths"), F.lit(0)) > 0.8, F.lit(False))
    label = F.when((F.col("bull") >= F.col("bear")) & (F.col("bull") >= F.col("chop")), "bull").when(F.col("bear") >= F.col("chop"), "bear").otherwise("chop")
    x = x.withColumn("label", label).withColumn("wide", wide)
    kept = lambda side: (F.col("label") == side) & (F.col(side) > 0.55) & F.col("wide")
    return x.select("key", "t", *[F.round(c, 6).alias(c) for c in ("bull", "bear", "chop")], "label", kept("bear").alias("inhibit_long"), kept("bull").alias("inhibit_short"))


MACRO = f"""WITH d AS (SELECT *, greatest(0.05, least(0.9, 1 - straight)) AS chop, list(width) FILTER (width IS NOT NULL) OVER {_W(60)} AS widths FROM ({_DECIDED})),
p AS (SELECT *, (1 - chop) * rises AS bull, (1 - chop) * (1 - rises) AS bear, coalesce(len(list_filter(widths, lambda v: v <= width)) > 0.8 * len(widths), FALSE) AS wide FROM d),
l AS (SELECT *, CASE WHEN bull >= greatest(bear, chop) THEN 'bull' WHEN bear >= chop THEN 'bear' ELSE 'chop' END AS label FROM p)
SELECT key, t, round(bull, 6) AS bull, round(bear, 6) AS bear, round(chop, 6) AS chop, label, label = 'bear' AND bear > 0.55 AND wide AS inhibit_long, label = 'bull' AND bull > 0.55 AND wide AS inhibit_short FROM l"""

PENALTY = 0.001


def ridge_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per supplier: prices of lines by quantity and discount with a penalty, solved from sums that combine before the shuffle."""
    a, b, y = F.col("l_quantity"), F.col("l_discount"), F.col("l_extendedprice")
    g = table(spark, sf_dir, "lineitem").where("l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL").groupBy("l_suppkey").agg(
        F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in {"aa": a * a, "ab": a * b, "bb": b * b, "ay": a * y, "by": b * y}.items()])
    g = g.withColumn("aa", F.col("aa") + PENALTY).withColumn("bb", F.col("bb") + PENALTY).withColumn("det", F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab"))
    return g.select("l_suppkey", "n", F.round((F.col("ay") * F.col("bb") - F.col("by") * F.col("ab")) / F.col("det"), 3).alias("by_quantity"), F.round((F.col("by") * F.col("aa") - F.col("ay") * F.col("ab")) / F.col("det"), 1).alias("by_discount"))


# One coefficient by Cramer's rule, the other from its own equation.
RIDGE = f"""WITH s AS (SELECT l_suppkey, count(*) AS n, sum(l_quantity * l_quantity) + {PENALTY} AS aa, sum(l_quantity * l_discount) AS ab, sum(l_discount * l_discount) + {PENALTY} AS bb, sum(l_quantity * l_extendedprice) AS ay, sum(l_discount * l_extendedprice) AS cy
  FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL GROUP BY 1), q AS (SELECT *, (ay * bb - cy * ab) / (aa * bb - ab * ab) AS x FROM s)
SELECT l_suppkey, n, round(x, 3) AS by_quantity, round((cy - ab * x) / bb, 1) AS by_discount FROM q"""


def month_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines and their quantity by the bucket of the month that their table would be partitioned by."""
    x = table(spark, sf_dir, "lineitem").groupBy(month_bucket("l_shipdate").alias("month_bucket"), "l_returnflag")
    return x.agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


BUCKETS = "SELECT CAST(strftime(l_shipdate, '%Y%m') AS INT) AS month_bucket, l_returnflag, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ALL"


def hedge_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's close against the mean close of all keys at that time: wandering alpha and beta by a filter, the spread that
    was not foreseen and its z."""
    return recurrence(bars(spark, sf_dir).select("key", "t", "close", F.avg("close").over(Window.partitionBy("t")).alias("market")), "hedge", places=4)


HEDGE = f"""WITH RECURSIVE b AS (SELECT key, t, close AS y, avg(close) OVER (PARTITION BY t) AS x, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM ({BARS_SQL})),
k AS (SELECT key, NULL::TIMESTAMP AS t, 0::BIGINT AS i, y AS a, 0::DOUBLE AS c, 1::DOUBLE AS p11, 0::DOUBLE AS p12, 1::DOUBLE AS p22, 1e-3::DOUBLE AS r, 0::DOUBLE AS spread, 0::DOUBLE AS s FROM b WHERE i = 1
UNION ALL SELECT key, t, i, a + u / s * e, c + v / s * e, q11 - u * u / s, p12 - u * v / s, q22 - v * v / s, greatest(0.99 * r + 0.01 * (e * e - (s - r)), 1e-10), e, s
  FROM (SELECT *, u + x * v + r AS s FROM (SELECT b.key, b.t, b.i, b.x, k.a, k.c, k.r, p11 + 1e-5 AS q11, p12, p22 + 1e-5 AS q22, p11 + 1e-5 + p12 * b.x AS u, p12 + (p22 + 1e-5) * b.x AS v, b.y - a - c * b.x AS e FROM k JOIN b ON b.key = k.key AND b.i = k.i + 1)))
SELECT key, t, round(a, 4) AS alpha, round(c, 4) AS beta, round(spread, 4) AS spread, round(spread / sqrt(greatest(s, 1e-12)), 4) AS z FROM k WHERE i > 0"""

ELBOW_FROM, ELBOW_TO = 2, 8


def elbow_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of the usable vectors for each k: the squared distances within clusters, how far that point lies from the chord
    of the curve, and which k is chosen (the farthest; the smallest of equals). One row per k; the vectors stay on the executors."""
    from pyspark.ml.clustering import KMeans

    x = vectors(spark, sf_dir).persist()
    try:
        curve = [(k, KMeans(k=k, seed=7, maxIter=15).fit(x).summary.trainingCost) for k in range(ELBOW_FROM, ELBOW_TO + 1)]
    finally:
        x.unpersist()
    (k0, w0), (k1, w1) = curve[0], curve[-1]
    chord = ((k1 - k0) ** 2 + (w1 - w0) ** 2) ** 0.5
    far = [abs((w1 - w0) * (k - k0) - (k1 - k0) * (w - w0)) / chord for k, w in curve]
    return spark.createDataFrame([(k, round(w, 4), round(d, 6), d == max(far) and far.index(d) == i) for i, ((k, w), d) in enumerate(zip(curve, far))], "k int, wcss double, distance double, chosen boolean")


QUERIES = {
    "hedge_ratio": (hedge_ratio, HEDGE), "elbow_clusters": (elbow_clusters, None),
    "implied_volatility": (implied_volatility, IMPLIED), "delta_strikes": (delta_strikes, DELTA_STRIKES), "gated_setups": (gated_setups, SETUPS), "convictions": (convictions, CONVICTIONS),
    "macro_regimes": (macro_regimes, MACRO), "ridge_fit": (ridge_fit, RIDGE), "month_buckets": (month_buckets, BUCKETS),
}
