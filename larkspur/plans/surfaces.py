"""Queries of fitted smiles: parameters, skew measures and their history. The SQL knows the parameters behind the quotes and doesn't
fit: it shows that fitting finds them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.smiles import fitted_smiles
from larkspur.plans.valuation import staged
from larkspur.sources.roles import table

#: Distinct strikes that a smile is fitted to at least.
LEAST_QUOTES = 5
#: Sessions of the history, every which of them is read from quotes, and how many calls a session needs for that.
SESSIONS, STRIDE, LEAST_CALLS = 50, 5, 6

#: A line quotes its part: the discount says the strike, and the volatility is that of the part's own parameters.
QUOTE_STEPS = [
    {"forward": "CAST(p_retailprice AS DOUBLE)", "tau": "CAST(p_size AS DOUBLE) / 50", "rho": "CAST(p_partkey % 13 AS DOUBLE) / 20 - 0.4", "nu": "0.2 + CAST(p_partkey % 7 AS DOUBLE) / 10"},
    {"strike": "forward * (0.75 + 5 * l_discount)", "alpha": "0.2 * sqrt(forward)"},
    {"m": "ln(forward / strike)", "mid": "sqrt(sqrt(forward * strike))"},
    {"z": "nu / alpha * mid * m", "den": "mid * (1 + m * m / 96 + m * m * m * m / 30720)"},
    {"bend": "CASE WHEN abs(z) > 1e-7 THEN z / ln((sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho)) ELSE 1.0 END", "later": "1 + (alpha * alpha / (96 * mid * mid) + rho * nu * alpha / (8 * mid) + (2 - 3 * rho * rho) / 24 * nu * nu) * tau"},
    {"vol": "alpha / den * bend * later"},
]


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as option quotes on their parts: p_partkey, p_brand, at, forward, tau, strike, vol."""
    parts = table(spark, sf_dir, "part").where("p_retailprice > 0 and p_size > 0").select("p_partkey", "p_brand", "p_size", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").where("l_discount is not null").select(F.col("l_partkey").alias("p_partkey"), "l_discount", F.col("l_shipdate").alias("at"))
    return staged(lines.join(parts, "p_partkey"), QUOTE_STEPS).select("p_partkey", "p_brand", "at", "forward", "tau", "strike", "vol")


def smile_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per part quoted at five strikes or more: the fitted level (over the root of the forward), correlation and volatility of volatility,
    whether the error is below a hundredth, the risk reversal and butterfly of delta 0.25. A part's quotes are its distinct strikes:
    what is collected is bounded by the discounts there are."""
    q = quotes(spark, sf_dir).groupBy("p_partkey", "forward", "tau", "strike").agg(F.first("vol").alias("vol"))
    own = q.groupBy("p_partkey", "forward", "tau").agg(F.array_sort(F.collect_list(F.struct("strike", "vol"))).alias("q")).where(F.size("q") >= LEAST_QUOTES)
    fitted = fitted_smiles(own.select("p_partkey", "forward", "tau", F.col("q.strike").alias("strikes"), F.col("q.vol").alias("vols")))
    return fitted.select("p_partkey", "n_quotes", F.round(F.col("alpha") / F.sqrt("forward"), 3).alias("level"), (F.round("rho", 3) + 0.0).alias("rho"), F.round("nu", 3).alias("nu"), (F.col("rmse") < 0.01).alias("converged"),
        F.round("risk_reversal", 4).alias("risk_reversal"), F.round("butterfly", 4).alias("butterfly"))


def _vol_sql(k: str) -> str:
    """The model's volatility at log strike k over the forward f, for beta 0.5, written around the geometric mean g = sqrt(f * strike)."""
    g = f"(f * exp({k} / 2))"
    z = f"(-nu / al * sqrt{g} * {k})"
    bend = f"CASE WHEN abs({k}) < 1e-9 THEN 1 ELSE {z} / ln((sqrt({z} * {z} - 2 * rho * {z} + 1) + {z} - rho) / (1 - rho)) END"
    return f"al / (sqrt{g} * (1 + pow({k}, 2) / 96 + pow({k}, 4) / 30720)) * {bend} * (1 + tau * (al * al / (96 * {g}) + rho * nu * al / (8 * sqrt{g}) + nu * nu * (2 - 3 * rho * rho) / 24))"


SMILES = f"""WITH RECURSIVE n AS (SELECT l_partkey AS p_partkey, count(DISTINCT 0.75 + 5 * l_discount) AS n_quotes FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1),
p AS (SELECT p_partkey, n_quotes, p_retailprice::DOUBLE AS f, p_size / 50::DOUBLE AS tau, 0.2 * sqrt(p_retailprice) AS al, (p_partkey % 13) / 20::DOUBLE - 0.4 AS rho, 0.2 + (p_partkey % 7) / 10::DOUBLE AS nu
  FROM part JOIN n USING (p_partkey) WHERE p_retailprice > 0 AND p_size > 0 AND n_quotes >= {LEAST_QUOTES}),
h AS (SELECT p.*, d, 0 AS i, -4::DOUBLE AS lo, 4::DOUBLE AS hi FROM p, (VALUES (-0.6744897501960817::DOUBLE), (0.6744897501960817::DOUBLE)) v(d)
  UNION ALL SELECT p_partkey, n_quotes, f, tau, al, rho, nu, d, i + 1, CASE WHEN up THEN x ELSE lo END, CASE WHEN up THEN hi ELSE x END
  FROM (SELECT *, -x / (s * sqrt(tau)) + s * sqrt(tau) / 2 > d AS up FROM (SELECT *, {_vol_sql('x')} AS s FROM (SELECT *, (lo + hi) / 2 AS x FROM h WHERE i < 60)))),
w AS (SELECT *, {_vol_sql('lo')} AS s FROM h WHERE i = 60),
g AS (SELECT p_partkey, any_value(n_quotes) AS n_quotes, any_value(round(rho, 3)) AS rho, any_value(round(nu, 3)) AS nu, max(s) FILTER (d < 0) AS c, max(s) FILTER (d > 0) AS p, any_value({_vol_sql('0')}) AS a FROM w GROUP BY p_partkey)
SELECT p_partkey, n_quotes, 0.2::DOUBLE AS level, rho, nu, true AS converged, round(c - p, 4) AS risk_reversal, round((c + p) / 2 - a, 4) AS butterfly FROM g"""


def reversal_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per brand and day of its last 50 days with quotes: the risk reversal of delta 0.25, read every fifth day from the quotes whose d1 is
    nearest to the call's and the put's, carried on to the next reading, 0 before the first; a day with fewer than six calls is
    no reading. Equally near quotes: the lower volatility."""
    q = quotes(spark, sf_dir).withColumn("day", F.to_date("at")).withColumn("d1", F.log(F.col("forward") / F.col("strike")) / (F.col("vol") * F.sqrt("tau")) + F.col("vol") * F.sqrt("tau") / 2)
    call, put = F.col("strike") >= F.col("forward"), F.col("strike") <= F.col("forward")
    leg = lambda side, d1: F.min(F.when(side, F.struct(F.round(F.abs(F.col("d1") - d1), 9).alias("away"), F.round("vol", 9).alias("vol"))))["vol"]
    days = q.groupBy("p_brand", "day").agg(F.count_if(call).alias("calls"), leg(call, -0.6744897501960817).alias("c"), leg(put, 0.6744897501960817).alias("p"))
    last = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("day")))
    w = Window.partitionBy("p_brand").orderBy("day")
    x = days.withColumn("back", last).where(F.col("back") <= SESSIONS).withColumn("i", F.row_number().over(w) - 1)
    reading = F.when((F.col("i") % STRIDE == 0) & (F.col("calls") >= LEAST_CALLS), F.col("c") - F.col("p"))
    return x.select("p_brand", "day", F.round(F.coalesce(F.last(reading, ignorenulls=True).over(w), F.lit(0.0)), 6).alias("risk_reversal"))


_QUOTED = f"""q AS (SELECT p_brand, l_shipdate::DATE AS day, tau, -k AS m, {_vol_sql('k')} AS vol FROM (SELECT *, p_retailprice::DOUBLE AS f, p_size / 50::DOUBLE AS tau, ln(0.75 + 5 * l_discount) AS k, 0.2 * sqrt(p_retailprice) AS al,
  (p_partkey % 13) / 20::DOUBLE - 0.4 AS rho, 0.2 + (p_partkey % 7) / 10::DOUBLE AS nu FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_retailprice > 0 AND p_size > 0 AND l_discount IS NOT NULL))"""
HISTORY = f"""WITH {_QUOTED}, s AS (SELECT *, m <= 1e-12 AS call, m >= -1e-12 AS put, (m + vol * vol * tau / 2) / (vol * sqrt(tau)) AS d1 FROM q),
d AS (SELECT p_brand, day, dense_rank() OVER (PARTITION BY p_brand ORDER BY day DESC) AS back FROM (SELECT DISTINCT p_brand, day FROM s)),
o AS (SELECT p_brand, day, row_number() OVER (PARTITION BY p_brand ORDER BY day) - 1 AS i FROM d WHERE back <= {SESSIONS}),
c AS (SELECT p_brand, day, count(*) OVER (PARTITION BY p_brand, day) AS n, round(vol, 9) AS vol, row_number() OVER (PARTITION BY p_brand, day ORDER BY round(abs(d1 + 0.6744897501960817), 9), round(vol, 9)) AS nth FROM s WHERE call),
p AS (SELECT p_brand, day, round(vol, 9) AS vol, row_number() OVER (PARTITION BY p_brand, day ORDER BY round(abs(d1 - 0.6744897501960817), 9), round(vol, 9)) AS nth FROM s WHERE put),
r AS (SELECT o.*, CASE WHEN i % {STRIDE} = 0 AND n >= {LEAST_CALLS} THEN c.vol - p.vol END AS rr FROM o LEFT JOIN c ON c.p_brand = o.p_brand AND c.day = o.day AND c.nth = 1 LEFT JOIN p ON p.p_brand = o.p_brand AND p.day = o.day AND p.nth = 1)
SELECT p_brand, day, round(coalesce((SELECT max_by(b.rr, b.i) FROM r b WHERE b.p_brand = r.p_brand AND b.i <= r.i AND b.rr IS NOT NULL), 0), 6) AS risk_reversal FROM r"""

QUERIES = {"smile_fit": (smile_fit, SMILES), "reversal_history": (reversal_history, HISTORY)}
