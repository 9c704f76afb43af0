"""Queries of option values, volume clocks, mean reversion in frames, ordered risk checks, ledger replay and claim coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.plans.performance import BM25_ALL, TRADES, retrieved, trades
from larkspur.sources.roles import BARS_SQL, bars, table


def normal_density(x: str) -> str:
    return f"(exp(-({x}) * ({x}) / 2) * 0.3989422804014327)"


def normal_cdf(x: str) -> str:
    """The normal distribution function by a polynomial of five terms; its error is below 1e-7."""
    k = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"{normal_density(x)} * {k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    return f"CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END"


def staged(df: DataFrame, steps: list[dict[str, str]]) -> DataFrame:
    """Adds the columns of each step in turn, by expressions that both Spark and the checking SQL read."""
    for step in steps:
        df = df.selectExpr("*", *[f"{v} AS {k}" for k, v in step.items()])
    return df


def staged_sql(sql: str, steps: list[dict[str, str]]) -> str:
    for step in steps:
        sql = f"SELECT *, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM ({sql})"
    return sql


#: Parts as options: spot is the retail price; moneyness, months to expiry and volatility come from size and key.
OPTION_STEPS = [
    {"s": "CAST(p_retailprice AS DOUBLE)", "tau": "CAST(p_size AS DOUBLE) / 50", "sigma": "0.1 + CAST(p_partkey % 40 AS DOUBLE) / 100", "r": "CAST(0.03 AS DOUBLE)"},
    {"strike": "s * (0.8 + CAST(p_size % 9 AS DOUBLE) / 20)", "sd": "sigma * sqrt(tau)", "df": "exp(-r * tau)"},
    {"d1": "(ln(s / strike) + r * tau) / sd + sd / 2"},
    {"d2": "d1 - sd"},
    {"n1": normal_cdf("d1"), "n2": normal_cdf("d2"), "density": normal_density("d1")},
    {"call": "s * n1 - strike * df * n2"},
]
OPTION_OUT = {"call_value": "round(call, 5)", "put_value": "round(call - s + strike * df, 5)", "delta": "round(n1, 6)", "gamma": "round(density / (s * sd), 8)", "vega": "round(s * density * sqrt(tau), 5)", "theta": "round(-s * density * sigma / (2 * sqrt(tau)) - r * strike * df * n2, 5)"}
_OUT = ", ".join(f"{v} AS {k}" for k, v in OPTION_OUT.items())


def option_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """European option values and sensitivities under a log-normal price: one projection, no shuffle."""
    priced = staged(table(spark, sf_dir, "part").where("p_retailprice > 0 AND p_size > 0").select("p_partkey", "p_size", "p_retailprice"), OPTION_STEPS)
    return priced.selectExpr("p_partkey", *[f"{v} AS {k}" for k, v in OPTION_OUT.items()])


OPTIONS = f"SELECT p_partkey, {_OUT} FROM ({staged_sql('SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_retailprice > 0 AND p_size > 0', OPTION_STEPS)})"

#: A stochastic-volatility smile (elasticity 0.5) whose level, slope and curvature come from the part's key.
SMILE_STEPS = [
    {"s": "CAST(p_retailprice AS DOUBLE)", "tau": "CAST(p_size AS DOUBLE) / 50", "rho": "CAST(p_partkey % 13 AS DOUBLE) / 20 - 0.4", "nu": "0.2 + CAST(p_partkey % 7 AS DOUBLE) / 10"},
    {"strike": "s * (0.8 + CAST(p_size % 9 AS DOUBLE) / 20)", "alpha": "0.2 * sqrt(s)"},
    {"m": "ln(s / strike)", "fk": "sqrt(sqrt(s * strike))"},
    {"z": "nu / alpha * fk * m", "den": "fk * (1 + m * m / 96 + m * m * m * m / 30720)"},
    {"x": "ln((sqrt(1 - 2 * rho * z + z * z) + z - rho) / (1 - rho))", "later": "1 + (alpha * alpha / (96 * fk * fk) + rho * nu * alpha / (8 * fk) + (2 - 3 * rho * rho) / 24 * nu * nu) * tau"},
    {"vol": "alpha / den * CASE WHEN abs(z) > 1e-7 THEN z / x ELSE 1.0 END * later", "level": "alpha / sqrt(s) * (1 + (alpha * alpha / (96 * s) + rho * nu * alpha / (8 * sqrt(s)) + (2 - 3 * rho * rho) / 24 * nu * nu) * tau)"},
]
_SMILE_OUT = {"p_partkey": "p_partkey", "moneyness": "round(m, 6)", "implied": "round(vol, 6)", "at_the_money": "round(level, 6)", "skew": "round(vol - level, 6)"}


def smile_vols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Implied volatility at each part's strike by the expansion of a stochastic-volatility model; one projection."""
    priced = staged(table(spark, sf_dir, "part").where("p_retailprice > 0 AND p_size > 0").select("p_partkey", "p_size", "p_retailprice"), SMILE_STEPS)
    return priced.selectExpr(*[f"{v} AS {k}" for k, v in _SMILE_OUT.items()])


SMILE = f"SELECT {', '.join(f'{v} AS {k}' for k, v in _SMILE_OUT.items())} FROM ({staged_sql('SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_retailprice > 0 AND p_size > 0', SMILE_STEPS)})"

BUCKET, CLOCK_BUCKETS = 500, 50


def volume_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imbalance of signed volume over the last 50 full volume buckets of each key; a trade is split over the buckets it spans."""
    w = Window.partitionBy("key").orderBy("l_shipdate", "l_orderkey", "l_linenumber")
    t = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select(F.col("l_suppkey").alias("key"), "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_quantity").alias("volume"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    t = t.withColumn("side", F.when(F.col("price") < F.lag("price").over(w), -1).otherwise(1)).withColumn("upto", F.sum("volume").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("since", F.col("upto") - F.col("volume")).withColumn("b", F.explode(F.sequence(F.floor(F.col("since") / BUCKET), F.ceil(F.col("upto") / BUCKET) - 1)))
    share = F.least("upto", (F.col("b") + 1) * F.lit(float(BUCKET))) - F.greatest("since", F.col("b") * F.lit(float(BUCKET)))
    full = t.withColumn("share", share).groupBy("key", "b").agg(F.sum("share").alias("v"), F.abs(F.sum(F.col("share") * F.col("side"))).alias("imbalance")).where(F.col("v") >= BUCKET - 1e-6)
    full = full.withColumn("last", F.max("b").over(Window.partitionBy("key"))).where(F.col("b") > F.col("last") - CLOCK_BUCKETS)
    return full.groupBy("key").agg(F.count("*").alias("buckets"), F.round(F.avg(F.col("imbalance") / F.col("v")), 6).alias("toxicity"))


CLOCK = f"""WITH t AS (SELECT l_suppkey AS key, l_quantity AS volume, CASE WHEN l_extendedprice / l_quantity < lag(l_extendedprice / l_quantity) OVER w THEN -1 ELSE 1 END AS side,
  sum(l_quantity) OVER (w ROWS UNBOUNDED PRECEDING) AS upto FROM lineitem WHERE l_quantity > 0 WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber)),
s AS (SELECT *, upto - volume AS since, unnest(range(floor((upto - volume) / {BUCKET})::BIGINT, ceil(upto / {BUCKET})::BIGINT)) AS b FROM t),
f AS (SELECT key, b, sum(least(upto, (b + 1) * {BUCKET}.0) - greatest(since, b * {BUCKET}.0)) AS v, abs(sum((least(upto, (b + 1) * {BUCKET}.0) - greatest(since, b * {BUCKET}.0)) * side)) AS imbalance FROM s GROUP BY ALL HAVING v >= {BUCKET} - 1e-6)
SELECT key, count(*) AS buckets, round(avg(imbalance / v), 6) AS toxicity FROM (SELECT *, max(b) OVER (PARTITION BY key) AS last FROM f) WHERE b > last - {CLOCK_BUCKETS} GROUP BY key"""


def rolling_reversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean reversion of the closes in a frame of 60 steps: persistence, half-life and the close's distance from the frame's own mean."""
    w = Window.partitionBy("key").orderBy("t")
    f = w.rowsBetween(-59, 0)
    x = bars(spark, sf_dir).select("key", "t", "close", F.lag("close").over(w).alias("back"))
    x = x.select("key", "t", "close", F.count("back").over(f).alias("n"), F.regr_slope("close", "back").over(f).alias("b"), F.avg("close").over(f).alias("m"), F.stddev_samp("close").over(f).alias("sd")).where("n = 60")
    reverts = (F.col("b") > 0) & (F.col("b") < 1)
    return x.select("key", "t", F.round("b", 6).alias("persistence"), F.when(reverts, F.round(F.log(F.lit(2.0)) / -F.log("b"), 5)).alias("half_life"), F.when(F.col("sd") > 1e-12, F.round((F.col("close") - F.col("m")) / F.col("sd"), 6)).otherwise(0.0).alias("z"))


REVERSION = f"""WITH x AS (SELECT key, t, close, lag(close) OVER (PARTITION BY key ORDER BY t) AS back FROM ({BARS_SQL})),
y AS (SELECT key, t, close, count(back) OVER f AS n, regr_slope(close, back) OVER f AS b, avg(close) OVER f AS m, stddev_samp(close) OVER f AS sd FROM x WINDOW f AS (PARTITION BY key ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
SELECT key, t, round(b, 6) AS persistence, CASE WHEN b > 0 AND b < 1 THEN round(ln(2.0) / -ln(b), 5) END AS half_life, CASE WHEN sd > 1e-12 THEN round((close - m) / sd, 6) ELSE 0.0 END AS z FROM y WHERE n = 60"""


def probabilistic_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy: the probability that the true ratio of mean to deviation is above zero, given skewness and tails."""
    g = trades(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), (F.avg("pnl") / F.stddev_samp("pnl")).alias("sr"), F.skewness("pnl").alias("g1"), F.kurtosis("pnl").alias("g2"))
    return staged(g.where("n > 3"), SHARPE_STEPS).selectExpr("strategy", "n", "round(sr, 6) AS sharpe", "round(p, 5) AS probability")


SHARPE_STEPS = [{"x": "sr * sqrt(n - 1) / sqrt(greatest(1 - g1 * sr + (g2 + 2) / 4 * sr * sr, 1e-12))"}, {"p": normal_cdf("x")}]
_MOMENTS = f"SELECT strategy, count(*) AS n, avg(pnl) / stddev_samp(pnl) AS sr, skewness(pnl) * (count(*) - 2) / sqrt(count(*) * (count(*) - 1)) AS g1, kurtosis_pop(pnl) AS g2 FROM ({TRADES}) GROUP BY strategy HAVING count(*) > 3"
SHARPE = f"SELECT strategy, n, round(sr, 6) AS sharpe, round(p, 5) AS probability FROM ({staged_sql(_MOMENTS, SHARPE_STEPS)})"

#: Ordered controls: the first that applies denies; a missing input denies.
CONTROLS = [
    ("account_missing", "c_acctbal IS NULL"), ("segment_not_entitled", "c_mktsegment = 'MACHINERY'"), ("price_missing", "o_totalprice IS NULL OR o_totalprice <= 0"), ("notional_limit", "o_totalprice > 250000"),
    ("buying_power", "c_acctbal < 0"), ("daily_notional", "day_total > 400000"),
]
_DENIAL = "CASE " + " ".join(f"WHEN {rule} THEN '{code}'" for code, rule in CONTROLS) + " END"


def risk_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's first denial in the order of the controls, and how many controls it passed before."""
    w = Window.partitionBy("o_custkey", F.to_date("o_orderdate")).orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    o = table(spark, sf_dir, "orders").withColumn("day_total", F.sum("o_totalprice").over(w))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    decided = o.join(c, "o_custkey", "left").withColumn("code", F.expr(_DENIAL))
    return decided.select("o_orderkey", F.col("code").isNull().alias("approved"), "code", F.expr(_PASSED).alias("passed"))


_PASSED = "CASE " + " ".join(f"WHEN code = '{code}' THEN {i}" for i, (code, _) in enumerate(CONTROLS)) + f" ELSE {len(CONTROLS)} END"
RISK = f"""SELECT o_orderkey, code IS NULL AS approved, code, {_PASSED} AS passed FROM (SELECT *, {_DENIAL} AS code FROM
  (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS day_total FROM orders) LEFT JOIN customer ON c_custkey = o_custkey)"""

AS_OF = "1998-01-01"


def ledger_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's state at an instant: its snapshot, with later patches replayed in order of validity.

    Lines are patches on three paths: returned ones remove the path, others set it to their quantity. The last patch of a
    path decides, so the replay is a maximum per path, combined before the shuffle, and no fold over all patches. Of patches of
    one time and number, which the SQL's order leaves open, the greatest flag and then the greatest quantity counts."""
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit(AS_OF).cast("timestamp"))
    patch = F.struct("l_shipdate", "l_linenumber", "l_returnflag", "l_quantity")
    last = li.groupBy("l_orderkey", (F.col("l_linenumber") % 3).alias("path")).agg(F.max(patch).alias("p"), F.count("*").alias("n"))
    # A null in path, flag or quantity sets nothing; halves go to the even number, as SQL casts them.
    value = F.when(F.col("p.l_returnflag") != "R", F.concat(F.col("path").cast("string"), F.lit("="), F.rint("p.l_quantity").cast("bigint").cast("string")))
    parts = F.array_sort(F.collect_list(F.when(value.isNotNull(), F.struct("path", value.alias("value")))))
    state = last.groupBy("l_orderkey").agg(F.array_join(F.transform(parts, lambda x: x["value"]), ",").alias("state"), F.sum("n").alias("patches"))
    o = table(spark, sf_dir, "orders")
    return o.join(state, o.o_orderkey == state.l_orderkey, "left").select("o_orderkey", "o_orderstatus", F.coalesce("state", F.lit("")).alias("state"), F.coalesce("patches", F.lit(0)).alias("patches"))


REPLAY = f"""WITH p AS (SELECT l_orderkey, l_linenumber % 3 AS path, l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_orderkey) AS patches FROM lineitem WHERE l_shipdate <= TIMESTAMP '{AS_OF}'
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 3 ORDER BY l_shipdate DESC, l_linenumber DESC) = 1),
s AS (SELECT l_orderkey, string_agg(CASE WHEN l_returnflag <> 'R' THEN path || '=' || l_quantity::BIGINT END, ',' ORDER BY path) AS state, any_value(patches) AS patches FROM p GROUP BY 1)
SELECT o_orderkey, o_orderstatus, coalesce(state, '') AS state, coalesce(patches, 0) AS patches FROM orders LEFT JOIN s ON l_orderkey = o_orderkey"""


#: How many of the documents retrieved for a claim are held against it.
CLAIM_DEPTH = 40


def claim_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims (benchmark texts) against the documents retrieved for them: the share of a claim's terms in one document."""
    terms = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= 2))
    hits = retrieved(spark, sf_dir, CLAIM_DEPTH).where("channel = 'lexical'").select("item_id", "doc_id")
    claim = table(spark, sf_dir, "benchmark").select("item_id", terms("text").alias("asked"))
    found = hits.join(claim, "item_id").join(table(spark, sf_dir, "documents").select("doc_id", terms("text").alias("given")), "doc_id")
    share = F.size(F.array_intersect("asked", "given")) / F.size("asked")
    covered = found.groupBy("item_id").agg(F.round(F.max(share), 6).alias("coverage"), F.count_if(share >= 0.6).alias("sources"))
    whole = claim.select("item_id").join(covered, "item_id", "left").fillna({"coverage": 0.0, "sources": 0})
    return whole.withColumn("supported", F.col("sources") > 0)


_TERMS = "list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2))"
COVERAGE = f"""WITH hits AS ({BM25_ALL} QUALIFY rank <= {CLAIM_DEPTH}), c AS (SELECT item_id, {_TERMS} AS asked FROM benchmark), g AS (SELECT doc_id, {_TERMS} AS given FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
s AS (SELECT item_id, len(list_intersect(asked, given)) / len(asked) AS share FROM hits JOIN c USING (item_id) JOIN g USING (doc_id))
SELECT c.item_id, coalesce(round(max(share), 6), 0) AS coverage, count(*) FILTER (share >= 0.6) AS sources, count(*) FILTER (share >= 0.6) > 0 AS supported FROM c LEFT JOIN s USING (item_id) GROUP BY c.item_id"""

QUERIES = {
    "option_values": (option_values, OPTIONS), "smile_vols": (smile_vols, SMILE), "volume_clock": (volume_clock, CLOCK), "rolling_reversion": (rolling_reversion, REVERSION), "probabilistic_sharpe": (probabilistic_sharpe, SHARPE),
    "risk_checks": (risk_checks, RISK), "ledger_replay": (ledger_replay, REPLAY), "claim_coverage": (claim_coverage, COVERAGE),
}
