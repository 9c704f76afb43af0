"""Queries of trading signals, barrier exits, unit roots, dependence, rank fusion, purged splits and fitted models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.indicators import RUN, full, lagged
from larkspur.plans.performance import BM25_ALL, retrieved, trades
from larkspur.plans.valuation import _MOMENTS, normal_cdf, staged, staged_sql
from larkspur.sources.roles import BARS_SQL, WIDE_SQL, bars, micros, table, wide_features
from larkspur.streaming.limits import sliding_limit

# Coefficients of a rational approximation of the normal quantile, for the middle and for the tails.
MIDDLE_TOP = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
MIDDLE_BOTTOM = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
TAIL_TOP = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BOTTOM = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
TAIL_FROM = 0.02425


def polynomial(coefficients: tuple[float, ...], x: str) -> str:
    out = f"CAST({coefficients[0]!r} AS DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + CAST({c!r} AS DOUBLE))"
    return out


def normal_quantile(p: str) -> str:
    """The normal quantile of p in (0, 1); its relative error is below 2e-9."""
    q, r = f"({p} - 0.5)", f"(({p} - 0.5) * ({p} - 0.5))"
    low, high = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    tail = lambda x: f"{polynomial(TAIL_TOP, x)} / {polynomial(TAIL_BOTTOM, x)}"
    return f"CASE WHEN {p} < {TAIL_FROM} THEN {tail(low)} WHEN {p} > {1 - TAIL_FROM} THEN -({tail(high)}) ELSE {q} * {polynomial(MIDDLE_TOP, r)} / {polynomial(MIDDLE_BOTTOM, r)} END"


_TRUE_RANGE = "CASE WHEN prev IS NULL THEN high - low ELSE greatest(high - low, abs(high - prev), abs(low - prev)) END"
SIGNAL_STEPS = [
    {"prev": lagged("close"), "mid": full("avg(close)", "close", 20), "sd": full("stddev_pop(close)", "close", 20), "usual": full("avg(volume)", "volume", 20), "top": "max(high) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)", "i": f"CAST(row_number() {RUN} AS DOUBLE)"},
    {"tr": _TRUE_RANGE, "z": "CASE WHEN sd > 1e-9 THEN (close - mid) / sd WHEN sd IS NOT NULL THEN 0.0 END", "width": "CASE WHEN mid <> 0 THEN 4 * sd / mid END", "slope": full("regr_slope(close, i)", "close", 20), "gap": "CASE WHEN prev > 0 THEN 100 * (open - prev) / prev ELSE 0.0 END"},
    {"atr": full("avg(tr)", "tr", 14), "narrow": "min(width) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)", "drift": "CASE WHEN mid <> 0 THEN 100 * slope / mid END"},
]
#: Regimes in order, the first that applies counts: its rule and the weights of reversion and of momentum in it.
REGIMES = [("unknown", "drift IS NULL", 0.0, 0.0), ("rising", "drift >= 1", 0.6, 1.2), ("falling", "drift <= -1", 0.6, 1.2), ("quiet", "width <= 1.1 * narrow", 0.8, 1.0), ("ranging", "TRUE", 1.2, 0.7)]
_CHOICE = lambda at: "CASE " + " ".join(f"WHEN {r[1]} THEN {at(r)}" for r in REGIMES) + " END"
#: Strategies: family, the side they take (1, -1 or 0) and their conviction (0 to 1).
STRATEGIES = {
    "reversion": ("revert", "CASE WHEN z >= 1.5 THEN -1 WHEN z <= -1.5 THEN 1 ELSE 0 END", "least(abs(z) / 4, 1.0)"),
    "breakout": ("follow", "CASE WHEN close > top AND volume >= usual THEN 1 ELSE 0 END", "least(volume / (3 * usual), 1.0)"),
    "expansion": ("follow", "CASE WHEN width > 1.1 * narrow OR abs(close - prev) < atr / 2 THEN 0 WHEN close > prev THEN 1 WHEN close < prev THEN -1 ELSE 0 END", "least(abs(close - prev) / (2 * atr), 1.0)"),
    "gap": ("revert", "CASE WHEN gap >= 3 THEN -1 WHEN gap <= -3 THEN 1 ELSE 0 END", "least(abs(gap) / 100, 1.0)"),
}
_SIDE = lambda way: "greatest(" + ", ".join(f"CASE WHEN {n}_side = {way} THEN coalesce({n}_conviction, 0.0) * {f} ELSE 0.0 END" for n, (f, _, _) in STRATEGIES.items()) + ")"
DECISION_STEPS = [
    {"regime": _CHOICE(lambda r: f"'{r[0]}'"), "revert": _CHOICE(lambda r: f"CAST({r[2]} AS DOUBLE)"), "follow": _CHOICE(lambda r: f"CAST({r[3]} AS DOUBLE)"), **{f"{n}_side": s for n, (_, s, _) in STRATEGIES.items()}, **{f"{n}_conviction": c for n, (_, _, c) in STRATEGIES.items()}},
    {"up": _SIDE(1), "down": _SIDE(-1)},
    {"way": "CASE WHEN greatest(up, down) < 0.35 OR up = down THEN 0 WHEN up > down THEN 1 ELSE -1 END"},
]
_SIGNAL = {"regime": "regime", "direction": "CASE way WHEN 1 THEN 'long' WHEN -1 THEN 'short' ELSE 'flat' END", "long_conviction": "round(up, 6)", "short_conviction": "round(down, 6)", "stop": "CASE WHEN way <> 0 THEN round(close - 2 * way * atr, 6) END", "target": "CASE WHEN way <> 0 THEN round(close + 3 * way * atr, 6) END"}


def signal_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bar: regime, the strongest conviction for each side over the strategies, the direction, and its levels. One sort per key."""
    return staged(bars(spark, sf_dir), SIGNAL_STEPS + DECISION_STEPS).selectExpr("key", "t", *[f"{v} AS {k}" for k, v in _SIGNAL.items()])


SIGNALS = f"SELECT key, t, {', '.join(f'{v} AS {k}' for k, v in _SIGNAL.items())} FROM ({staged_sql(BARS_SQL, SIGNAL_STEPS + DECISION_STEPS)})"

HOLD = 20
_LEVELS = [{"stop": "close - 2 * way * atr", "target": "close + 3 * way * atr"}]
_AHEAD = f"OVER (PARTITION BY key ORDER BY t ROWS BETWEEN 1 FOLLOWING AND {HOLD} FOLLOWING)"
_TOUCH = "(way = 1 AND (x.low <= stop OR x.high >= target)) OR (way = -1 AND (x.high >= stop OR x.low <= target))"
_EXIT = {"exit_t": "e.t", "bars_held": "CAST(e.i - i AS INT)", "reason": "CASE WHEN hit IS NULL THEN CASE WHEN n = 20 THEN 'time' ELSE 'end' END WHEN (way = 1 AND e.low <= stop) OR (way = -1 AND e.high >= stop) THEN 'stop' ELSE 'target' END"}
_PNL = "round(way * (CASE reason WHEN 'stop' THEN stop WHEN 'target' THEN target ELSE last_close END - close), 6)"


def barrier_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal as a trade of its own: the first of the next 20 bars that touches stop (checked first) or target, else time or the end.

    The path of a trade is a frame of at most 20 bars, so no event loop runs over the series."""
    x = staged(bars(spark, sf_dir), SIGNAL_STEPS + DECISION_STEPS + _LEVELS)
    x = x.selectExpr("key", "t", "close", "i", "way", "stop", "target", f"collect_list(struct(t, i, low, high, close)) {_AHEAD} AS path").where("way <> 0 AND stop IS NOT NULL")
    x = x.selectExpr("*", f"get(filter(path, x -> {_TOUCH}), 0) AS hit", "size(path) AS n").selectExpr("*", "coalesce(hit, get(path, n - 1)) AS e")
    x = x.selectExpr("*", "e.close AS last_close", *[f"{v} AS {k}" for k, v in _EXIT.items()])
    return x.selectExpr("key", "t", "CASE way WHEN 1 THEN 'long' ELSE 'short' END AS direction", "exit_t", "bars_held", "reason", f"{_PNL} AS pnl")


EXITS = f"""WITH x AS (SELECT key, t, close, i, way, stop, target, list({{'t': t, 'i': i, 'low': low, 'high': high, 'close': close}}) {_AHEAD} AS path FROM ({staged_sql(BARS_SQL, SIGNAL_STEPS + DECISION_STEPS + _LEVELS)})),
h AS (SELECT *, list_filter(path, lambda x: {_TOUCH})[1] AS hit, coalesce(len(path), 0) AS n, path[-1] AS final FROM x WHERE way <> 0 AND stop IS NOT NULL),
ended AS (SELECT *, CASE WHEN hit IS NULL THEN final ELSE hit END AS e FROM h),
r AS (SELECT *, e.close AS last_close, {', '.join(f'{v} AS {k}' for k, v in _EXIT.items())} FROM ended)
SELECT key, t, CASE way WHEN 1 THEN 'long' ELSE 'short' END AS direction, exit_t, bars_held, reason, {_PNL} AS pnl FROM r"""

_ADF = [
    {"det": "v1 * v2 - c12 * c12"},
    {"b1": "CASE WHEN det > 1e-12 THEN (c1 * v2 - c2 * c12) / det END", "b2": "CASE WHEN det > 1e-12 THEN (c2 * v1 - c1 * c12) / det END"},
    {"se": "sqrt(greatest(n * (vd - b1 * c1 - b2 * c2), 0.0) / (n - 3) * v2 / (n * det))"},
]
_ADF_AGG = "count(*) AS n, var_pop(x) AS v1, var_pop(ld) AS v2, var_pop(d) AS vd, covar_pop(x, ld) AS c12, covar_pop(d, x) AS c1, covar_pop(d, ld) AS c2"
_ADF_OUT = "CASE WHEN n < 20 THEN 0.0 WHEN se > 1e-12 THEN round(b1 / se, 5) END AS statistic"


def unit_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dickey-Fuller t of each key's closes, with a constant and one lag: a regression on two columns from their moments alone."""
    x = staged(bars(spark, sf_dir), [{"x": lagged("close")}, {"d": "close - x"}, {"ld": lagged("d")}]).where("ld IS NOT NULL")
    g = x.groupBy("key").agg(*[F.expr(a) for a in _split(_ADF_AGG)])
    return staged(g, _ADF).selectExpr("key", "n", "round(b1, 6) AS slope", _ADF_OUT)


_ADF_ROWS = staged_sql(BARS_SQL, [{"x": lagged("close")}, {"d": "close - x"}, {"ld": lagged("d")}])
UNIT_ROOT = f"SELECT key, n, round(b1, 6) AS slope, {_ADF_OUT} FROM ({staged_sql(f'SELECT key, {_ADF_AGG} FROM ({_ADF_ROWS}) WHERE ld IS NOT NULL GROUP BY key', _ADF)})"

_RANK = lambda c: f"(rank() OVER (PARTITION BY symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, {c}) - 1) / CAST(2 AS DOUBLE)) / (count(*) OVER (PARTITION BY symbol) + 1)"
_PSEUDO = [{"u": _RANK("quantity"), "v": _RANK("discount")}, {"gu": normal_quantile("u"), "gv": normal_quantile("v")}]
_TAILS = [{"tau": "CASE WHEN abs(rho) < 1 THEN 2 / pi() * asin(rho) END"}, {"clayton": "CASE WHEN tau > 0 AND tau < 1 THEN 2 * tau / (1 - tau) END", "gumbel": "CASE WHEN tau >= 0 AND tau < 1 THEN 1 / (1 - tau) END"}]
_TAILS_OUT = "symbol, n, round(rho, 6) AS rho, round(tau, 6) AS tau, round(clayton, 5) AS clayton, round(gumbel, 5) AS gumbel, round(CASE WHEN clayton > 0 THEN pow(CAST(2 AS DOUBLE), -1 / clayton) ELSE 0.0 END, 6) AS lower_tail, round(CASE WHEN gumbel > 1 THEN 2 - pow(CAST(2 AS DOUBLE), 1 / gumbel) ELSE 0.0 END, 6) AS upper_tail, joint_low"


def rank_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity: dependence of two monthly features by normal scores of their ranks, the copula parameters that it
    implies, their tail dependence, and how many months lie low in both. A window holds one entity's months."""
    x = staged(wide_features(spark, sf_dir), _PSEUDO)
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), F.corr("gu", "gv").alias("rho"), F.count_if((F.col("u") <= 0.2) & (F.col("v") <= 0.2)).alias("joint_low"))
    return staged(g.where("n >= 8"), _TAILS).selectExpr(*_split(_TAILS_OUT))


def _split(columns: str) -> list[str]:
    """Select items, cut at the commas outside parentheses."""
    out, depth, item = [], 0, ""
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(item)
            item = ""
        else:
            item += c
    return [*out, item]


_PAIRS = f"SELECT symbol, count(*) AS n, corr(gu, gv) AS rho, count(*) FILTER (u <= 0.2 AND v <= 0.2) AS joint_low FROM ({staged_sql(WIDE_SQL, _PSEUDO)}) GROUP BY symbol HAVING count(*) >= 8"
DEPENDENCE = f"SELECT {_TAILS_OUT} FROM ({staged_sql(_PAIRS, _TAILS)})"

#: Both channels are read down to two fifths of the documents, at least 5 and at most 40; K softens the ranks; cosines up to FLOOR don't count.
FUSED_SHARE, FUSED_LEAST, FUSED_MOST, FUSED_K, FLOOR = 0.4, 5, 40, 10, 0.02


def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: reciprocal ranks of the lexical and the dense channel, weighted by each channel's confidence (how far
    its best score is above its last), summed per document."""
    n = table(spark, sf_dir, "documents").count()
    depth = min(FUSED_MOST, max(FUSED_LEAST, -int(-n * FUSED_SHARE // 1)))
    return fused(retrieved(spark, sf_dir, depth).where(f"score > CASE channel WHEN 'dense' THEN {FLOOR} ELSE 0 END"))


def fused(both: DataFrame) -> DataFrame:
    """Of the hits of two channels (channel, item_id, doc_id, score, rank): one row for each text and document, with its score and place."""
    top, least = F.max("score"), F.min("score")
    sure = both.groupBy("item_id", "channel").agg(F.when(F.count("*") == 1, 1.0).when(top > 0, (top - least) / top).otherwise(0.0).alias("sure"))
    every = sure.groupBy("item_id").agg(F.sum("sure").alias("total"))
    weight = F.when(F.col("total") > 0, F.col("sure") / F.col("total")).otherwise(0.5)
    weights = sure.join(every, "item_id").select("item_id", "channel", weight.alias("weight"))
    fused = both.join(weights, ["item_id", "channel"]).groupBy("item_id", "doc_id").agg(F.count("*").alias("channels"), F.round(F.sum(F.col("weight") / (F.col("rank") + float(FUSED_K))), 7).alias("score"))
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")))


_TERMS = "list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)"
#: From the hits of both channels, lex and v, on.
FUSED = f"""b AS (SELECT 'lexical' AS channel, item_id, doc_id, score, rank FROM lex WHERE score > 0 UNION ALL SELECT 'dense', item_id, doc_id, score, rank FROM v WHERE score > {FLOOR}),
k AS (SELECT b.* FROM b CROSS JOIN depth WHERE rank <= depth),
s AS (SELECT item_id, channel, CASE WHEN count(*) = 1 THEN 1 WHEN max(score) > 0 THEN (max(score) - min(score)) / max(score) ELSE 0 END AS sure FROM k GROUP BY ALL),
w AS (SELECT item_id, channel, CASE WHEN sum(sure) OVER (PARTITION BY item_id) > 0 THEN sure / sum(sure) OVER (PARTITION BY item_id) ELSE 0.5 END AS weight FROM s),
f AS (SELECT item_id, doc_id, count(*) AS channels, round(sum(weight / (rank + {FUSED_K}.0::DOUBLE)), 7) AS score FROM k JOIN w USING (item_id, channel) GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS place FROM f"""
FUSION = f"""WITH lex AS ({BM25_ALL}), depth AS (SELECT least({FUSED_MOST}, greatest({FUSED_LEAST}, ceil(count(*) * {FUSED_SHARE}))) AS depth FROM documents),
q AS (SELECT item_id, term, count(*) AS qf FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL), d AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL),
c AS (SELECT item_id, doc_id, round(dot / (dn * qn), 6) AS score FROM (SELECT item_id, doc_id, sum(tf * qf) AS dot FROM d JOIN q USING (term) GROUP BY ALL) JOIN (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM d GROUP BY 1) USING (doc_id) JOIN (SELECT item_id, sqrt(sum(qf * qf)) AS qn FROM q GROUP BY 1) USING (item_id)),
v AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM c),
{FUSED}"""


def slot_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each bar's volume against the mean of the same hour in up to ten days before."""
    w = Window.partitionBy("key", F.hour("t")).orderBy("t").rowsBetween(-10, -1)
    return bars(spark, sf_dir).select("key", "t", F.when(F.avg("volume").over(w) > 0, F.round(F.col("volume") / F.avg("volume").over(w), 6)).alias("relative"))


SLOT = f"SELECT key, t, round(volume / avg(volume) OVER (PARTITION BY key, hour(t) ORDER BY t ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 6) AS relative FROM ({BARS_SQL})"

#: The greatest of as many independent ratios as there are strategies is expected to reach this by chance.
_EULER = 0.5772156649015329
DEFLATED_STEPS = [
    {"t": "CAST(trials AS DOUBLE)"}, {"p1": "1 - 1 / t", "p2": "1 - exp(-1) / t"}, {"q1": normal_quantile("p1"), "q2": normal_quantile("p2")}, {"bar": f"spread * ((1 - {_EULER}) * q1 + {_EULER} * q2)"},
    {"x": "(sr - bar) * sqrt(n - 1) / sqrt(greatest(1 - g1 * sr + (g2 + 2) / 4 * sr * sr, 1e-12))"}, {"p": normal_cdf("x")},
]


def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy: the probability that its ratio is above what the best of all strategies reaches by chance."""
    g = trades(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), (F.avg("pnl") / F.stddev_samp("pnl")).alias("sr"), F.skewness("pnl").alias("g1"), F.kurtosis("pnl").alias("g2")).where("n > 3")
    every = g.agg(F.count("*").alias("trials"), F.stddev_samp("sr").alias("spread"))
    return staged(g.crossJoin(F.broadcast(every)).where("trials > 1"), DEFLATED_STEPS).selectExpr("strategy", "n", "round(bar, 6) AS expected_best", "round(p, 5) AS probability")


_EVERY = f"SELECT * FROM ({_MOMENTS}) CROSS JOIN (SELECT count(*) AS trials, stddev_samp(sr) AS spread FROM ({_MOMENTS})) WHERE trials > 1"
DEFLATED = f"SELECT strategy, n, round(bar, 6) AS expected_best, round(p, 5) AS probability FROM ({staged_sql(_EVERY, DEFLATED_STEPS)})"

HORIZON_DAYS, TRAIN_SHARE = 5, 0.8


def purged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split in time: training rows whose label would reach into the test period are purged. Counts per day make the quantile."""
    day = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01").cast("date"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"))
    daily = o.groupBy("day").agg(F.count("*").alias("c"))
    cut = daily.agg(F.percentile("day", F.lit(TRAIN_SHARE), F.col("c")).alias("cut"))
    part = F.when(F.col("day") >= F.col("cut"), "test").when(F.col("day") + HORIZON_DAYS < F.col("cut"), "train").otherwise("purged")
    return o.crossJoin(F.broadcast(cut)).select("o_orderkey", part.alias("part"))


PURGED = f"""WITH o AS (SELECT o_orderkey, date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS day FROM orders), c AS (SELECT quantile_cont(day, {TRAIN_SHARE}) AS cut FROM o)
SELECT o_orderkey, CASE WHEN day >= cut THEN 'test' WHEN day + {HORIZON_DAYS} < cut THEN 'train' ELSE 'purged' END AS part FROM o CROSS JOIN c"""


#: What the trees read of an order line.
LINE_INPUTS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "month"]


def fitted_trees(spark: SparkSession, sf_dir: str):
    """(lines with their inputs, gradient-boosted trees for whether a line is returned): fitted on four fifths of the orders."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x = table(spark, sf_dir, "lineitem").withColumn("month", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("double")).withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    x = x.withColumn("held_out", F.pmod(F.xxhash64("l_orderkey"), F.lit(5)) == 0).dropna(subset=LINE_INPUTS)
    ready = VectorAssembler(inputCols=LINE_INPUTS, outputCol="features", handleInvalid="skip").transform(x)
    return ready, GBTClassifier(maxIter=8, maxDepth=3, seed=7).fit(ready.where("not held_out and label is not null"))


def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient-boosted trees for whether a line is returned, applied to all lines whose inputs are known."""
    from pyspark.ml.functions import vector_to_array

    ready, model = fitted_trees(spark, sf_dir)
    return model.transform(ready).select("l_orderkey", "l_linenumber", "held_out", F.col("label").cast("int").alias("returned"), F.round(vector_to_array("probability")[1], 6).alias("score"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    most = e.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).agg(F.max_by("dim", "n").alias("dim"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") == F.col("dim"))
    return e.crossJoin(F.broadcast(most)).where(usable).select("vec_id", array_to_vector("v").alias("features"))


def cluster_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-means of the usable vectors (k 8, seeded): each vector's cluster."""
    from pyspark.ml.clustering import KMeans

    x = vectors(spark, sf_dir)
    return KMeans(k=8, seed=7, maxIter=15).fit(x).transform(x).select("vec_id", F.col("prediction").alias("cluster"))


def principal_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usable vectors on their first three principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array

    x = vectors(spark, sf_dir)
    out = PCA(k=3, inputCol="features", outputCol="pc").fit(x).transform(x).withColumn("pc", vector_to_array("pc"))
    return out.select("vec_id", *[F.round(F.col("pc")[i], 6).alias(f"pc{i + 1}") for i in range(3)])


LIMIT, WIDTH = 2, 6 * 3_600_000_000


def sliding_log_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event against a limit of two let through in six hours per user; refused ones don't count."""
    e = table(spark, sf_dir, "events").select("user_id", micros("ts").alias("at"), "event_id")
    return sliding_limit(e, "user_id", "at", "event_id", LIMIT, WIDTH)


QUERIES = {
    "signal_scan": (signal_scan, SIGNALS), "barrier_exits": (barrier_exits, EXITS), "unit_root": (unit_root, UNIT_ROOT), "rank_dependence": (rank_dependence, DEPENDENCE), "rank_fusion": (rank_fusion, FUSION),
    "slot_volume": (slot_volume, SLOT), "deflated_sharpe": (deflated_sharpe, DEFLATED), "purged_split": (purged_split, PURGED), "boosted_trees": (boosted_trees, None), "cluster_vectors": (cluster_vectors, None), "principal_components": (principal_components, None), "sliding_log_limit": (sliding_log_limit, None),
}
