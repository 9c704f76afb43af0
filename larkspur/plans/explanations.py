"""Queries that explain predictions and order: additive contributions, importance, spread of probabilities, vines of normal
scores, bars since an event, release in order of a sequence. Each has SQL that takes another way to the same numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import copulas, trees
from larkspur.plans.performance import LABELLED, labelled
from larkspur.plans.signals import LINE_INPUTS, fitted_trees, normal_quantile, vectors
from larkspur.plans.valuation import staged, staged_sql
from larkspur.sources.roles import BARS_SQL, WIDE_SQL, bars, table, wide_features

#: A probability that spreads by less than this over all rows says nothing.
SPREAD_FLOOR = 0.01
#: Sequence numbers to a block: a busy key's rows are taken block by block in several tasks.
BLOCK = 65_536
#: A bar that closes this much above the one before it.
JUMP = 0.01


def _contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the contributions of quantity and discount to a least-squares price: weight times distance from the
    mean, so that they and the mean price (base) add up to the prediction. The model is one row, made of sums that combine
    before the shuffle; lines with a null in any of the three are left out."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_extendedprice").alias("y")).dropna(subset=["q", "d", "y"])
    qq, dd, qd, qy, dy = F.var_pop("q"), F.var_pop("d"), F.covar_pop("q", "d"), F.covar_pop("q", "y"), F.covar_pop("d", "y")
    sums = x.agg(F.avg("q").alias("mq"), F.avg("d").alias("md"), F.avg("y").alias("base"), qq.alias("qq"), dd.alias("dd"), qd.alias("qd"), qy.alias("qy"), dy.alias("dy"))
    det = F.col("qq") * F.col("dd") - F.col("qd") * F.col("qd")
    model = sums.select("mq", "md", "base", F.when(det > 0, (F.col("qy") * F.col("dd") - F.col("dy") * F.col("qd")) / det).alias("wq"), F.when(det > 0, (F.col("dy") * F.col("qq") - F.col("qy") * F.col("qd")) / det).alias("wd"))
    x = x.crossJoin(F.broadcast(model)).withColumn("by_q", F.col("wq") * (F.col("q") - F.col("mq"))).withColumn("by_d", F.col("wd") * (F.col("d") - F.col("md")))
    return x.withColumn("predicted", F.col("base") - F.col("wq") * F.col("mq") - F.col("wd") * F.col("md") + F.col("wq") * F.col("q") + F.col("wd") * F.col("d"))


def line_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order line: both contributions, the greater one's name and share of their sizes, and the change of quantity that
    would bring the prediction to the mean price."""
    x, size = _contributions(spark, sf_dir), F.abs("by_q") + F.abs("by_d")
    return x.select("l_orderkey", "l_linenumber", F.round("by_q", 2).alias("by_quantity"), F.round("by_d", 2).alias("by_discount"),
        F.when(F.abs("by_q") >= F.abs("by_d"), "quantity").otherwise("discount").alias("driver"), F.round(F.when(size > 0, F.greatest(F.abs("by_q"), F.abs("by_d")) / size).otherwise(0.0), 6).alias("share"),
        F.round(F.when(F.col("wq") != 0, -(F.col("by_q") + F.col("by_d")) / F.col("wq")), 3).alias("quantity_to_mean"))


def attribution_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per return flag: mean size of both contributions, the share of quantity, and whether contributions add up on all lines."""
    g = _contributions(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.avg(F.abs("by_q")).alias("mq"), F.avg(F.abs("by_d")).alias("md"), F.max(F.abs(F.col("base") + F.col("by_q") + F.col("by_d") - F.col("predicted"))).alias("error"))
    return g.select("l_returnflag", "n", F.round("mq", 2).alias("of_quantity"), F.round("md", 2).alias("of_discount"), F.round(F.when(F.col("mq") + F.col("md") > 0, F.col("mq") / (F.col("mq") + F.col("md"))).otherwise(0.0), 6).alias("quantity_share"), (F.col("error") < 1e-6).alias("adds_up"))


# The price without discount's part is fitted on the quantity without discount's part; discount takes the rest.
_CONTRIBUTIONS = """WITH x AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity AS q, l_discount AS d, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_extendedprice IS NOT NULL),
s AS (SELECT avg(q) AS mq, avg(d) AS md, regr_slope(q, d) AS q_on_d, regr_slope(y, d) AS y_on_d FROM x),
w1 AS (SELECT s.*, (SELECT regr_slope(y - y_on_d * d, q - q_on_d * d) FROM x, s) AS wq FROM s), w AS (SELECT *, y_on_d - wq * q_on_d AS wd FROM w1),
c AS (SELECT x.*, wq, wq * (q - mq) AS by_q, wd * (d - md) AS by_d FROM x, w)"""
LINE_ATTRIBUTIONS = f"""{_CONTRIBUTIONS} SELECT l_orderkey, l_linenumber, round(by_q, 2) AS by_quantity, round(by_d, 2) AS by_discount, CASE WHEN abs(by_q) >= abs(by_d) THEN 'quantity' ELSE 'discount' END AS driver,
  round(greatest(abs(by_q), abs(by_d)) / (abs(by_q) + abs(by_d)), 6) AS share, round(mean_q - q - by_d / wq, 3) AS quantity_to_mean FROM c, (SELECT mq AS mean_q FROM s)"""
IMPORTANCE = f"""{_CONTRIBUTIONS} SELECT l_returnflag, count(*) AS n, round(avg(abs(by_q)), 2) AS of_quantity, round(avg(abs(by_d)), 2) AS of_discount,
  round(sum(abs(by_q)) / (sum(abs(by_q)) + sum(abs(by_d))), 6) AS quantity_share, true AS adds_up FROM c GROUP BY 1"""


def probability_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per label: the sample deviation of the predicted probability (0 below two rows) and whether it says anything."""
    g = labelled(spark, sf_dir).groupBy("y").agg(F.count("*").alias("n"), F.when(F.count("*") > 1, F.stddev_samp("p")).otherwise(0.0).alias("spread"))
    return g.select("y", "n", F.round("spread", 6).alias("spread"), (F.col("spread") >= SPREAD_FLOOR).alias("informative"))


SPREAD = f"""SELECT y, count(*) AS n, round(coalesce(sqrt(sum((p - m) * (p - m)) / nullif(count(*) - 1, 0)), 0), 6) AS spread, coalesce(sqrt(sum((p - m) * (p - m)) / nullif(count(*) - 1, 0)), 0) >= {SPREAD_FLOOR} AS informative
  FROM (SELECT *, avg(p) OVER (PARTITION BY y) AS m FROM ({LABELLED})) GROUP BY y"""


def vine_dependence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity with 8 months or more: a canonical vine of normal pair copulas over its monthly quantity, discount and
    revenue. The root is the feature that the others depend on most; edge_a and edge_b lead from it to the two others in
    order of name, conditional is their dependence given the root. information is the log density's mean gain."""
    names = ("discount", "quantity", "revenue")
    x = staged(wide_features(spark, sf_dir), _SCORES)
    g = x.groupBy("symbol").agg(F.count("*").alias("n"), *[F.corr(f"g_{a}", f"g_{b}").alias(f"{a}_{b}") for a, b in _PAIRS]).where("n >= 8").dropna()
    r = lambda a, b: F.col("_".join(sorted((a, b))))
    strength = {a: sum((F.abs(r(a, b)) for b in names if b != a), F.lit(0.0)) for a in names}
    most = F.greatest(*strength.values())
    trees = []
    for a in names:
        b, c = (k for k in names if k != a)
        free = F.sqrt((1 - r(a, b) * r(a, b)) * (1 - r(a, c) * r(a, c)))
        trees.append((a, F.struct(F.lit(a).alias("root"), r(a, b).alias("edge_a"), r(a, c).alias("edge_b"), F.when(free > 1e-9, (r(b, c) - r(a, b) * r(a, c)) / free).alias("conditional"))))
    chosen = F.coalesce(*[F.when(strength[a] == most, tree) for a, tree in trees])
    v = g.select("symbol", "n", chosen.alias("v")).select("symbol", "n", "v.*")
    gain = F.when(F.col("conditional").isNotNull() & (F.abs("conditional") < 1 - 1e-9), -0.5 * (F.log(1 - F.pow("edge_a", 2)) + F.log(1 - F.pow("edge_b", 2)) + F.log(1 - F.pow("conditional", 2))))
    return v.select("symbol", "n", "root", *[F.round(k, 6).alias(k) for k in ("edge_a", "edge_b", "conditional")], F.round(gain, 5).alias("information"))


_PAIRS = (("discount", "quantity"), ("discount", "revenue"), ("quantity", "revenue"))
_RANKS = {f"u_{c}": f"(rank() OVER (PARTITION BY symbol ORDER BY {c}) + (count(*) OVER (PARTITION BY symbol, {c}) - 1) / CAST(2 AS DOUBLE)) / (count(*) OVER (PARTITION BY symbol) + 1)" for c in ("discount", "quantity", "revenue")}
_SCORES = [_RANKS, {f"g_{c}": normal_quantile(f"u_{c}") for c in ("discount", "quantity", "revenue")}]
# The gain needs no vine: it is that of the whole correlation matrix's determinant.
VINE = f"""WITH g AS (SELECT symbol, count(*) AS n, corr(g_discount, g_quantity) AS dq, corr(g_discount, g_revenue) AS dr, corr(g_quantity, g_revenue) AS qr FROM ({staged_sql(WIDE_SQL, _SCORES)}) GROUP BY symbol HAVING count(*) >= 8),
t AS (SELECT symbol, n, unnest([{{'root': 'discount', 'a': dq, 'b': dr, 'c': qr}}, {{'root': 'quantity', 'a': dq, 'b': qr, 'c': dr}}, {{'root': 'revenue', 'a': dr, 'b': qr, 'c': dq}}]) AS v, 1 + 2 * dq * dr * qr - dq * dq - dr * dr - qr * qr AS det FROM g WHERE dq + dr + qr IS NOT NULL),
o AS (SELECT symbol, n, v.root AS root, v.a AS a, v.b AS b, v.c AS c, det, row_number() OVER (PARTITION BY symbol ORDER BY abs(v.a) + abs(v.b) DESC, v.root) AS nth FROM t)
SELECT symbol, n, root, round(a, 6) AS edge_a, round(b, 6) AS edge_b, round((c - a * b) / sqrt((1 - a * a) * (1 - b * b)), 6) AS conditional, round(-0.5 * ln(det), 5) AS information FROM o WHERE nth = 1"""


def bars_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bar: bars since the key's last jump of the close by a hundredth or more, this bar included; null before the first."""
    w = Window.partitionBy("key").orderBy("t")
    x = bars(spark, sf_dir).select("key", "t", "close", F.row_number().over(w).alias("i"), F.lag("close").over(w).alias("before"))
    x = x.withColumn("at", F.when(F.col("close") >= (1 + JUMP) * F.col("before"), F.col("i")))
    return x.select("key", "t", (F.col("i") - F.last("at", ignorenulls=True).over(w)).cast("bigint").alias("since"))


SINCE = f"""SELECT key, t, CASE WHEN stretch > 0 THEN row_number() OVER (PARTITION BY key, stretch ORDER BY t) - 1 END AS since FROM
  (SELECT *, count(*) FILTER (jump) OVER (PARTITION BY key ORDER BY t) AS stretch FROM (SELECT key, t, close >= {1 + JUMP} * lag(close) OVER (PARTITION BY key ORDER BY t) AS jump FROM ({BARS_SQL})))"""


def barrier_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each event can be released in the order of its user's event numbers: once all earlier ones have arrived. An event
    that comes again counts at its first arrival; rows without number or time are left out. Users are taken in blocks of
    numbers, each block starting from the latest arrival of the blocks before, so a busy user's events lie in many tasks."""
    x = table(spark, sf_dir, "events").where("event_id is not null and ts is not null").groupBy("user_id", "event_id").agg(F.min("ts").alias("arrived"))
    x = x.withColumn("block", F.floor(F.col("event_id") / BLOCK))
    before = Window.partitionBy("user_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy("user_id", "block").agg(F.max("arrived").alias("latest")).select(F.col("user_id").alias("u"), F.col("block").alias("b"), F.max("latest").over(before).alias("carried"))
    x = x.join(blocks, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("block") == F.col("b")))
    own = F.max("arrived").over(Window.partitionBy("user_id", "block").orderBy("event_id"))
    released = F.greatest("carried", own)
    return x.select("user_id", "event_id", released.alias("released"), F.round((F.unix_micros(released.cast("timestamp")) - F.unix_micros(F.col("arrived").cast("timestamp"))) / 1e6, 3).alias("waited"))


RELEASE = """SELECT user_id, event_id, max(arrived) OVER w AS released, round((epoch_us(max(arrived) OVER w) - epoch_us(arrived)) / 1e6, 3) AS waited
  FROM (SELECT user_id, event_id, min(ts) AS arrived FROM events WHERE event_id IS NOT NULL AND ts IS NOT NULL GROUP BY ALL) WINDOW w AS (PARTITION BY user_id ORDER BY event_id)"""


#: Contributions shown one by one.
SHOWN = 2


def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order line, from the boosted trees: the margin, each input's exact Shapley value (path-dependent), the waterfall of the two
    largest and the others, and what is missing to the margin (at most rounding)."""
    ready, model = fitted_trees(spark, sf_dir)
    e = trees.of_spark(model, len(LINE_INPUTS))
    x = trees.explained(ready.select("l_orderkey", "l_linenumber", *LINE_INPUTS), LINE_INPUTS, e, parts=("contributions",), show=SHOWN)
    # Written out element by element: functions over arrays are interpreted row by row.
    missing = F.abs(sum((F.col("contributions")[i] for i in range(len(LINE_INPUTS))), F.lit(e.base)) - F.col("margin"))
    steps = [F.col("waterfall")[i] for i in range(min(SHOWN + 1, len(LINE_INPUTS)))]
    return x.select("l_orderkey", "l_linenumber", F.round("margin", 6).alias("margin"), *[F.round(F.col("contributions")[i], 6).alias(f"by_{c.removeprefix('l_')}") for i, c in enumerate(LINE_INPUTS)],
        F.array(*[F.struct(s["feature"].alias("feature"), F.round(s["upto"], 6).alias("upto")) for s in steps]).alias("waterfall"), (missing < 1e-6).alias("adds_up"))


def tree_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per input of the boosted trees: its share of the splits' gain, the mean size of its Shapley values and of its path attributions."""
    ready, model = fitted_trees(spark, sf_dir)
    e = trees.of_spark(model, len(LINE_INPUTS))
    x = trees.explained(ready.select(*LINE_INPUTS), LINE_INPUTS, e)
    parts = F.arrays_zip(F.array(*[F.lit(c) for c in LINE_INPUTS]).alias("input"), F.array(*[F.lit(float(g / max(e.gains.sum(), 1e-300))) for g in e.gains]).alias("gain"), F.col("contributions").alias("c"), F.col("path_attributions").alias("p"))
    g = x.select(F.explode(parts).alias("x")).groupBy("x.input", "x.gain").agg(F.avg(F.abs("x.c")).alias("c"), F.avg(F.abs("x.p")).alias("p"))
    return g.select("input", F.round("gain", 6).alias("gain"), F.round("c", 6).alias("shapley"), F.round("p", 6).alias("path"))


def line_counterfactuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order line: the least change of its quantity, and of its discount, that turns the trees' decision, null where none does; and
    whether the trees, asked again with the changed quantity, decide otherwise."""
    ready, model = fitted_trees(spark, sf_dir)
    flips = ("l_quantity", "l_discount")
    x = trees.explained(ready.select("l_orderkey", "l_linenumber", *LINE_INPUTS), LINE_INPUTS, trees.of_spark(model, len(LINE_INPUTS)), flips, ())
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    moved = x.withColumn("changed", F.coalesce("flip_l_quantity", "l_quantity"))
    again = model.transform(VectorAssembler(inputCols=["changed", *LINE_INPUTS[1:]], outputCol="features").transform(moved))
    turned = F.when(F.col("flip_l_quantity").isNotNull(), (vector_to_array("probability")[1] > 0.5) != (F.col("margin") > 0))
    return again.select("l_orderkey", "l_linenumber", F.round(F.col("flip_l_quantity") - F.col("l_quantity"), 6).alias("quantity_change"), F.round(F.col("flip_l_discount") - F.col("l_discount"), 6).alias("discount_change"), turned.alias("verified"))


#: Representative rows.
BACKGROUND = 8


def background_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings that stand for all of them: of each cluster the vector nearest to its centre, the smallest id of equals, with the
    cluster's share of the vectors as its weight."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import vector_to_array

    x = vectors(spark, sf_dir)
    model = KMeans(k=BACKGROUND, seed=7, maxIter=20).fit(x)
    centres = F.array(*[F.array(*[F.lit(float(v)) for v in c]) for c in model.clusterCenters()])
    near = model.transform(x).select("vec_id", "prediction", vector_to_array("features").alias("v")).withColumn("c", F.get(centres, F.col("prediction")))
    away = F.aggregate(F.zip_with("v", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, d: s + d)
    g = near.select("prediction", "vec_id", away.alias("away")).groupBy("prediction").agg(F.min(F.struct("away", "vec_id")).alias("best"), F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select(F.col("best.vec_id").alias("vec_id"), F.col("n").alias("stands_for"), F.round(F.col("n") / F.col("total"), 6).alias("weight"))


def fitted_vines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per entity: the canonical vine of its monthly quantity, discount and revenue with a family chosen for each edge by likelihood, its
    log likelihood, and the mean tail dependence of the first tree. An entity has a row a month."""
    x = wide_features(spark, sf_dir).groupBy("symbol").agg(*[F.collect_list(F.coalesce(c, F.lit(float("nan")))).alias(c) for c in VINE_INPUTS])
    v = copulas.fitted_vines(x, VINE_INPUTS)
    edge = lambda e: F.struct(e["tree"].alias("tree"), e["root"].alias("root"), e["other"].alias("other"), e["family"].alias("family"), F.round(e["theta"], 4).alias("theta"), e["nu"].alias("nu"))
    return v.select("symbol", "n", F.transform("edges", edge).alias("edges"), F.round("loglik", 4).alias("loglik"), F.round("lower_tail", 4).alias("lower_tail"), F.round("upper_tail", 4).alias("upper_tail"))


VINE_INPUTS = ["discount", "quantity", "revenue"]

QUERIES = {
    "line_attributions": (line_attributions, LINE_ATTRIBUTIONS), "attribution_importance": (attribution_importance, IMPORTANCE), "probability_spread": (probability_spread, SPREAD),
    "vine_dependence": (vine_dependence, VINE), "bars_since": (bars_since, SINCE), "barrier_release": (barrier_release, RELEASE),
    "tree_contributions": (tree_contributions, None), "tree_importance": (tree_importance, None), "line_counterfactuals": (line_counterfactuals, None), "background_rows": (background_rows, None), "fitted_vines": (fitted_vines, None),
}
