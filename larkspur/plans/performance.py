"""Queries of back-test results, decaying events, retrieval and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.quantiles import quantiles
from larkspur.operators.retrieval import best_documents
from larkspur.sources.roles import EQUITY_SQL, equity, micros, table


def _days():
    """One row per calendar day: the size of this window is bounded by the calendar."""
    return Window.partitionBy(F.lit(0)).orderBy("day")


def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    peak = F.max("equity").over(_days().rowsBetween(Window.unboundedPreceding, 0))
    return equity(spark, sf_dir).select("day", "equity", F.round((F.col("equity") - peak) / peak, 8).alias("drawdown"))


DRAWDOWN = f"SELECT day, equity, round((equity - p) / p, 8) AS drawdown FROM (SELECT *, max(equity) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS p FROM ({EQUITY_SQL}))"


def drawdown_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stretch below the peak: first day, length and depth."""
    d = drawdown(spark, sf_dir).withColumn("under", F.col("drawdown") < -1e-9)
    d = d.withColumn("island", F.sum(F.when(F.col("under"), 0).otherwise(1)).over(_days()))
    return d.where("under").groupBy("island").agg(F.min("day").alias("since"), F.count("*").alias("days"), F.min("drawdown").alias("depth")).drop("island")


RUNS = f"SELECT min(day) AS since, count(*) AS days, min(drawdown) AS depth FROM (SELECT *, sum(CASE WHEN drawdown < -1e-9 THEN 0 ELSE 1 END) OVER (ORDER BY day) AS island FROM ({DRAWDOWN})) WHERE drawdown < -1e-9 GROUP BY island"


def monthly_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = equity(spark, sf_dir).groupBy(F.date_trunc("month", "day").alias("month")).agg(F.max_by("equity", "day").alias("close"), F.count("*").alias("days"))
    before = F.lag("close").over(Window.partitionBy(F.lit(0)).orderBy("month"))
    return m.select("month", "days", F.round(F.col("close") / before - 1, 8).alias("ret"))


MONTHLY = f"SELECT month, days, round(close / lag(close) OVER (ORDER BY month) - 1, 8) AS ret FROM (SELECT date_trunc('month', day) AS month, arg_max(equity, day) AS close, count(*) AS days FROM ({EQUITY_SQL}) GROUP BY 1)"

TRADES = "SELECT o_orderpriority AS strategy, o_orderkey AS id, o_orderdate AS traded, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * o_totalprice AS pnl FROM orders"


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderpriority").alias("strategy"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("traded"), (F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1) * F.col("o_totalprice")).alias("pnl"))


def trade_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per strategy: count, win rate, profit factor (999 without a loss), expectancy, worst and best trade."""
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), F.sum(F.when(F.col("pnl") < 0, -F.col("pnl")))
    g = trades(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pnl") > 0).cast("double")), 6).alias("win_rate"), F.round(F.when(loss > 0, F.coalesce(win, F.lit(0.0)) / loss).otherwise(999.0), 6).alias("profit_factor"), F.round(F.avg("pnl"), 4).alias("expectancy"), F.min("pnl").alias("worst"), F.max("pnl").alias("best"), F.round(F.sqrt(F.count("*").cast("double")) * F.avg("pnl") / F.stddev_samp("pnl"), 6).alias("t_stat"))
    return g


METRICS = f"""SELECT strategy, count(*) AS n, round(avg((pnl > 0)::INT), 6) AS win_rate, round(CASE WHEN sum(CASE WHEN pnl < 0 THEN -pnl END) > 0 THEN coalesce(sum(CASE WHEN pnl > 0 THEN pnl END), 0) / sum(CASE WHEN pnl < 0 THEN -pnl END) ELSE 999.0 END, 6) AS profit_factor,
  round(avg(pnl), 4) AS expectancy, min(pnl) AS worst, max(pnl) AS best, round(sqrt(count(*)) * avg(pnl) / stddev_samp(pnl), 6) AS t_stat FROM ({TRADES}) GROUP BY strategy"""


def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest runs of wins and of losses per strategy, in trade order: runs per month first, joined at the months' ends."""
    w = Window.partitionBy("strategy", "month").orderBy("traded", "id")
    t = trades(spark, sf_dir).withColumn("win", F.coalesce(F.col("pnl") > 0, F.lit(False))).withColumn("month", F.date_trunc("month", "traded"))
    t = t.withColumn("turn", F.when(F.col("win") == F.lag("win").over(w), 0).otherwise(1)).withColumn("island", F.sum("turn").over(w))
    runs = t.groupBy("strategy", "month", "win", "island").agg(F.count("*").alias("n"))
    # A month's first and last run may go on in the months beside it; the others are whole.
    ends = Window.partitionBy("strategy", "month")
    runs = runs.withColumn("outer", (F.col("island") == F.min("island").over(ends)) | (F.col("island") == F.max("island").over(ends)))
    whole = runs.where("not outer").select("strategy", "win", "n")
    # At most two rows per month are left: runs of equal outcome are joined in order, then islands again.
    o = Window.partitionBy("strategy").orderBy("month", "island")
    rest = runs.where("outer").withColumn("again", F.when(F.col("win") == F.lag("win").over(o), 0).otherwise(1))
    # Between a month's first and last run lie others, unless they are neighbours, so equal ones there are not one run.
    rest = rest.withColumn("again", F.when((F.lag("month").over(o) == F.col("month")) & (F.col("island") - F.lag("island").over(o) > 1), 1).otherwise(F.col("again")))
    joined = rest.withColumn("of", F.sum("again").over(o)).groupBy("strategy", "win", "of").agg(F.sum("n").alias("n")).select("strategy", "win", "n")
    return whole.union(joined).groupBy("strategy").agg(F.max(F.when(F.col("win"), F.col("n"))).alias("wins"), F.max(F.when(~F.col("win"), F.col("n"))).alias("losses"))


STREAKS = f"""SELECT strategy, max(CASE WHEN win THEN n END) AS wins, max(CASE WHEN NOT win THEN n END) AS losses FROM (SELECT strategy, win, island, count(*) AS n FROM (SELECT *, sum(turn) OVER (PARTITION BY strategy ORDER BY traded, id) AS island FROM
  (SELECT *, pnl > 0 AS win, CASE WHEN (pnl > 0) = lag(pnl > 0) OVER (PARTITION BY strategy ORDER BY traded, id) THEN 0 ELSE 1 END AS turn FROM ({TRADES}))) GROUP BY ALL) GROUP BY strategy"""


def tail_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Value at risk (5 % quantile) and the mean of what lies at or below it, per strategy."""
    t = trades(spark, sf_dir)
    q = quantiles(t, "strategy", "pnl", {"var": 0.05}).select("strategy", "var")
    return t.join(F.broadcast(q), "strategy").where("pnl <= var").groupBy("strategy").agg(F.round(F.first("var"), 4).alias("var"), F.round(F.avg("pnl"), 4).alias("cvar"), F.count("*").alias("n"))


TAIL = f"WITH t AS ({TRADES}), q AS (SELECT strategy, quantile_cont(pnl, 0.05) AS v FROM t GROUP BY 1) SELECT strategy, round(any_value(v), 4) AS var, round(avg(pnl), 4) AS cvar, count(*) AS n FROM t JOIN q USING (strategy) WHERE pnl <= v GROUP BY strategy"


def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds of 250 training and 60 test days, moved on by 60: mean daily pnl of both parts."""
    d = equity(spark, sf_dir).withColumn("i", F.row_number().over(_days()) - 1)
    n = F.floor((F.col("i")) / 60)
    folds = d.withColumn("fold", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - 309) / 60).cast("int")), n.cast("int"))))
    at = F.col("i") - 60 * F.col("fold")
    parts = folds.where((at >= 0) & (at < 310)).withColumn("test", at >= 250)
    g = parts.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.avg(F.when(~F.col("test"), F.col("pnl"))), 2).alias("train"), F.round(F.avg(F.when(F.col("test"), F.col("pnl"))), 2).alias("out"))
    return g.where("n = 310")


WALK = f"""WITH d AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM ({EQUITY_SQL})), f AS (SELECT unnest(range(0, (SELECT count(*) FROM d)))::INT AS fold)
SELECT fold, count(*) AS n, round(avg(CASE WHEN i - 60 * fold < 250 THEN pnl END), 2) AS train, round(avg(CASE WHEN i - 60 * fold >= 250 THEN pnl END), 2) AS out FROM d JOIN f ON i >= 60 * fold AND i < 60 * fold + 310 GROUP BY fold HAVING count(*) = 310"""

HALF_LIFE = {"click": 6.0, "view": 3.0, "purchase": 48.0, "signup": 72.0, "error": 12.0}
AUTHORITY = {"click": 0.5, "view": 0.3, "purchase": 1.0, "signup": 0.9, "error": 0.6}
NOW = "2024-01-30 00:00:00"


def decayed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and stream: the mean value weighted by decay with age, authority and confidence, and the evidence."""
    pick = lambda m: F.element_at(F.create_map(*[F.lit(x) for p in m.items() for x in p]), F.col("event_type"))
    e = table(spark, sf_dir, "events").where(F.col("ts") <= F.lit(NOW).cast("timestamp"))
    hours = (F.unix_micros(F.lit(NOW).cast("timestamp")) - micros("ts")) / 3.6e9
    confidence = F.get_json_object("props", "$.k").cast("double") / 100
    e = e.withColumn("w", F.pow(F.lit(2.0), -hours / pick(HALF_LIFE)) * pick(AUTHORITY) * F.coalesce(confidence, F.lit(0.5)))
    return e.groupBy("user_id", "event_type").agg(F.sum("w").alias("evidence"), F.when(F.sum("w") > 1e-12, F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"), F.count("*").alias("n"))


def decay_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decayed_streams(spark, sf_dir).select("user_id", "event_type", F.round("evidence", 6).alias("evidence"), F.round("value", 6).alias("value"), "n")


def decay_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the evidence-weighted mean over streams, and the evidence."""
    g = decayed_streams(spark, sf_dir).where("value IS NOT NULL").groupBy("user_id").agg(F.sum("evidence").alias("e"), F.sum(F.col("evidence") * F.col("value")).alias("s"))
    return g.select("user_id", F.round("e", 6).alias("evidence"), F.round(F.col("s") / F.col("e"), 6).alias("composite"))


_CASE = lambda m: "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " END"
DECAYED = f"""SELECT user_id, event_type, sum(w) AS evidence, CASE WHEN sum(w) > 1e-12 THEN sum(w * value) / sum(w) END AS value, count(*) AS n FROM (SELECT *, pow(2.0::DOUBLE, -((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9) / {_CASE(HALF_LIFE)}) * {_CASE(AUTHORITY)}
  * coalesce(json_extract_string(props, '$.k')::DOUBLE / 100, 0.5) AS w FROM events WHERE ts <= TIMESTAMP '{NOW}') GROUP BY ALL"""
DECAY = f"SELECT user_id, event_type, round(evidence, 6) AS evidence, round(value, 6) AS value, n FROM ({DECAYED})"
COMPOSITE = f"SELECT user_id, round(sum(evidence), 6) AS evidence, round(sum(evidence * value) / sum(evidence), 6) AS composite FROM ({DECAYED}) WHERE value IS NOT NULL GROUP BY user_id"


def retrieved(spark: SparkSession, sf_dir: str, depth: int) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), depth)


def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best documents for each benchmark text by BM25 (k1 1.2, b 0.75); statistics over all documents."""
    return retrieved(spark, sf_dir, 5).where("channel = 'lexical'").select("item_id", "doc_id", "score", "rank")


BM25_ALL = """WITH q AS (SELECT DISTINCT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS term FROM benchmark),
d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS terms FROM documents), n AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM d),
tf AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
h AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN n GROUP BY ALL)
SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM h"""
BM25 = f"{BM25_ALL} QUALIFY rank <= 5"


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions to calibrate: a length score for the labelled documents."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") / (F.col("n_chars") + 400)).alias("p"))


LABELLED = "SELECT doc_id, quality AS y, n_chars / (n_chars + 400) AS p FROM documents JOIN labels USING (doc_id)"


def reliability_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten bins of predicted probability: count, mean prediction, observed share; empty bins at their centres."""
    b = labelled(spark, sf_dir).groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"))
    bins = spark.range(10).select(F.col("id").cast("int").alias("bin"))
    return bins.join(b, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("predicted", (F.col("bin") + 0.5) / 10).alias("predicted"), "observed")


RELIABILITY = f"""SELECT g.bin::INT AS bin, coalesce(n, 0) AS n, coalesce(predicted, (g.bin + 0.5) / 10) AS predicted, observed FROM (SELECT unnest(range(10)) AS bin) g LEFT JOIN
  (SELECT least(9, floor(p * 10)) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed FROM ({LABELLED}) GROUP BY 1) b ON b.bin = g.bin"""


def classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve (ties averaged), Brier score, accuracy and expected calibration error.

    Ranks come from counts per distinct score, so no task sorts all predictions."""
    x = labelled(spark, sf_dir)
    s = x.groupBy("p").agg(F.count("*").alias("n"), F.sum("y").alias("pos"))
    # Running counts on 1000 ranges of the score first, then within a range.
    s = s.withColumn("part", F.floor(F.col("p") * 1000))
    parts = s.groupBy("part").agg(F.sum("n").alias("m")).withColumn("base", F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("m"))
    r = s.join(F.broadcast(parts.select("part", "base")), "part").withColumn("upto", F.col("base") + F.sum("n").over(Window.partitionBy("part").orderBy("p")))
    auc = r.agg(F.sum(F.col("pos") * (F.col("upto") - (F.col("n") - 1) / 2)).alias("rs"), F.sum("pos").cast("double").alias("np"), F.sum("n").cast("double").alias("nn"))
    auc = auc.select(F.round((F.col("rs") - F.col("np") * (F.col("np") + 1) / 2) / (F.col("np") * (F.col("nn") - F.col("np"))), 6).alias("auc"))
    rest = x.agg(F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"), F.round(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("double")), 6).alias("accuracy"))
    ece = x.groupBy(F.least(F.lit(9), F.floor(F.col("p") * 10)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap")).agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"))
    return auc.crossJoin(rest).crossJoin(ece)


CLASSIFICATION = f"""WITH x AS ({LABELLED}), r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM x),
e AS (SELECT count(*) AS n, abs(avg(p) - avg(y)) AS gap FROM x GROUP BY least(9, floor(p * 10)))
SELECT (SELECT round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6) FROM r) AS auc, (SELECT round(avg((p - y) * (p - y)), 6) FROM x) AS brier,
  (SELECT round(avg(((p >= 0.5)::INT = y)::INT), 6) FROM x) AS accuracy, (SELECT round(sum(n * gap) / sum(n), 6) FROM e) AS ece"""

QUERIES = {
    "drawdown": (drawdown, DRAWDOWN), "drawdown_runs": (drawdown_runs, RUNS), "monthly_returns": (monthly_returns, MONTHLY), "trade_metrics": (trade_metrics, METRICS), "streaks": (streaks, STREAKS), "tail_risk": (tail_risk, TAIL),
    "walk_forward": (walk_forward, WALK), "decay_stream": (decay_stream, DECAY), "decay_composite": (decay_composite, COMPOSITE), "bm25": (bm25, BM25), "reliability_curve": (reliability_curve, RELIABILITY), "classification": (classification, CLASSIFICATION),
}
