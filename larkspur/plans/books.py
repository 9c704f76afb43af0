"""Queries of books of trades with one capital, clusters of actors, the clock of three speeds, and retrieval by stored vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators.frames import distinct_in_frame
from larkspur.operators.portfolio import Rules, run_books, summary
from larkspur.operators.vectors import PAIR_WEIGHT, RUN_WEIGHT, WIDTH, WORD_WEIGHT, embedded, nearest
from larkspur.plans.performance import BM25_ALL, retrieved
from larkspur.plans.signals import DECISION_STEPS, FLOOR, FUSED, FUSED_LEAST, FUSED_MOST, FUSED_SHARE, SIGNAL_STEPS, STRATEGIES, fused
from larkspur.plans.valuation import staged
from larkspur.sources.roles import BARS_SQL, bars, micros, table
from larkspur.streaming.clock import SLOWER, clocked

BOOKS = Rules(least_conviction=0.35)


def booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The signals of each strategy, and of their fusion, as the bars of a book of its own."""
    x = staged(bars(spark, sf_dir), SIGNAL_STEPS + DECISION_STEPS)
    one = lambda book, way, conviction: F.struct(F.lit(book).alias("book"), F.expr(f"CAST({way} AS INT)").alias("way"), F.expr(f"CAST({conviction} AS DOUBLE)").alias("conviction"))
    books = [one(n, f"{n}_side", f"{n}_conviction") for n in STRATEGIES] + [one("fused", "way", "greatest(up, down)")]
    x = x.select(micros("t").alias("t"), "key", "high", "low", "close", "atr", F.explode(F.array(*books)).alias("b")).select("*", "b.*")
    return x.selectExpr("book", "t", "key", "high", "low", "close", "way", "close - 2 * way * atr AS stop", "close + 3 * way * atr AS target", "atr", "conviction")


def portfolio_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades of each strategy's book, whose open trades share one capital: sizes, fills, costs and reasons of their ends."""
    x = run_books(booked(spark, sf_dir), BOOKS).where("kind = 'trade'")
    money = [F.round(c, 6).alias(c) for c in ("entry_price", "exit_price", "gross", "fee", "net", "conviction", "best", "worst")]
    return x.select("book", "key", "way", F.timestamp_micros("entry_t").alias("entered"), F.timestamp_micros("t").alias("left"), "quantity", "bars_held", "reason", *money)


def portfolio_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each book came to: trades, win rate, profit factor, turnover, equity, drawdown, exposure."""
    return summary(run_books(booked(spark, sf_dir), BOOKS))


#: A cluster: at least so many actors in the frame, a net share of their value above the trigger, and a price that has not run ahead of its mean.
FRAME_HOURS, LEAST_ACTORS, FULL_ACTORS, NET_TRIGGER, AHEAD, ANCHOR = 3, 3, 8, 0.25, 3.0, 20
_CLUSTER = [
    "round(CASE WHEN gross > 0 THEN net / gross ELSE 0 END, 6) AS net_share", "round(ahead, 6) AS ahead",
    f"coalesce(actors >= {LEAST_ACTORS} AND gross > 0 AND net >= {NET_TRIGGER}D * gross AND ahead <= {AHEAD}D, FALSE) AS fired",
]


def actor_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per bar: how many different users acted on its key in the three hours up to its last event, their net share of value
    (events whose k is 50 or more add, others take away), how far the close is ahead of its mean, whether that is a cluster, and its conviction."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = table(spark, sf_dir, "events").select("event_type", "user_id", micros("ts").alias("us"), "value", F.when(k >= 50, F.col("value")).when(k < 50, -F.col("value")).alias("signed"))
    found = distinct_in_frame(e, "event_type", "user_id", "us", FRAME_HOURS * 3_600_000_000, {"gross": F.col("value"), "net": F.col("signed")})
    hour = F.date_trunc("hour", F.timestamp_micros("t"))
    at_bar = found.groupBy("key", hour.alias("hour")).agg(F.max_by(F.struct("actors", "gross", "net"), "t").alias("f")).select("key", F.date_format("hour", "yyyyMMddHH").alias("h"), "f.actors", F.col("f.gross").cast("double").alias("gross"), F.col("f.net").cast("double").alias("net"))
    w = Window.partitionBy("key").orderBy("t").rowsBetween(1 - ANCHOR, 0)
    anchor = F.when(F.count("*").over(w) == ANCHOR, F.avg("close").over(w))
    b = bars(spark, sf_dir).select("key", "t", F.date_format("t", "yyyyMMddHH").alias("h"), F.when(anchor > 0, 100 * (F.col("close") / anchor - 1)).alias("ahead"))
    x = b.join(at_bar, ["key", "h"])
    conviction = F.least(F.lit(1.0), 0.4 + 0.28 * F.least(F.lit(1.0), (F.col("net_share") - NET_TRIGGER) / 0.6) + 0.18 * F.least(F.lit(1.0), F.col("actors") / FULL_ACTORS))
    out = x.selectExpr("key", "t", "actors", *_CLUSTER)
    return out.withColumn("conviction", F.when(F.col("fired"), F.round(conviction, 6)))


CLUSTERS = f"""WITH b AS (SELECT key, t, CASE WHEN count(*) OVER w = {ANCHOR} AND avg(close) OVER w > 0 THEN 100 * (close / avg(close) OVER w - 1) END AS ahead FROM ({BARS_SQL}) WINDOW w AS (PARTITION BY key ORDER BY t ROWS BETWEEN {ANCHOR - 1} PRECEDING AND CURRENT ROW)),
e AS (SELECT event_type AS key, ts, user_id, value::DECIMAL(18,4) AS v, CASE WHEN json_extract_string(props, '$.k')::DOUBLE >= 50 THEN value WHEN json_extract_string(props, '$.k')::DOUBLE < 50 THEN -value END::DECIMAL(18,4) AS s FROM events),
z AS (SELECT key, date_trunc('hour', ts) AS t, max(ts) AS z FROM e GROUP BY ALL),
f AS (SELECT z.key, z.t, count(DISTINCT user_id) AS actors, sum(v)::DOUBLE AS gross, coalesce(sum(s), 0)::DOUBLE AS net FROM z JOIN e ON e.key = z.key AND e.ts <= z.z AND e.ts > z.z - INTERVAL {FRAME_HOURS} HOUR GROUP BY ALL),
g AS (SELECT key, t, actors, round(CASE WHEN gross > 0 THEN net / gross ELSE 0 END, 6) AS net_share, round(ahead, 6) AS ahead, CASE WHEN actors < {LEAST_ACTORS} OR gross <= 0 OR ahead IS NULL THEN FALSE ELSE net >= {NET_TRIGGER} * gross AND b.ahead <= {AHEAD} END AS fired FROM f JOIN b USING (key, t))
SELECT *, CASE WHEN fired THEN round(least(1, 0.4 + 0.28 * least(1, (net_share - {NET_TRIGGER}) / 0.6) + 0.18 * least(1, actors / {FULL_ACTORS}.0)), 6)::DOUBLE END AS conviction FROM g"""

#: The slower speeds' periods in ticks (hours).
PERIODS = dict(zip(SLOWER, (24, 4), strict=True))


def clock_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each key's bars as ticks, and the states of its days and quarters of days, committed at the last tick they have. A fall by
    more than a half forbids long trades, a rise to more than the double short ones."""
    b = bars(spark, sf_dir).select("key", F.floor(micros("t") / 3_600_000_000).alias("seq"), "open", "close")
    none = F.lit(None)
    out = b.select("key", F.lit("fast").alias("speed"), "seq", none.cast("string").alias("label"), none.cast("boolean").alias("no_long"), none.cast("boolean").alias("no_short"))
    for speed, ticks in PERIODS.items():
        p = b.groupBy("key", F.floor(F.col("seq") / ticks)).agg(F.min_by("open", "seq").alias("open"), F.max_by("close", "seq").alias("close"), F.max("seq").alias("seq"))
        out = out.union(p.select("key", F.lit(speed), "seq", F.when(F.col("close") > F.col("open"), "up").otherwise("down"), F.col("close") < F.col("open") / 2, F.col("close") > F.col("open") * 2))
    return out


def tiered_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ticks that days and quarters of days let through, with the states they see and the vetoes that hold."""
    return clocked(clock_rows(spark, sf_dir))


_PERIOD = lambda n: f"SELECT key, max(h) AS seq, CASE WHEN last(close ORDER BY h) > first(open ORDER BY h) THEN 'up' ELSE 'down' END AS label, last(close ORDER BY h) < first(open ORDER BY h) / 2 AS no_long, last(close ORDER BY h) > first(open ORDER BY h) * 2 AS no_short FROM b GROUP BY key, h // {n}"
CLOCK = f"""WITH b AS (SELECT key, epoch_us(t) // 3600000000 AS h, open, close FROM ({BARS_SQL})), s AS ({_PERIOD(24)}), m AS ({_PERIOD(4)}), r AS (SELECT key, max(h) AS top FROM b GROUP BY key)
SELECT b.key, b.h AS seq, s.seq AS slow_seq, s.label AS slow_label, m.seq AS middle_seq, m.label AS middle_label, coalesce(s.no_long, FALSE) OR coalesce(m.no_long, FALSE) AS no_long, coalesce(s.no_short, FALSE) OR coalesce(m.no_short, FALSE) AS no_short
FROM b JOIN r USING (key) ASOF LEFT JOIN s ON b.key = s.key AND b.h > s.seq ASOF LEFT JOIN m ON b.key = m.key AND b.h > m.seq WHERE b.h - 1 <= r.top"""


def vector_hits(spark: SparkSession, sf_dir: str, depth: int = 5) -> DataFrame:
    """The nearest documents of each benchmark text by the cosine of their hashed vectors."""
    return nearest(embedded(table(spark, sf_dir, "documents")), embedded(table(spark, sf_dir, "benchmark"), "item_id"), depth, FLOOR)


_HASH = "('0x' || substr(md5(f), 1, 8))::BIGINT"
_SPLIT = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9]+'), lambda w: lower(w))"
VECTORS = f"""t AS (SELECT 'd' AS kind, doc_id AS id, {_SPLIT} AS ws FROM documents UNION ALL SELECT 'q', item_id, {_SPLIT} FROM benchmark),
u AS (SELECT kind, id, unnest(ws) AS w FROM t), g AS (SELECT kind, id, {WORD_WEIGHT} AS weight, 'u:' || w AS f FROM u
  UNION ALL SELECT kind, id, {PAIR_WEIGHT}, 'b:' || unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM t
  UNION ALL SELECT kind, id, {RUN_WEIGHT}, 'c:' || substr(' ' || w || ' ', i, 3) FROM (SELECT kind, id, w, unnest(range(1, length(w) + 1)) AS i FROM (SELECT DISTINCT * FROM u))),
p AS (SELECT kind, id, {_HASH} % {WIDTH} AS place, CASE WHEN ({_HASH} >> 8) % 2 = 0 THEN 1 ELSE -1 END * weight * (1 + ln(n)) AS x FROM (SELECT kind, id, weight, f, count(*) AS n FROM g GROUP BY ALL)),
e AS (SELECT kind, id, place, sum(x)::DOUBLE AS x FROM p GROUP BY ALL), l AS (SELECT kind, id, sqrt(sum(x * x)) AS norm FROM e GROUP BY ALL HAVING sum(x * x) > 0), y AS (SELECT kind, id, place, x / norm AS x FROM e JOIN l USING (kind, id)),
h AS (SELECT q.id AS item_id, d.id AS doc_id, round(sum(q.x * d.x), 6) AS score FROM y q JOIN y d ON q.kind = 'q' AND d.kind = 'd' AND q.place = d.place GROUP BY ALL),
v AS (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS rank FROM h WHERE score > {FLOOR})"""
NEAREST = f"WITH {VECTORS} SELECT * FROM v WHERE rank <= 5"


def hybrid_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion of the lexical channel with the vectors' own channel, each read down to two fifths of the documents, at most 40."""
    n = table(spark, sf_dir, "documents").count()
    depth = min(FUSED_MOST, max(FUSED_LEAST, -int(-n * FUSED_SHARE // 1)))
    lexical = retrieved(spark, sf_dir, depth).where("channel = 'lexical' AND score > 0")
    return fused(lexical.unionByName(vector_hits(spark, sf_dir, depth).withColumn("channel", F.lit("dense"))))


_DEPTH = f"depth AS (SELECT least({FUSED_MOST}, greatest({FUSED_LEAST}, ceil(count(*) * {FUSED_SHARE}))) AS depth FROM documents)"
HYBRID = f"WITH lex AS ({BM25_ALL}), {_DEPTH}, {VECTORS}, {FUSED}"

#: A text has support where its best lexical score or its best cosine reaches this. Fixed values.
LEXICAL_SUPPORT, DENSE_SUPPORT = 5.0, 0.42


def evidence_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per benchmark text: the best score in each channel, and whether either can support an answer."""
    lexical = retrieved(spark, sf_dir, 1).where("channel = 'lexical'").select("item_id", F.col("score").alias("lexical"))
    best = lexical.join(vector_hits(spark, sf_dir, 1).select("item_id", F.col("score").alias("dense")), "item_id", "full")
    every = table(spark, sf_dir, "benchmark").select("item_id").distinct().join(best, "item_id", "left")
    return every.select("item_id", F.coalesce("lexical", F.lit(0.0)).alias("lexical"), F.coalesce("dense", F.lit(0.0)).alias("dense")).withColumn("supported", F.expr(f"lexical >= {LEXICAL_SUPPORT} OR dense >= {DENSE_SUPPORT}"))


EVIDENCE = f"""WITH lex AS ({BM25_ALL}), {VECTORS}, best AS (SELECT item_id, coalesce(max(lex.score), 0)::DOUBLE AS lexical FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN lex USING (item_id) GROUP BY 1),
near AS (SELECT item_id, max(score) AS dense FROM v GROUP BY 1) SELECT item_id, lexical, coalesce(dense, 0)::DOUBLE AS dense, lexical >= {LEXICAL_SUPPORT} OR coalesce(dense, 0) >= {DENSE_SUPPORT} AS supported FROM best LEFT JOIN near USING (item_id)"""

QUERIES = {
    "portfolio_trades": (portfolio_trades, None), "portfolio_summary": (portfolio_summary, None), "actor_clusters": (actor_clusters, CLUSTERS), "tiered_clock": (tiered_clock, CLOCK),
    "vector_hits": (vector_hits, NEAREST), "hybrid_hits": (hybrid_hits, HYBRID), "evidence_found": (evidence_found, EVIDENCE),
}
