"""Queries over the screened universe: snapshot, screening, ranks, windows over long features, joins in time, ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions.quantiles import quantiles
from larkspur.sources.roles import ENTITIES_SQL, FEATURES, LONG_SQL, entities, long_features, micros, table


def latest_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest value of each feature, turned into columns: one shuffle, no self join."""
    long = long_features(spark, sf_dir)
    newest = long.groupBy("symbol", "feature").agg(F.max_by("value", "as_of").alias("value"), F.max("as_of").alias("as_of"))
    return newest.groupBy("symbol").pivot("feature", list(FEATURES)).agg(F.max("value"))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with their newest features and newest trade."""
    trades = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.max_by(F.struct("l_extendedprice", "l_shipdate"), F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("q"))
    wide = entities(spark, sf_dir).join(latest_features(spark, sf_dir), "symbol")
    return wide.join(trades.select("symbol", F.col("q.l_extendedprice").alias("last_price"), F.col("q.l_shipdate").alias("last_time")), "symbol", "left")


LATEST = f"SELECT symbol, {', '.join(f'''max(CASE WHEN feature = '{f}' THEN value END) AS {f}''' for f in FEATURES)} FROM (SELECT symbol, feature, arg_max(value, as_of) AS value FROM ({LONG_SQL}) GROUP BY ALL) GROUP BY symbol"
TRADE = "SELECT l_suppkey AS symbol, l_extendedprice AS last_price, l_shipdate AS last_time FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1"
SNAPSHOT = f"SELECT * FROM ({ENTITIES_SQL}) JOIN ({LATEST}) USING (symbol) LEFT JOIN ({TRADE}) USING (symbol)"


def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer, by date, then key."""
    o = table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")


LATEST_PER_KEY = "SELECT o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def between(column: str, low=None, high=None) -> F.Column:
    """low <= column < high; an open end where None."""
    rule = F.lit(True)
    if low is not None:
        rule &= F.col(column) >= low
    if high is not None:
        rule &= F.col(column) < high
    return rule


def complement(column: str, rule: F.Column) -> F.Column:
    """The true complement of a rule on a nullable column: rows without a value are in it."""
    return F.col(column).isNull() | ~rule


def screener(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-benchmarks in two sectors, balance in a band, a name that holds a text whatever its case."""
    s = snapshot(spark, sf_dir)
    return s.where(~F.col("is_benchmark") & F.col("sector").isin("ASIA", "EUROPE") & between("balance", -500, 9000) & F.lower("name").contains("supplier")).select("symbol", "name", "sector", "balance", "revenue")


SCREENER = f"SELECT symbol, name, sector, balance, revenue FROM ({SNAPSHOT}) WHERE NOT is_benchmark AND sector IN ('ASIA', 'EUROPE') AND balance >= -500 AND balance < 9000 AND lower(name) LIKE '%supplier%'"


def negated_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders not in a price band, where prices of open orders count as unknown."""
    o = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderstatus") != "O", F.col("o_totalprice")))
    return o.where(complement("price", between("price", 50_000, 200_000))).select("o_orderkey", "price")


NEGATED = "SELECT o_orderkey, price FROM (SELECT *, CASE WHEN o_orderstatus <> 'O' THEN o_totalprice END AS price FROM orders) WHERE price IS NULL OR NOT (price >= 50000 AND price < 200000)"


def nulls_last_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 entities with the greatest revenue, unknown last, ties by symbol."""
    s = snapshot(spark, sf_dir).withColumn("score", F.when(F.col("symbol") % 3 != 0, F.col("revenue")))
    return s.where("NOT is_benchmark").orderBy(F.desc_nulls_last("score"), "symbol").limit(25).select("symbol", "sector", "score")


TOPK = f"SELECT symbol, sector, CASE WHEN symbol % 3 <> 0 THEN revenue END AS score FROM ({SNAPSHOT}) WHERE NOT is_benchmark ORDER BY score DESC NULLS LAST, symbol LIMIT 25"


def count_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).where(~F.col("is_benchmark") & (F.col("balance") > 0)).groupBy("sector").agg(F.count("*").alias("matches"))


COUNT = f"SELECT sector, count(*) AS matches FROM ({SNAPSHOT}) WHERE NOT is_benchmark AND balance > 0 GROUP BY sector"


def sector_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot(spark, sf_dir).select("symbol", "sector", F.rank().over(Window.partitionBy("sector").orderBy(F.desc_nulls_last("balance"))).alias("rank"))


RANK = f"SELECT symbol, sector, (rank() OVER (PARTITION BY sector ORDER BY balance DESC NULLS LAST))::INT AS rank FROM ({SNAPSHOT})"


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-sectional rank of each feature among the entities of its month, as a share in (0, 1)."""
    w = Window.partitionBy("as_of", "feature")
    n = F.count("*").over(w)
    return long_features(spark, sf_dir).select("symbol", "as_of", "feature", F.round(F.greatest(1 / (n + 1), F.least(n / (n + 1), F.cume_dist().over(w.orderBy("value")) * n / (n + 1))), 6).alias("normalised"))


NORMALISED = f"""SELECT symbol, as_of, feature, round(greatest(1 / (n + 1), least(n / (n + 1), c * n / (n + 1))), 6) AS normalised FROM
  (SELECT *, count(*) OVER (PARTITION BY as_of, feature) AS n, cume_dist() OVER (PARTITION BY as_of, feature ORDER BY value) AS c FROM ({LONG_SQL}))"""


def delta_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change over one and five months of each feature, and the change's z score over the last 24."""
    w = Window.partitionBy("symbol", "feature").orderBy("as_of")
    f = w.rowsBetween(-23, 0)
    d = long_features(spark, sf_dir).withColumn("d1", F.col("value") - F.lag("value").over(w)).withColumn("d5", F.col("value") - F.lag("value", 5).over(w))
    sd = F.stddev_pop("d1").over(f)
    return d.select("symbol", "feature", "as_of", F.round("d1", 6).alias("delta1"), F.round("d5", 6).alias("delta5"), F.when(sd > 1e-9, F.round((F.col("d1") - F.avg("d1").over(f)) / sd, 4)).alias("z1"))


DELTA = f"""SELECT symbol, feature, as_of, round(d1, 6) AS delta1, round(d5, 6) AS delta5, CASE WHEN s > 1e-9 THEN round((d1 - a) / s, 4) END AS z1 FROM
 (SELECT *, avg(d1) OVER f AS a, stddev_pop(d1) OVER f AS s FROM (SELECT *, value - lag(value) OVER w AS d1, value - lag(value, 5) OVER w AS d5 FROM ({LONG_SQL}) WINDOW w AS (PARTITION BY symbol, feature ORDER BY as_of))
  WINDOW f AS (PARTITION BY symbol, feature ORDER BY as_of ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""


def own_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the last 24 months' values below the newest one."""
    f = Window.partitionBy("symbol", "feature").orderBy("as_of").rowsBetween(-23, 0)
    kept = long_features(spark, sf_dir).withColumn("seen", F.collect_list("value").over(f))
    n = F.size("seen")
    return kept.select("symbol", "feature", "as_of", F.when(n > 1, F.round(F.size(F.filter("seen", lambda x: x < F.col("value"))) / (n - 1), 6)).alias("percentile"))


OWN_PERCENTILE = f"""SELECT symbol, feature, as_of, CASE WHEN len(seen) > 1 THEN round(len(list_filter(seen, lambda x: x < value)) / (len(seen) - 1), 6) END AS percentile FROM
  (SELECT *, list(value) OVER (PARTITION BY symbol, feature ORDER BY as_of ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS seen FROM ({LONG_SQL}))"""


def state_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of orders by band of price: the first band with low <= price < high, else the last."""
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy(F.when(p < 50_000, "low").when(p < 150_000, "middle").when(p < 300_000, "high").otherwise("extreme").alias("band")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


BANDS = "SELECT CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 150000 THEN 'middle' WHEN o_totalprice < 300000 THEN 'high' ELSE 'extreme' END AS band, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1"


def hydrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as an ordered text; orders without lines get none."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))), lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_suppkey"].cast("string"))), ",").alias("lines"))
    o = table(spark, sf_dir, "orders")
    return o.join(lines, o.o_orderkey == lines.l_orderkey, "left").select("o_orderkey", F.coalesce("lines", F.lit("")).alias("lines"))


HYDRATE = "SELECT o_orderkey, coalesce(lines, '') AS lines FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_suppkey, ',' ORDER BY l_linenumber, l_suppkey) AS lines FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by priority since a date, where the status is not open."""
    o = table(spark, sf_dir, "orders")
    return o.where((F.col("o_orderstatus") != "O") & (F.col("o_orderdate") >= "1996-01-01")).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("notional"))


HISTOGRAM = "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS notional FROM orders WHERE o_orderstatus <> 'O' AND o_orderdate >= '1996-01-01' GROUP BY 1"


def nearest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the click of the same user nearest in time; the earlier of two equally near.

    Only the last click before and the first one after can be nearest: two window passes instead of a range join."""
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')").select("user_id", "ts", "event_id", "event_type")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    click = F.when(F.col("event_type") == "click", F.struct("ts", "event_id"))
    e = e.withColumn("p", F.last(click, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("n", F.first(click, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    gap = lambda c: F.abs(micros("ts") - micros(f"{c}.ts"))
    back = F.col("n").isNull() | (gap("p") <= gap("n"))
    near = F.when(F.col("p").isNotNull() & back, F.col("p")).otherwise(F.col("n"))
    return e.where("event_type = 'purchase'").select("event_id", near["event_id"].alias("click_id"))


NEAREST = """SELECT p.event_id, (SELECT c.event_id FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click'
  ORDER BY abs(epoch_us(c.ts) - epoch_us(p.ts)), c.ts, c.event_id LIMIT 1) AS click_id FROM events p WHERE p.event_type = 'purchase'"""


VALID_AT, RECORDED_BY = "1997-06-30", "1997-09-30"


def as_of_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger on two axes: each customer's order that was valid at an instant (by its date), of those that were recorded
    by another (an order is recorded with its last shipment; one without lines at once)."""
    shipped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderdate") <= VALID_AT)
    o = o.join(shipped, o.o_orderkey == shipped.l_orderkey, "left").where(F.coalesce("shipped", "o_orderdate") <= RECORDED_BY)
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("s"), F.count("*").alias("versions")).select("o_custkey", "s.*", "versions")


AS_OF = f"""SELECT o_custkey, o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_custkey) AS versions FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
  WHERE o_orderdate <= '{VALID_AT}' AND coalesce(shipped, o_orderdate) <= '{RECORDED_BY}' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def ledger_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots (orders) and deltas (their lines) as one history, numbered per order by validity, kind and id."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    both = o.select(F.col("o_orderkey").alias("entity"), F.col("o_orderdate").alias("valid_from"), F.lit("snapshot").alias("kind"), F.lit(0).alias("id")).unionByName(
        li.select(F.col("l_orderkey").alias("entity"), F.col("l_shipdate").alias("valid_from"), F.lit("delta").alias("kind"), F.col("l_linenumber").cast("int").alias("id"))
    )
    return both.withColumn("step", F.row_number().over(Window.partitionBy("entity").orderBy("valid_from", F.desc("kind"), "id")))


HISTORY = """SELECT *, (row_number() OVER (PARTITION BY entity ORDER BY valid_from, kind DESC, id))::INT AS step FROM (SELECT o_orderkey AS entity, o_orderdate AS valid_from, 'snapshot' AS kind, 0 AS id FROM orders
  UNION ALL SELECT l_orderkey, l_shipdate, 'delta', l_linenumber::INT FROM lineitem)"""


def trailing_quarter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order: the customer's order value over the 90 days up to it (a range frame in time)."""
    w = Window.partitionBy("o_custkey").orderBy(micros("o_orderdate")).rangeBetween(-90 * 86_400_000_000, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("trailing"))


TRAILING = "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 90 DAY PRECEDING AND CURRENT ROW), 2) AS trailing FROM orders"


def fixed_window_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed-window rate limit: requests per user and hour, and how many a limit of 2 lets through."""
    n = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("bucket")).agg(F.count("*").alias("n"))
    return n.withColumn("allowed", F.least("n", F.lit(2)).cast("bigint"))


FIXED = "SELECT user_id, date_trunc('hour', ts) AS bucket, count(*) AS n, least(count(*), 2) AS allowed FROM events GROUP BY 1, 2"


def sliding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per event: the user's events in the hour up to it."""
    w = Window.partitionBy("user_id").orderBy(micros("ts")).rangeBetween(-3_600_000_000, 0)
    return table(spark, sf_dir, "events").select("event_id", F.count("*").over(w).alias("n"))


SLIDING = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n FROM events"


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the seconds between a user's events, by type."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").withColumn("gap", (micros("ts") - F.lag(micros("ts")).over(w)) / 1e6)
    q = quantiles(e, "event_type", "gap", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("event_type", "n", *[F.round(p, 3).alias(p) for p in ("p50", "p95", "p99")])


LATENCY = """SELECT event_type, count(*) AS n, round(quantile_cont(gap, 0.5), 3) AS p50, round(quantile_cont(gap, 0.95), 3) AS p95, round(quantile_cont(gap, 0.99), 3) AS p99 FROM
  (SELECT event_type, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1e6 AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1"""


def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users who bought and signed up, or erred without a view."""
    e = table(spark, sf_dir, "events")
    of = lambda t: e.where(F.col("event_type") == t).select("user_id", F.dayofmonth("ts").alias("day"))
    return of("purchase").intersect(of("signup")).union(of("error").exceptAll(of("view"))).distinct()


SETS = """SELECT DISTINCT * FROM ((SELECT user_id, day(ts)::INT AS day FROM events WHERE event_type = 'purchase' INTERSECT SELECT user_id, day(ts)::INT FROM events WHERE event_type = 'signup')
  UNION ALL (SELECT user_id, day(ts)::INT FROM events WHERE event_type = 'error' EXCEPT ALL SELECT user_id, day(ts)::INT FROM events WHERE event_type = 'view'))"""

QUERIES = {
    "snapshot": (snapshot, SNAPSHOT), "latest_per_key": (latest_per_key, LATEST_PER_KEY), "screener": (screener, SCREENER), "negated_band": (negated_band, NEGATED), "nulls_last_topk": (nulls_last_topk, TOPK),
    "count_matches": (count_matches, COUNT), "sector_rank": (sector_rank, RANK), "normalised": (normalised, NORMALISED), "delta_z": (delta_z, DELTA), "own_percentile": (own_percentile, OWN_PERCENTILE),
    "state_bands": (state_bands, BANDS), "hydrate": (hydrate, HYDRATE), "histogram": (histogram, HISTOGRAM), "nearest_join": (nearest_join, NEAREST), "as_of_state": (as_of_state, AS_OF), "ledger_history": (ledger_history, HISTORY),
    "trailing_quarter": (trailing_quarter, TRAILING), "fixed_window_limit": (fixed_window_limit, FIXED), "sliding_count": (sliding_count, SLIDING), "latency": (latency, LATENCY), "set_operations": (set_operations, SETS),
}
