"""The market roles of the given tables: bars, price series, entities, long features, trades, equity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """Microseconds of a timestamp, with or without a zone."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def month_bucket(column: str) -> F.Column:
    """Year and month of a timestamp as one number (202411), in the session's zone."""
    return F.year(column) * 100 + F.month(column)


def write_monthly(rows: DataFrame, time: str, path: str, mode: str = "append") -> None:
    """Rows as Parquet in a folder per month; readers that filter on month_bucket skip the others. Large months are written by
    several tasks, small ones by one."""
    rows.withColumn("month_bucket", month_bucket(time)).hint("rebalance", "month_bucket").write.mode(mode).partitionBy("month_bucket").parquet(path)


def latest_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """An upsert: of the rows with equal keys, the one with the greatest order stays (combined before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")


def _like(table: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch with the table's columns and kinds; columns that it lacks are null, others are left out."""
    given = set(batch.columns)
    return batch.select(*[(F.col(c) if c in given else F.lit(None)).cast(kind).alias(c) for c, kind in table.dtypes])


def upserted(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after a batch of upserts: of the batch's rows with equal keys the one with the greatest order, and no older row of
    the table with these keys. Null is a key like others. The same batch again changes nothing. Rows of the table are shuffled
    once by their keys; where the batch is small, it is sent to them instead."""
    newest = latest_wins(_like(table, batch), keys, order)
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return table.alias("t").join(newest.select(*keys).alias("b"), same, "left_anti").unionByName(newest.select(*table.columns))


def inserted(table: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table after inserts that leave rows alone which are already there: of new keys, the batch's row with the least order."""
    own = _like(table, batch)
    rest = [c for c in own.columns if c not in keys]
    first = own.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*")
    same = [F.col(f"t.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return table.unionByName(first.alias("b").join(table.select(*keys).alias("t"), same, "left_anti").select(*table.columns))


def replaced(table: DataFrame, batch: DataFrame, owner: str) -> DataFrame:
    """The table after all rows of each owner in the batch are replaced by the batch's (a document's chunks, a signal's drivers)."""
    own = _like(table, batch)
    return table.alias("t").join(own.select(owner).distinct().alias("b"), F.col(f"t.{owner}").eqNullSafe(F.col(f"b.{owner}")), "left_anti").unionByName(own)


def ohlcv(ticks: DataFrame, key: str, time: str, tie: str, price: str, unit: str = "hour", size: F.Column | None = None) -> DataFrame:
    """Ticks to bars (key, t, open, high, low, close, volume)."""
    order = F.struct(time, tie)
    return ticks.groupBy(F.col(key).alias("key"), F.date_trunc(unit, F.col(time)).alias("t")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"),
        F.sum(size if size is not None else F.lit(1.0)).cast("double").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ohlcv(table(spark, sf_dir, "events"), "event_type", "ts", "event_id", "value")


BARS_SQL = """SELECT event_type AS key, date_trunc('hour', ts) AS t, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY ALL"""


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with their nation and region, as the screened universe."""
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    named = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    return named.select(F.col("s_suppkey").alias("symbol"), F.col("s_name").alias("name"), F.col("r_name").alias("sector"), F.col("n_name").alias("country"), F.col("s_acctbal").alias("balance"), (F.col("s_suppkey") % 10 == 0).alias("is_benchmark"))


ENTITIES_SQL = """SELECT s_suppkey AS symbol, s_name AS name, r_name AS sector, n_name AS country, s_acctbal AS balance, s_suppkey % 10 = 0 AS is_benchmark
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

FEATURES = ("lines", "quantity", "revenue", "discount")


def wide_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, as_of month, lines, quantity, revenue, discount)."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol"), F.date_trunc("month", "l_shipdate").alias("as_of")).agg(
        F.count("*").cast("double").alias("lines"), F.sum("l_quantity").alias("quantity"),
        F.sum(F.col("l_extendedprice").cast("decimal(12,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"),
    )


def long_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wide_features(spark, sf_dir).unpivot(["symbol", "as_of"], list(FEATURES), "feature", "value")


WIDE_SQL = """SELECT l_suppkey AS symbol, date_trunc('month', l_shipdate) AS as_of, count(*)::DOUBLE AS lines, sum(l_quantity) AS quantity,
  sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY ALL"""
LONG_SQL = f"SELECT * FROM (UNPIVOT ({WIDE_SQL}) ON lines, quantity, revenue, discount INTO NAME feature VALUE value)"


def equity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, equity): a curve that starts at 100 000 000 and moves by each day's signed order value."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders")
    daily = o.groupBy(F.date_trunc("day", "o_orderdate").alias("day")).agg(F.round(F.sum(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))), 2).alias("pnl"))
    # One row per calendar day: the window's size is bounded by the calendar, not by the input.
    return daily.withColumn("equity", F.round(1e8 + F.sum("pnl").over(Window.partitionBy(F.lit(0)).orderBy("day")), 2)).select("day", "pnl", "equity")


EQUITY_SQL = """SELECT day, pnl, round(1e8 + sum(pnl) OVER (ORDER BY day), 2) AS equity FROM (SELECT date_trunc('day', o_orderdate) AS day,
  round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END), 2) AS pnl FROM orders GROUP BY ALL)"""
