"""Queries of tables after batches of writes: upserts, inserts that leave rows alone, and replacement of an owner's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.sources.roles import inserted, micros, replaced, table, upserted

#: Orders before this day are the table, later ones the batch.
BATCH_FROM = "1996-01-01"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The newest order of each customer and priority before the day, and the orders from it on."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("at"))
    o = o.withColumn("place", F.struct("at", "o_orderkey"))
    return o.where(F.col("at") < BATCH_FROM), o.where(F.col("at") >= BATCH_FROM)


def upserted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer and priority: those before a day, with those from it on upserted."""
    before, after = _orders(spark, sf_dir)
    keys = ["o_custkey", "o_orderpriority"]
    known = upserted(before.limit(0), before, keys, "place")
    return upserted(known, after, keys, "place").select(*keys, "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


UPSERTED = "SELECT o_custkey, o_orderpriority, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def inserted_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, kind and day, where a second batch (values from 50 on) may only add what the first one has not."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", F.to_date("ts").alias("day"), "event_id", "value", micros("ts").alias("us"))
    e = e.withColumn("place", F.struct("us", "event_id"))
    keys = ["user_id", "event_type", "day"]
    known = inserted(e.limit(0), e.where("value < 50"), keys, "place")
    return inserted(known, e.where("value >= 50"), keys, "place").select(*keys, "event_id", "value")


INSERTED = "SELECT user_id, event_type, ts::DATE AS day, event_id, value FROM events WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type, ts::DATE ORDER BY value >= 50, ts, event_id) = 1"


def replaced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order its lines, where orders with a returned line are written again with those lines alone."""
    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")
    return replaced(x, x.where("l_returnflag = 'R'"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


REPLACED = """SELECT l_orderkey, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem
WHERE l_returnflag = 'R' OR l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY l_orderkey"""

QUERIES = {"upserted_orders": (upserted_orders, UPSERTED), "inserted_events": (inserted_events, INSERTED), "replaced_lines": (replaced_lines, REPLACED)}
