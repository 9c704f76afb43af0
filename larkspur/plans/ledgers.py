"""Queries of the ledger: customers' states written as snapshots and deltas, and read as of both axes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.plans.relational import RECORDED_BY, VALID_AT
from larkspur.sources import ledger
from larkspur.sources.roles import table

#: Totals above this make a state's flag; at and below it the state has none.
LARGE = 250_000


def shared_folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a temporary one only where they are one process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-ledger-')}/ledger-{uuid.uuid4().hex}"


def customer_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state per order: status, priority in two parts, and a flag for large totals; recorded with the order's last shipment."""
    shipped = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    part = F.split("o_orderpriority", "-")
    state = F.struct(F.col("o_orderstatus").alias("status"), F.struct(part[0].alias("class"), part[1].alias("name")).alias("priority"), F.when(F.col("o_totalprice") > LARGE, F.array(F.lit("large"))).alias("flags"))
    return o.select(F.col("o_custkey").cast("string").alias("entity"), F.lit("orders").alias("facet"), F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.coalesce("shipped", "o_orderdate").cast("timestamp").alias("recorded_at"), F.col("o_orderkey").alias("seq"), F.to_json(state).alias("state"))


def ledger_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' states, written as a ledger (a snapshot each first day of a quarter, deltas elsewhere; the second batch twice, which
    changes nothing) and read at an instant as far as recorded by another: the leaves of each state."""
    path, states = shared_folder(spark), customer_states(spark, sf_dir)
    rows = ledger.ledger_rows(states, F.col("valid_from") == F.date_trunc("quarter", "valid_from"))
    for batch in ("snapshot", "delta", "delta"):
        ledger.append(rows.where(F.col("kind") == batch), path, batch)
    return ledger.as_of(ledger.read(spark, path), VALID_AT, RECORDED_BY).select("entity", "path", "value")


AS_OF = f"""WITH o AS (SELECT o_custkey::VARCHAR AS entity, o_orderdate AS v, coalesce(shipped, o_orderdate) AS r, o_orderkey AS seq, o_orderstatus, string_split(trim(o_orderpriority), '-') AS p, o_totalprice > {LARGE} AS large
  FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey),
l AS (SELECT entity, v, r, seq, path, value FROM o, LATERAL (SELECT unnest(['/status', '/priority/class', '/priority/name', '/flags/#0']) AS path, unnest(['"' || o_orderstatus || '"', '"' || p[1] || '"', '"' || p[2] || '"', CASE WHEN large THEN '"large"' END]) AS value)),
w AS (SELECT *, lag(value) OVER x AS was, row_number() OVER x AS i, (row_number() OVER x = 1 OR v = date_trunc('quarter', v)) AS whole FROM l WINDOW x AS (PARTITION BY entity, path ORDER BY v, r, seq)),
s AS (SELECT * FROM w WHERE v <= '{VALID_AT}' AND r <= '{RECORDED_BY}'),
b AS (SELECT entity, max((v, NOT whole, r, seq)) AS since FROM s WHERE whole GROUP BY entity),
c AS (SELECT s.entity, path, value, row_number() OVER (PARTITION BY s.entity, path ORDER BY v DESC, NOT whole DESC, r DESC, seq DESC) AS nth FROM s LEFT JOIN b ON b.entity = s.entity
  WHERE (since IS NULL OR (v, NOT whole, r, seq) >= since) AND (whole OR value IS DISTINCT FROM was))
SELECT entity, path, value FROM c WHERE nth = 1 AND value IS NOT NULL"""

QUERIES = {"ledger_as_of": (ledger_as_of, AS_OF)}
