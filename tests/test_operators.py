from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from larkspur.operators.indicators import indicator
from larkspur.operators.recurrences import ema, recurrence, wilder
from larkspur.plans.series import _indicator_sql
from larkspur.sources.roles import BARS_SQL, latest_wins
from larkspur.streaming.limits import sequence_barrier, tumbling_counts


def test_smoothing_is_seeded_with_the_mean():
    x = np.array([1.0, 2, 3, 4, 5])
    assert np.allclose(ema(x, 3)[2:], [2, 3, 4])
    assert np.allclose(wilder(x, 3)[2:], [2, 2 + 2 / 3, 2 + 2 / 3 + (5 - 2 - 2 / 3) / 3])
    assert np.isnan(ema(x, 9)).all()


def test_rsi_guards(spark):
    t = pd.date_range("2024-01-01", periods=40, freq="h")
    flat = pd.DataFrame({"key": "flat", "t": t, "open": 1.0, "high": 1.0, "low": 1.0, "close": 1.0, "volume": 1.0})
    up = flat.assign(key="up", close=np.arange(40.0))
    out = recurrence(spark.createDataFrame(pd.concat([flat, up])), "rsi").toPandas()
    assert set(out[out.key == "flat"].rsi.dropna()) == {50.0}
    assert set(out[out.key == "up"].rsi.dropna()) == {100.0}


def test_latest_wins(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "k int, v string, seq int")
    assert sorted(tuple(r) for r in latest_wins(df, ["k"], "seq").select("k", "v").collect()) == [(1, "b"), (2, "c")]


def test_streaming_counts_equal_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type", "cast(ts as timestamp) ts", "value")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = tumbling_counts(stream, "event_type", "ts").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.sql("SELECT event_type, bucket, n FROM counts").collect()}
    want = {tuple(r) for r in src.selectExpr("event_type", "date_trunc('hour', ts) b").groupBy("event_type", "b").count().collect()}
    assert got == want


def test_sequence_barrier_orders_and_drops(spark, tmp_path):
    data = [("a", 2, "z"), ("a", 0, "x"), ("a", 1, "y"), ("a", 1, "again"), ("b", 1, "late")]
    spark.createDataFrame(data, "k string, s bigint, p string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, s bigint, p string").parquet(str(tmp_path / "in"))
    q = sequence_barrier(stream, "k", "s", "p").writeStream.outputMode("append").format("memory").queryName("barrier").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("SELECT * FROM barrier ORDER BY k, s").collect()] == [("a", 0, "x"), ("a", 1, "y"), ("a", 2, "z")]


def test_rogers_satchell_of_prices_of_zero(spark):
    """Against its SQL in DuckDB: terms of zero prices are infinite, or not a number where both prices of a quotient are zero; null stays null."""
    rng = np.random.default_rng(3)
    price = lambda: 0.0 if rng.random() < 0.04 else float(10 + rng.random())
    rows = [("a", i, price(), price(), price(), None if i == 90 else price(), 1.0) for i in range(200)] + [("b", i, 1.0, 2.0, 1.0, 1.5, 1.0) for i in range(25)] + [("c", i, 0.0, 0.0, 0.0, 0.0, 1.0) for i in range(20)]
    columns = "key, t, open, high, low, close, volume"
    got = indicator(spark.createDataFrame(rows, "key string, t int, open double, high double, low double, close double, volume double"), "rogers_satchell").collect()
    made = ", ".join(f"({', '.join('NULL' if v is None else repr(v) + ('::DOUBLE' if isinstance(v, float) else '') for v in r)})" for r in rows)
    want = duckdb.execute(_indicator_sql("rogers_satchell").replace(BARS_SQL, f"SELECT * FROM (VALUES {made}) v({columns})")).fetchall()
    same = lambda found: {(k, t): None if v is None else repr(v + 0.0) for k, t, v in found}
    assert same(got) == same(want) and {"inf", "nan"} <= set(same(got).values())
