"""The normal quantile, the regression from moments, barrier exits and the boosted trees against plain computations."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
from pyspark.sql import functions as F

from larkspur.plans import signals
from larkspur.sources.roles import bars
from larkspur.streaming.limits import admit, sliding_limit, sliding_limit_stream

SF = "/root/testdata/sf0.001"


def test_normal_quantile(spark):
    p = [1e-6, 0.001, 0.02425, 0.3, 0.5, 0.77, 0.98, 0.999999]
    got = spark.createDataFrame([(x,) for x in p], "p double").selectExpr("p", f"{signals.normal_quantile('p')} AS q").collect()
    for r in got:
        assert abs(r.q - NormalDist().inv_cdf(r.p)) < 1e-7


def test_unit_root_equals_least_squares(spark):
    x = np.array([r.close for r in bars(spark, SF).where("key = 'click'").orderBy("t").collect()])
    d = np.diff(x)
    a = np.column_stack([np.ones(len(d) - 1), x[1:-1], d[:-1]])
    beta, sse, *_ = np.linalg.lstsq(a, d[1:], rcond=None)
    t = beta[1] / np.sqrt(np.linalg.inv(a.T @ a)[1, 1] * sse[0] / (len(a) - 3))
    got = signals.unit_root(spark, SF).where("key = 'click'").first()
    assert got.n == len(a) and abs(got.statistic - t) < 1e-4


def test_exits_stay_in_the_frame(spark):
    got = signals.barrier_exits(spark, SF).collect()
    assert {"stop", "target"} <= {r.reason for r in got}
    assert all(1 <= r.bars_held <= signals.HOLD for r in got if r.bars_held is not None)
    assert all(r.bars_held == signals.HOLD for r in got if r.reason == "time")
    assert all(r.pnl < 0 for r in got if r.reason == "stop") and all(r.pnl > 0 for r in got if r.reason == "target")


def test_purged_rows_lie_between(spark):
    day = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    ends = {r.part: (r.lo, r.hi) for r in signals.purged_split(spark, SF).join(day, "o_orderkey").groupBy("part").agg(F.min("day").alias("lo"), F.max("day").alias("hi")).collect()}
    assert ends["train"][1] < ends["purged"][0] and ends["purged"][1] < ends["test"][0]
    assert (ends["test"][0] - ends["train"][1]).days > signals.HORIZON_DAYS


def test_boosted_trees_are_calibrated(spark):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    r = signals.boosted_trees(spark, SF).agg(F.count("*").alias("n"), F.avg("score").alias("p"), F.avg("returned").alias("y"), F.count_if("held_out").alias("held")).first()
    assert r.n == n and 0 < r.held < n and abs(r.p - r.y) < 0.05


def test_sliding_limit_equals_brute_force(spark, tmp_path):
    got = signals.sliding_log_limit(spark, SF).collect()
    by_user: dict = {}
    for r in sorted(got, key=lambda r: (r.user_id, r["at"], r.event_id)):
        passed = by_user.setdefault(r.user_id, [])
        allowed = sum(t > r["at"] - signals.WIDTH for t in passed) < signals.LIMIT
        assert r.allowed == allowed
        if allowed:
            passed.append(r["at"])
    assert len(got) == spark.read.parquet(f"{SF}/events.parquet").count() and {r.allowed for r in got} == {True, False}
    # The stream decides alike.
    rows = spark.createDataFrame([(r.user_id, r["at"]) for r in got], "user_id bigint, at bigint")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = sliding_limit_stream(stream, "user_id", "at", signals.LIMIT, signals.WIDTH).writeStream.outputMode("append").format("memory").queryName("limited").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    key = lambda r: (r.user_id, r["at"], r.allowed)
    assert sorted(map(key, spark.sql("SELECT * FROM limited").collect())) == sorted(map(key, got))


def test_sliding_limit_of_a_busy_key_is_not_held(spark):
    """Keys without a pause, cut over many Arrow batches; no group goes to one frame."""
    rows = [(k, t * 7 % 1000 + t // 50, t) for k, n in ((1, 900), (2, 3), (None, 40)) for t in range(n)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = sliding_limit(spark.createDataFrame(rows, "who bigint, at bigint, id bigint"), "who", "at", "id", 5, 60)
        got = {(r.who, r.id): r.allowed for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for who in (1, 2, None):
        own = sorted((r for r in rows if r[0] == who), key=lambda r: r[1:])
        want |= {(who, r[2]): ok for r, ok in zip(own, admit([r[1] for r in own], 5, 60, []), strict=True)}
    assert got == want and set(got.values()) == {True, False}
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
