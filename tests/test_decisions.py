"""Implied volatilities against the quantile's own distribution, and tables partitioned by month."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from larkspur.plans import decisions
from larkspur.sources.roles import table, write_monthly

SF = "/root/testdata/sf0.001"


def test_strikes_have_the_delta(spark):
    for r in decisions.delta_strikes(spark, SF).join(table(spark, SF, "part"), "p_partkey").limit(50).collect():
        tau, sigma = r.p_size / 50, 0.1 + r.p_partkey % 40 / 100
        for strike, delta in ((r.call_strike, 0.25), (r.put_strike, 0.75)):
            d1 = NormalDist().inv_cdf(delta)
            assert abs(strike - r.p_retailprice * 2.718281828459045 ** ((0.03 + sigma**2 / 2) * tau - d1 * sigma * tau**0.5)) < 1e-3 * strike


def test_price_at_its_bounds_implies_nothing(spark):
    x = spark.createDataFrame([(100.0, 90.0, 0.5, p) for p in (0.0, 10.0, 100.0, 200.0, 14.0)], "s double, strike double, tau double, price double")
    x = x.selectExpr("*", "0.0D AS r", "1.0D AS df")
    got = [r.v for r in x.selectExpr("price", f"{decisions.implied_vol('price')} AS v").orderBy("price").collect()]
    assert got[0] is None and got[1] is None and got[3] is None and got[4] is None
    assert 0.2 < got[2] < 0.5


def test_months_are_pruned(spark, tmp_path):
    path = str(tmp_path / "lines")
    rows = table(spark, SF, "lineitem").select("l_orderkey", "l_shipdate")
    write_monthly(rows, "l_shipdate", path)
    back = spark.read.parquet(path)
    assert back.count() == rows.count()
    assert back.where(F.col("month_bucket") != F.year("l_shipdate") * 100 + F.month("l_shipdate")).count() == 0
    some = back.where(F.col("month_bucket") == back.agg(F.min("month_bucket")).first()[0])
    assert 0 < len(some.inputFiles()) <= len(back.inputFiles())
    assert "PartitionFilters: [isnotnull(month_bucket" in some._jdf.queryExecution().toString()


def test_elbow_is_farthest_from_the_chord(spark):
    curve = sorted(decisions.elbow_clusters(spark, SF).collect())
    x, y = [r.k for r in curve], [r.wcss for r in curve]
    assert x == list(range(decisions.ELBOW_FROM, decisions.ELBOW_TO + 1))
    slope = (y[-1] - y[0]) / (x[-1] - x[0])
    off = [abs(b - y[0] - slope * (a - x[0])) / (1 + slope * slope) ** 0.5 for a, b in zip(x, y)]
    assert [r.chosen for r in curve] == [i == off.index(max(off)) for i in range(len(off))]
    assert all(abs(r.distance - o) < 1e-3 for r, o in zip(curve, off))
