"""Exact quantiles of groups of any size: ranges of the value first, and only the ranges that hold a wanted rank are sorted."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that a group's values are divided into; a task sorts about so large a share of a group.
PARTS = 64


def quantiles(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, a column for each of shares): quantiles with linear interpolation. Null values don't count.

    The ranges come from a mergeable sketch; counts per range tell in which of them a rank lies, so the sketch's error has
    no part in the result. Very many equal values are one range, and one task's counts: they are counted before they are sorted."""
    x = rows.where(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.col(value).alias("v")).agg(F.count("*").alias("c"))
    bounds = x.groupBy("g").agg(F.percentile_approx("v", [i / PARTS for i in range(1, PARTS)], 1000).alias("bounds"))
    x = x.join(F.broadcast(bounds), "g").withColumn("part", F.size(F.filter("bounds", lambda b: b < F.col("v")))).drop("bounds")
    parts = x.groupBy("g", "part").agg(F.sum("c").alias("m"))
    w = Window.partitionBy("g").orderBy("part")
    parts = parts.withColumn("base", F.sum("m").over(w) - F.col("m")).withColumn("n", F.sum("m").over(Window.partitionBy("g")))
    # Ranks from 0; the two around each share.
    asked = parts.withColumn("r", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.lit(q) * (F.col("n") - 1)).alias("at")) for k, q in shares.items()])))
    asked = asked.where((F.floor("r.at") < F.col("base") + F.col("m")) & (F.ceil("r.at") >= F.col("base")))
    wanted = asked.groupBy("g", "part").agg(F.first("base").alias("base"), F.first("n").alias("n"), F.collect_list("r").alias("rs"))
    upto = F.sum("c").over(Window.partitionBy("g", "part").orderBy("v"))
    sorted_ = x.join(F.broadcast(wanted), ["g", "part"]).withColumn("last", F.col("base") + upto - 1).withColumn("first", F.col("last") - F.col("c") + 1)
    hit = sorted_.select("g", "n", "v", "first", "last", F.explode("rs").alias("r"))
    weight = F.when(F.floor("r.at").between(F.col("first"), F.col("last")), F.floor("r.at") + 1 - F.col("r.at")).otherwise(0.0) + F.when(F.ceil("r.at").between(F.col("first"), F.col("last")) & (F.ceil("r.at") > F.floor("r.at")), F.col("r.at") - F.floor("r.at")).otherwise(0.0)
    out = hit.groupBy("g").agg(F.first("n").alias("n"), *[F.sum(F.when(F.col("r.k") == k, weight * F.col("v"))).alias(k) for k in shares])
    return out.withColumnRenamed("g", group)
