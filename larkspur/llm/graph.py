"""Connected components of an edge table, as a chain of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b): any two bigint columns; returns (id, component) for every id in edges.

    component is the smallest id reachable. Alternates the large-star and the small-star step: every
    vertex hands its larger (then its smaller) neighbours to its smallest one, until nothing changes.
    Each step is a minimum per vertex (combined before the shuffle) and a join back, so a vertex with
    very many neighbours is split by the skew-join rule. The edges of each round are written out.
    Self loops, repeated edges and an empty table are fine."""
    now = written(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    ids = now.select(F.col("u").alias("id")).union(now.select("v")).distinct()
    now, before = now.where("u <> v"), None
    while True:
        # Large star: edges in both directions; neighbours above u go to the least of u's neighbourhood.
        both = now.select("u", "v").union(now.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u's neighbours below it, and u itself, go to the least of them.
        down = large.where("u <> v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        star = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        now = written(star.where("u <> v").distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return ids.join(now.select(F.col("u").alias("id"), F.col("v").alias("component")).groupBy("id").agg(F.min("component").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
