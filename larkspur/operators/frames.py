"""Distinct actors and sums in a sliding time frame, at every event, without a list of any frame.

An actor counts from an event until the frame has moved past it or the actor's next event, whichever comes first. So each event is +1 at its
time and -1 at that end, and the count at a time is the sum of all steps up to it. Steps are summed within blocks of one
frame's length; the totals of earlier blocks are added to that. No window holds more than a block of a key, or of one actor of a key, but for the
one over a key's block totals, which the calendar bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distinct_in_frame(events: DataFrame, key: str, actor: str, time: str, width: int, sums: dict[str, Column] | None = None) -> DataFrame:
    """(key, time, actors, events, *sums): for each key and each time in microseconds that has an event, how many different actors and how many events
    lie in (time - width, time], and the sums over them (decimals, so that what is taken away leaves no error).

    Events with a null key, actor or time do not count; nulls in a summed column are 0. Equal events count as events, and as one actor."""
    names = list(sums or {})
    e = events.select(F.col(key).alias("key"), F.col(actor).alias("actor"), F.col(time).alias("t"), *[F.coalesce(c.cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")).alias(n) for n, c in (sums or {}).items()])
    block = F.floor(F.col("t") / width).alias("block")
    d = e.where("key IS NOT NULL AND actor IS NOT NULL AND t IS NOT NULL").groupBy("key", "actor", "t", block).agg(F.count("*").alias("events"), *[F.sum(n).alias(n) for n in names])
    later = d.groupBy("key", "actor", (F.col("block") - 1).alias("block")).agg(F.min("t").alias("later"))
    following = F.lead("t").over(Window.partitionBy("key", "actor", "block").orderBy("t"))
    d = d.withColumn("following", following).join(later, ["key", "actor", "block"], "left")
    end = F.col("t") + width
    zero = [F.lit(0).cast("decimal(28,4)").alias(n) for n in names]
    plain, minus = [F.col(n).cast("decimal(28,4)").alias(n) for n in names], [(-F.col(n)).cast("decimal(28,4)").alias(n) for n in names]
    step = lambda t, actors, events, own, asked: F.struct(t.alias("t"), F.lit(actors).alias("actors"), events.cast("bigint").alias("events"), *own, F.lit(asked).alias("asked"))
    steps = F.array(
        step(F.col("t"), 1, F.col("events"), plain, True),
        step(F.least(end, F.coalesce("following", "later", end)), -1, F.lit(0), zero, False),
        step(end, 0, -F.col("events"), minus, False),
    )
    counted = ["actors", "events", *names]
    g = d.select("key", F.explode(steps).alias("s")).select("key", "s.*").groupBy("key", "t", block).agg(*[F.sum(c).alias(c) for c in counted], F.max("asked").alias("asked"))
    within, over_blocks = Window.partitionBy("key", "block").orderBy("t"), Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = g.groupBy("key", "block").agg(*[F.sum(c).alias(c) for c in counted])
    before = totals.select("key", "block", *[F.sum(c).over(over_blocks).alias(f"{c}_before") for c in counted])
    running = g.select("key", "t", "block", "asked", *[F.sum(c).over(within).alias(c) for c in counted])
    return running.where("asked").join(before, ["key", "block"]).select("key", "t", *[(F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).alias(c) for c in counted])
