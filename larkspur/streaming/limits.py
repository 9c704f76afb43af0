"""Stateful operators: tumbling counts, exact duplicates within a watermark, a sequence barrier, and a sliding-log rate limit
(as a stream and in batch)."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_counts(stream: DataFrame, key: str, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts and sums of value per key and window, closed once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(key, F.col("window.start").alias("bucket"), "n", "total")


def without_repeats(stream: DataFrame, ids: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each id; state is dropped with the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(ids)


def sequence_barrier(stream: DataFrame, key: str, seq: str, payload: str) -> DataFrame:
    """Rows released per key in the order of seq without gaps from 0; a row that comes early waits for the missing ones,
    one that comes again is dropped. State per key: the next number and the waiting rows."""

    def release(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, waiting = state.get if state.exists else (0, "{}")
        held = {int(k): v for k, v in json.loads(waiting).items()}
        for batch in batches:
            for s, p in zip(batch[seq], batch[payload], strict=True):
                if s >= following:
                    held.setdefault(int(s), p)
        out = []
        while following in held:
            out.append((keys[0], following, held.pop(following)))
            following += 1
        state.update((following, json.dumps(held)))
        yield pd.DataFrame(out, columns=[key, seq, payload])

    kinds = dict(stream.dtypes)
    return stream.groupBy(key).applyInPandasWithState(release, f"{key} {kinds[key]}, {seq} bigint, {payload} string", "following bigint, waiting string", "append", GroupStateTimeout.NoTimeout)


def admit(times: list[int], limit: int, width: int, log: list[int]) -> list[bool]:
    """Whether each hit is let through: fewer than limit hits let through in (time - width, time]. log, the times let
    through before, is updated; refused hits don't count."""
    out = []
    for t in times:
        while log and log[0] <= t - width:
            log.pop(0)
        out.append(len(log) < limit)
        if out[-1]:
            log.append(t)
    return out


def sliding_limit_stream(stream: DataFrame, key: str, at: str, limit: int, width: int) -> DataFrame:
    """Hits (key, at in microseconds) with allowed. State per key: at most limit times. Hits of one micro-batch are taken in time order."""

    def decide(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = json.loads(state.get[0]) if state.exists else []
        times = sorted(int(t) for batch in batches for t in batch[at])
        allowed = admit(times, limit, width, log)
        state.update((json.dumps(log),))
        yield pd.DataFrame({key: [keys[0]] * len(times), at: times, "allowed": allowed})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(decide, f"{key} {kind}, {at} bigint, allowed boolean", "log string", "append", GroupStateTimeout.NoTimeout)


def sliding_limit(hits: DataFrame, key: str, at: str, tie: str, limit: int, width: int) -> DataFrame:
    """The same in batch: hits (key, at, tie) with allowed. Each key's hits come sorted in Arrow batches; only its log, at
    most limit times, is carried from one to the next, so no key is held in memory. Hits without a time come last."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, log = None, []
        for batch in batches:
            keys = batch.column(0).to_pylist()
            times = [math.nan if t is None else t for t in batch.column(1).to_pylist()]
            allowed = []
            for k, run in groupby(range(len(keys)), keys.__getitem__):
                if k != last:
                    last, log = k, []
                allowed += admit([times[i] for i in run], limit, width, log)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=[key, at, tie, "allowed"])

    kinds = dict(hits.dtypes)
    dealt = hits.select(key, at, tie).repartition(key).sortWithinPartitions(key, F.asc_nulls_last(at), tie)
    return dealt.mapInArrow(decide, f"{key} {kinds[key]}, {at} {kinds[at]}, {tie} {kinds[tie]}, allowed boolean")
