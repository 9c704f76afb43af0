"""A clock of three speeds: a row of the fast speed is let through once both slower ones have committed their state up to the tick before.

A fast row n sees the state of each slower speed that was committed last at a tick up to n - 1, and waits while either speed's
greatest commit is below n - 1; a row 0 waits for nothing and sees none. Each speed commits a key's ticks in rising order; a fast row
that comes again, or a commit behind one that is already there, is dropped. Either speed's veto holds."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: The slower speeds.
SLOWER = ("slow", "middle")
_SEEN = [f"{s}_{c}" for s in SLOWER for c in ("seq", "label")]


def clocked(rows: DataFrame) -> DataFrame:
    """Batch form. Of rows (key, speed slow, middle or fast, seq, label, no_long, no_short): each fast row that both speeds let
    through, with the state it sees. One sort per key; the last state is carried along it, no frame is collected."""
    x = rows.where("key IS NOT NULL AND seq IS NOT NULL AND speed IN ('slow', 'middle', 'fast')")
    x = x.groupBy("key", "speed", "seq").agg(F.min(F.struct("label", "no_long", "no_short")).alias("s"))
    reached = x.groupBy("key").agg(*[F.max(F.when(F.col("speed") == s, F.col("seq"))).alias(f"{s}_reached") for s in SLOWER])
    # Fast rows stand before the commits of their own tick.
    order = Window.partitionBy("key").orderBy("seq", F.when(F.col("speed") == "fast", 0).otherwise(1)).rowsBetween(Window.unboundedPreceding, 0)
    state = lambda s: F.last(F.when(F.col("speed") == s, F.struct("seq", "s.*")), ignorenulls=True).over(order).alias(s)
    seen = x.select("key", "speed", "seq", *[state(s) for s in SLOWER]).where("speed = 'fast'").join(reached, "key")
    open_ = F.expr("seq <= 0 OR (slow_reached >= seq - 1 AND middle_reached >= seq - 1)")
    veto = lambda c: F.coalesce(F.col(f"slow.{c}"), F.lit(False)) | F.coalesce(F.col(f"middle.{c}"), F.lit(False))
    return seen.where(open_).select("key", "seq", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in SLOWER for c in ("seq", "label")], veto("no_long").alias("no_long"), veto("no_short").alias("no_short"))


class Clock:
    """The state of one key: the commits that a waiting or a coming row can see, and the rows that wait."""

    def __init__(self, state: dict | None = None):
        state = state or {}
        self.states: dict[str, list] = {s: state.get(s, []) for s in SLOWER}
        self.waiting: list[int] = state.get("waiting", [])
        self.done: int | None = state.get("done")

    def take(self, rows: list[tuple]) -> list[tuple]:
        """Rows (speed, seq, label, no_long, no_short) of one batch; what they let through, in order of seq."""
        for speed, seq, *own in sorted(rows, key=lambda r: (r[1], r[0])):
            if speed in SLOWER:
                commits = self.states[speed]
                if not commits or seq > commits[-1][0]:
                    commits.append([seq, *own])
            elif (self.done is None or seq > self.done) and seq not in self.waiting:
                self.waiting.append(seq)
        self.waiting.sort()
        out = []
        reached = [self.states[s][-1][0] if self.states[s] else None for s in SLOWER]
        while self.waiting and (self.waiting[0] <= 0 or all(r is not None and r >= self.waiting[0] - 1 for r in reached)):
            n = self.done = self.waiting.pop(0)
            seen = []
            for s in SLOWER:
                at = bisect_right(self.states[s], n - 1, key=lambda c: c[0])
                seen.append(self.states[s][at - 1] if at else [None, None, False, False])
                del self.states[s][: max(at - 1, 0)]
            out.append((n, *[x for s in seen for x in s[:2]], any(bool(s[2]) for s in seen), any(bool(s[3]) for s in seen)))
        return out

    def kept(self) -> str:
        return json.dumps({**self.states, "waiting": self.waiting, "done": self.done})


def clocked_stream(stream: DataFrame) -> DataFrame:
    """The same as a stream: rows are let through in the batch in which the later of both commits comes. State per key: the waiting rows,
    and the commits from the one that the last row saw."""

    def take(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        clock = Clock(json.loads(state.get[0]) if state.exists else None)
        plain = lambda v: None if pd.isna(v) else v
        rows = [(s, int(n), plain(label), bool(plain(a)), bool(plain(b))) for x in batches for s, n, label, a, b in zip(x["speed"], x["seq"], x["label"], x["no_long"], x["no_short"], strict=True)]
        out = clock.take(rows)
        state.update((clock.kept(),))
        frame = pd.DataFrame([(keys[0], *r) for r in out], columns=["key", "seq", *_SEEN, "no_long", "no_short"])
        yield frame.astype({"slow_seq": "Int64", "middle_seq": "Int64"})

    kind = dict(stream.dtypes)["key"]
    known = stream.where("key IS NOT NULL AND seq IS NOT NULL AND speed IN ('slow', 'middle', 'fast')")
    schema = f"key {kind}, seq bigint, slow_seq bigint, slow_label string, middle_seq bigint, middle_label string, no_long boolean, no_short boolean"
    return known.groupBy("key").applyInPandasWithState(take, schema, "clock string", "append", GroupStateTimeout.NoTimeout)
