"""Calendar, texts, quantiles, streaks and recurrences on hand-made rows."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from larkspur.functions import calendar, text
from larkspur.functions.quantiles import quantiles
from larkspur.operators.recurrences import recurrence


def test_holidays_and_early_closes():
    day = dt.date.fromisoformat
    assert calendar.easter(2024) == day("2024-03-31") and calendar.easter(2019) == day("2019-04-21")
    assert {day("2024-03-29"), day("2024-06-19"), day("2024-11-28"), day("2024-09-02")} < calendar.holidays(2024)
    assert len(calendar.holidays(2024)) == 10 and day("2025-01-09") in calendar.holidays(2025)
    assert day("2021-12-24") in calendar.holidays(2021) and day("2022-12-26") in calendar.holidays(2022)
    assert not {day("2022-01-01"), day("2021-12-31")} & (calendar.holidays(2021) | calendar.holidays(2022))
    assert calendar.early_closes(2024) == {day("2024-07-03"), day("2024-11-29"), day("2024-12-24")}
    assert calendar.early_closes(2022) == {day("2022-11-25")} and calendar.early_closes(2023) == {day("2023-07-03"), day("2023-11-24")}


def test_sessions_over_changes_of_the_clock(spark):
    at = ["2024-03-08 14:30:00", "2024-03-11 13:30:00", "2024-03-11 13:29:00", "2024-07-03 17:00:00", "2024-07-04 15:00:00", "2024-07-06 15:00:00", "2019-11-29 17:59:00"]
    rows = calendar.session_columns(spark.createDataFrame([(i, x) for i, x in enumerate(at)], "i int, x string").withColumn("ts", F.col("x").cast("timestamp")), "ts").orderBy("i").collect()
    assert [r.is_open for r in rows] == [True, True, False, False, False, False, True]
    assert [r.phase for r in rows] == ["opening_auction", "opening_auction", "pre_market", "after_hours", "closed", "closed", "closing_auction"]
    assert [r.since_open for r in rows[:4]] == [0, 0, 0, 210]
    assert [str(r.last_close) for r in rows[3:6]] == ["2024-07-03 17:00:00", "2024-07-03 17:00:00", "2024-07-05 20:00:00"]
    assert str(rows[1].session_open) == "2024-03-11 13:30:00" and str(rows[0].session_open) == "2024-03-08 14:30:00"


def test_quantiles_equal_numpy(spark):
    rng = random.Random(1)
    rows = [("a", rng.gauss(0, 1)) for _ in range(1000)] + [("b", float(rng.randrange(3))) for _ in range(500)] + [("c", 7.0), ("c", None), ("d", None)]
    got = {r.g: r for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "g", "v", {"low": 0.05, "mid": 0.5, "top": 1.0, "none": 0.0}).collect()}
    for g in "abc":
        own = [v for k, v in rows if k == g and v is not None]
        assert got[g].n == len(own)
        assert np.allclose([got[g].low, got[g].mid, got[g].top, got[g].none], np.quantile(own, [0.05, 0.5, 1.0, 0.0]))
    assert "d" not in got


def test_streaks_over_months(spark, monkeypatch):
    from larkspur.plans import performance

    rng = random.Random(2)
    for trial in range(3):
        rows = [(s, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(0, 200) if trial else i), rng.choice([-1.0, 1.0, 1.0])) for s in "xy" for i in range(120)]
        monkeypatch.setattr(performance, "trades", lambda *_, rows=rows: spark.createDataFrame(rows, "strategy string, id int, traded timestamp, pnl double"))
        got = {r.strategy: (r.wins, r.losses) for r in performance.streaks(spark, "").collect()}
        for s in "xy":
            best, run, before = {True: 0, False: 0}, 0, None
            for _, _, _, pnl in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
                run = run + 1 if (pnl > 0) == before else 1
                before = pnl > 0
                best[before] = max(best[before], run)
            assert got[s] == (best[True], best[False])


def test_quantities_and_terms_of_claims(spark):
    def quantities(x):
        (r,) = spark.createDataFrame([(x,)], "x string").select(text.quantities(F.col("x")).alias("q")).collect()
        return [(q.value, q.kind) for q in r.q]

    assert quantities("Revenue rose 4.5% to $1,200 million; 12 people, 3 and 40.") == [(4.5, "percent"), (1.2e9, "currency"), (12.0, "count"), (40.0, "bare")]
    assert quantities("50 basis points, 25bps, $ 3bn, 2.5x, 7 tigers, 1.5") == [(0.5, "percent"), (0.25, "percent"), (3e9, "currency"), (2.5, "multiple"), (1.5, "bare")] and quantities(None) == []
    pairs = [((4.5, "percent"), (4.55, "percent"), True), ((4.5, "percent"), (4.5, "count"), False), ((100.0, "bare"), (101.0, "currency"), True), ((100.0, "bare"), (110.0, "bare"), False), ((0.0, "bare"), (0.0, "bare"), True)]
    kind = "struct<value:double,kind:string>"
    rows = spark.createDataFrame(pairs, f"a {kind}, b {kind}, ok boolean").select(text.agree(F.col("a"), F.col("b")).alias("got"), "ok").collect()
    assert all(r.got == r.ok for r in rows)
    (r,) = spark.createDataFrame([("In Q3  2024, on 2024-01-31, January 5, 2024, FY24 and next quarter; March 2023",)], "x string").select(text.calendar_terms(F.col("x")).alias("d")).collect()
    assert sorted(r.d) == ["2024-01-05", "2024-01-31", "fy24", "next quarter", "q32024"]


def test_claims_are_held_against_sources(spark):
    rows = [("Sales rose 4.5% in Q3 2024.", "In Q3 2024 sales rose 4.52 percent", True, True), ("Sales rose 4.5% in Q3 2024.", "Sales rose 9%", False, False), ("No figures here.", "1 2 3 400", False, False), (None, None, False, False)]
    got = spark.createDataFrame(rows, "c string, s string, n boolean, t boolean").select(text.claim_checks("c", "s").alias("r"), "n", "t").collect()
    assert all((r.r.numerical, r.r.temporal) == (r.n, r.t) for r in got)


def test_sentences_chunks_and_stems(spark):
    long = " ".join(f"Sentence number {'x' * 40} {w}." for w in "abcdefghijklmnop")
    rows = spark.createDataFrame([(0, long), (1, ""), (2, "Version 1.2 is out. It works!  Yes? no. [1] Was 5.1% so. [2] And 7. Next"), (3, None), (None, "A. B. C. d"), (None, "A. B.")], "i int, t string")
    split = {r.t: r.s for r in rows.select("t", text.sentences(F.col("t")).alias("s")).collect()}
    assert split[rows.collect()[2].t] == ["Version 1.2 is out.", "It works!", "Yes? no. [1]", "Was 5.1% so. [2]", "And 7. Next"] and split["A. B. C. d"] == ["A.", "B.", "C. d"]
    got = text.chunks(rows, "i", "t").collect()
    assert {r.i for r in got} == {0, 2, None} and sorted(r.chunk for r in got if r.i is None) == ["A. B.", "A. B. C. d"]
    parts = [r.chunk.split(". ") for r in sorted((r for r in got if r.i == 0), key=lambda r: r.ordinal)]
    assert len(parts) > 1 and all(a[-1].rstrip(".") == b[0].rstrip(".") for a, b in zip(parts[:-1], parts[1:], strict=True))
    words = {"studies": "studi", "classes": "class", "trading": "trade", "king": "king", "traded": "trade", "stocks": "stock", "gross": "gross", "caresses": "caress", "agreed": "agree", "feed": "feed", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflate", "hopping": "hop", "falling": "fall", "filing": "file", "tanned": "tan", "sized": "size", "crying": "cry"}
    assert {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()} == words


def test_trend_recurrences_on_hand_series(spark):
    """A flat series has no movement; a trend begins upwards; ranges count from the first bar."""
    t = pd.date_range("2024-01-01", periods=40, freq="h")
    flat = pd.DataFrame({"key": "flat", "t": t, "open": 5.0, "high": 5.0, "low": 5.0, "close": 5.0, "volume": 1.0})
    up = flat.assign(key="up", high=np.arange(40.0) + 2, low=np.arange(40.0), close=np.arange(40.0) + 1)
    bars = spark.createDataFrame(pd.concat([flat, up]))
    adx = recurrence(bars, "adx").toPandas().sort_values("t")
    assert adx[adx.key == "flat"].adx.isna().all()
    own = adx[adx.key == "up"]
    assert own.plus_di.isna().sum() == 13 and own.adx.isna().sum() == 26 and (own.adx.dropna() == 100).all() and (own.minus_di.dropna() == 0).all()
    trend = recurrence(bars, "supertrend").toPandas()
    assert (trend.direction.dropna() == 1).all() and trend[trend.key == "up"].direction.notna().sum() == 31
