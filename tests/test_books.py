"""Books of trades with one capital against a plain loop, distinct actors against lists, the clock as a stream against its batch form, vectors by hand."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import frames, portfolio, vectors
from larkspur.streaming import clock

HOUR, DAY = 3_600_000_000, 86_400_000_000
BARS = "book string, t bigint, key string, high double, low double, close double, way int, stop double, target double, atr double, conviction double, open string"


def bar(book, t, key, high, low, close, way=0, stop=None, target=None, atr=1.0, conviction=1.0):
    return (book, t, key, float(high), float(low), float(close), way, stop, target, atr, conviction, "clash")


def run(spark, rows, rules):
    return portfolio.run_books(spark.createDataFrame(rows, BARS), rules)


def test_one_trade_by_hand(spark):
    rules = portfolio.Rules(capital=10_000.0, risk=0.01, most_open=2, hold=5, slippage_bps=10.0, commission=0.01)
    rows = [bar("a", 0, "x", 101, 99, 100, 1, 95.0, 110.0), bar("a", HOUR, "x", 104, 98, 102), bar("a", 2 * HOUR, "x", 111, 103, 108), bar("a", 3 * HOUR, "x", 109, 107, 108)]
    out = run(spark, rows, rules).collect()
    (trade,) = [r for r in out if r.kind == "trade"]
    # 1 % of 10 000 over a distance of 5: 20 pieces, bought at 100.1, sold at 109.89.
    assert (trade.quantity, trade.reason, trade.bars_held, trade.entry_t, trade.t) == (20, "target", 2, 0, 2 * HOUR)
    assert math.isclose(trade.entry_price, 100.1) and math.isclose(trade.exit_price, 109.89)
    assert math.isclose(trade.gross, 20 * (109.89 - 100.1)) and math.isclose(trade.fee, 0.2) and math.isclose(trade.net, trade.gross - 0.2)
    assert math.isclose(trade.best, 111 / 100.1 - 1) and math.isclose(trade.worst, 98 / 100.1 - 1)
    equity = [r.equity for r in sorted((r for r in out if r.kind == "equity"), key=lambda r: r.t)]
    assert equity[0] == 10_000 and math.isclose(equity[1], 10_000 + 20 * (102 - 100.1)) and math.isclose(equity[-1], 10_000 + trade.net)


def test_stop_before_target_age_end_and_shorts(spark):
    rules = portfolio.Rules(capital=10_000.0, most_open=9, hold=2, slippage_bps=0.0, commission=0.0)
    rows = [bar("a", 0, k, 101, 99, 100, w, s, g) for k, w, s, g in (("both", 1, 95.0, 105.0), ("old", 1, 90.0, 120.0), ("short", -1, 105.0, 95.0))]
    rows += [bar("a", HOUR, "both", 106, 94, 100), bar("a", HOUR, "old", 101, 99, 100), bar("a", HOUR, "short", 100, 94, 95)]
    rows += [bar("a", 2 * HOUR, "old", 101, 99, 101), bar("a", 2 * HOUR, "both", 101, 99, 100, 1, 90.0, 120.0), bar("a", DAY, "both", 101, 99, 100, 1, 90.0, 120.0), bar("a", DAY + HOUR, "both", 102, 99, 101)]
    got = {(r.key, r.t): (r.reason, r.net > 0) for r in run(spark, rows, rules).where("kind = 'trade'").collect()}
    # On the first day both may enter once; on the next day again, and its bars end there.
    assert got == {("both", HOUR): ("stop", False), ("old", 2 * HOUR): ("time", True), ("short", HOUR): ("target", True), ("both", DAY + HOUR): ("end", True)}


def looped(rows, rules):
    """Every bar of one book, by lists that are searched anew at each time."""
    times, cash, open_, taken, trades, curve = sorted({r[1] for r in rows}), rules.capital, [], set(), [], {}
    last = {k: max(r[1] for r in rows if r[2] == k) for k in {r[2] for r in rows}}
    for t in times:
        now = {r[2]: r for r in rows if r[1] == t}
        for x in list(open_):
            if x["key"] not in now:
                continue
            _, _, key, high, low, close, *_ = now[x["key"]]
            x["age"] += 1
            x["mark"] = close
            if x["way"] == 1:
                end = (x["stop"], "stop") if low <= x["stop"] else (x["target"], "target") if high >= x["target"] else None
            else:
                end = (x["stop"], "stop") if high >= x["stop"] else (x["target"], "target") if low <= x["target"] else None
            end = end or ((close, "time") if x["age"] >= rules.hold else (close, "end") if t == last[key] else None)
            if end:
                fill = end[0] - x["way"] * end[0] * rules.slippage_bps / 10_000
                net = x["way"] * (fill - x["price"]) * x["n"] - rules.commission * x["n"]
                cash += x["price"] * x["n"] + net
                open_.remove(x)
                trades.append((x["since"], t, key, x["n"], end[1], round(net, 6)))
        curve[t] = equity = cash + sum(x["price"] * x["n"] + x["way"] * (x["mark"] - x["price"]) * x["n"] for x in open_)
        for key in sorted(now):
            _, _, _, _, _, close, way, stop, target, atr, *_ = now[key]
            if way and t != last[key] and len(open_) < rules.most_open and key not in [x["key"] for x in open_] and (key, t // DAY) not in taken:
                n = max(1, math.floor(equity * rules.risk / max(abs(close - stop), 0.5 * max(atr, 0.004 * close))))
                if n * close <= equity * 0.5 and (way < 0 or n * close <= cash):
                    price = close + way * close * rules.slippage_bps / 10_000
                    cash -= price * n
                    taken.add((key, t // DAY))
                    open_.append({"key": key, "way": way, "price": price, "n": n, "stop": stop, "target": target, "age": 0, "mark": close, "since": t})
    return trades, curve


@pytest.mark.parametrize("seed", range(3))
def test_books_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    rules = portfolio.Rules(capital=20_000.0, risk=0.01, most_open=3, hold=6)
    rows = []
    for book in "ab":
        for key in "pqrstu":
            price = 100.0
            for i in range(150):
                price *= math.exp(rng.gauss(0, 0.02))
                if rng.random() < 0.1:
                    continue
                way = rng.choice([1, -1]) if rng.random() < 0.15 else 0
                rows.append(bar(book, i * 5 * HOUR, key, price * (1 + rng.random() * 0.02), price * (1 - rng.random() * 0.02), price, way, price * (1 - 0.03 * way), price * (1 + 0.05 * way), price * 0.02))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = run(spark, rng.sample(rows, len(rows)), rules).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for book in "ab":
        trades, curve = looped([r for r in rows if r[0] == book], rules)
        assert len(trades) > 10
        assert sorted(trades) == sorted((r.entry_t, r.t, r.key, r.quantity, r.reason, round(r.net, 6)) for r in out if r.kind == "trade" and r.book == book)
        own = {r.t: r.equity for r in out if r.kind == "equity" and r.book == book}
        assert own and all(math.isclose(v, curve[t], rel_tol=1e-9) for t, v in own.items())


def test_books_of_odd_rows(spark):
    rules = portfolio.Rules()
    assert run(spark, [], rules).count() == 0
    odd = [(None, 0, "x", 1.0, 1.0, 1.0, 1, 0.5, 2.0, None, None, ""), ("a", 0, None, 1.0, 1.0, 1.0, 1, 0.5, 2.0, None, None, ""), ("a", 0, "x", 1.0, 1.0, 1.0, 1, None, 2.0, None, None, ""), ("a", 0, "y", 1.0, 1.0, -1.0, 1, 0.5, 2.0, None, None, "")]
    assert run(spark, odd, rules).count() == 0
    twice = [bar("a", 0, "x", 101, 99, 100, 1, 95.0, 110.0)] * 3 + [bar("a", HOUR, "x", 111, 99, 100)] * 2
    s = portfolio.summary(run(spark, twice, rules)).first()
    assert (s.trades, s.win_rate, s.profit_factor) == (1, 1.0, None)


@pytest.mark.parametrize("width", [1, 10, 1000])
def test_distinct_actors_equal_lists(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice("ab"), rng.randrange(4), rng.randrange(-40, 300), rng.choice([None, 0.1, 0.2, 3.0])) for _ in range(400)]
    rows += [("a", 1, 7, 0.5)] * 5 + [(None, 1, 1, 1.0), ("a", None, 1, 1.0), ("a", 1, None, 1.0)]
    got = frames.distinct_in_frame(spark.createDataFrame(rows, "k string, who int, at bigint, v double"), "k", "who", "at", width, {"total": F.col("v")}).collect()
    known = [r for r in rows if None not in r[:3]]
    want = set()
    for k, t in {(r[0], r[2]) for r in known}:
        own = [r for r in known if r[0] == k and t - width < r[2] <= t]
        want.add((k, t, len({r[1] for r in own}), len(own), round(sum(r[3] or 0 for r in own), 4)))
    assert {(r.key, r.t, r.actors, r.events, float(r.total)) for r in got} == want and len(got) == len(want)


def test_distinct_actors_of_nothing(spark):
    assert frames.distinct_in_frame(spark.createDataFrame([], "k string, who int, at bigint"), "k", "who", "at", 5).count() == 0


CLOCK = "key string, speed string, seq bigint, label string, no_long boolean, no_short boolean"


def test_clock_as_stream_equals_batch(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for key in "ab":
        for n in range(40):
            rows.append((key, "fast", n, None, None, None))
            for speed, every in (("middle", 3), ("slow", 7)):
                if n % every == every - 1 and (key, n) != ("b", 34):
                    rows.append((key, speed, n, rng.choice(["up", "down", None]), rng.random() < 0.3, rng.choice([None, True, False])))
    rows += [("c", "fast", 3, None, None, None), (None, "fast", 1, None, None, None), ("c", "other", 1, "x", True, True)]
    rows.sort(key=lambda r: (r[2], r[1]))
    want = {tuple(r) for r in clock.clocked(spark.createDataFrame(rows, CLOCK)).collect()}
    # The first tick waits for nothing, later ones up to the tick after the lesser of both last commits.
    assert {r[1] for r in want if r[0] == "a"} == set(range(36)) and {r[1] for r in want if r[0] == "b"} == set(range(29)) and not [r for r in want if r[0] == "c"]
    parts, got = 3, []
    stream = clock.clocked_stream(spark.readStream.schema(CLOCK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")) if (tmp_path / "in").mkdir() is None else None)
    query = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "check")).foreachBatch(lambda df, _: got.append([tuple(r) for r in df.collect()])).start()
    try:
        for i in range(parts):
            own = rows[len(rows) * i // parts : len(rows) * (i + 1) // parts]
            # A batch comes in any order, and brings rows of the one before again.
            again = rows[: len(rows) * i // parts][-5:]
            spark.createDataFrame(rng.sample(own + again, len(own) + len(again)), CLOCK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            query.processAllAvailable()
    finally:
        query.stop()
    out = [r for batch in got for r in batch]
    assert set(out) == want and len(out) == len(want) and len([b for b in got if b]) == parts


def test_vectors_and_nearest(spark):
    assert not vectors.vector(None).any() and not vectors.vector(" .,;").any()
    assert math.isclose(np.linalg.norm(vectors.vector("Guidance cut")), 1) and np.allclose(vectors.vector("A b"), vectors.vector("a  B!"))
    near, far = vectors.vector("amortization") @ vectors.vector("amortisation"), vectors.vector("amortization") @ vectors.vector("weather")
    assert near > 0.4 > far
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["apple", "apples", "pear", "pears", "plum", "figs"]) for _ in range(rng.randrange(12))) for _ in range(60)]
    docs = spark.createDataFrame([(i, x, "clash") for i, x in enumerate([*texts, texts[3], None, "word " * 50_000])] + [(None, "plum", "")], "doc_id bigint, text string, vec string").repartition(5)
    asked = spark.createDataFrame([(i, x) for i, x in enumerate(["apple pear", "plums", "", None])], "item_id bigint, text string")
    stored = vectors.embedded(docs)
    assert stored.count() == 64
    got = vectors.nearest(stored, vectors.embedded(asked, "item_id"), 4, 0.1).collect()
    full = {r.doc_id: np.array(r.vec) for r in stored.where("doc_id is not null").collect()}
    want = set()
    for i, x in enumerate(["apple pear", "plums"]):
        scores = sorted((-round(float(v @ vectors.vector(x)), 6), d) for d, v in full.items())
        want |= {(i, d, -s, k + 1) for k, (s, d) in enumerate(scores[:4]) if -s > 0.1}
    assert {(r.item_id, r.doc_id, r.score, r["rank"]) for r in got} == want and len(want) > 4
    assert vectors.nearest(stored.limit(0), vectors.embedded(asked, "item_id"), 3).count() == 0 and vectors.nearest(stored, vectors.embedded(asked, "item_id").limit(0), 3).count() == 0
