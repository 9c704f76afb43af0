"""Back-tests whose trades share one capital.

A book is one capital. Whether a trade may open, and how large it is, depends on what the book holds at that bar, so a
book's bars are read in order of time: sorted by Spark, streamed through a task in Arrow batches, and only the book's
state (cash and at most `most_open` trades) goes from one batch to the next. Books are independent of each other and run
side by side. Before that, in parallel, bars that no trade can touch are dropped: those further than `hold` bars
behind a signal of their key.

At each time, first the open trades: the stop is checked before the target, then the age, then the end of the key's bars.
Then the equity is struck, and the signals of that time may open trades in order of their keys: at most one trade
of a key at a time, one entry of a key a day, `most_open` trades in all, no trade above half of the equity, no long
trade above the cash. The size is what loses `risk` of the equity at the stop."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


@dataclass(frozen=True)
class Rules:
    capital: float = 100_000.0
    risk: float = 0.01
    most_open: int = 3
    hold: int = 20
    slippage_bps: float = 5.0
    commission: float = 0.005
    least_conviction: float = 0.0


@dataclass
class Trade:
    key: str
    way: int
    at: int
    price: float
    quantity: int
    stop: float
    target: float
    conviction: float
    close: float
    age: int = 0
    best: float = 0.0
    worst: float = 0.0

    def exit(self, bar: tuple, hold: int) -> tuple[float, str] | None:
        """The price and the reason at which the trade closes on its key's next bar, if it does."""
        high, low, close, last = bar[3], bar[4], bar[5], bar[10]
        ahead, behind = (high, low) if self.way > 0 else (low, high)
        self.age, self.close = self.age + 1, close
        self.best = max(self.best, self.way * (ahead / self.price - 1))
        self.worst = min(self.worst, self.way * (behind / self.price - 1))
        if self.way * (behind - self.stop) <= 0:
            return self.stop, "stop"
        if self.way * (ahead - self.target) >= 0:
            return self.target, "target"
        if self.age >= hold:
            return close, "time"
        return (close, "end") if last else None


@dataclass
class Book:
    rules: Rules
    name: str
    cash: float = 0.0
    peak: float = 0.0
    day: int | None = None
    entered: set = field(default_factory=set)
    trades: dict[str, Trade] = field(default_factory=dict)

    def step(self, bars: list[tuple]) -> list[tuple]:
        """One time's bars, one for each key, in order of the keys: rows of the trades that close, and one of the equity."""
        rules, out, t = self.rules, [], bars[0][1]
        if t // DAY != self.day:
            self.day, self.entered = t // DAY, set()
        turned = 0.0
        for bar in bars:
            trade = self.trades.get(bar[2])
            done = trade and trade.exit(bar, rules.hold)
            if done:
                fill = done[0] * (1 - trade.way * rules.slippage_bps / 10_000)
                gross, fee = trade.way * (fill - trade.price) * trade.quantity, rules.commission * trade.quantity
                self.cash += trade.price * trade.quantity + gross - fee
                turned += fill * trade.quantity
                del self.trades[bar[2]]
                out.append(("trade", self.name, t, bar[2], trade.way, trade.at, trade.price, fill, trade.quantity, gross, fee, gross - fee, trade.age, done[1], trade.conviction, trade.best, trade.worst, None, None, None, None))
        equity = self.cash + sum(x.quantity * (x.price + x.way * (x.close - x.price)) for x in self.trades.values())
        exposed = len(self.trades)
        for bar in bars:
            _, _, key, _, _, close, way, stop, target, atr, last, conviction = bar
            if len(self.trades) >= rules.most_open:
                break
            if not way or last or key in self.trades or key in self.entered or conviction < rules.least_conviction:
                continue
            distance = max(abs(close - stop), max(close * 0.02 if atr is None else atr, close * 0.004) / 2)
            quantity = max(1, int(equity * rules.risk // max(distance, 1e-12)))
            worth = quantity * close
            if worth > equity / 2 or (way > 0 and worth > self.cash):
                continue
            price = close * (1 + way * rules.slippage_bps / 10_000)
            self.cash -= price * quantity
            turned += price * quantity
            self.entered.add(key)
            self.trades[key] = Trade(key, way, t, price, quantity, stop, target, conviction, close)
        self.peak = max(self.peak, equity)
        out.append(("equity", self.name, t, *[None] * 14, equity, equity / self.peak - 1 if self.peak > 0 else 0.0, exposed, turned))
        return out


ROWS = "kind string, book string, t bigint, key string, way int, entry_t bigint, entry_price double, exit_price double, quantity bigint, gross double, fee double, net double, bars_held int, reason string, conviction double, best double, worst double, equity double, drawdown double, exposed int, turnover double"
_KINDS = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
_SCHEMA = pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in ROWS.split(", "))])
BARS = ("book", "t", "key", "high", "low", "close", "way", "stop", "target", "atr", "last", "conviction")


def _run(rules: Rules):
    def run(batches):
        book, step, out = None, [], []
        for batch in batches:
            for bar in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if step and (bar[0] != step[0][0] or bar[1] != step[0][1]):
                    out += book.step(step)
                    step = []
                if book is None or bar[0] != book.name:
                    book = Book(rules, bar[0], rules.capital, rules.capital)
                if not step or step[-1][2] != bar[2]:
                    step.append(bar)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in out], _SCHEMA)
                out = []
        if step:
            out += book.step(step)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_SCHEMA.names, r, strict=True)) for r in out], _SCHEMA)

    return run


def run_books(bars: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Rows of kind trade (one for each closed trade) and of kind equity (one for each book and time that counts), of bars
    (book, t in microseconds, key, high, low, close, way 1 long, -1 short or 0 none, stop, target, atr, conviction).

    Signals without a stop, target or close, or with a price at or below 0, do not count; nor do bars with a null book, time, key or price.
    Of bars with equal book, time and key one counts, the least by its prices. A book without signals has no rows; other columns are not read."""
    whole = bars.where(" AND ".join(f"{c} IS NOT NULL" for c in ("book", "t", "key", "high", "low", "close")))
    columns = [F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "stop", "target", "atr")]
    x = whole.select(F.col("book").cast("string").alias("book"), F.col("t").cast("bigint").alias("t"), F.col("key").cast("string").alias("key"), *columns, F.coalesce(F.col("way").cast("int"), F.lit(0)).alias("way"), F.coalesce(F.col("conviction").cast("double"), F.lit(0.0)).alias("conviction"))
    x = x.withColumn("way", F.expr("CASE WHEN stop IS NULL OR target IS NULL OR close <= 0 THEN 0 ELSE way END"))
    order = Window.partitionBy("book", "key").orderBy("t")
    near = F.max(F.abs("way")).over(order.rowsBetween(-rules.hold, 0)) > 0
    x = x.withColumn("last", F.lead("t").over(order).isNull()).withColumn("near", near).where("near")
    dealt = x.repartition("book").sortWithinPartitions("book", "t", "key", "high", "low", "close")
    return dealt.select(*BARS).mapInArrow(_run(rules), ROWS)


def summary(rows: DataFrame) -> DataFrame:
    """Of the rows of run_books, per book: trades, win rate, profit factor (null without losses), net, turnover, the last
    equity, the deepest drawdown, and the share of its times with an open trade."""
    trade, net = F.col("kind") == "trade", F.col("net")
    won, lost = F.sum(F.when(trade & (net > 0), net)), -F.sum(F.when(trade & (net <= 0), net))
    return rows.groupBy("book").agg(
        F.count_if(trade).alias("trades"), F.round(F.count_if(trade & (net > 0)) / F.nullif(F.count_if(trade), F.lit(0)), 6).alias("win_rate"),
        F.round(F.when(lost > 0, F.coalesce(won, F.lit(0.0)) / lost), 6).alias("profit_factor"), F.round(F.coalesce(F.sum("net"), F.lit(0.0)), 4).alias("net"),
        F.round(F.sum("turnover"), 2).alias("turnover"), F.round(F.max_by("equity", F.when(~trade, F.col("t"))), 4).alias("equity"),
        F.round(F.min("drawdown"), 6).alias("drawdown"), F.round(F.count_if(F.col("exposed") > 0) / F.count_if(~trade), 6).alias("exposure"),
    )
