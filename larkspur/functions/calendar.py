"""The trading calendar of New York: days and hours from a rule, as one small table of days that instants are joined to."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ZONE = "America/New_York"
OPEN, CLOSE, EARLY_CLOSE = 9 * 60 + 30, 16 * 60, 13 * 60
#: Days of mourning, closed beside the rule (fixed values).
EXTRA_CLOSED = (dt.date(2025, 1, 9),)
#: The years that the table of days covers, from the first to the last.
YEARS = (2019, 2029)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday (Monday 0) of a month; the last for n = -1."""
    if n < 0:
        last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
        return last - dt.timedelta((last.weekday() - weekday) % 7)
    first = dt.date(year, month, 1)
    return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))


def easter(year: int) -> dt.date:
    """Western Easter, by the anonymous Gregorian computation."""
    century, golden = divmod(year, 100)[0], year % 19
    moon = (19 * golden + century - century // 4 - (century - (century + 8) // 25 + 1) // 3 + 15) % 30
    weekday = (32 + 2 * (century % 4) + 2 * ((year % 100) // 4) - moon - year % 4) % 7
    shift = moon + weekday - 7 * ((golden + 11 * moon + 22 * weekday) // 451) + 114
    return dt.date(year, shift // 31, shift % 31 + 1)


def holidays(year: int) -> set[dt.date]:
    fixed = [dt.date(year, 7, 4), dt.date(year, 12, 25)] + ([dt.date(year, 6, 19)] if year >= 2022 else [])
    out = {d - dt.timedelta(1) if d.weekday() == 5 else d + dt.timedelta(1) if d.weekday() == 6 else d for d in fixed}
    new_year = dt.date(year, 1, 1)
    out |= {new_year + dt.timedelta(1)} if new_year.weekday() == 6 else {new_year} if new_year.weekday() < 5 else set()
    out |= {_nth(year, 1, 0, 3), _nth(year, 2, 0, 3), easter(year) - dt.timedelta(2), _nth(year, 5, 0, -1), _nth(year, 9, 0, 1), _nth(year, 11, 3, 4)}
    return out | {d for d in EXTRA_CLOSED if d.year == year}


def early_closes(year: int) -> set[dt.date]:
    """The days before Independence Day and Christmas, where both are on weekdays, and the day after Thanksgiving."""
    eves = [dt.date(year, 7, 3), dt.date(year, 12, 24)]
    return ({d for d in eves if d.weekday() < 4} | {_nth(year, 11, 3, 4) + dt.timedelta(1)}) - holidays(year)


def days(spark: SparkSession, years: tuple[int, int] = YEARS) -> DataFrame:
    """(day, trading, close_minute, nth: trading days up to and with the day, last_day and last_close_minute: the trading day
    before). One row per calendar day: bounded by the years."""
    rows, n, before = [], 0, (None, None)
    day = dt.date(years[0], 1, 1)
    closed = set().union(*(holidays(y) for y in range(years[0], years[1] + 1)))
    early = set().union(*(early_closes(y) for y in range(years[0], years[1] + 1)))
    while day.year <= years[1]:
        trading, close = day.weekday() < 5 and day not in closed, EARLY_CLOSE if day in early else CLOSE
        n += trading
        rows.append((day, trading, close, n, *before))
        before = (day, close) if trading else before
        day += dt.timedelta(1)
    return spark.createDataFrame(rows, "day date, trading boolean, close_minute int, nth int, last_day date, last_close_minute int")


def to_new_york(ts: F.Column) -> F.Column:
    """The wall clock of New York at an instant (the session's zone is UTC)."""
    return F.from_utc_timestamp(ts, ZONE)


def from_new_york(day: F.Column, minute: F.Column) -> F.Column:
    """The instant at which New York's clock shows a minute of a day."""
    return F.to_utc_timestamp(F.timestamp_micros(F.unix_micros(day.cast("timestamp")) + minute.cast("bigint") * 60_000_000), ZONE)


def session_columns(rows: DataFrame, ts: str) -> DataFrame:
    """rows with New York's day and minute, whether the day trades and the market is open, minutes since it opened, the phase,
    and the instants of the session's opening and close and of the last completed close. Instants outside YEARS get nulls."""
    clock = to_new_york(F.col(ts).cast("timestamp"))
    x = rows.withColumns({"ny_day": clock.cast("date"), "ny_minute": F.hour(clock) * 60 + F.minute(clock)})
    x = x.join(F.broadcast(days(rows.sparkSession)), F.col("ny_day") == F.col("day"), "left").drop("day")
    m, close = F.col("ny_minute"), F.col("close_minute")
    phase = (
        F.when(~F.col("trading") | (m < 240) | (m >= 1200), "closed").when(m < OPEN, "pre_market").when(m < OPEN + 30, "opening_auction").when(m < 720, "morning")
        .when(m < close - 45, "midday").when(m < close, "closing_auction").otherwise("after_hours")
    )
    over = F.col("trading") & (m >= close)
    return x.withColumns({
        "is_open": F.col("trading") & (m >= OPEN) & (m < close), "since_open": F.greatest(F.lit(0), F.least(m, close) - OPEN), "phase": phase,
        "session_open": from_new_york(F.col("ny_day"), F.lit(OPEN)), "session_close": from_new_york(F.col("ny_day"), close),
        "last_close": F.when(over, from_new_york(F.col("ny_day"), close)).otherwise(from_new_york(F.col("last_day"), F.col("last_close_minute"))),
    }).drop("last_day", "last_close_minute")
