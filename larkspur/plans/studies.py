"""Queries of the trading calendar, further indicators, reversion outlooks, retrieval texts and sizing, each with SQL of its own."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import calendar, text
from larkspur.operators import covariances
from larkspur.plans.performance import BM25_ALL, TRADES, trades
from larkspur.plans.signals import FUSION, rank_fusion, vectors
from larkspur.plans.valuation import normal_cdf
from larkspur.sources.roles import BARS_SQL, bars, table


def _run():
    return Window.partitionBy("key").orderBy("t")


def trading_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event on New York's trading calendar, and the number of sessions that opened in the seven days up to it."""
    x = calendar.session_columns(table(spark, sf_dir, "events").select("event_id", "ts"), "ts")
    week = calendar.days(spark).select(F.date_add("day", 7).alias("ny_day"), F.col("nth").alias("nth_then"), F.col("trading").alias("trading_then"))
    x = x.join(F.broadcast(week), "ny_day", "left")
    # From the opening of the first day on, whatever the instant's time of day.
    opened = F.col("nth") - F.col("nth_then") + F.col("trading_then").cast("int") - (F.col("trading") & (F.col("ny_minute") < calendar.OPEN)).cast("int")
    return x.select("event_id", "ny_day", "ny_minute", "trading", "is_open", "since_open", "phase", "session_open", "session_close", "last_close", opened.alias("sessions_7d"))


CALENDAR = """WITH RECURSIVE e AS (SELECT event_id, ts, CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, CAST(hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) AS INT) AS m FROM events),
d AS (SELECT CAST(x AS DATE) AS day, isodow(x) < 6 AND CAST(x AS DATE) NOT IN (DATE '2023-12-25', DATE '2024-01-01', DATE '2024-01-15', DATE '2024-02-19') AS trading FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-20', TIMESTAMP '2024-02-28', INTERVAL 1 DAY)) AS x)),
p AS (SELECT day, trading, last_value(CASE WHEN trading THEN day END IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d)
SELECT event_id, e.day AS ny_day, m AS ny_minute, trading, trading AND m >= 570 AND m < 960 AS is_open, greatest(0, least(m, 960) - 570)::INT AS since_open,
  CASE WHEN NOT trading OR m < 240 OR m >= 1200 THEN 'closed' WHEN m < 570 THEN 'pre_market' WHEN m < 600 THEN 'opening_auction' WHEN m < 720 THEN 'morning' WHEN m < 915 THEN 'midday' WHEN m < 960 THEN 'closing_auction' ELSE 'after_hours' END AS phase,
  e.day + INTERVAL 870 MINUTE AS session_open, e.day + INTERVAL 1260 MINUTE AS session_close, CASE WHEN trading AND m >= 960 THEN e.day ELSE before END + INTERVAL 1260 MINUTE AS last_close,
  (SELECT count(*) FROM d WHERE d.trading AND d.day BETWEEN e.day - 7 AND e.day AND d.day + INTERVAL 870 MINUTE <= e.ts)::INT AS sessions_7d
FROM e JOIN p ON p.day = e.day"""


def _frame(n: int):
    return _run().rowsBetween(1 - n, 0)


def _wma(column: str, n: int) -> F.Column:
    """The mean of the last n values weighted 1 to n; null until there are n."""
    total = sum(((F.lag(column, i).over(_run()) * (n - i)) for i in range(1, n)), F.col(column) * n)
    return total / (n * (n + 1) / 2)


def ind_hma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hull's moving average over 16 closes: weighted means of 8 and of 16, then of their difference over 4."""
    x = bars(spark, sf_dir).select("key", "t", "close").withColumn("raw", 2 * _wma("close", 8) - _wma("close", 16))
    return x.select("key", "t", F.round(_wma("raw", 4), 6).alias("hma"))


_W = lambda c, n: "list_sum(list_transform(list_zip(" + f"list({c}) OVER (PARTITION BY key ORDER BY t ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), range(1, {n + 1})), lambda z: z[1] * z[2])) / {n * (n + 1) // 2}.0"
HMA = f"""WITH w AS (SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) AS i, {_W("close", 8)} AS a, {_W("close", 16)} AS b FROM ({BARS_SQL})), r AS (SELECT key, t, i, CASE WHEN i >= 16 THEN 2 * a - b END AS raw FROM w)
SELECT key, t, CASE WHEN i >= 19 THEN round({_W("raw", 4)}, 6) END AS hma FROM r"""


def ind_squeeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the last 120 band widths that are at most the newest; null under ten of them."""
    mid, sd = F.avg("close").over(_frame(20)), F.stddev_pop("close").over(_frame(20))
    x = bars(spark, sf_dir).withColumn("width", F.when((F.row_number().over(_run()) >= 20) & (mid != 0), 4 * sd / mid))
    seen = F.collect_list("width").over(_frame(120))
    n = F.size(seen)
    return x.withColumn("seen", seen).select("key", "t", F.when(F.col("width").isNotNull() & (F.size("seen") >= 10), F.round(F.size(F.filter("seen", lambda v: v <= F.col("width"))) / F.size("seen"), 6)).alias("squeeze"))


SQUEEZE = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM ({BARS_SQL})),
w AS (SELECT key, t, i, CASE WHEN i >= 20 AND avg(close) OVER f <> 0 THEN 4 * stddev_pop(close) OVER f / avg(close) OVER f END AS width FROM b WINDOW f AS (PARTITION BY key ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
s AS (SELECT a.key, a.t, count(c.width) AS n, count(*) FILTER (c.width <= a.width) AS below FROM w a JOIN w c ON c.key = a.key AND c.i BETWEEN a.i - 119 AND a.i WHERE a.width IS NOT NULL GROUP BY ALL)
SELECT w.key, w.t, CASE WHEN n >= 10 THEN round(below / n, 6) END AS squeeze FROM w LEFT JOIN s USING (key, t)"""

AROON = 25


def ind_aroon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How new the highest and the lowest of the last 26 bars are (the newest of equals), in percent."""
    w = _frame(AROON + 1)
    since = lambda seen, best: F.array_position(F.reverse(seen), best) - 1
    x = bars(spark, sf_dir).select("key", "t", F.collect_list("high").over(w).alias("hs"), F.collect_list("low").over(w).alias("ls"))
    up, down = (100 * (AROON - since(F.col(c), f(F.col(c)))) / AROON for c, f in (("hs", F.array_max), ("ls", F.array_min)))
    full = F.size("hs") > AROON
    return x.select("key", "t", F.when(full, F.round(up, 6)).alias("up"), F.when(full, F.round(down, 6)).alias("down"), F.when(full, F.round(up - down, 6)).alias("oscillator"))


AROON_SQL = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM ({BARS_SQL})),
x AS (SELECT a.key, a.t, 4.0 * ({AROON} - (a.i - arg_max(c.i, (c.high, c.i)))) AS up, 4.0 * ({AROON} - (a.i - arg_min(c.i, (c.low, -c.i)))) AS down FROM b a JOIN b c ON c.key = a.key AND c.i BETWEEN a.i - {AROON} AND a.i WHERE a.i > {AROON} GROUP BY a.key, a.t, a.i)
SELECT b.key, b.t, round(up, 6)::DOUBLE AS up, round(down, 6)::DOUBLE AS down, round(up - down, 6)::DOUBLE AS oscillator FROM b LEFT JOIN x USING (key, t)"""


def ind_crosses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the mean of 5 closes crosses that of 20, upwards or downwards, and how many bars ago it last rose through it."""
    x = bars(spark, sf_dir).withColumn("i", F.row_number().over(_run()))
    x = x.withColumns({"a": F.when(F.col("i") >= 5, F.avg("close").over(_frame(5))), "b": F.when(F.col("i") >= 20, F.avg("close").over(_frame(20)))})
    x = x.withColumns({"a0": F.lag("a").over(_run()), "b0": F.lag("b").over(_run())})
    x = x.withColumn("above", F.coalesce((F.col("a0") <= F.col("b0")) & (F.col("a") > F.col("b")), F.lit(False))).withColumn("below", F.coalesce((F.col("a0") >= F.col("b0")) & (F.col("a") < F.col("b")), F.lit(False)))
    return x.select("key", "t", "above", "below", (F.col("i") - F.max(F.when(F.col("above"), F.col("i"))).over(_run())).cast("int").alias("bars_since_above"))


CROSSES = f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t) AS i FROM ({BARS_SQL})),
m AS (SELECT key, t, i, CASE WHEN i >= 5 THEN avg(close) OVER (PARTITION BY key ORDER BY t ROWS 4 PRECEDING) END AS a, CASE WHEN i >= 20 THEN avg(close) OVER (PARTITION BY key ORDER BY t ROWS 19 PRECEDING) END AS b FROM b),
c AS (SELECT n.key, n.t, n.i, coalesce(o.a <= o.b AND n.a > n.b, false) AS above, coalesce(o.a >= o.b AND n.a < n.b, false) AS below FROM m n LEFT JOIN m o ON o.key = n.key AND o.i = n.i - 1)
SELECT key, t, above, below, (i - (SELECT max(p.i) FROM c p WHERE p.key = c.key AND p.i <= c.i AND p.above))::INT AS bars_since_above FROM c"""

HORIZON = 24


def ou_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mean-reverting process fitted to each key's closes, seen from its last close: expectation and variance in 24 bars, the
    probability of standing nearer to the mean than now, bands of two equilibrium deviations, bars to half the gap, z score."""
    x = bars(spark, sf_dir).select("key", "t", F.col("close").alias("x"), F.lead("close").over(_run()).alias("y"))
    last = x.groupBy("key").agg(F.max_by("x", "t").alias("now"))
    f = x.where("y IS NOT NULL").groupBy("key").agg(F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"), (F.var_pop("y") - F.pow(F.covar_pop("x", "y"), 2) / F.var_pop("x")).alias("s2")).where("b > 1e-6 AND b < 1 - 1e-6")
    f = f.join(last, "key").selectExpr("key", "now", "b", "a / (1 - b) AS mu", "-ln(b) AS theta", "s2 / (1 - b * b) AS eq2")
    f = f.selectExpr("*", "now - mu AS gap", f"(now - mu) * exp(-theta * {HORIZON}) AS m", f"eq2 * (1 - exp(-2 * theta * {HORIZON})) AS v").selectExpr("*", "(abs(gap) - m) / sqrt(v) AS hi", "(-abs(gap) - m) / sqrt(v) AS lo")
    return f.selectExpr("key", "round(mu + m, 5) AS expected", "round(v, 3) AS variance", f"CASE WHEN abs(gap) < 1e-12 THEN 0.5 ELSE round({normal_cdf('hi')} - {normal_cdf('lo')}, 5) END AS probability", "round(mu + 2 * sqrt(eq2), 5) AS upper", "round(mu - 2 * sqrt(eq2), 5) AS lower", "round(ln(CAST(2 AS DOUBLE)) / theta, 5) AS bars_to_half", "round(gap / sqrt(eq2), 5) AS z")


OUTLOOK = f"""WITH x AS (SELECT key, t, close AS x, lead(close) OVER (PARTITION BY key ORDER BY t) AS y FROM ({BARS_SQL})), c AS (SELECT key, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM x WHERE y IS NOT NULL GROUP BY key),
f AS (SELECT key, any_value(b) AS b, any_value(a / (1 - b)) AS mu, -ln(any_value(b)) AS theta, avg((y - a - b * x) * (y - a - b * x)) / (1 - any_value(b * b)) AS eq2 FROM x JOIN c USING (key) WHERE y IS NOT NULL AND b > 1e-6 AND b < 1 - 1e-6 GROUP BY key),
g AS (SELECT *, arg_max.x AS now FROM f JOIN (SELECT key, max_by(x, t) AS x FROM x GROUP BY key) arg_max USING (key)), h AS (SELECT *, now - mu AS gap, (now - mu) * pow(b, {HORIZON}) AS m, eq2 * (1 - pow(b, 2 * {HORIZON})) AS v FROM g),
k AS (SELECT *, (abs(gap) - m) / sqrt(v) AS hi, (-abs(gap) - m) / sqrt(v) AS lo FROM h)
SELECT key, round(mu + m, 5) AS expected, round(v, 3) AS variance, CASE WHEN abs(gap) < 1e-12 THEN 0.5 ELSE round({normal_cdf('hi')} - {normal_cdf('lo')}, 5) END AS probability, round(mu + 2 * sqrt(eq2), 5) AS upper, round(mu - 2 * sqrt(eq2), 5) AS lower, round(ln(2.0::DOUBLE) / theta, 5) AS bars_to_half, round(gap / sqrt(eq2), 5) AS z FROM k"""

ECDF_ROWS = 64


def running_ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's value against the last 64 of its user, itself included: the share at or below it, kept inside (0, 1)."""
    seen = F.collect_list("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(1 - ECDF_ROWS, 0))
    x = table(spark, sf_dir, "events").withColumn("seen", seen)
    n = F.size("seen")
    return x.select("event_id", F.when(n == 0, 0.5).otherwise(F.round(F.greatest(1 / (n + 1), F.size(F.filter("seen", lambda v: v <= F.col("value"))) / (n + 1)), 6)).alias("share"))


ECDF = f"""WITH e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT a.event_id, round(greatest(1, count(*) FILTER (b.value <= a.value)) / (count(*) + 1), 6) AS share FROM e a JOIN e b ON b.user_id = a.user_id AND b.i BETWEEN a.i - {ECDF_ROWS - 1} AND a.i GROUP BY a.event_id"""


def hurst_sizes(n: int) -> list[tuple[int, float]]:
    """Sizes of segments from 8 to half the length, each with the logarithm of the rescaled range that noise has."""
    out, size = [], 8
    while size <= n // 2:
        front = math.exp(math.lgamma((size - 1) / 2) - math.lgamma(size / 2)) / math.sqrt(math.pi)
        out.append((size, math.log((size - 0.5) / size * front * sum(math.sqrt((size - i) / i) for i in range(1, size)))))
        size = int(size * 1.6)
    return out


#: Longer series are judged by segments of up to half this length.
HURST_ROWS = 100_000
_SIZES = hurst_sizes(HURST_ROWS)


def hurst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hurst's exponent of each key's closes by rescaled ranges, against what noise shows; 0.5 for fewer than 32."""
    x = bars(spark, sf_dir).select("key", "close", (F.row_number().over(_run()) - 1).alias("i"), F.count("*").over(Window.partitionBy("key")).alias("n"))
    size = F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.lit(e).alias("noise")) for s, e in _SIZES])).alias("s")
    x = x.select("*", size).where("s.size <= n / 2").withColumn("part", F.floor(F.col("i") / F.col("s.size"))).where("(part + 1) * s.size <= n")
    seg = Window.partitionBy("key", "s.size", "part")
    away = F.col("close") - F.avg("close").over(seg)
    x = x.withColumn("away", away).withColumn("path", F.sum("away").over(seg.orderBy("i")))
    r = x.groupBy("key", "n", "s.size", "s.noise", "part").agg((F.max("path") - F.min("path")).alias("range"), F.stddev_samp("close").alias("sd")).where("sd > 1e-12")
    points = r.groupBy("key", "n", "size", "noise").agg((F.log(F.avg(F.col("range") / F.col("sd"))) - F.first("noise")).alias("y")).withColumn("x", F.log("size"))
    fit = points.groupBy("key", "n").agg(F.regr_slope("y", "x").alias("b"), F.count("*").alias("sizes"))
    every = bars(spark, sf_dir).select("key").distinct()
    h = F.when((F.col("n") < 32) | (F.col("sizes") < 2) | F.col("b").isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 + F.col("b"))))
    return every.join(fit, "key", "left").select("key", F.round(h, 6).alias("hurst"))


HURST = f"""WITH b AS (SELECT key, close, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM ({BARS_SQL})), z AS (SELECT * FROM (VALUES {', '.join(f'({s}, {e!r}::DOUBLE)' for s, e in _SIZES)}) AS z(size, noise)),
x AS (SELECT key, n, size, noise, i, i // size AS part, close FROM b JOIN z ON size <= n // 2 WHERE (i // size + 1) * size <= n), m AS (SELECT key, size, part, avg(close) AS mean, stddev_samp(close) AS sd FROM x GROUP BY ALL),
p AS (SELECT x.key, n, x.size, noise, x.part, sd, sum(close - mean) OVER (PARTITION BY x.key, x.size, x.part ORDER BY i) AS path FROM x JOIN m ON m.key = x.key AND m.size = x.size AND m.part = x.part WHERE sd > 1e-12),
r AS (SELECT key, n, size, noise, part, (max(path) - min(path)) / any_value(sd) AS rs FROM p GROUP BY ALL), l AS (SELECT key, n, ln(size) AS x, ln(avg(rs)) - noise AS y FROM r GROUP BY key, n, size, noise),
f AS (SELECT key, CASE WHEN n < 32 OR count(*) < 2 THEN 0.5 ELSE greatest(0, least(1, 0.5 + regr_slope(y, x))) END AS h FROM l GROUP BY key, n)
SELECT key, round(coalesce(h, 0.5), 6)::DOUBLE AS hurst FROM (SELECT DISTINCT key FROM b) LEFT JOIN f USING (key)"""


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks: the sentences that begin in one stretch of 420 characters, after the last sentence before them."""
    d = text.chunks(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return d.select("doc_id", "ordinal", F.length("chunk").alias("n_chars"), F.md5(F.encode("chunk", "UTF-8")).alias("digest"))


# Sentences by words: one ends where a word that ends with a stop, or its citation marks, stands before a word that begins one.
CHUNKS = rf"""WITH w AS (SELECT doc_id, rowid AS row, string_split_regex(trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D ]+', ' ', 'g')), ' ') AS ws FROM (SELECT *, row_number() OVER () AS rowid FROM documents)),
u AS (SELECT doc_id, row, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
n AS (SELECT *, regexp_matches(word, '[^0-9][.!?](\[[0-9]+\])*$') OR (regexp_matches(word, '^(\[[0-9]+\])+$') AND regexp_matches(coalesce(lag(word) OVER o, ''), '[^0-9][.!?](\[[0-9]+\])*$')) AS stop,
      regexp_matches(coalesce(lead(word) OVER o, ''), '^[A-Z0-9"''(]') AS opens FROM u WHERE word <> '' WINDOW o AS (PARTITION BY row ORDER BY i)),
k AS (SELECT *, coalesce(count(*) FILTER (stop AND opens) OVER (PARTITION BY row ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM n),
s AS (SELECT doc_id, row, nth, string_agg(word, ' ' ORDER BY i) AS sentence FROM k GROUP BY doc_id, row, nth),
b AS (SELECT *, coalesce(sum(length(sentence) + 1) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {text.CHUNK_CHARS} AS stretch, lag(sentence) OVER o AS before FROM s WINDOW o AS (PARTITION BY row ORDER BY nth)),
c AS (SELECT doc_id, row, stretch, concat_ws(' ', arg_min(before, nth) FILTER (before IS NOT NULL AND nth = first_nth), string_agg(sentence, ' ' ORDER BY nth)) AS chunk FROM (SELECT *, min(nth) OVER (PARTITION BY row, stretch) AS first_nth FROM b) GROUP BY doc_id, row, stretch)
SELECT doc_id, (row_number() OVER (PARTITION BY row ORDER BY stretch) - 1)::INT AS ordinal, length(chunk)::INT AS n_chars, md5(chunk) AS digest FROM c"""


def stem_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms of the documents have each stem, and in how many documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) >= 2)).alias("term"))
    # A document's terms are stemmed once each.
    per = d.groupBy("doc_id", "term").agg(F.count("*").alias("n")).groupBy("doc_id", text.stem(F.col("term")).alias("stem")).agg(F.sum("n").alias("n"))
    return per.groupBy("stem").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


# By endings and lengths instead of patterns: y becomes Y where it is no vowel, and the word a string of v and c.
STEMS = """WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda t: length(t) >= 2)) AS w FROM documents),
d AS (SELECT DISTINCT w FROM t),
a AS (SELECT w, CASE WHEN w[-4:] = 'sses' THEN w[:-3] WHEN w[-3:] = 'ies' THEN w[:-3] WHEN w[-2:] = 'ss' THEN w WHEN w[-1:] = 's' AND length(w) > 1 THEN w[:-2] ELSE w END AS o FROM d),
b AS (SELECT w, CASE WHEN w[-4:] = 'sses' THEN w[:-3] WHEN w[-3:] = 'ies' THEN w[:-3] ELSE o END AS o FROM a),
c AS (SELECT w, o, CASE WHEN o[-2:] = 'ed' THEN o[:-3] WHEN o[-3:] = 'ing' THEN o[:-4] ELSE '' END AS r, o[:-4] AS e FROM b),
f AS (SELECT *, translate(regexp_replace(r, '([^aeiou])y', '\1a', 'g'), 'aeiou', 'vvvvv') AS rv, translate(regexp_replace(e, '([^aeiou])y', '\1a', 'g'), 'aeiou', 'vvvvv') AS ev FROM c),
s AS (SELECT w, CASE WHEN o[-3:] = 'eed' THEN CASE WHEN regexp_matches(ev, 'v[^v]') AND regexp_matches(e, '([aeiou]|[^aeiou]y)[^aeiou]') THEN o[:-2] ELSE o END
  WHEN NOT contains(rv, 'v') THEN o
  WHEN r[-2:] IN ('at', 'bl', 'iz') THEN r || 'e'
  WHEN length(r) > 1 AND r[-1:] = r[-2:-2] AND NOT contains('aeioulsz', r[-1:]) THEN r[:-2]
  WHEN regexp_matches(r, '^[^aeiou]+[aeiouy].$') AND NOT contains('aeiouwxy', r[-1:]) THEN r || 'e' ELSE r END AS stem FROM f)
SELECT stem, count(*) AS n, count(DISTINCT doc_id) AS documents FROM t JOIN s USING (w) GROUP BY stem"""

PER_SOURCE, SHOWN = 2, 6


def diversified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six hits shown for each benchmark text: two of a source first, in order of place, then what is left."""
    hits = rank_fusion(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    of_source = F.row_number().over(Window.partitionBy("item_id", "source").orderBy("place"))
    shown = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("nth") > PER_SOURCE, "place"))
    return hits.withColumn("nth", of_source).withColumn("shown", shown).where(F.col("shown") <= SHOWN).select("item_id", "doc_id", "source", "place", "shown")


DIVERSIFIED = f"""WITH h AS (SELECT f.item_id, f.doc_id, f.place, d.source, row_number() OVER (PARTITION BY f.item_id, d.source ORDER BY f.place) AS nth FROM ({FUSION}) f JOIN documents d USING (doc_id))
SELECT item_id, doc_id, source, place, (row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN nth > {PER_SOURCE} THEN 1 ELSE 0 END, place))::INT AS shown FROM h QUALIFY shown <= {SHOWN}"""


def kelly_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of Kelly's share for each strategy from its win rate and the ratio of its mean win to its mean loss (1 without losses)."""
    win, loss = F.avg(F.when(F.col("pnl") > 0, F.col("pnl"))), F.avg(F.when(F.col("pnl") < 0, -F.col("pnl")))
    g = trades(spark, sf_dir).groupBy("strategy").agg(F.avg((F.col("pnl") > 0).cast("double")).alias("p"), F.coalesce(F.when(loss > 0, win / loss), F.lit(1.0)).alias("odds"))
    return g.select("strategy", F.round("p", 6).alias("win_rate"), F.round("odds", 6).alias("odds"), F.when(F.col("p") <= 0.5, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), (F.col("p") - (1 - F.col("p")) / F.col("odds")) * 0.5), 6)).alias("size"))


KELLY = f"""WITH g AS (SELECT strategy, count(*) FILTER (pnl > 0) / count(*) AS p, coalesce(avg(pnl) FILTER (pnl > 0) / -avg(pnl) FILTER (pnl < 0), 1) AS odds FROM ({TRADES}) GROUP BY 1)
SELECT strategy, round(p, 6) AS win_rate, round(odds, 6) AS odds, round(CASE WHEN p <= 0.5 THEN 0 ELSE greatest(0, (p - (1 - p) / odds) / 2) END, 6) AS size FROM g"""


def price_collars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The band of limit prices that an order may be entered at: twice the share that counts as erroneous for its price level."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 40).alias("price"))
    share = 2 * F.when(F.abs("price") <= 25, 0.1).when(F.abs("price") <= 50, 0.05).otherwise(0.03)
    return p.select("p_partkey", F.round(share, 6).alias("tolerance"), F.round(F.col("price") * (1 - share), 6).alias("lowest"), F.round(F.col("price") * (1 + share), 6).alias("highest"))


COLLARS = """WITH b AS (SELECT * FROM (VALUES (0, 25, 0.2::DOUBLE), (25, 50, 0.1::DOUBLE), (50, 1e18, 0.06::DOUBLE)) AS b(above, upto, share))
SELECT p_partkey, share AS tolerance, round(p_retailprice / 40 - share * p_retailprice / 40, 6) AS lowest, round(p_retailprice / 40 + share * p_retailprice / 40, 6) AS highest FROM part JOIN b ON abs(p_retailprice / 40) > above AND abs(p_retailprice / 40) <= upto"""


def state_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changes from each order of a customer to the next, as add, replace and remove operations on paths of its state.

    A state is a map; a path is there only if it has a value, so keys come and go."""
    o = table(spark, sf_dir, "orders")
    state = F.map_filter(F.create_map(F.lit("/status"), F.col("o_orderstatus"), F.lit("/priority"), F.col("o_orderpriority"), F.lit("/large"), F.when(F.col("o_totalprice") > 250_000, "yes")), lambda k, v: v.isNotNull())
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    x = o.select("o_custkey", "o_orderkey", "o_orderdate", state.alias("now")).withColumn("before", F.lag("now").over(w)).where("before IS NOT NULL")
    path = F.explode(F.array_union(F.map_keys("before"), F.map_keys("now"))).alias("path")
    x = x.select("o_orderkey", "before", "now", path).select("o_orderkey", "path", F.try_element_at("before", F.col("path")).alias("was"), F.try_element_at("now", F.col("path")).alias("value"))
    op = F.when(F.col("value").isNull(), "remove").when(F.col("was").isNull(), "add").otherwise("replace")
    return x.where(~F.col("was").eqNullSafe(F.col("value"))).select("o_orderkey", "path", op.alias("op"), "value")


PATCHES = """WITH s AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, o_orderstatus AS a, o_orderpriority AS b, CASE WHEN o_totalprice > 250000 THEN 'yes' END AS c FROM orders),
p AS (SELECT o_custkey, o_orderkey, i, '/status' AS path, a AS v FROM s UNION ALL SELECT o_custkey, o_orderkey, i, '/priority', b FROM s UNION ALL SELECT o_custkey, o_orderkey, i, '/large', c FROM s)
SELECT n.o_orderkey, n.path, CASE WHEN n.v IS NULL THEN 'remove' WHEN o.v IS NULL THEN 'add' ELSE 'replace' END AS op, n.v AS value FROM p n JOIN p o ON o.o_custkey = n.o_custkey AND o.i = n.i - 1 AND o.path = n.path WHERE n.v IS DISTINCT FROM o.v"""


def plateau_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the sum of the events' weights, which stay 1 for two days and then halve every three."""
    days = (F.lit(1_706_572_800_000_000) - F.unix_micros(F.col("ts").cast("timestamp"))) / 8.64e10
    e = table(spark, sf_dir, "events").where("ts <= '2024-01-30 00:00:00'").withColumn("w", F.when(days <= 2, 1.0).otherwise(F.pow(F.lit(2.0), -(days - 2) / 3)))
    return e.groupBy("user_id").agg(F.round(F.sum("w"), 6).alias("weight"))


PLATEAU = "SELECT user_id, round(sum(pow(0.5::DOUBLE, greatest(epoch(TIMESTAMP '2024-01-30' - ts) / 86400 - 2, 0) / 3)), 6) AS weight FROM events WHERE ts <= TIMESTAMP '2024-01-30' GROUP BY user_id"


def claim_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text as a claim: how many of the documents retrieved for it hold all its quantities, and all its dates."""
    from larkspur.plans.valuation import CLAIM_DEPTH, retrieved

    hits = retrieved(spark, sf_dir, CLAIM_DEPTH).where("channel = 'lexical'").select("item_id", "doc_id")
    claims, docs = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("claim")), table(spark, sf_dir, "documents").select("doc_id", "text")
    checked = hits.join(claims, "item_id").join(docs, "doc_id").select("item_id", text.claim_checks("claim", "text").alias("c"))
    n = checked.groupBy("item_id").agg(F.count_if("c.numerical").alias("numerical"), F.count_if("c.temporal").alias("temporal"))
    return claims.select("item_id").join(n, "item_id", "left").fillna(0)


# Tokens as rows: what follows a number comes by lead(); a claim's quantities meet a source's in a join.
EVIDENCE = rf"""WITH hits AS ({BM25_ALL} QUALIFY rank <= 40),
x AS (SELECT 'c' AS side, item_id AS id, lower(trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D ]+', ' ', 'g'))) AS s FROM benchmark UNION ALL SELECT 'd', doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[\x09-\x0D ]+', ' ', 'g'))) FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
t AS (SELECT side, id, unnest(ts) AS tok, generate_subscripts(ts, 1) AS i FROM (SELECT side, id, regexp_extract_all(replace(s, '$ ', '$'), '{text.TOKEN}') AS ts FROM x)),
n AS (SELECT *, lead(tok, 1) OVER o AS t1, lead(tok, 2) OVER o AS t2, lead(tok, 3) OVER o AS t3 FROM t WINDOW o AS (PARTITION BY side, id ORDER BY i)),
sc(word, factor) AS (VALUES {', '.join(f"('{k}', {v!r}::DOUBLE)" for k, v in text.SCALES.items())}), un(unit, kind, per) AS (VALUES {', '.join(f"('{k}', '{v[0]}', {v[1]}::DOUBLE)" for k, v in text.UNITS.items())}),
m AS (SELECT n.*, factor, CASE WHEN factor IS NULL THEN t1 ELSE t2 END AS u1, CASE WHEN factor IS NULL THEN t1 || ' ' || t2 ELSE t2 || ' ' || t3 END AS u2 FROM n LEFT JOIN sc ON word = t1 WHERE regexp_matches(tok, '[0-9]')),
q AS (SELECT m.side, m.id, m.i, CAST(replace(replace(tok, '$', ''), ',', '') AS DOUBLE) * coalesce(factor, 1) / coalesce(b.per, a.per, 1) AS v, coalesce(b.kind, a.kind, CASE WHEN tok[1] = '$' THEN 'currency' ELSE 'bare' END) AS kind FROM m LEFT JOIN un a ON a.unit = u1 LEFT JOIN un b ON b.unit = u2),
k AS (SELECT * FROM q WHERE kind <> 'bare' OR abs(v) >= {text.LEAST_BARE} OR v <> floor(v)),
asked AS (SELECT id AS item_id, i, v, kind FROM k WHERE side = 'c'),
met AS (SELECT DISTINCT h.item_id, h.doc_id, a.i FROM hits h JOIN asked a USING (item_id) JOIN k g ON g.side = 'd' AND g.id = h.doc_id AND (g.kind = a.kind OR 'bare' IN (g.kind, a.kind))
  AND (abs(g.v - a.v) <= {text.RELATIVE_TOLERANCE} * greatest(abs(g.v), abs(a.v)) OR ('percent' IN (g.kind, a.kind) AND abs(g.v - a.v) <= {text.POINT_TOLERANCE} AND greatest(abs(g.v), abs(a.v)) > 0))),
need AS (SELECT item_id, count(*) AS needed FROM asked GROUP BY item_id),
full_n AS (SELECT item_id, doc_id FROM (SELECT item_id, doc_id, count(*) AS held FROM met GROUP BY ALL) JOIN need USING (item_id) WHERE held = needed),
p(pattern) AS (VALUES ('q[1-4] ?[0-9]{{4}}'), ('fy ?[0-9]{{2,4}}'), ('fiscal [0-9]{{4}}'), ('[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}'), ('({'|'.join(text.MONTHS)}) [0-9]{{1,2}},? [0-9]{{4}}'), ('(next|last|prior|trailing) (twelve months|four quarters|quarter|year)')),
r AS (SELECT side, id, unnest(regexp_extract_all(s, '\b' || pattern || '\b')) AS d FROM x, p),
e AS (SELECT DISTINCT side, id, CASE WHEN regexp_matches(d, '^q') THEN replace(d, ' ', '') WHEN regexp_matches(d, '^({'|'.join(text.MONTHS)}) ') THEN strftime(strptime(replace(d, ',', ''), '%B %-d %Y'), '%Y-%m-%d') ELSE d END AS d FROM r),
full_d AS (SELECT h.item_id, h.doc_id FROM hits h JOIN e c ON c.side = 'c' AND c.id = h.item_id LEFT JOIN e g ON g.side = 'd' AND g.id = h.doc_id AND g.d = c.d GROUP BY ALL HAVING count(*) = count(g.d))
SELECT item_id, count(DISTINCT full_n.doc_id) AS numerical, count(DISTINCT full_d.doc_id) AS temporal FROM (SELECT DISTINCT item_id FROM benchmark) LEFT JOIN full_n USING (item_id) LEFT JOIN full_d USING (item_id) GROUP BY item_id"""


def embedding_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sample covariances of the places of the embeddings, of the vectors that are whole and of the commonest length."""
    from pyspark.ml.functions import vector_to_array

    x = vectors(spark, sf_dir).select(vector_to_array("features").alias("v"))
    return covariances.covariance(x, "v").select("i", "j", F.round("covariance", 9).alias("covariance"))


COVARIANCE = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding::DOUBLE[], lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM e WHERE len(v) = (SELECT arg_max(d, n) FROM (SELECT len(v) AS d, count(*) AS n FROM e GROUP BY 1))), u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM w)
SELECT a.k::INT AS i, b.k::INT AS j, round(covar_samp(a.x, b.x), 9) AS covariance FROM u a JOIN u b ON a.vec_id = b.vec_id AND a.k <= b.k GROUP BY 1, 2"""


def explained_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the embeddings in order of variance, their share of it, and whether they are among the fewest that explain 0.9."""
    from pyspark.ml.functions import vector_to_array

    e = covariances.explained(covariances.covariance(vectors(spark, sf_dir).select(vector_to_array("features").alias("v")), "v"))
    enough = covariances.components_for(e)
    return e.select("component", F.round("variance", 9).alias("variance"), F.round("share", 6).alias("share"), F.round("cumulative", 6).alias("cumulative"), (F.col("component") <= enough).alias("needed"))


QUERIES = {
    "trading_calendar": (trading_calendar, CALENDAR), "ind_hma": (ind_hma, HMA), "ind_squeeze": (ind_squeeze, SQUEEZE), "ind_aroon": (ind_aroon, AROON_SQL), "ind_crosses": (ind_crosses, CROSSES),
    "ou_outlook": (ou_outlook, OUTLOOK), "running_ecdf": (running_ecdf, ECDF), "hurst": (hurst, HURST), "chunk_documents": (chunk_documents, CHUNKS), "stem_counts": (stem_counts, STEMS), "diversified": (diversified, DIVERSIFIED),
    "kelly_sizes": (kelly_sizes, KELLY), "price_collars": (price_collars, COLLARS), "state_patches": (state_patches, PATCHES), "plateau_decay": (plateau_decay, PLATEAU), "claim_evidence": (claim_evidence, EVIDENCE),
    "embedding_covariance": (embedding_covariance, COVARIANCE), "explained_variance": (explained_variance, None),
}
