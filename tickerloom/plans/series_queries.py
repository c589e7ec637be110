"""Registered queries over price series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.operators import bars as B
from tickerloom.operators import indicators as I
from tickerloom.plans import views as V
from tickerloom.plans.registry import register
from tickerloom.plans.stored import stored

_ORDER = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"

EOD = f"""
ticks AS (
  SELECT p_brand AS symbol, l_shipdate AS ts, CAST(l_shipdate AS DATE) AS d,
         l_extendedprice / l_quantity AS price, l_quantity AS volume, {_ORDER} AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
eod AS (
  SELECT symbol, d AS date, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, ord) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM ticks GROUP BY symbol, d
),
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
         lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc
  FROM eod
)"""


def _resampled(unit: str) -> str:
    return f"""WITH {EOD}
SELECT symbol, CAST(date_trunc('{unit}', date) AS VARCHAR)[1:10] AS date,
       arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
       CAST(sum(volume) AS BIGINT) AS volume
FROM eod GROUP BY symbol, date_trunc('{unit}', date)"""


def _dated(df: DataFrame, fmt: str = "yyyy-MM-dd") -> DataFrame:
    return df.withColumn("date", F.date_format("date", fmt))


def _daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars as a written table: the indicator pass reads them more than once."""
    return stored(V.eod(spark, sf), "eod")


def _rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles})


@register(f"""WITH {EOD}
SELECT symbol, CAST(date AS VARCHAR) AS date, open, high, low, close, volume FROM eod""")
def daily_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(V.eod(spark, sf))


@register(_resampled("week"))
def weekly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(B.resample(V.eod(spark, sf), "1wk"))


@register(_resampled("month"))
def monthly_bars(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(B.resample(V.eod(spark, sf), "1mo"))


@register("""
SELECT event_type AS symbol, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS date,
       arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
       arg_max(value, row(ts, event_id)) AS close,
       CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS volume
FROM events GROUP BY 1, date_trunc('hour', ts)""")
def hourly_bars(spark: SparkSession, sf: str) -> DataFrame:
    bars = B.bars_from_ticks(V.event_ticks(spark, sf), "hour", ("ts", "event_id"))
    return _dated(bars, "yyyy-MM-dd HH:mm")


def _indicators(spark: SparkSession, sf: str, features: tuple[str, ...], columns: tuple[str, ...],
                **options) -> DataFrame:
    full = I.enrich(_daily(spark, sf), features, **options)
    return _dated(_rounded(full.select("symbol", "date", *columns)))


def _mean(period: int, column: str = "close") -> str:
    return (f"CASE WHEN i >= {period - 1} THEN avg({column}) OVER (PARTITION BY symbol ORDER BY i "
            f"ROWS BETWEEN {period - 1} PRECEDING AND CURRENT ROW) END")


@register(f"""WITH {EOD},
m AS (SELECT *, {_mean(20)} AS sma20, {_mean(50)} AS sma50, {_mean(200)} AS sma200,
      CASE WHEN i >= 19 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY i
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sg FROM bars),
b AS (SELECT *, sma20 + 2 * sg AS up, sma20 - 2 * sg AS lo FROM m)
SELECT symbol, CAST(date AS VARCHAR) AS date, round(sma20, 4) AS sma20, round(sma50, 4) AS sma50,
       round(sma200, 4) AS sma200, round(up, 4) AS bb_upper, round(sma20, 4) AS bb_middle,
       round(lo, 4) AS bb_lower,
       CASE WHEN up <> 0 AND lo <> 0 AND up <> lo THEN round((close - lo) / (up - lo), 4) END AS bb_percent_b,
       CASE WHEN up <> 0 AND lo <> 0 THEN round((up - lo) / sma20 * 100, 4) END AS bb_bandwidth
FROM b""")
def sma_bands(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("sma", "bands"),
                       ("sma20", "sma50", "sma200", "bb_upper", "bb_middle", "bb_lower", "bb_percent_b", "bb_bandwidth"))


@register(f"""WITH {EOD},
t AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM bars)
SELECT symbol, CAST(date AS VARCHAR) AS date, round({_mean(14, 'tr')}, 4) AS atr14 FROM t""")
def atr(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("atr",), ("atr14",))


@register(f"""WITH {EOD}
SELECT symbol, CAST(date AS VARCHAR) AS date,
       round(sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 4) AS vwap
FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def vwap(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("vwap",), ("vwap",))


@register(f"""WITH {EOD},
v AS (SELECT *, {_mean(20, 'volume')} AS av FROM bars)
SELECT symbol, CAST(date AS VARCHAR) AS date, volume > 2 * av AS volume_spike,
       round(volume / av, 4) AS vol_vs_avg FROM v""")
def volume_spike(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("volume_spike",), ("volume_spike", "vol_vs_avg"))


@register(f"""WITH {EOD},
r AS (SELECT *, close / pc - 1 AS ret FROM bars)
SELECT symbol, CAST(date AS VARCHAR) AS date,
       round(coalesce((close - pc) / pc * 100, 0), 4) AS price_change_pct,
       round((high - low) / low * 100, 4) AS high_low_range_pct,
       CASE WHEN i >= 20 THEN round(stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY i
         ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 4) END AS volatility
FROM r""")
def returns_volatility(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("returns", "volatility"), ("price_change_pct", "high_low_range_pct", "volatility"))


@register(f"""WITH {EOD},
m AS (SELECT *, {_mean(20)} AS a, {_mean(50)} AS b, {_mean(200)} AS c FROM bars)
SELECT symbol, CAST(date AS VARCHAR) AS date, round((close - a) / a * 100, 4) AS price_vs_sma20,
       round((close - b) / b * 100, 4) AS price_vs_sma50, round((close - c) / c * 100, 4) AS price_vs_sma200
FROM m""")
def price_vs_sma(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("sma",), ("price_vs_sma20", "price_vs_sma50", "price_vs_sma200"))


def _ema_steps(periods: tuple[int, ...]) -> str:
    """Recursive walk over the bars of every symbol at once, one row index per step."""
    seeds = ", ".join(f"avg(close) FILTER (i < {p}) AS s{p}" for p in periods)
    base = ", ".join(f"CASE WHEN {p} = 1 THEN b.close END AS e{p}" for p in periods)
    step = ", ".join(
        f"CASE WHEN b.i = {p - 1} THEN b.s{p} WHEN b.i > {p - 1} "
        f"THEN b.close * {2.0 / (p + 1)!r} + w.e{p} * {1 - 2.0 / (p + 1)!r} END"
        for p in periods
    )
    return f"""
seeds AS (SELECT symbol, {seeds} FROM bars GROUP BY symbol),
src AS (SELECT bars.symbol, bars.date, bars.i, bars.close, {', '.join(f's{p}' for p in periods)}
        FROM bars JOIN seeds ON bars.symbol = seeds.symbol),
emas AS (
  SELECT b.symbol, b.date, b.i, {base} FROM src b WHERE b.i = 0
  UNION ALL
  SELECT b.symbol, b.date, b.i, {step} FROM emas w JOIN src b ON b.symbol = w.symbol AND b.i = w.i + 1
)"""


@register(f"""WITH RECURSIVE {EOD}, {_ema_steps((9, 12, 26, 50))}
SELECT symbol, CAST(date AS VARCHAR) AS date, round(e9, 4) AS ema9, round(e12, 4) AS ema12,
       round(e26, 4) AS ema26, round(e50, 4) AS ema50 FROM emas""")
def ema(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("ema",), ("ema9", "ema12", "ema26", "ema50"))


@register(f"""WITH RECURSIVE {EOD}, {_ema_steps((12, 26))},
c AS (SELECT *, lag(e12) OVER w AS p12, lag(e26) OVER w AS p26 FROM emas
      WINDOW w AS (PARTITION BY symbol ORDER BY i))
SELECT symbol, CAST(date AS VARCHAR) AS date,
       CASE WHEN p12 <= p26 AND e12 > e26 THEN 'bullish'
            WHEN p12 >= p26 AND e12 < e26 THEN 'bearish' END AS ema_crossover
FROM c""")
def ema_crossover(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("ema_crossover",), ("ema_crossover",))


_MACD = """
line AS (SELECT symbol, date, i, CASE WHEN i >= 25 THEN e12 - e26 END AS line FROM emas),
sig AS (
  SELECT symbol, date, i, line, CAST(0 AS DOUBLE) AS s FROM line WHERE i = 24
  UNION ALL
  SELECT l.symbol, l.date, l.i, l.line, l.line * 0.2 + w.s * 0.8
  FROM sig w JOIN line l ON l.symbol = w.symbol AND l.i = w.i + 1
),
j AS (SELECT line.symbol, line.date, line.i, line.line, CASE WHEN line.i >= 25 THEN sig.s END AS s
      FROM line LEFT JOIN sig ON line.symbol = sig.symbol AND line.i = sig.i),
k AS (SELECT *, lag(line) OVER w AS pl, lag(s) OVER w AS ps FROM j
      WINDOW w AS (PARTITION BY symbol ORDER BY i))"""


@register(f"""WITH RECURSIVE {EOD}, {_ema_steps((12, 26))}, {_MACD}
SELECT symbol, CAST(date AS VARCHAR) AS date, round(line, 4) AS macd_line, round(s, 4) AS macd_signal,
       round(line - s, 4) AS macd_histogram, coalesce(line > s AND pl <= ps, FALSE) AS macd_bullish_cross
FROM k""")
def macd(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("macd",), ("macd_line", "macd_signal", "macd_histogram", "macd_bullish_cross"))


def _rsi_steps(periods: tuple[int, ...]) -> str:
    seeds = ", ".join(
        f"sum(greatest(close - pc, 0)) FILTER (i BETWEEN 1 AND {p}) / {p} AS g{p}, "
        f"sum(greatest(pc - close, 0)) FILTER (i BETWEEN 1 AND {p}) / {p} AS l{p}" for p in periods)
    base = ", ".join(f"CAST(NULL AS DOUBLE) AS ag{p}, CAST(NULL AS DOUBLE) AS al{p}" for p in periods)
    step = ", ".join(
        f"CASE WHEN b.i = {p} THEN b.g{p} WHEN b.i > {p} THEN (w.ag{p} * {p - 1} + greatest(b.ch, 0)) / {p} END, "
        f"CASE WHEN b.i = {p} THEN b.l{p} WHEN b.i > {p} THEN (w.al{p} * {p - 1} + greatest(-b.ch, 0)) / {p} END"
        for p in periods)
    values = ", ".join(
        f"CASE WHEN al{p} = 0 THEN 100 ELSE 100 - 100 / (1 + ag{p} / al{p}) END AS rsi{p}" for p in periods)
    return f"""
rseeds AS (SELECT symbol, {seeds} FROM bars GROUP BY symbol),
rsrc AS (SELECT bars.symbol, bars.date, bars.i, bars.close - bars.pc AS ch,
        {', '.join(f'g{p}, l{p}' for p in periods)} FROM bars JOIN rseeds ON bars.symbol = rseeds.symbol),
walk AS (
  SELECT b.symbol, b.date, b.i, {base} FROM rsrc b WHERE b.i = 0
  UNION ALL
  SELECT b.symbol, b.date, b.i, {step} FROM walk w JOIN rsrc b ON b.symbol = w.symbol AND b.i = w.i + 1
),
rsis AS (SELECT symbol, date, i, {values} FROM walk)"""


@register(f"""WITH RECURSIVE {EOD}, {_rsi_steps((14, 9))}
SELECT symbol, CAST(date AS VARCHAR) AS date, round(rsi14, 4) AS rsi14, round(rsi9, 4) AS rsi9,
       coalesce(rsi14 < 30, FALSE) AS oversold, coalesce(rsi14 > 70, FALSE) AS overbought FROM rsis""")
def rsi(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("rsi",), ("rsi14", "rsi9", "oversold", "overbought"))


@register(f"""WITH RECURSIVE {EOD}, {_rsi_steps((14,))},
f AS (SELECT *, min(rsi14) OVER w AS lo, max(rsi14) OVER w AS hi, count(rsi14) OVER w AS n FROM rsis
      WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
SELECT symbol, CAST(date AS VARCHAR) AS date,
       CASE WHEN n = 14 THEN CASE WHEN hi = lo THEN 0 ELSE round((rsi14 - lo) / (hi - lo) * 100, 4) END END
         AS stoch_rsi FROM f""")
def stoch_rsi(spark: SparkSession, sf: str) -> DataFrame:
    return _indicators(spark, sf, ("stoch_rsi",), ("stoch_rsi",))


_WEEKLY = f"""{EOD.split("bars AS (")[0]}
weeks AS (
  SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS date, arg_min(open, date) AS open, max(high) AS high,
         min(low) AS low, arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume
  FROM eod GROUP BY symbol, date_trunc('week', date)
),
bars AS (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
         lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc FROM weeks
)"""


@register(f"""WITH {_WEEKLY},
m AS (SELECT *, {_mean(20)} AS sma20,
      CASE WHEN i >= 19 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY i
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sg,
      greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
      sum((high + low + close) / 3 * volume) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)
        / sum(volume) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS vw FROM bars)
SELECT symbol, CAST(date AS VARCHAR) AS date, open, high, low, close, volume, round(sma20, 4) AS sma20,
       round(sma20 + 2 * sg, 4) AS bb_upper, round(sma20 - 2 * sg, 4) AS bb_lower,
       round({_mean(14, 'tr')}, 4) AS atr14, round(vw, 4) AS vwap
FROM m""")
def weekly_indicators(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars with a moving average, bands, true range and VWAP per symbol."""
    weekly = stored(B.resample(V.eod(spark, sf), "1wk"), "weekly")
    full = I.enrich(weekly, ("sma", "bands", "atr", "vwap"), sma_periods=(20,))
    shown = ("sma20", "bb_upper", "bb_lower", "atr14", "vwap")
    rows = full.withColumns({c: F.round(c, 4) for c in shown})
    return _dated(rows.select("symbol", "date", "open", "high", "low", "close", "volume", *shown))


_ALL = f"""{EOD.split("bars AS (")[0]}
parts AS (
  SELECT '1d' AS interval, symbol AS sym, date, open, high, low, close, volume FROM eod
  UNION ALL
  SELECT '1wk', symbol, CAST(date_trunc('week', date) AS DATE), arg_min(open, date), max(high), min(low),
         arg_max(close, date), CAST(sum(volume) AS BIGINT) FROM eod GROUP BY symbol, date_trunc('week', date)
  UNION ALL
  SELECT '1mo', symbol, CAST(date_trunc('month', date) AS DATE), arg_min(open, date), max(high), min(low),
         arg_max(close, date), CAST(sum(volume) AS BIGINT) FROM eod GROUP BY symbol, date_trunc('month', date)
),
bars AS (
  SELECT *, interval || ':' || sym AS symbol,
         row_number() OVER (PARTITION BY interval, sym ORDER BY date) - 1 AS i,
         lag(close) OVER (PARTITION BY interval, sym ORDER BY date) AS pc FROM parts
)"""


_ENRICHED = f"""WITH RECURSIVE {_ALL}, {_ema_steps((9, 12, 26, 50))}, {_rsi_steps((14, 9))}, {_MACD},
m AS (SELECT *, {_mean(20)} AS sma20, {_mean(50)} AS sma50, {_mean(200)} AS sma200,
      CASE WHEN i >= 19 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY i
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sg,
      greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
      {_mean(20, 'volume')} AS av,
      sum((high + low + close) / 3 * volume) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING)
        / sum(volume) OVER (PARTITION BY symbol ORDER BY i ROWS UNBOUNDED PRECEDING) AS vw,
      CASE WHEN i >= 20 THEN stddev_samp(close / pc - 1) OVER (PARTITION BY symbol ORDER BY i
        ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM bars),
e AS (SELECT *, lag(e12) OVER w AS p12, lag(e26) OVER w AS p26 FROM emas
      WINDOW w AS (PARTITION BY symbol ORDER BY i)),
f AS (SELECT *, min(rsi14) OVER w AS lo, max(rsi14) OVER w AS hi, count(rsi14) OVER w AS n FROM rsis
      WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))"""
_JOINED = """FROM m JOIN e ON m.symbol = e.symbol AND m.i = e.i JOIN f ON m.symbol = f.symbol AND m.i = f.i
  JOIN k ON m.symbol = k.symbol AND m.i = k.i"""


@register(f"""{_ENRICHED}
SELECT m.interval, m.sym AS symbol, CAST(m.date AS VARCHAR) AS date, m.close,
       round(coalesce((m.close - m.pc) / m.pc * 100, 0), 4) AS price_change_pct,
       round(sma20, 4) AS sma20, round(sma50, 4) AS sma50, round(sma200, 4) AS sma200,
       round(e9, 4) AS ema9, round(e12, 4) AS ema12, round(e26, 4) AS ema26, round(e50, 4) AS ema50,
       CASE WHEN p12 <= p26 AND e12 > e26 THEN 'bullish' WHEN p12 >= p26 AND e12 < e26 THEN 'bearish' END
         AS ema_crossover,
       round(rsi14, 4) AS rsi14, round(rsi9, 4) AS rsi9,
       CASE WHEN n = 14 THEN CASE WHEN hi = lo THEN 0 ELSE round((rsi14 - lo) / (hi - lo) * 100, 4) END END AS stoch_rsi,
       round(line, 4) AS macd_line, round(s, 4) AS macd_signal,
       coalesce(line > s AND pl <= ps, FALSE) AS macd_bullish_cross,
       round(sma20 + 2 * sg, 4) AS bb_upper, round(sma20 - 2 * sg, 4) AS bb_lower,
       round({_mean(14, 'tr').replace('symbol', 'm.symbol').replace(' i ', ' m.i ')}, 4) AS atr14,
       m.volume > 2 * av AS volume_spike, round(vw, 4) AS vwap, round(vol, 4) AS volatility
{_JOINED}""")
def price_history(spark: SparkSession, sf: str) -> DataFrame:
    """All indicators for daily, weekly and monthly bars in one pass."""
    full = _all_features(spark, sf)
    columns = ("price_change_pct", "sma20", "sma50", "sma200", "ema9", "ema12", "ema26", "ema50", "ema_crossover",
               "rsi14", "rsi9", "stoch_rsi", "macd_line", "macd_signal", "macd_bullish_cross", "bb_upper",
               "bb_lower", "atr14", "volume_spike", "vwap", "volatility")
    types = dict(full.dtypes)
    rows = full.select("interval", "symbol", "date", "close", *[
        F.round(c, 4).alias(c) if types[c] == "double" else F.col(c) for c in columns])
    return _dated(rows)


def _all_features(spark: SparkSession, sf: str) -> DataFrame:
    # Bars are read several times: to be numbered, summed up and cut.
    bars = stored(B.all_intervals(_daily(spark, sf)), "all_intervals")
    return I.enrich(bars, keys=("interval", "symbol"))


@register(f"""{_ENRICHED}
SELECT m.interval, m.sym AS symbol, CAST(m.date AS VARCHAR) AS date, m.volume,
       round(sma20, 4) AS sma20, round((m.close - sma50) / sma50 * 100, 4) AS price_vs_sma50, round(e50, 4) AS ema50,
       CASE WHEN p12 <= p26 AND e12 > e26 THEN 'bullish' WHEN p12 >= p26 AND e12 < e26 THEN 'bearish' END AS crossover_12_26,
       round(rsi9, 4) AS rsi9, coalesce(rsi14 < 30, FALSE) AS oversold, round(s, 4) AS signal_line,
       round(line - s, 4) AS histogram, round(sma20 + 2 * sg, 4) AS upper, round(vw, 4) AS vwap,
       round({_mean(14, 'tr').replace('symbol', 'm.symbol').replace(' i ', ' m.i ')}, 4) AS atr14
{_JOINED}""")
def nested_history(spark: SparkSession, sf: str) -> DataFrame:
    """The nested document of each bar, opened again at some of its fields."""
    fields = ("sma.sma20", "sma.price_vs_sma50", "ema.ema50", "ema.crossover_12_26", "rsi.rsi9", "rsi.oversold",
              "macd.signal_line", "macd.histogram", "bollinger.upper", "volume.vwap", "atr.atr14")
    rows = I.nested_history(_all_features(spark, sf)).select(
        "interval", "symbol", "date", "volume", *[F.col(f"indicators.{f}") for f in fields])
    return _dated(rows.withColumns({c: F.round(c, 4) for c, kind in rows.dtypes if kind == "double"}))


# The 'ta' dialect: averages start at the first value.
TA = f"""{EOD},
x AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr,
             coalesce(greatest(close - pc, 0), 0) AS g, coalesce(greatest(pc - close, 0), 0) AS l,
             {_mean(20)} AS sma20, {_mean(50)} AS sma50, {_mean(200)} AS sma200,
             CASE WHEN i >= 19 THEN stddev_pop(close) OVER (PARTITION BY symbol ORDER BY i
               ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS sg,
             {_mean(20, 'volume')} AS av, close / pc - 1 AS ret FROM bars),
y AS (SELECT *, {_mean(14, 'tr')} AS atr_seed,
             CASE WHEN i >= 20 THEN stddev_samp(ret) OVER (PARTITION BY symbol ORDER BY i
               ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS vol FROM x),
tw AS (
  SELECT symbol, i, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS sig, CAST(0 AS DOUBLE) AS ag,
         CAST(0 AS DOUBLE) AS al, CAST(NULL AS DOUBLE) AS atr FROM y WHERE i = 0
  UNION ALL
  SELECT symbol, i, e12, e26, CASE WHEN i = 25 THEN e12 - e26 WHEN i > 25 THEN (e12 - e26) * 0.2 + sig * 0.8 END,
         ag, al, atr
  FROM (SELECT y.symbol, y.i, y.close * {2 / 13!r} + tw.e12 * {1 - 2 / 13!r} AS e12,
               y.close * {2 / 27!r} + tw.e26 * {1 - 2 / 27!r} AS e26, tw.sig,
               (tw.ag * 13 + y.g) / 14 AS ag, (tw.al * 13 + y.l) / 14 AS al,
               CASE WHEN y.i = 13 THEN y.atr_seed WHEN y.i > 13 THEN (tw.atr * 13 + y.tr) / 14 END AS atr
        FROM tw JOIN y ON y.symbol = tw.symbol AND y.i = tw.i + 1)
),
snap AS (
  SELECT y.symbol, y.date, round(close, 2) AS current_price,
         round(CASE WHEN y.i < 13 THEN 0 WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END, 2) AS rsi,
         round(CASE WHEN y.i < 25 THEN 0 ELSE e12 - e26 END, 2) AS macd,
         round(CASE WHEN y.i < 33 THEN 0 ELSE sig END, 2) AS macd_signal,
         round(coalesce(sma20, 0), 2) AS sma_20, round(coalesce(sma50, 0), 2) AS sma_50,
         round(coalesce(sma200, 0), 2) AS sma_200, round(coalesce(sma20 + 2 * sg, 0), 2) AS bb_high,
         round(coalesce(sma20 - 2 * sg, 0), 2) AS bb_low, round(coalesce(atr, 0), 2) AS atr,
         round(coalesce(vol, 0), 4) AS volatility, coalesce(volume > 2 * av, FALSE) AS volume_spike
  FROM y JOIN tw ON y.symbol = tw.symbol AND y.i = tw.i
  QUALIFY row_number() OVER (PARTITION BY y.symbol ORDER BY y.date DESC) = 1
)"""


@register(f"WITH RECURSIVE {TA} SELECT * REPLACE (CAST(date AS VARCHAR) AS date) FROM snap")
def latest_technicals(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(I.latest_snapshot(_daily(spark, sf)))


@register(f"""WITH RECURSIVE {EOD}, {_ema_steps((12, 26))}, {_rsi_steps((14,)).replace(
    "CASE WHEN al14 = 0 THEN 100 ELSE 100 - 100 / (1 + ag14 / al14) END",
    "100 - 100 / (1 + ag14 / CASE WHEN al14 = 0 THEN 1 ELSE al14 END)")},
line AS (SELECT symbol, date, i, e12 - e26 AS line FROM emas WHERE i >= 25),
seed AS (SELECT symbol, avg(line) AS s FROM line WHERE i <= 33 GROUP BY symbol),
sig AS (
  SELECT line.symbol, line.i, seed.s FROM line JOIN seed ON line.symbol = seed.symbol WHERE i = 33
  UNION ALL
  SELECT l.symbol, l.i, l.line * 0.2 + w.s * 0.8 FROM sig w JOIN line l ON l.symbol = w.symbol AND l.i = w.i + 1
)
SELECT r.symbol, CAST(r.date AS VARCHAR) AS date, round(rsi14, 4) AS rsi14, round(line, 4) AS macd_line,
       round(s, 4) AS macd_signal, round(line - s, 4) AS macd_histogram
FROM rsis r LEFT JOIN line ON r.symbol = line.symbol AND r.i = line.i LEFT JOIN sig ON r.symbol = sig.symbol AND r.i = sig.i""")
def utils_dialect(spark: SparkSession, sf: str) -> DataFrame:
    """RSI and MACD with the seeded signal line."""
    return _indicators(spark, sf, ("rsi", "macd"), ("rsi14", "macd_line", "macd_signal", "macd_histogram"),
                       dialect="utils", rsi_periods=(14,))


@register(f"""WITH RECURSIVE {TA}
SELECT y.symbol, CAST(y.date AS VARCHAR) AS date,
       CASE WHEN y.i >= 13 THEN round(CASE WHEN al = 0 THEN 100 ELSE 100 - 100 / (1 + ag / al) END, 4) END AS rsi14,
       CASE WHEN y.i >= 25 THEN round(e12 - e26, 4) END AS macd_line,
       CASE WHEN y.i >= 33 THEN round(sig, 4) END AS macd_signal, round(atr, 4) AS atr14
FROM y JOIN tw ON y.symbol = tw.symbol AND y.i = tw.i""")
def ta_dialect(spark: SparkSession, sf: str) -> DataFrame:
    """RSI, MACD and ATR with averages that start at the first value."""
    return _indicators(spark, sf, ("rsi", "macd", "atr"), ("rsi14", "macd_line", "macd_signal", "atr14"),
                       dialect="ta", rsi_periods=(14,))
