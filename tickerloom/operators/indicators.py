"""Technical indicators over bars, for all symbols in one pass.

Bars are numbered per symbol (two-level count), cut into bounded blocks with a
halo, and every indicator is computed over the same (symbol, block) window: one
shuffle and one sort, no task ever holds a whole series.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickerloom.plans import recurrence as rec
from tickerloom.plans.blocks import number_rows, with_halo

SMA_PERIODS = (20, 50, 200)
EMA_PERIODS = (9, 12, 26, 50)
RSI_PERIODS = (14, 9)
FAST, SLOW, SIGNAL = 12, 26, 9
STOCH = 14
BAND_PERIOD, BAND_WIDTH = 20, 2.0
ATR_PERIOD = 14
SPIKE_PERIOD, SPIKE_FACTOR = 20, 2.0
VOLATILITY_PERIOD = 20

# Means over at least this many rows use running sums.
LONG_PERIOD = 40

# Rows after which a 9-row signal average has forgotten its start (0.8 ** 240 < 1e-23).
SIGNAL_HALO = 240

FEATURES = (
    "returns", "sma", "ema", "rsi", "stoch_rsi", "macd", "ema_crossover",
    "bands", "atr", "vwap", "volume_spike", "volatility",
)

DIALECTS = ("service", "utils", "ta")


def index_bars(bars: DataFrame, keys: Sequence[str] = ("symbol",), chunk_days: int = 512,
               vwap: bool = True) -> DataFrame:
    """Add ``idx``, the previous close and, for the VWAP, running sums from the series start."""
    chunk = F.floor(F.col("date").cast("timestamp").cast("bigint") / (86400 * chunk_days))
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    sums = {
        "cum_value": typical * F.col("volume"),
        "cum_volume": F.col("volume").cast("double"),
    }
    return number_rows(
        bars.withColumn("_chunk", chunk), keys, ["_chunk"],
        bucket_order=[F.asc("_chunk")], row_order=[F.asc("date")],
        sums=sums if vwap else None, lasts={"prev_close": ("close", "date")},
    ).drop("_chunk")


def _mean(column: str, period: int, w: WindowSpec) -> Column:
    """Mean of the last ``period`` rows.

    A sliding frame adds ``period`` values per row.  Longer means are differences of
    the block's running sum, which costs the same for any period; the sum restarts
    with each block, so its rounding error stays near 1e-13 of the value.
    """
    if period < LONG_PERIOD:
        mean = F.avg(column).over(w.rowsBetween(-(period - 1), 0))
    else:
        running = F.col(f"_run_{column}")
        mean = (running - F.coalesce(F.lag(running, period).over(w), F.lit(0.0))) / period
    return F.when(F.col("idx") >= period - 1, mean)


def _recurrences(wanted: set[str], dialect: str, ema_periods: Sequence[int],
                 rsi_periods: Sequence[int]) -> list[rec.Recurrence]:
    seed = "first" if dialect == "ta" else "sma"
    periods: set[int] = set()
    if "ema" in wanted:
        periods |= set(ema_periods)
    if wanted & {"macd", "ema_crossover"}:
        periods |= {FAST, SLOW}
    out = [rec.ema(f"ema{p}", "close", p, seed=seed) for p in sorted(periods)]
    rsis: set[int] = set(rsi_periods) if "rsi" in wanted else set()
    if "stoch_rsi" in wanted:
        rsis.add(STOCH)
    first = 0 if dialect == "ta" else 1
    for p in sorted(rsis):
        out.append(rec.wilder(f"gain{p}", "gain", p, first=first, seed=seed))
        out.append(rec.wilder(f"loss{p}", "loss", p, first=first, seed=seed))
    if "atr" in wanted and dialect == "ta":
        out.append(rec.wilder(f"atr{ATR_PERIOD}", "true_range", ATR_PERIOD, first=0))
    return out


def _halo(wanted: set[str], sma_periods: Sequence[int]) -> int:
    need = [1]
    if "sma" in wanted:
        need.append(max(sma_periods))
    if "macd" in wanted:
        need.append(SIGNAL_HALO)
    if "stoch_rsi" in wanted:
        need.append(STOCH)
    if wanted & {"bands", "volume_spike", "volatility", "atr"}:
        need.append(max(BAND_PERIOD, SPIKE_PERIOD, VOLATILITY_PERIOD, ATR_PERIOD))
    return max(need)


def rsi_value(gain: Column, loss: Column, dialect: str = "service") -> Column:
    """Strength index from average gain and loss; dialects differ when there is no loss."""
    if dialect == "utils":
        return 100 - 100 / (1 + gain / F.when(loss == 0, F.lit(1.0)).otherwise(loss))
    return F.when(loss == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))


def enrich(
    bars: DataFrame,
    features: Iterable[str] = FEATURES,
    keys: Sequence[str] = ("symbol",),
    dialect: str = "service",
    sma_periods: Sequence[int] = SMA_PERIODS,
    ema_periods: Sequence[int] = EMA_PERIODS,
    rsi_periods: Sequence[int] = RSI_PERIODS,
    rows: int = 2048,
    chunk_days: int = 512,
) -> DataFrame:
    """Add the wanted indicators to bars unique per (keys, date); results are unrounded."""
    wanted = set(features)
    if unknown := wanted - set(FEATURES):
        raise ValueError(f"unknown features: {sorted(unknown)}")
    if dialect not in DIALECTS:
        raise ValueError(f"unknown dialect: {dialect}")

    base = index_bars(bars, keys, chunk_days, vwap="vwap" in wanted)
    change = F.col("close") - F.col("prev_close")
    base = base.withColumns({
        "gain": F.greatest(change, F.lit(0.0)),
        "loss": F.greatest(-change, F.lit(0.0)),
        "true_range": F.greatest(
            F.col("high") - F.col("low"),
            F.abs(F.col("high") - F.col("prev_close")),
            F.abs(F.col("low") - F.col("prev_close")),
        ),
        "return": F.col("close") / F.nullif(F.col("prev_close"), F.lit(0.0)) - 1,
    })

    recs = _recurrences(wanted, dialect, ema_periods, rsi_periods)
    halo = _halo(wanted, sma_periods)
    # Periods too far apart for one block size take passes of their own.
    signal = [rec.Recurrence("macd_signal", "macd_line", 2.0 / (SIGNAL + 1), 1)] if "macd" in wanted else []
    together, *apart = rec.passes(recs, halo, rows, signal)
    for group in apart:
        base = base.join(rec.run(base, keys, group, rows), [*keys, "idx"])
    size = rec.block_rows([*together, *signal], halo, rows)
    df = with_halo(base, size, halo)
    if together:
        carries = rec.block_carries(base, keys, together, size, halo)
        df = df.join(carries, [*keys, "block"])
    w = Window.partitionBy(*keys, "block").orderBy("idx")
    idx = F.col("idx")

    if "sma" in wanted and max(sma_periods) >= LONG_PERIOD:
        running = F.sum("close").over(w.rowsBetween(Window.unboundedPreceding, 0))
        df = df.withColumn("_run_close", running)

    # Recurrences and plain frames first, then what builds on them.
    stage: dict[str, Column] = {r.name: rec.scan(r, w, size, halo) for r in together}
    if "sma" in wanted:
        stage |= {f"sma{p}": _mean("close", p, w) for p in sma_periods}
    if "bands" in wanted:
        frame = w.rowsBetween(-(BAND_PERIOD - 1), 0)
        stage["bb_middle"] = _mean("close", BAND_PERIOD, w)
        stage["bb_sigma"] = F.when(idx >= BAND_PERIOD - 1, F.stddev_pop("close").over(frame))
    if "atr" in wanted and dialect != "ta":
        stage[f"atr{ATR_PERIOD}"] = _mean("true_range", ATR_PERIOD, w)
    if "volume_spike" in wanted:
        stage["avg_volume"] = _mean("volume", SPIKE_PERIOD, w)
    if "volatility" in wanted:
        frame = w.rowsBetween(-(VOLATILITY_PERIOD - 1), 0)
        stage["volatility"] = F.when(idx >= VOLATILITY_PERIOD, F.stddev_samp("return").over(frame))
    df = df.withColumns(stage) if stage else df

    if dialect == "ta":
        gates = {r.name: int(r.name[3:]) for r in recs if r.name.startswith("ema")}
        df = df.withColumns({n: F.when(idx >= p - 1, F.col(n)) for n, p in gates.items()}) if gates else df

    stage = {}
    for p in sorted({int(r.name[4:]) for r in recs if r.name.startswith("gain")}):
        value = rsi_value(F.col(f"gain{p}"), F.col(f"loss{p}"), dialect)
        stage[f"rsi{p}"] = F.when(idx >= p - 1, value) if dialect == "ta" else value
    if "macd" in wanted:
        stage["macd_line"] = F.col(f"ema{FAST}") - F.col(f"ema{SLOW}")
    df = df.withColumns(stage) if stage else df

    stage = {}
    if "macd" in wanted:
        first, seed, shown = {
            "service": (0, SIGNAL, SLOW - 1),
            "utils": (SLOW - 1, SIGNAL, SLOW + SIGNAL - 2),
            "ta": (SLOW - 1, 1, SLOW + SIGNAL - 2),
        }[dialect]
        line = rec.Recurrence("macd_signal", "macd_line", 2.0 / (SIGNAL + 1), seed, first)
        signal = rec.scan(line, w, size, halo, carried=False)
        stage["macd_signal"] = F.when(idx >= shown, signal)
    if "stoch_rsi" in wanted:
        frame = w.rowsBetween(-(STOCH - 1), 0)
        r = F.col(f"rsi{STOCH}")
        lo, hi = F.min(r).over(frame), F.max(r).over(frame)
        full = F.count(r).over(frame) == STOCH
        stage["stoch_rsi"] = F.when(
            full, F.when(hi == lo, F.lit(0.0)).otherwise((r - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100)
        )
    if "ema_crossover" in wanted:
        fast, slow = F.col(f"ema{FAST}"), F.col(f"ema{SLOW}")
        was_fast, was_slow = F.lag(fast).over(w), F.lag(slow).over(w)
        stage["ema_crossover"] = F.when((was_fast <= was_slow) & (fast > slow), F.lit("bullish")).when(
            (was_fast >= was_slow) & (fast < slow), F.lit("bearish")
        )
    df = df.withColumns(stage) if stage else df

    if "macd" in wanted:
        line, signal = F.col("macd_line"), F.col("macd_signal")
        crossed = (line > signal) & (F.lag(line).over(w) <= F.lag(signal).over(w))
        df = df.withColumns({
            "macd_histogram": line - signal,
            "macd_bullish_cross": F.coalesce(crossed, F.lit(False)),
        })

    df = df.filter("owned")
    return df.select(*bars.columns, "idx", *_finish(wanted, dialect, sma_periods, ema_periods, rsi_periods))


def _finish(wanted: set[str], dialect: str, sma_periods: Sequence[int], ema_periods: Sequence[int],
            rsi_periods: Sequence[int]) -> list[Column]:
    """Row-level columns on top of the windowed ones."""
    close = F.col("close")
    out: list[Column] = []
    if "returns" in wanted:
        out += [
            F.coalesce((close - F.col("prev_close")) / F.nullif(F.col("prev_close"), F.lit(0.0)) * 100, F.lit(0.0)).alias("price_change_pct"),
            ((F.col("high") - F.col("low")) / F.nullif(F.col("low"), F.lit(0.0)) * 100).alias("high_low_range_pct"),
        ]
    if "sma" in wanted:
        for p in sma_periods:
            sma = F.col(f"sma{p}")
            out += [sma, ((close - sma) / F.nullif(sma, F.lit(0.0)) * 100).alias(f"price_vs_sma{p}")]
    if "ema" in wanted:
        out += [F.col(f"ema{p}") for p in ema_periods]
    if "rsi" in wanted:
        out += [F.col(f"rsi{p}") for p in rsi_periods]
        main = F.col(f"rsi{rsi_periods[0]}")
        out += [
            F.coalesce(main < 30, F.lit(False)).alias("oversold"),
            F.coalesce(main > 70, F.lit(False)).alias("overbought"),
        ]
    if "stoch_rsi" in wanted:
        out.append(F.col("stoch_rsi"))
    if "macd" in wanted:
        out += [F.col(c) for c in ("macd_line", "macd_signal", "macd_histogram", "macd_bullish_cross")]
    if "ema_crossover" in wanted:
        out.append(F.col("ema_crossover"))
    if "bands" in wanted:
        mid, sigma = F.col("bb_middle"), F.col("bb_sigma")
        upper, lower = mid + sigma * BAND_WIDTH, mid - sigma * BAND_WIDTH
        usable = (upper != 0) & (lower != 0)
        width = F.nullif(upper - lower, F.lit(0.0))
        out += [
            upper.alias("bb_upper"), mid, lower.alias("bb_lower"),
            F.when(usable, (close - lower) / width).alias("bb_percent_b"),
            F.when(usable, (upper - lower) / F.nullif(mid, F.lit(0.0)) * 100).alias("bb_bandwidth"),
        ]
    if "atr" in wanted:
        out.append(F.col(f"atr{ATR_PERIOD}"))
    if "vwap" in wanted:
        out.append((F.col("cum_value") / F.nullif(F.col("cum_volume"), F.lit(0.0))).alias("vwap"))
    if "volume_spike" in wanted:
        avg = F.col("avg_volume")
        out += [
            (F.col("volume") > avg * SPIKE_FACTOR).alias("volume_spike"),
            (F.col("volume") / F.nullif(avg, F.lit(0.0))).alias("vol_vs_avg"),
        ]
    if "volatility" in wanted:
        out.append(F.col("volatility"))
    return out


# Decimals shown per indicator.
SHOWN_DECIMALS = {
    "price_change_pct": 4,
    "high_low_range_pct": 4,
    "price_vs_sma20": 3,
    "price_vs_sma50": 3,
    "price_vs_sma200": 3,
    "rsi14": 2,
    "rsi9": 2,
    "stoch_rsi": 2,
    "macd_line": 4,
    "macd_signal": 4,
    "macd_histogram": 4,
    "bb_upper": 3,
    "bb_middle": 3,
    "bb_lower": 3,
    "bb_percent_b": 3,
    "bb_bandwidth": 3,
    "atr14": 4,
    "vwap": 3,
    "vol_vs_avg": 2,
}


def shown(df: DataFrame) -> DataFrame:
    """Round to the displayed decimals."""
    return df.withColumns({c: F.round(c, d) for c, d in SHOWN_DECIMALS.items() if c in df.columns})


def nested_history(enriched: DataFrame) -> DataFrame:
    """The enriched candle as one nested document per row."""
    group = lambda *cols: F.struct(*cols)
    indicators = F.struct(
        group("sma20", "sma50", "sma200", "price_vs_sma20", "price_vs_sma50", "price_vs_sma200").alias("sma"),
        group("ema9", "ema12", "ema26", "ema50", F.col("ema_crossover").alias("crossover_12_26")).alias("ema"),
        group("rsi14", "rsi9", "stoch_rsi", "oversold", "overbought").alias("rsi"),
        group("macd_line", F.col("macd_signal").alias("signal_line"), F.col("macd_histogram").alias("histogram"),
              F.col("macd_bullish_cross").alias("bullish_cross")).alias("macd"),
        group(F.col("bb_upper").alias("upper"), F.col("bb_middle").alias("middle"), F.col("bb_lower").alias("lower"),
              F.col("bb_percent_b").alias("percent_b"), F.col("bb_bandwidth").alias("bandwidth")).alias("bollinger"),
        group("atr14").alias("atr"),
        group("vwap", F.col("volume_spike").alias("spike"), "vol_vs_avg").alias("volume"),
    )
    keep = [c for c in ("symbol", "interval", "date", "open", "high", "low", "close", "volume",
                        "price_change_pct", "high_low_range_pct") if c in enriched.columns]
    return enriched.select(*keep, indicators.alias("indicators"))


def latest_snapshot(bars: DataFrame) -> DataFrame:
    """The last bar's indicators per symbol in the ``ta`` dialect; missing values become 0."""
    full = enrich(
        bars, ("rsi", "macd", "sma", "bands", "atr", "volatility", "volume_spike"), dialect="ta", rsi_periods=(14,)
    )
    # Output name, input column and shown decimals of the snapshot.
    fields = {
        "current_price": ("close", 2),
        "rsi": ("rsi14", 2),
        "macd": ("macd_line", 2),
        "macd_signal": ("macd_signal", 2),
        "sma_20": ("sma20", 2),
        "sma_50": ("sma50", 2),
        "sma_200": ("sma200", 2),
        "bb_high": ("bb_upper", 2),
        "bb_low": ("bb_lower", 2),
        "atr": ("atr14", 2),
        "volatility": ("volatility", 4),
    }
    sources = [src for src, _ in fields.values()]
    last = full.groupBy("symbol").agg(
        F.max("date").alias("date"),
        *[F.max_by(c, "date").alias(c) for c in [*dict.fromkeys(sources), "volume_spike"]],
    )
    zero = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    return last.select(
        "symbol", "date",
        *[F.round(zero(src), digits).alias(name) for name, (src, digits) in fields.items()],
        F.coalesce("volume_spike", F.lit(False)).alias("volume_spike"),
    )
