"""Indicators against plain sequential loops, with blocks small enough to cross many."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tickerloom.operators import indicators as I
from tickerloom.plans import recurrence as rec


def walk(n, seed=3, start=100.0):
    rnd, out, x = random.Random(seed), [], start
    for _ in range(n):
        x = max(1.0, x * (1 + rnd.gauss(0, 0.02)))
        out.append(round(x, 2))
    return out


def loop_ema(xs, p, seed="sma"):
    out, k, e = [None] * len(xs), 2 / (p + 1), None
    for i, x in enumerate(xs):
        if seed == "sma":
            if i == p - 1:
                e = sum(xs[:p]) / p
            elif i >= p:
                e = x * k + e * (1 - k)
        else:
            e = x if i == 0 else x * k + e * (1 - k)
        out[i] = e if i >= p - 1 else None
    return out


def loop_rsi(xs, p, dialect="service"):
    out = [None] * len(xs)
    g = [max(b - a, 0.0) for a, b in zip(xs, xs[1:])]
    l = [max(a - b, 0.0) for a, b in zip(xs, xs[1:])]
    if len(xs) < p + 1:
        return out
    ag, al = sum(g[:p]) / p, sum(l[:p]) / p
    for i in range(p, len(xs)):
        if i > p:
            ag, al = (ag * (p - 1) + g[i - 1]) / p, (al * (p - 1) + l[i - 1]) / p
        if dialect == "utils":
            out[i] = 100 - 100 / (1 + ag / (al or 1.0))
        else:
            out[i] = 100.0 if al == 0 else 100 - 100 / (1 + ag / al)
    return out


def loop_macd(xs, dialect="service"):
    seed = "first" if dialect == "ta" else "sma"
    fast, slow = loop_ema(xs, 12, seed), loop_ema(xs, 26, seed)
    line = [None if s is None else f - s for f, s in zip(fast, slow)]
    if dialect == "service":
        signal = loop_ema([v or 0.0 for v in line], 9)
        signal = [s if v is not None else None for s, v in zip(signal, line)]
    else:
        head = next((i for i, v in enumerate(line) if v is not None), len(line))
        signal = [None] * head + loop_ema(line[head:], 9, seed)
    return line, signal


def close(got, want, tol=1e-9):
    assert len(got) == len(want)
    for i, (a, b) in enumerate(zip(got, want)):
        if b is None:
            assert a is None, (i, a)
        else:
            assert a is not None and math.isclose(a, b, rel_tol=tol, abs_tol=tol), (i, a, b)


def test_ema_crosses_blocks_and_chunks(make_bars, columns):
    xs, ys = walk(700), walk(60, seed=9)
    df = I.enrich(make_bars({"A": xs, "B": ys, "C": xs[:8]}), ("ema",), rows=64, chunk_days=37)
    for symbol, series in (("A", xs), ("B", ys), ("C", xs[:8])):
        for p, got in zip(I.EMA_PERIODS, columns(df, symbol, *[f"ema{p}" for p in I.EMA_PERIODS])):
            close(got, loop_ema(series, p) if len(series) >= p else [None] * len(series))


def test_any_ema_period(make_bars, columns):
    xs = walk(900, 5)
    for periods in ((1,), (2,), (3, 5), (200,)):
        df = I.enrich(make_bars({"A": xs}), ("ema",), ema_periods=periods, rows=250, chunk_days=100)
        for p, got in zip(periods, columns(df, "A", *[f"ema{p}" for p in periods])):
            close(got, loop_ema(xs, p))


@pytest.mark.parametrize("n", [13, 14, 15, 26, 27, 28, 400])
def test_rsi_and_stochastic(make_bars, columns, n):
    xs = walk(n, seed=n)
    df = I.enrich(make_bars({"A": xs}), ("rsi", "stoch_rsi"), rows=64, chunk_days=50)
    rsi14, rsi9, stoch = columns(df, "A", "rsi14", "rsi9", "stoch_rsi")
    want = loop_rsi(xs, 14)
    close(rsi14, want)
    close(rsi9, loop_rsi(xs, 9))
    expected = []
    for i in range(n):
        win = [v for v in want[max(0, i - 13): i + 1] if v is not None]
        if len(win) < 14:
            expected.append(None)
        else:
            lo, hi = min(win), max(win)
            expected.append(0.0 if hi == lo else (want[i] - lo) / (hi - lo) * 100)
    close(stoch, expected, 1e-6)
    assert all(v is None or 0 <= v <= 100 for v in rsi14)


def test_rsi_edges(make_bars, columns):
    up, down, flat = [float(i) for i in range(1, 41)], [float(50 - i) for i in range(40)], [7.0] * 40
    df = I.enrich(make_bars({"U": up, "D": down, "F": flat}), ("rsi", "stoch_rsi"))
    assert set(columns(df, "U", "rsi14")[0][14:]) == {100.0}
    assert set(columns(df, "D", "rsi14")[0][14:]) == {0.0}
    assert set(columns(df, "F", "rsi14")[0][14:]) == {100.0}
    assert set(columns(df, "F", "stoch_rsi")[0][27:]) == {0.0}
    flags = columns(df, "D", "oversold", "overbought")
    assert flags[0][13:15] == [False, True] and not any(flags[1])


def test_rsi_keeps_its_value_through_a_long_flat_stretch(make_bars, columns):
    xs = walk(60, 2) + [50.0] * 700
    df = I.enrich(make_bars({"A": xs}), ("rsi",), rows=64, chunk_days=90)
    close(columns(df, "A", "rsi14")[0], loop_rsi(xs, 14), 1e-7)


@pytest.mark.parametrize("dialect", I.DIALECTS)
def test_macd_dialects(make_bars, columns, dialect):
    xs = walk(1100, 11)
    df = I.enrich(make_bars({"A": xs, "S": xs[:30]}), ("macd",), dialect=dialect, rows=300, chunk_days=200)
    for symbol, series in (("A", xs), ("S", xs[:30])):
        line, signal = loop_macd(series, dialect)
        got_line, got_signal, cross = columns(df, symbol, "macd_line", "macd_signal", "macd_bullish_cross")
        close(got_line, line)
        close(got_signal, signal)
        for i in range(1, len(series)):
            if None not in (line[i], signal[i], line[i - 1], signal[i - 1]) and abs(line[i] - signal[i]) > 1e-9:
                assert cross[i] == (line[i] > signal[i] and line[i - 1] <= signal[i - 1])
    if dialect == "service":
        line, signal = columns(df, "S", "macd_line", "macd_signal")
        assert line[24] is None and math.isclose(signal[25], 0.2 * line[25])


def test_rsi_dialect_without_losses(make_bars, columns):
    up = [float(i) for i in range(1, 31)]
    df = I.enrich(make_bars({"U": up}), ("rsi",), dialect="utils")
    close(columns(df, "U", "rsi14")[0], loop_rsi(up, 14, "utils"))


def test_frames_and_running_values(make_bars, columns):
    xs = walk(620, 4)
    df = I.enrich(make_bars({"A": xs}), ("returns", "sma", "bands", "atr", "vwap", "volume_spike", "volatility"),
                  rows=256, chunk_days=90).cache()
    hi, lo, v = [x * 1.02 for x in xs], [x * 0.97 for x in xs], [100 + (i * 37) % 50 for i in range(len(xs))]
    mean = lambda a, p, i: sum(a[i - p + 1:i + 1]) / p if i >= p - 1 else None
    n = range(len(xs))
    for p in (20, 50, 200):
        close(columns(df, "A", f"sma{p}")[0], [mean(xs, p, i) for i in n])
    tr = [hi[0] - lo[0]] + [max(hi[i] - lo[i], abs(hi[i] - xs[i - 1]), abs(lo[i] - xs[i - 1])) for i in n if i]
    close(columns(df, "A", "atr14")[0], [mean(tr, 14, i) for i in n])
    cv = ctp = 0.0
    want = []
    for i in n:
        ctp += (hi[i] + lo[i] + xs[i]) / 3 * v[i]
        cv += v[i]
        want.append(ctp / cv)
    close(columns(df, "A", "vwap")[0], want)
    upper, width = columns(df, "A", "bb_upper", "bb_bandwidth")
    for i in (19, 255, 256, 300, 619):
        m = mean(xs, 20, i)
        sd = math.sqrt(sum((x - m) ** 2 for x in xs[i - 19:i + 1]) / 20)
        assert math.isclose(upper[i], m + 2 * sd, rel_tol=1e-9)
        assert math.isclose(width[i], 4 * sd / m * 100, rel_tol=1e-9)
    ratio, spike, change, vol = columns(df, "A", "vol_vs_avg", "volume_spike", "price_change_pct", "volatility")
    assert spike[18] is None and ratio[18] is None
    assert math.isclose(ratio[400], v[400] / mean(v, 20, 400))
    assert change[0] == 0 and math.isclose(change[5], (xs[5] - xs[4]) / xs[4] * 100)
    rets = [xs[i] / xs[i - 1] - 1 for i in range(381, 401)]
    m = sum(rets) / 20
    assert vol[19] is None and math.isclose(vol[400], math.sqrt(sum((r - m) ** 2 for r in rets) / 19))
    df.unpersist()


def test_flat_bands_and_zero_volume(spark, make_bars, columns):
    df = I.enrich(make_bars({"F": [5.0] * 30}), ("bands",))
    upper, b, width = columns(df, "F", "bb_upper", "bb_percent_b", "bb_bandwidth")
    assert upper[18] is None and upper[19] == 5.0 and b[25] is None and width[25] == 0
    from pyspark.sql import functions as F
    none = make_bars({"Z": [5.0] * 3}).withColumn("volume", F.lit(0).cast("bigint"))
    assert columns(I.enrich(none, ("vwap",)), "Z", "vwap")[0] == [None] * 3


def test_snapshot_of_a_short_series_is_zero(make_bars):
    row = I.latest_snapshot(make_bars({"A": walk(5)})).first()
    assert row["sma_200"] == 0 and row["rsi"] == 0 and row["macd_signal"] == 0 and row["volume_spike"] is False
    assert row["current_price"] == walk(5)[-1]


def test_nested_document(make_bars):
    doc = I.nested_history(I.shown(I.enrich(make_bars({"A": walk(40)})))).orderBy("date").collect()[-1]
    assert doc["indicators"]["sma"]["sma200"] is None
    assert doc["indicators"]["rsi"]["rsi14"] == round(doc["indicators"]["rsi"]["rsi14"], 2)


def test_block_size_is_checked():
    with pytest.raises(ValueError):
        rec.block_rows([rec.ema("a", "close", 2), rec.ema("b", "close", 2000)], 1)
    with pytest.raises(ValueError):
        I.enrich(None, ("nope",))


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(1, 1000), min_size=1, max_size=260), st.integers(60, 120))
def test_ema_equals_loop_for_any_series(make_bars, columns, xs, rows):
    df = I.enrich(make_bars({"A": xs}), ("ema",), ema_periods=(9, 26), rows=rows, chunk_days=11)
    for p, got in zip((9, 26), columns(df, "A", "ema9", "ema26")):
        close(got, loop_ema(xs, p) if len(xs) >= p else [None] * len(xs))


def test_distant_periods_take_passes_of_their_own(make_bars, columns):
    closes = [100 + 10 * ((i * 7919) % 13) / 13 + i / 50 for i in range(900)]

    def plain(period):
        out, value = [None] * (period - 1), sum(closes[:period]) / period
        out.append(value)
        for c in closes[period:]:
            value = c * 2 / (period + 1) + value * (1 - 2 / (period + 1))
            out.append(value)
        return out

    groups = rec.passes([rec.ema(f"ema{p}", "close", p) for p in (2, 12, 200)], 240)
    assert len(groups) > 1 and sorted(r.name for g in groups for r in g) == ["ema12", "ema2", "ema200"]
    full = I.enrich(make_bars({"A": closes}), ("ema", "macd", "sma"), ema_periods=(2, 12, 26, 200, 500), sma_periods=(200,))
    found = columns(full, "A", "ema2", "ema12", "ema200", "ema500", "macd_line")
    for got, period in zip(found, (2, 12, 200, 500)):
        want = plain(period)
        assert [x is None for x in got] == [x is None for x in want]
        assert [x for x in got if x is not None] == pytest.approx([x for x in want if x is not None], rel=1e-9)
    line = [a - b if a is not None and b is not None else None for a, b in zip(plain(12), plain(26))]
    assert [x for x in found[4] if x is not None] == pytest.approx([x for x in line if x is not None][-len([x for x in found[4] if x is not None]):], abs=1e-9)
