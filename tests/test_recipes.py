"""Window recipes against naive sequential models on random data."""

import datetime as dt

import numpy as np
import pytest

from quantspark.operators.features import add_gap
from quantspark.operators.labels import BarrierConfig, barrier_arrays, triple_barrier
from quantspark.operators.monitor import fifo_trades


def naive_gap(high, low, close, bull, cap):
    active, last, out, near, far = False, None, [], None, None
    for i in range(len(close)):
        if active:
            if (close[i] < far) if bull else (close[i] > far):
                active, last = False, i
            elif (low[i] <= far) if bull else (high[i] >= far):
                active = False
        if i >= 2 and (high[i - 2] < low[i] if bull else low[i - 2] > high[i]):
            active, far, near = True, (high[i - 2] if bull else low[i - 2]), (low[i] if bull else high[i])
        dist = ((close[i] - near) if bull else (near - close[i])) / close[i] if active else 0.0
        out.append((int(active), round(dist, 9), cap if last is None else min(i - last, cap)))
    return out


@pytest.mark.parametrize("side", ["bull", "bear"])
def test_gaps_as_islands(spark, side):
    rng, rows, want = np.random.default_rng(3), [], {}
    for day in range(40):
        close = 100 + np.cumsum(rng.normal(0, 1, 30))
        high, low = close + rng.random(30), close - rng.random(30)
        date = dt.date(2026, 1, 1) + dt.timedelta(days=day)
        rows += [("A", date, i, float(h), float(lo), float(c)) for i, (h, lo, c) in enumerate(zip(high, low, close, strict=True))]
        want.update({(date, i): x for i, x in enumerate(naive_gap(high, low, close, side == "bull", 10))})
    df = spark.createDataFrame(rows, "symbol string, session_date date, ts int, high double, low double, close double")
    for r in add_gap(df, side, 10).collect():
        assert (r[f"{side}_fvg_active"], round(r[f"{side}_fvg_dist"], 9), r[f"bars_since_{side}_ifvg"]) == want[r.session_date, r.ts]


def test_fifo_intervals(spark):
    rng, rows, want = np.random.default_rng(4), [], []
    for symbol in range(20):
        queue = []
        for k in range(40):
            side, q = ("buy", "sell")[int(rng.integers(2))], int(rng.integers(1, 300))
            rows.append((symbol, k, dt.datetime(2026, 1, 1) + dt.timedelta(hours=k), side, q, float(k)))
            if side == "buy":
                queue.append([k, q])
                continue
            while q and queue:
                take = min(q, queue[0][1])
                want.append((symbol, queue[0][0], k, take))
                q, queue[0][1] = q - take, queue[0][1] - take
                if not queue[0][1]:
                    queue.pop(0)
    df = spark.createDataFrame(rows, "symbol int, seq int, ts timestamp, side string, qty long, price double")
    got = [(r.symbol, int(r.entry_price), int(r.exit_price), r.qty) for r in fifo_trades(df).collect()]
    assert sorted(got) == sorted(want)


def test_barriers_both_ways(spark):
    rng = np.random.default_rng(5)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 400)))
    rows = [("A", i, float(c), float(c * 1.004), float(c * 0.996)) for i, c in enumerate(close)]
    df = spark.createDataFrame(rows, "symbol string, ts int, close double, high double, low double")
    a = triple_barrier(df, BarrierConfig(horizon=20)).orderBy("ts").collect()
    b = triple_barrier(df, BarrierConfig(horizon=20, array_horizon=0, block=64)).orderBy("ts").collect()
    assert [(r.label, r.exit_bar_offset) for r in a] == [(r.label, r.exit_bar_offset) for r in b]
    label, _, _ = barrier_arrays(close, close * 1.004, close * 0.996, 400, BarrierConfig(horizon=20))
    assert [None if x != x else int(x) for x in label] == [r.label for r in a]
