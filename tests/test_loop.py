"""An iteration of live trading: gates, exits, entries, state."""

import datetime as dt

import pytest

from quantspark.operators.risk import RiskConfig
from quantspark.streaming import live, loop

START = dt.datetime(2026, 1, 5, 10, 0)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
FREE = loop.LoopConfig(min_bars=60, risk=RiskConfig(max_position=0.4))


def session(spark, n=60, **last):
    """n quiet bars of each symbol; the last one's (low, high, close) as given."""
    rows = []
    for s in ("A", "B", "C", "D"):
        rows += [(s, START + dt.timedelta(minutes=i), 100.0, 100.5, 99.5, 100.0, 10.0) for i in range(n)]
        if s in last:
            low, high, close = last[s]
            rows[-1] = (s, START + dt.timedelta(minutes=n - 1), 100.0, high, low, close, 10.0)
    return spark.createDataFrame(rows, BARS)


def signals(*symbols):
    return lambda bars: bars.select("symbol").distinct().selectExpr("symbol", f"int(symbol in ({', '.join(map(repr, symbols)) or 'null'})) predicted", "0.7d proba")


@pytest.fixture
def at(tmp_path):
    return live.Broker(), live.KillSwitch(tmp_path / "kill"), str(tmp_path / "state.json"), []


def go(bars, scorer, at, now=START + dt.timedelta(hours=1), cfg=FREE):
    broker, switch, path, log = at
    return loop.iterate(bars, scorer, broker, switch, path, now, cfg, log.append)


def test_entries_share_the_headroom(spark, at):
    assert go(session(spark), signals("A", "B", "C", "D"), at) == "completed"
    broker, _, path, log = at
    assert broker.positions == {"A": 40, "B": 40, "C": 20}  # 40 % each, the third trimmed to what is left
    assert [(e["symbol"], e["reason"]) for e in log if e["event_type"] == "entry_rejected"] == [("D", "exposure")]
    state = loop.LoopState.load(path)
    assert sorted(state.positions) == ["A", "B", "C"] and state.positions["A"].stop == pytest.approx(99.0)
    assert [e["event_type"] for e in log][-4:] == ["fill", "fill", "fill", "loop_completed"]


def test_too_few_bars_or_no_signal(spark, at):
    go(session(spark, 59), signals("A"), at)
    go(session(spark), signals(), at)
    assert at[0].positions == {}


def test_exits_once_and_counts_day_trades(spark, at):
    go(session(spark), signals("A", "B"), at)
    later = session(spark, 62, A=(98.0, 103.0, 100.0), B=(99.5, 102.5, 102.0))
    go(later, signals(), at, START + dt.timedelta(minutes=62))
    broker, _, path, log = at
    assert {(e["symbol"], e["reason"], e["price"]) for e in log if e["event_type"] == "exit_signal"} == {("A", "stop_loss", 99.0), ("B", "take_profit", 102.0)}
    state = loop.LoopState.load(path)
    assert broker.positions == {} and state.positions == {} and state.day_trades == ["2026-01-05"] * 2
    go(later, signals(), at, START + dt.timedelta(minutes=63))
    assert len(broker.fills) == 4


def test_bars_before_the_entry_close_nothing(spark, at):
    go(session(spark, 60, A=(90.0, 100.5, 100.0)), signals("A"), at)
    go(session(spark, 60, A=(90.0, 100.5, 100.0)), signals(), at)
    assert at[0].positions == {"A": 40}


def test_deadline_without_new_bars(spark, at):
    b = session(spark)
    go(b, signals("A"), at)
    go(b, signals(), at, START + dt.timedelta(hours=9))
    assert [e["reason"] for e in at[3] if e["event_type"] == "exit_signal"] == ["max_holding"] and at[0].positions == {}


def test_gates_stop_the_loop(spark, at):
    broker, switch, path, log = at
    switch.engage("x")
    assert go(session(spark), signals("A"), at) == "kill_switch_engaged"
    switch.disengage()
    broker.open = False
    assert go(session(spark), signals("A"), at) == "market_closed"
    broker.open = True
    go(session(spark), signals("A"), at)
    fall = session(spark, 61, A=(92.0, 100.0, 92.0))  # 40 shares lose 8 each: 3.2 % of the equity
    assert go(fall, signals("B"), at) == "daily_loss"
    assert broker.positions == {"A": 40}
    assert go(fall, signals(), at, START + dt.timedelta(days=1)) == "completed"  # the daily latch clears with the date
    broker.cash -= 2_000
    assert go(fall, signals(), at, START + dt.timedelta(days=1, hours=1)) == "drawdown"
    assert go(fall, signals(), at, START + dt.timedelta(days=2)) == "drawdown"


def test_day_trade_gate(spark, at):
    loop.LoopState(day_trades=["2025-12-30", "2026-01-01", "2026-01-02", "2026-01-05"]).save(at[2])
    go(session(spark), signals("A"), at)  # of the five weekdays up to Monday 5 January the first is 30 December
    assert [e["reason"] for e in at[3] if e["event_type"] == "entry_rejected"] == ["pdt"]
    state = loop.LoopState(day_trades=["2025-12-29", "2026-01-02"])
    assert state.recent_day_trades(dt.date(2026, 1, 5), RiskConfig()) == 1
    assert state.recent_day_trades(dt.date(2026, 1, 4), RiskConfig()) == 2


def test_reconciliation(spark, at):
    broker, _, path, log = at
    go(session(spark), signals("A"), at)
    broker.positions = {"Z": 3}
    broker.prices["Z"] = 1.0
    go(session(spark, 61), signals(), at)
    assert [(e["symbol"], e["kind"]) for e in log if e["event_type"] == "reconciliation_mismatch"] == [("A", "missing"), ("Z", "untracked")]
    assert loop.LoopState.load(path).positions == {}


def test_flatten_and_paper_only(at):
    broker, switch, _, _ = at
    broker.submit("A", "buy", 2, 10.0)
    assert loop.flatten(broker, switch) == 1 and switch.engaged and broker.positions == {} and broker.cash == 10_000.0
    with pytest.raises(ValueError):
        live.Broker(paper=False)


def test_live_bars(spark):
    t = dt.datetime(2026, 1, 5, 15, 0)  # 10:00 in New York
    rows = [("A", t, 1.0, 2.0, 1.0, 1.0, 1.0, 1), ("A", t, 1.0, 3.0, 1.0, 1.0, 1.0, 2), ("A", t + dt.timedelta(minutes=1), 1.0, 0.5, 1.0, 1.0, 1.0, 3), ("A", t.replace(hour=13), 1.0, 2.0, 1.0, 1.0, 1.0, 4)]
    got = loop.live_bars(spark.createDataFrame(rows, BARS + ", seq int"), order="seq").collect()
    assert [(r.ts, r.high) for r in got] == [(t, 2.0)]


def test_stream_exits(spark, tmp_path):
    opened, bars = str(tmp_path / "opened"), str(tmp_path / "bars")
    m = lambda k: START + dt.timedelta(minutes=k)
    own = "symbol string, ts timestamp, stop double, target double, deadline timestamp"
    spark.createDataFrame([(s, m(0), 99.0, 102.0, m(30)) for s in "STDQ"], own).coalesce(1).write.parquet(opened)
    rows = [("S", 1, 99.5, 101.0), ("S", 2, 98.0, 103.0), ("T", 3, 99.5, 102.5), ("D", 30, 99.5, 101.0), ("Q", 5, 99.5, 101.0), ("N", 5, 1.0, 200.0)]
    make = lambda x: spark.createDataFrame([(s, m(k), 100.0, hi, lo, 100.0, 1.0) for s, k, lo, hi in x], live.BAR).coalesce(1).write.mode("append").parquet(bars)

    def run():
        src = spark.readStream.schema(own).parquet(opened)
        q = loop.stream_exits(src, live.read_bars(spark, bars, 100)).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    make(rows)
    run()
    make([("N", 300, 1.0, 200.0)])  # the watermark passes Q's deadline
    run()
    got = {r.symbol: (r.ts, r.reason, r.price) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"S": (m(2), "stop_loss", 99.0), "T": (m(3), "take_profit", 102.0), "D": (m(30), "max_holding", 100.0), "Q": (m(30), "max_holding", 100.0)}
