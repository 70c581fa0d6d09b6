"""The live path gives what the batch path gives."""

import datetime as dt

import numpy as np
import pytest

from quantspark.streaming import live


def bars(spark, n=200):
    rng, rows = np.random.default_rng(2), []
    for s in ("A", "B"):
        close = 100 + np.cumsum(rng.normal(0, 1, n))
        rows += [(s, dt.datetime(2026, 1, 5) + dt.timedelta(minutes=i), float(c), float(c + 1), float(c - 1), float(c), 10.0) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, live.BAR)


def test_stream_equals_batch(spark, tmp_path):
    b = bars(spark)
    for k in range(4):  # files in order of time, one a micro-batch
        part = b.where(f"pmod(minute(ts) + 60 * hour(ts), 200) >= {50 * k} and minute(ts) + 60 * hour(ts) < {50 * (k + 1)}")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = live.stream_features(live.clean_stream(live.read_bars(spark, str(tmp_path / "in"))))
    q = s.writeStream.format("memory").queryName("feats").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.symbol, r.ts): r for r in spark.table("feats").collect()}
    want = live.batch_features(b).collect()
    assert len(got) == len(want) == 400
    for w in want:
        for c in ("ret_5", "ret_60", "range_position_20"):
            assert got[w.symbol, w.ts][c] == (None if w[c] is None else pytest.approx(w[c], abs=1e-9))


def test_exits_see_every_new_bar(spark):
    b = spark.createDataFrame([("A", dt.datetime(2026, 1, 5, 10, 0), 100.0, 100.0, 90.0, 100.0, 1.0), ("A", dt.datetime(2026, 1, 5, 10, 1), 100.0, 120.0, 100.0, 100.0, 1.0)], live.BAR)
    p = spark.createDataFrame([("A", 95.0, 110.0, dt.datetime(2026, 1, 9)), ("B", 1.0, 2.0, dt.datetime(2026, 1, 1))], "symbol string, stop double, target double, deadline timestamp")
    got = {r.symbol: r.reason for r in live.exits(p, b, dt.datetime(2026, 1, 5)).collect()}
    assert got == {"A": "stop_loss", "B": "max_holding"}


def test_loop_logs_and_stops(spark, tmp_path):
    bars(spark, 5).write.parquet(str(tmp_path / "in"))
    switch, seen = live.KillSwitch(tmp_path / "kill"), []
    run = lambda cp: live.run_iterations(live.read_bars(spark, str(tmp_path / "in"), 100), str(tmp_path / cp), broker, switch, lambda b, n, k: k.submit("A", "buy", 1, 2.0), seen.append).awaitTermination()
    broker = live.Broker()
    run("a")
    assert [e["event_type"] for e in seen] == ["fill", "loop_completed"] and broker.cash == 9_998.0
    switch.engage("test")
    run("b")
    assert seen[-1]["event_type"] == "kill_switch" and len(broker.fills) == 1
    switch.disengage()
    assert not switch.engaged
