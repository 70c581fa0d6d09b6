"""Operators on small hand-built frames."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantspark.functions.stats import two_sided_p
from quantspark.operators import calendar as cal
from quantspark.operators import crosssection as cs
from quantspark.operators import features as ft
from quantspark.operators import hygiene as hy
from quantspark.operators import labels as lb
from quantspark.operators import metrics as mt
from quantspark.operators import monitor as mon
from quantspark.operators import options as op
from quantspark.operators import pead as pe
from quantspark.operators import risk as rk
from quantspark.operators import simulate as sm
from quantspark.operators import universe as un
from quantspark.schema import require_columns
from quantspark.sources import io

OPEN = dt.datetime(2026, 1, 5, 14, 30)


def minute_bars(spark, n=390, start=OPEN, symbol="A", step=0.01):
    rows = [(symbol, start + dt.timedelta(minutes=i), 100 + step * i, 100.05 + step * i, 99.95 + step * i, 100 + step * i, 1000.0, i) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq long")


def daily_panel(spark, prices: dict[str, list], volume=1e6):
    rows = []
    for s, ps in prices.items():
        for i, p in enumerate(ps):
            if p is not None:
                rows.append((s, dt.date(2026, 1, 1) + dt.timedelta(days=i), *[float(p)] * 4, float(volume)))
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume double")


def test_required_columns(spark):
    with pytest.raises(ValueError, match="volume"):
        require_columns(spark.range(1).withColumn("open", F.lit(1)), ("open", "volume"))


def test_duplicates_keep_the_first_arrival(spark):
    b = minute_bars(spark, 3).union(minute_bars(spark, 1).withColumn("seq", F.lit(99)))
    flagged = hy.flag_duplicates(b, "symbol", "ts").where("is_duplicate").collect()
    assert [r.seq for r in flagged] == [99]


def test_session_and_halts(spark):
    whole = minute_bars(spark, 540, OPEN - dt.timedelta(minutes=90))
    inside = hy.regular_session(whole)
    assert inside.count() == 390
    gap = inside.where("hour(local_ts) <> 11")
    assert hy.halt_like_days(inside).count() == 0
    assert hy.halt_like_days(gap).first().n_missing == 60
    report = hy.quality_report(minute_bars(spark)).first()
    assert report.is_clean and report.n_rows == 390
    assert hy.clean_bars(whole).count() == 390


def test_discontinuity_keeps_rows_from_the_last_break(spark):
    panel = daily_panel(spark, {"A": [1, 10, 11, 60, 61], "B": [10, 25, 26, 27, 28]})
    kept = hy.split_discontinuous(panel, 3.0)
    assert sorted((r.symbol, r.close) for r in kept.collect()) == [("A", 60.0), ("A", 61.0)] + [("B", float(x)) for x in (10, 25, 26, 27, 28)]


def test_holdout(spark):
    df = spark.createDataFrame([(dt.date(2026, 4, 30),), (dt.date(2026, 5, 1),), (dt.date(2026, 7, 31),), (dt.date(2026, 8, 1),)], "date date")
    assert hy.exclude_holdout(df).count() == 2
    assert hy.exclude_holdout(df, exclude=False).count() == 4


@pytest.mark.parametrize(("name", "fund"), [("SPDR S&P 500 ETF", True), ("Direxion Daily Bull 3X", True), ("Camden Property Trust", False), ("Bullfrog AI Holdings", False), (None, False), ("", False)])
def test_fund_names(spark, name, fund):
    df = spark.createDataFrame([(name,)], "name string")
    assert df.select(un.looks_like_fund("name")).first()[0] is fund


def test_unknown_names_stay_but_leveraged_go(spark):
    symbols = spark.createDataFrame([("TQQQ",), ("OLD",), ("IDX",)], "symbol string")
    assets = spark.createDataFrame([("IDX", "Some Index Fund")], "symbol string, name string")
    assert [r.symbol for r in un.exclude_funds(symbols, assets).collect()] == ["OLD"]


def test_candidate_tickers(spark):
    t = {r.symbol for r in un.candidate_tickers(spark, 2).collect()}
    assert len(t) == 26 + 676 and {"A", "Z", "AA", "ZZ"} <= t
    assert un.candidate_tickers(spark).count() == 475_254


def test_liquidity_filter(spark):
    p = daily_panel(spark, {"LIQUID": [50, 50], "PENNY": [1, 1]}).union(daily_panel(spark, {"THIN": [50, 50]}, 10.0))
    assert [r.symbol for r in un.filter_by_liquidity(p).collect()] == ["LIQUID"]


def test_rsi_bounds_and_flat(spark):
    up = ft.add_features(minute_bars(spark, 40).withColumn("session_date", F.to_date("ts"))).orderBy("ts").collect()
    assert up[13].rsi_14 is None and up[14].rsi_14 == 100.0
    flat = ft.add_features(minute_bars(spark, 40, step=0.0).withColumn("session_date", F.to_date("ts"))).orderBy("ts").collect()
    assert flat[-1].rsi_14 is None
    assert up[4].ret_5 is None and up[5].ret_5 == pytest.approx(100.05 / 100 - 1)


def test_no_lookahead(spark):
    rng = np.random.default_rng(1)
    rows = [("A", OPEN + dt.timedelta(minutes=i), *(100 + rng.normal(0, 1, 4)).tolist(), 1000.0) for i in range(120)]
    b = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double").withColumn("session_date", F.to_date("ts"))
    cfg = ft.SweepConfig(open_minute=870)
    make = lambda x: ft.add_ict_features(ft.add_features(x), cfg)
    assert ft.unchanged_before(make, b, OPEN + dt.timedelta(minutes=80))


def test_barrier_cases(spark):
    def label(highs, lows, horizon=3):
        rows = [("A", i, 100.0, h, lo) for i, (h, lo) in enumerate(zip(map(float, highs), map(float, lows), strict=True))]
        b = spark.createDataFrame(rows, "symbol string, ts int, close double, high double, low double")
        both = [lb.triple_barrier(b, lb.BarrierConfig(horizon=horizon, array_horizon=n)).orderBy("ts").first() for n in (64, 0)]
        assert (both[0].label, both[0].exit_bar_offset) == (both[1].label, both[1].exit_bar_offset)
        return both[0].label, both[0].exit_bar_offset

    assert label([100, 103, 100, 100], [100, 99.5, 98, 100]) == (1, 1)
    assert label([100, 101, 103, 100], [100, 98.9, 100, 100]) == (-1, 1)
    assert label([100, 103, 100, 100], [100, 98, 100, 100]) == (-1, 1)
    assert label([100, 101, 101, 101], [100, 99.5, 99.5, 99.5]) == (0, 3)
    assert label([100, 101], [100, 99.5]) == (None, None)


def test_class_balance(spark):
    df = spark.createDataFrame([(1,)] * 90 + [(0,)] * 5 + [(-1,)] * 5 + [(None,)] * 10, "label int")
    r = {x.label: x for x in lb.class_balance(df).collect()}
    assert r[1].n == 90 and r[1].is_skewed and r[1].n_dropped == 10 and r[1].n_valid == 100


def test_folds(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    f = lb.walk_forward_folds(lb.trading_dates(spark, days), 5, 4).orderBy("fold_id").collect()
    assert [(x.train_end, x.test_start) for x in f][0] == (days[5], days[10]) and f[-1].test_end == days[-1]
    assert all(a.test_end < b.test_start for a, b in zip(f, f[1:], strict=False))
    with pytest.raises(ValueError, match="not enough"):
        lb.walk_forward_folds(lb.trading_dates(spark, days[:5]), 5, 4)


def test_momentum_counts_market_days(spark):
    p = daily_panel(spark, {"A": [10, None, 12, 13, 14, 15], "B": [1, 2, 3, 4, 5, 6]})
    s = {(r.symbol, r.i): r.score for r in cs.momentum_scores(p, cs.MomentumConfig(formation=4, skip=1)).collect()}
    assert s["A", 5] == pytest.approx(13 / 10 - 1) and s["A", 6] is None and s["B", 6] == pytest.approx(5 / 2 - 1)


def test_selection_ties_by_symbol_and_losers(spark):
    p = daily_panel(spark, {k: [10, 10, v] for k, v in {"C": 20, "A": 20, "B": 10}.items()})
    cfg = cs.MomentumConfig(formation=1, skip=0, top=2, volume_window=1)
    ends = cal.month_ends(cal.calendar(p))
    longs = [r.symbol for r in cs.select_momentum(cs.momentum_scores(p, cfg), ends, cfg).orderBy("rank").collect()]
    shorts = [r.symbol for r in cs.select_momentum(cs.momentum_scores(p, cfg), ends, cfg, losers=True).orderBy("rank").collect()]
    assert longs == ["A", "C"] and shorts == ["B", "A"]


def test_events_need_both_and_look_back_only(spark):
    prices = [100 + (i % 2) for i in range(62)] + [130]
    p = daily_panel(spark, {"A": prices}).withColumn("volume", F.when(F.col("close") == 130, 5e6).otherwise(1e6))
    found = cs.detect_events(p).where("is_event").collect()
    assert [r.close for r in found] == [130.0] and found[0].volume_multiple == 5.0
    assert cs.detect_events(daily_panel(spark, {"A": prices})).where("is_event").count() == 0


def test_strict_and_loose_next_session(spark):
    c = lb.trading_dates(spark, [dt.date(2026, 1, 2), dt.date(2026, 1, 5)])
    e = spark.createDataFrame([(dt.date(2026, 1, 2),), (dt.date(2026, 1, 3),), (dt.date(2026, 1, 9),)], "d date")
    look = lambda strict: [r.entry_date for r in cal.first_session(e, c, "d", strict).orderBy("d").collect()]
    assert look(True) == [dt.date(2026, 1, 5), dt.date(2026, 1, 5), None]
    assert look(False) == [dt.date(2026, 1, 2), dt.date(2026, 1, 5), None]


def test_sue_and_buckets(spark):
    rows = [("A", dt.date(2020, 1, 1) + dt.timedelta(days=i), i, 0.0, float(i % 3)) for i in range(10)]
    e = pe.add_sue(spark.createDataFrame(rows, "symbol string, announced date, order_key int, estimate_eps double, reported_eps double"))
    assert [r.sue is None for r in e.orderBy("announced").collect()] == [True] * 6 + [False] * 4
    x = spark.createDataFrame([(float(i), "A", dt.date(2020, 1, 1), i) for i in range(11)], "sue double, symbol string, announced date, order_key int")
    assert [r.bucket for r in pe.add_buckets(x).orderBy("sue").collect()] == [1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 5]


def test_option_dates_and_keys(spark):
    df = spark.createDataFrame([(dt.date(2026, 5, 20),), (dt.date(2026, 8, 1),)], "d date")
    assert [r[0] for r in df.select(op.third_friday("d")).collect()] == [dt.date(2026, 5, 15), dt.date(2026, 8, 21)]
    assert df.select(op.occ_symbol(F.lit("SPY"), F.col("d"), F.lit("P"), F.lit(450.5))).first()[0] == "SPY260520P00450500"


def test_fees_fills_sizing(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(rk.sell_fees(F.lit(100.0), F.lit(50.0))) == pytest.approx(5000 * 23.10e-6 + 0.0119)
    assert get(rk.sell_fees(F.lit(1e6), F.lit(1.0))) == pytest.approx(1e6 * 23.10e-6 + 5.95)
    assert get(rk.entry_fill(F.lit(100.0), F.lit(99.0))) == pytest.approx(100.05)
    limit = rk.FillConfig(kind="limit", limit_offset=0.01)
    assert get(rk.entry_fill(F.lit(100.0), F.lit(98.0), limit)) == 99.0 and get(rk.entry_fill(F.lit(100.0), F.lit(99.5), limit)) is None
    with pytest.raises(ValueError, match="unknown"):
        rk.entry_fill(F.lit(1.0), F.lit(1.0), rk.FillConfig(kind="iceberg"))
    assert get(rk.fixed_fractional(F.lit(10_000.0), F.lit(100.0), F.lit(0.01))) == 25
    assert get(rk.fixed_fractional(F.lit(10_000.0), F.lit(100.0), F.lit(0.10))) == 10
    assert get(rk.fixed_fractional(F.lit(0.0), F.lit(100.0), F.lit(0.01))) == 0
    assert get(rk.capped_kelly(F.lit(0.9), F.lit(2.0))) == 0.05 and get(rk.capped_kelly(F.lit(0.1), F.lit(1.0))) == 0.0


def test_latches(spark):
    t = lambda d, h: dt.datetime(2026, 1, d, h)
    rows = [("x", t(1, 9), 100.0), ("x", t(1, 10), 97.0), ("x", t(1, 11), 100.0), ("x", t(2, 9), 100.0), ("x", t(3, 9), 89.0), ("x", t(4, 9), 120.0)]
    e = spark.createDataFrame(rows, "account string, ts timestamp, equity double")
    assert [r.tripped for r in rk.daily_loss_latch(e).orderBy("ts").collect()] == [False, True, True, False, False, False]
    assert [r.tripped for r in rk.drawdown_latch(e).orderBy("ts").collect()] == [False, False, False, False, True, True]


def test_day_trade_window(spark):
    days = [dt.date(2026, 1, 1) + dt.timedelta(days=i) for i in range(8)]
    t = spark.createDataFrame([("x", days[0]), ("x", days[1]), ("x", days[2]), ("x", days[6])], "account string, date date")
    r = {x.date: (x.n_day_trades, x.allowed) for x in rk.pdt_window(t, lb.trading_dates(spark, days)).collect()}
    assert r[days[2]] == (3, False) and r[days[6]] == (2, True)


def test_fifo_splits_partial_sells(spark):
    rows = [("A", 1, "buy", 10, 1.0), ("A", 2, "sell", 6, 2.0), ("A", 3, "sell", 4, 3.0), ("A", 4, "sell", 5, 9.0)]
    f = spark.createDataFrame([(s, k, dt.datetime(2026, 1, k), side, q, p) for s, k, side, q, p in rows], "symbol string, seq long, ts timestamp, side string, qty long, price double")
    assert sorted((r.qty, r.exit_price) for r in mon.fifo_trades(f).collect()) == [(4, 3.0), (6, 2.0)]


def test_divergence_and_reconcile(spark):
    schema = "win_rate double, expectancy double, sharpe double, max_drawdown double"
    live, base = spark.createDataFrame([(0.2, 0.001, None, -0.1)], schema), spark.createDataFrame([(0.5, 0.001, 1.0, -0.1)], schema)
    assert [r.metric for r in mon.divergence_flags(live, base).collect()] == ["win_rate"]
    e, a = spark.createDataFrame([("A", 5), ("B", 1)], "symbol string, qty long"), spark.createDataFrame([("A", 5), ("C", 2)], "symbol string, qty long")
    assert sorted(tuple(r) for r in mon.reconcile(e, a).collect()) == [("B", 1, 0), ("C", 0, 2)]


def test_portfolio_metrics_start_at_the_first_equity(spark):
    c = spark.createDataFrame([("x", dt.date(2026, 1, i + 1), v) for i, v in enumerate([100.0, 110.0, 99.0, 120.0])], "account string, date date, equity double")
    m = mt.portfolio_metrics(c).first()
    assert m.total_return == pytest.approx(0.2) and m.max_drawdown == pytest.approx(-0.1)


def test_student_p_values():
    p = two_sided_p(np.array([2.0, 0.0, 2.228139, 12.7062]), np.array([10.0, 5.0, 10.0, 1.0]))
    assert p == pytest.approx([0.07338803, 1.0, 0.05, 0.05], abs=1e-5)


def account_bars(spark, bars):
    rows = [("acct", "A", dt.datetime(2026, 1, 5, 10, i), *b) for i, b in enumerate(bars)]
    return spark.createDataFrame(rows, "account string, symbol string, ts timestamp, open double, high double, low double, close double, signal int")


def test_account_fills_at_the_next_bar_and_stop_wins(spark):
    flat = (100.0, 100.0, 100.0, 100.0)
    out = sm.event_backtest(account_bars(spark, [(*flat, 1), (*flat, 0), (100.0, 110.0, 90.0, 100.0, 0)])).where("kind = 'trade'").collect()
    assert len(out) == 1 and out[0].exit_reason == "stop_loss" and out[0].entry_price == pytest.approx(100.05) and out[0].holding_bars == 1
    assert out[0].is_day_trade and out[0].shares == 24


def test_account_closes_at_the_end(spark):
    flat = (100.0, 100.0, 100.0, 100.0)
    out = sm.event_backtest(account_bars(spark, [(*flat, 1), (*flat, 0), (*flat, 0)]))
    assert [r.exit_reason for r in out.where("kind = 'trade'").collect()] == ["end_of_data"]


def test_portfolio_buys_sells_and_drops(spark):
    d = [dt.date(2026, 1, i) for i in range(1, 5)]
    rows = [("p", d[0], "A", 10.0, 10.0), ("p", d[1], "A", 10.0, 11.0), ("p", d[2], "A", 12.0, 12.0), ("p", d[3], "B", 5.0, 5.0)]
    rows += [("p", x, "B", 5.0, 5.0) for x in d[:3]]
    prices = spark.createDataFrame(rows, "account string, date date, symbol string, open double, close double")
    plan = spark.createDataFrame([("p", d[0], "long", 1, "A"), ("p", d[3], "long", 1, "B")], "account string, date date, side string, rank int, symbol string")
    out = sm.portfolio_backtest(prices, plan, sm.PortfolioConfig(slippage_bps=0.0)).collect()
    trades = [(r.symbol, r.side, r.shares) for r in out if r.kind == "trade"]
    equity = {r.date: r.equity for r in out if r.kind == "equity"}
    assert trades == [("A", "buy", 1000), ("A", "drop_no_price", 1000)]
    assert equity[d[1]] == 11_000.0 and equity[d[3]] == 0.0


def test_portfolio_shorts_pay_to_borrow(spark):
    d = [dt.date(2026, 1, i) for i in range(1, 3)]
    prices = spark.createDataFrame([("p", x, "A", 10.0, 10.0) for x in d], "account string, date date, symbol string, open double, close double")
    plan = spark.createDataFrame([("p", d[0], "short", 1, "A")], "account string, date date, side string, rank int, symbol string")
    out = sm.portfolio_backtest(prices, plan, sm.PortfolioConfig(slippage_bps=0.0)).where("kind = 'equity'").orderBy("date").collect()
    day = 10_000 * 0.03 / 252
    assert out[0].equity - out[1].equity == pytest.approx(day) and out[0].equity < 10_000


def test_cache_fetches_once(spark, tmp_path):
    calls = []

    def fetch(symbols):
        calls.append(symbols)
        return minute_bars(spark, 3, symbol=symbols[0]).drop("seq")

    for _ in range(2):
        assert io.cache_or_fetch(spark, str(tmp_path / "c"), "1m", ["A"], fetch).count() == 3
    assert calls == [["A"]]


def test_verified_fetch_asks_again_for_the_missing(spark):
    asked = []

    def fetch(symbols):
        names = sorted(r.symbol for r in symbols.collect())
        asked.append(names)
        return spark.createDataFrame([(s,) for s in names if s != "FRCB" or len(names) == 1], "symbol string")

    got = io.verified_fetch(fetch, spark.createDataFrame([("AAPL",), ("FRC",), ("FRCB",)], "symbol string"))
    assert got.count() == 3 and ["FRCB"] in asked


def test_logs_and_runs(spark, tmp_path):
    e = spark.createDataFrame([("fill", "A", "buy", 1, 2.0), ("signal", "A", None, None, None)], "event_type string, symbol string, side string, qty long, price double")
    io.append_log(e, str(tmp_path / "log"))
    assert io.load_fills(spark, str(tmp_path / "log")).count() == 1
    assert [io.append_run(spark, str(tmp_path / "runs"), phase="x", params_json={"a": 1}, sharpe=1.5) for _ in range(2)] == [1, 2]
    assert io.read_runs(spark, str(tmp_path / "runs")).where("run_id = 2").first().sharpe == 1.5
    assert io.load_state(str(tmp_path / "none")) == {}


def test_report_table():
    assert "n/a" in io.markdown_table([{"a": math.nan, "b": 1.5}], "T")


def test_fold_averages_skip_nulls(spark):
    f = spark.createDataFrame([(0.5, 0.1, None, -0.1, 3), (0.7, 0.3, 2.0, -0.3, 4)], "win_rate double, expectancy double, sharpe double, max_drawdown double, n_trades int")
    r = mt.average_folds(f).first()
    assert (r.win_rate, r.sharpe, r.n_trades) == (pytest.approx(0.6), 2.0, 7)


def test_signal_lookup_takes_the_last_of_several(spark):
    bars = spark.createDataFrame([("A", 1), ("A", 2)], "symbol string, ts int")
    found = spark.createDataFrame([("A", 1, 1, 0), ("A", 1, 2, 1)], "symbol string, ts int, seq int, signal int")
    assert [r.signal for r in sm.lookup_signals(bars, found).orderBy("ts").collect()] == [1, 0]


def test_buckets_are_whole_and_even_on_many_rows(spark):
    x = spark.range(400_000).select(
        (F.rand(3) * 4).alias("sue"), F.lit("s").alias("symbol"), F.col("id").alias("announced"), F.col("id").alias("order_key"), F.rand(4).alias("more")
    )
    x = x.withColumn("sue", F.when(F.col("order_key") % 3 == 0, 1.5).otherwise(F.col("sue")))  # a third are ties
    for adaptive in ("true", "false"):
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        n = {r["bucket"]: r["count"] for r in pe.add_buckets(x, pe.PeadConfig(ranges=16)).groupBy("bucket").count().collect()}
        assert set(n) == {1, 2, 3, 4, 5} and sum(n.values()) == 400_000 and max(n.values()) - min(n.values()) <= 2
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert pe.add_buckets(x.limit(0)).count() == 0


def test_drawdown_latch_is_lifted_by_a_reset(spark):
    from quantspark.operators import risk as rk

    rows = [("a", dt.datetime(2024, 1, k + 1), e) for k, e in enumerate([100.0, 85.0, 90.0, 90.0, 89.0, 80.0])]
    eq = spark.createDataFrame(rows, "account string, ts timestamp, equity double")
    resets = spark.createDataFrame([("a", dt.datetime(2024, 1, 4))], "account string, reset_ts timestamp")
    got = [(r.peak, r.tripped) for r in rk.drawdown_latch(eq, 0.1, resets).orderBy("ts").collect()]
    assert got == [(100, False), (100, True), (100, True), (90, False), (90, False), (90, True)]
    assert [r.tripped for r in rk.drawdown_latch(eq, 0.1).orderBy("ts").collect()] == [False] + [True] * 5


def test_model_round_trip_and_both_samples(spark, tmp_path):
    from quantspark.operators import ml

    rows = [(i, dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7), float(i % 3), int(i % 7 > 3), 0.01 * (i % 7 - 3)) for i in range(120)]
    data = spark.createDataFrame(rows, "id long, date date, x double, y double, target int, realized_return double")
    folds = spark.createDataFrame([(0, rows[0][1], rows[59][1], rows[62][1], rows[119][1])], "fold_id int, train_start date, train_end date, test_start date, test_end date")
    cfg = ml.ModelConfig(iterations=3, depth=2)
    model = ml.fit(data, ["x", "y"], cfg)
    ml.save_model(model, str(tmp_path / "m"))
    again = ml.load_model(str(tmp_path / "m"))
    assert ml.score(model, data, cfg).select("id", "proba").collect() == ml.score(again, data, cfg).select("id", "proba").collect()
    got = {r.part: r for r in ml.in_and_out_of_sample(data, folds, ["x", "y"], cfg).collect()}
    assert set(got) == {"train", "test"} and got["train"].n == 60 and got["train"].accuracy == 1 and got["test"].mean_return > 0


def test_panel_file_retries_names_and_dashboard(spark, tmp_path):
    from quantspark.operators import universe as un
    from quantspark.sources import io

    calls = []

    def fetch(symbols, first, last):
        calls.append(symbols)
        return spark.createDataFrame([(s, first) for s in symbols], "symbol string, date string")

    for order in (["B", "A"], ["A", "B"]):
        assert io.panel_or_fetch(spark, str(tmp_path), order, "2024-01-01", "2024-02-01", fetch).count() == 2
    assert len(calls) == 1
    waits, left = [], [ValueError, ValueError]

    def call():
        if left:
            raise left.pop()
        return 7

    assert io.with_retries(call, sleep=waits.append) == 7 and waits == [3.0, 6.0]
    with pytest.raises(ZeroDivisionError):
        io.with_retries(lambda: 1 // 0, attempts=2, sleep=waits.append)
    files = spark.createDataFrame([("/a/b/BRK.B_1min.parquet",), ("AAPL_1Day_x.parquet",)], "p string")
    assert [r[0] for r in files.select(un.symbol_of_file(F.col("p"))).collect()] == ["BRK.B", "AAPL"]
    text = io.dashboard(11_000.0, 10_000.0, {"AAPL": 3}, 1)
    assert "+1,000.00" in text and "AAPL: 3" in text and "1/3" in text
    io.write_report(text, str(tmp_path / "r" / "x.md"))
    assert (tmp_path / "r" / "x.md").read_text() == text
