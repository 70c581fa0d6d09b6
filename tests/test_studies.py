"""Whole studies on small tables, through the command line and directly."""

import datetime as dt

import pytest

from quantspark.__main__ import main, signal_data
from quantspark.operators import ml
from quantspark.operators import simulate as sm
from quantspark.plans import queries as q
from quantspark.plans import studies as st
from quantspark.sources.io import cache_or_fetch
from quantspark.streaming import live

SF = "/root/testdata/sf0.01"
SMALL = st.SignalStudy(("ret_5", "range_position_20"), 2, model=ml.ModelConfig(iterations=2, depth=2, threshold=0.3), account=sm.AccountConfig(equity=100_000.0, max_holding=5), time="date")


def test_train_and_backtest(spark, tmp_path):
    data, panel = signal_data(spark, SF)
    made = {n: t.collect() for n, t in st.train_study(data, panel, SMALL, str(tmp_path / "model"), "range_position_20").items()}
    assert sum(r.n for r in made["class_balance"]) == data.count()
    signals = sum(r.n_trades for r in made["folds"])
    assert made["random_baseline"][0].n_trades == signals == made["out_of_sample"][0].n_trades
    assert 0 <= made["accuracy"][0].accuracy <= 1 and sum(r.n_trades for r in made["regimes"]) == signals
    assert ml.score(ml.load_model(str(tmp_path / "model")), data).count() == data.count()
    run = {n: t.collect() for n, t in st.backtest_study(data, SMALL).items()}
    assert run["metrics"][0].n_trades == len(run["trades"]) == sum(r.n for r in run["exits"]) if run["trades"] else not run["metrics"]
    assert len({r.date for r in run["equity"]}) == len(run["equity"])


def test_momentum(spark):
    panel = q.daily(spark, SF)
    made = {n: t.collect() for n, t in st.momentum_study(panel, q.BENCHMARK, q.MOM).items()}
    assert {r.account for r in made["metrics"]} == {"momentum", "benchmark", "vol_matched", "equal_weight"}
    assert {r.against for r in made["tests"]} == {"benchmark", "vol_matched"}
    assert all(q.BENCHMARK != r.symbol for r in made["trades"]) and made["totals"][0].n_trades == len(made["trades"]) > 0
    assert len(made["equity"]) == panel.select("date").distinct().count()
    # A held-out period is left out unless it is asked for.
    period = (dt.date(1997, 1, 1), dt.date(1997, 6, 30))
    inside = lambda rows: [r for r in rows if period[0] <= r.date <= period[1]]
    assert inside(made["equity"]) and not inside(st.momentum_study(panel, q.BENCHMARK, q.MOM, period=period)["equity"].collect())
    assert inside(st.momentum_study(panel, q.BENCHMARK, q.MOM, period=period, include_holdout=True)["equity"].collect())


def test_fetch_cleans_and_caches(spark, tmp_path):
    asked, rows = [], []
    for day in (4, 5):  # 4 May 2026 is held out by the period given
        rows += [("A", dt.datetime(2026, 5, day, h), 1.0, 2.0, 1.0, 1.5, 1.0, h) for h in range(24)]
    raw = spark.createDataFrame([*rows, rows[-1]], "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double, seq int")

    def fetch(symbols):
        asked.append(symbols)
        return raw

    cfg = q.hy.SessionConfig(zone="UTC", open_minute=0, close_minute=1440, bar_minutes=60, halt_gap=2)
    for _ in range(2):
        made = st.training_data(spark, str(tmp_path / "c"), "1H", ["A"], fetch, cfg, (dt.date(2026, 5, 4),) * 2)
        assert made["bars"].count() == 24 and made["quality"].first().is_clean
    assert asked == [["A"]]
    st.cached_clean(spark, str(tmp_path / "c"), "1H", ["A"], fetch, False, cfg)
    assert len(asked) == 2


def test_command_line(spark, tmp_path, capsys):
    flag = str(tmp_path / "flag")
    assert main(["kill-switch", flag, "--action", "engage"]) == 0 and live.KillSwitch(flag).engaged
    assert main(["kill-switch", flag]) == 0 and main(["kill-switch", flag, "--action", "disengage"]) == 0
    assert capsys.readouterr().out.split("\n")[:3] == ["engaged", "engaged", "not engaged"]
    out = tmp_path / "r.md"
    assert main(["momentum", SF, "--out", str(out), "--refresh-universe", str(tmp_path / "u"), "--rows", "3"]) == 0
    assert "## metrics" in out.read_text() and spark.read.text(str(tmp_path / "u")).count() > 0
    data, _ = signal_data(spark, SF)
    ml.save_model(ml.fit(data, ["ret_5", "range_position_20"], SMALL.model), str(tmp_path / "m"))
    start = dt.datetime(2026, 1, 5, 15)
    rows = [("A", start + dt.timedelta(minutes=i), 10.0, 11.0 + i % 3, 9.0, 10.0 + i % 2, 5.0) for i in range(70)]
    spark.createDataFrame(rows, live.BAR).write.parquet(str(tmp_path / "bars"))
    args = ["loop", str(tmp_path / "bars"), "--model", str(tmp_path / "m"), "--state", str(tmp_path / "s.json"), "--flag", flag, "--log", str(tmp_path / "log")]
    assert main(args) == 0 and "loop_completed" in (tmp_path / "log").read_text()
    live.KillSwitch(flag).engage()
    assert main(args) == 1


def test_ranges_are_cached_apart(spark, tmp_path):
    asked = []

    def fetch(n):
        return lambda symbols: asked.append(n) or spark.range(n).selectExpr("'A' symbol", "timestamp_seconds(id) ts", "id * 1.0d close")

    for n, last in ((2, "2026-01-02"), (5, "2026-01-05"), (2, "2026-01-02")):
        assert cache_or_fetch(spark, str(tmp_path / "c"), "1Min", ["A"], fetch(n), first="2026-01-01", last=last).count() == n
    assert asked == [2, 5]


def test_unknown_query(spark):
    with pytest.raises(KeyError):
        main(["query", SF, "--name", "nothing"])
