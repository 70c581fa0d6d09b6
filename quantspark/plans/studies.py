"""Whole studies: from bars to a report's tables. Each takes DataFrames and returns named DataFrames.

What several tables of a study are made of (predictions, a simulated account) is written once to the shared folder.
"""

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.functions.stats import student_p, t_statistic
from quantspark.operators import calendar as cal
from quantspark.operators import crosssection as cs
from quantspark.operators import hygiene as hy
from quantspark.operators import labels as lb
from quantspark.operators import metrics as mt
from quantspark.operators import ml
from quantspark.operators import monitor as mon
from quantspark.operators import simulate as sm
from quantspark.operators import universe as un
from quantspark.session import written
from quantspark.sources.io import cache_or_fetch, write_cache

Tables = dict[str, DataFrame]


def cached_clean(
    spark: SparkSession, path: str, timeframe: str, symbols: list[str], fetch: Callable, use_cache: bool = True, session: hy.SessionConfig = hy.SessionConfig()
) -> Tables:
    """bars: cached or fetched ones of all symbols, cleaned; quality: what the raw ones were like. One job over all
    symbols. Raw bars have seq, the order of arrival."""
    if use_cache:
        raw = cache_or_fetch(spark, path, timeframe, symbols, fetch)
    else:
        raw = fetch(symbols)
        write_cache(raw, path, timeframe)
    return {"bars": hy.clean_bars(raw, session), "quality": hy.quality_report(raw, session)}


def training_data(
    spark: SparkSession, path: str, timeframe: str, symbols: list[str], fetch: Callable, session: hy.SessionConfig = hy.SessionConfig(),
    period: tuple[dt.date, dt.date] = hy.HOLDOUT,
) -> Tables:
    """bars without the holdout, and a quality row a symbol of those."""
    made = cached_clean(spark, path, timeframe, symbols, fetch, session=session)
    kept = hy.exclude_holdout(made["bars"], "session_date", period=period)
    return {"bars": kept, "quality": hy.quality_report(kept.drop("local_ts", "session_date"), session)}


@dataclass(frozen=True)
class SignalStudy:
    features: tuple[str, ...]
    folds: int = 5
    embargo: int = 4
    model: ml.ModelConfig = ml.ModelConfig()
    account: sm.AccountConfig = field(default_factory=sm.AccountConfig)
    time: str = "ts"


def predictions(data: DataFrame, cfg: SignalStudy) -> DataFrame:
    """data (symbol, date, OHLC, label, target, realized_return, the features) of every fold, scored, with part."""
    folds = lb.walk_forward_folds(cal.calendar(data), cfg.folds, cfg.embargo)
    return written(ml.walk_forward(data, folds, list(cfg.features), cfg.model, ("train", "test")))


def _signalled(scored: DataFrame, part: str) -> DataFrame:
    return scored.where((F.col("part") == part) & (F.col("predicted") == 1)).withColumn("account", F.col("fold_id").cast("string"))


def train_study(data: DataFrame, panel: DataFrame, cfg: SignalStudy, model_path: str | None = None, vol: str | None = None) -> Tables:
    """Class balance, metrics of the held-out signals by fold and over all, a random baseline of as many rows, buying and
    holding, and (with a column ``vol``) regimes; the model of all rows is saved at ``model_path``."""
    scored = predictions(data, cfg)
    chosen = _signalled(scored, "test")
    per_fold, key = mt.signal_metrics(chosen), F.concat_ws("|", "symbol", cfg.time)
    tested = scored.where("part = 'test'").withColumn("account", F.lit("random")).withColumn("_key", key)
    out = {
        "class_balance": lb.class_balance(data),
        "folds": per_fold.withColumnRenamed("account", "fold"),
        "accuracy": mt.accuracy(scored.where("part = 'test'")),
        "out_of_sample": mt.average_folds(per_fold),
        "random_baseline": mt.signal_metrics(mt.random_entries(tested, chosen.count(), "_key")),
        "buy_and_hold": mt.buy_and_hold(panel),
    }
    if vol:
        out["regimes"] = mt.regime_split(chosen.withColumn("vol", F.col(vol)), "vol")
    if model_path:
        ml.save_model(ml.fit(data, list(cfg.features), cfg.model), model_path)
    return out


def backtest_study(data: DataFrame, cfg: SignalStudy) -> Tables:
    """Held-out predictions traded by one account: metrics, exits, concentration, significance of the returns, and the
    in-sample beside the out-of-sample edge of the signals."""
    scored = predictions(data, cfg)
    bars = scored.where("part = 'test'").select(
        F.lit("all").alias("account"), "symbol", F.col(cfg.time).cast("timestamp").alias("ts"), "open", "high", "low", "close", F.col("predicted").alias("signal")
    )
    run = written(sm.event_backtest(bars, cfg.account))
    trades = run.where("kind = 'trade'").drop("kind", "date", "equity")
    curve = run.where("kind = 'equity'").select("account", "date", "equity")
    inside, outside = (mt.average_folds(mt.signal_metrics(_signalled(scored, p))).select(F.col("expectancy").alias(p)) for p in ("train", "test"))
    t = trades.agg(F.count("*").alias("n"), t_statistic(F.col("return_pct")).alias("t_stat"))
    return {
        "metrics": mt.backtest_metrics(trades, curve),
        "exits": mt.exit_reasons(trades),
        "concentration": mt.pnl_concentration(trades),
        "significance": t.withColumn("p_value", student_p("t_stat", (F.col("n") - 1).cast("double"))),
        "divergence": inside.crossJoin(outside).withColumn("diverges", mon.sample_divergence(F.col("train"), F.col("test"))),  # one row each
        "trades": trades,
        "equity": curve,
    }


def momentum_study(
    panel: DataFrame, benchmark: str, cfg: cs.MomentumConfig = cs.MomentumConfig(), account: sm.PortfolioConfig = sm.PortfolioConfig(), shorts: bool = False,
    include_holdout: bool = False, period: tuple[dt.date, dt.date] = hy.HOLDOUT, max_jump: float = 3.0,
) -> Tables:
    """Monthly momentum, filled at the next session's open, beside the benchmark held, matched to its volatility, and an
    equal-weighted universe. panel: symbol, date, OHLC, volume, and seq if days can repeat."""
    panel = panel if "seq" in panel.columns else panel.withColumn("seq", F.lit(0))
    clean = written(hy.exclude_holdout(hy.clean_daily_panel(panel, max_jump), exclude=not include_holdout, period=period))
    traded, days = un.without_benchmark(clean, benchmark), cal.calendar(clean)
    scored = cs.momentum_scores(traded, cfg)
    plan = cs.long_short_targets(scored, cal.month_ends(days), cfg)
    plan = plan if shorts else plan.where("side = 'long'")
    filled = cal.next_session(plan, days).drop("date").withColumnRenamed("fill_date", "date").withColumn("account", F.lit("momentum"))
    run = written(sm.portfolio_backtest(traded.select(F.lit("momentum").alias("account"), "date", "symbol", "open", "close"), filled, account))
    curve = run.where("kind = 'equity'").select("account", "date", "equity")
    own = curve.select("date", "equity")
    held = clean.where(F.col("symbol") == benchmark).select("date", "close")
    bench = mt.normalised(held, account.equity).select("date", "equity")
    matched = mt.vol_matched(own, bench, account.equity)
    even = mt.equal_weight_curve(traded, account.equity).select("date", "equity")
    named = lambda df, name: df.select(F.lit(name).alias("account"), "date", "equity")
    curves = curve.unionByName(named(bench, "benchmark")).unionByName(named(matched, "vol_matched")).unionByName(named(even, "equal_weight"))
    test = lambda other, name: mt.paired_t(own, other, p_value=True).withColumn("against", F.lit(name))
    rebalances = run.where("kind = 'rebalance'").select("date", "turnover", "n_positions", "symbols")
    trades = run.where("kind = 'trade'").select("date", "symbol", "side", "shares", "price", "fees")
    return {
        "quality": hy.daily_quality(panel),
        "metrics": mt.portfolio_metrics(curves),
        "tests": test(bench, "benchmark").unionByName(test(matched.select("date", "equity"), "vol_matched")),
        "totals": mt.trade_totals(trades, rebalances),
        "rebalances": rebalances,
        "trades": trades,
        "equity": curve,
    }
