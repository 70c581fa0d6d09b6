"""The query catalogue: one entry an operator, over the driver tables with parameters scaled to them."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.operators import calendar as cal_
from quantspark.operators import crosssection as cs
from quantspark.operators import features as ft
from quantspark.operators import hygiene as hy
from quantspark.operators import labels as lb
from quantspark.operators import metrics as mt
from quantspark.operators import monitor as mon
from quantspark.operators import options as op
from quantspark.operators import pead as pe
from quantspark.operators import risk as rk
from quantspark.operators import universe as un
from quantspark.schema import rounded
from quantspark.sources import adapters as ad

SESSION = hy.SessionConfig()
HOURLY = hy.SessionConfig(open_minute=0, close_minute=1440, bar_minutes=60, halt_gap=2)
SWEEP = ft.SweepConfig(accumulation=240, lookback=6, cap=24, open_minute=0)
MOM = cs.MomentumConfig(formation=20, skip=5, top=5, min_price=5.0, min_dollar_volume=1_000.0, volume_window=5)
EVENT = cs.EventConfig(sigma=1.5, volume=1.5, top=5, min_dollar_volume=1_000.0)
BARRIER = lb.BarrierConfig(profit=0.03, stop=0.03, horizon=5)
FEATURES = ["ret_5", "ret_15", "ret_30", "ret_60", "vol_30", "vol_60", "rel_vol_30", "vwap_dev", "rsi_14", "range_position_20"]
BENCHMARK = "Brand#11"
PROBES = [dt.date(1996, 6, 28), dt.date(1997, 6, 30), dt.date(1998, 6, 30), dt.date(1999, 6, 30)]

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def daily(spark: SparkSession, d: str) -> DataFrame:
    return ad.bars_daily(spark, d)


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """The panel before it is one: rows of line items, several a symbol and date."""
    items, parts = ad.read(spark, d, "lineitem"), ad.read(spark, d, "part")
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    p = F.col("p_retailprice")
    return items.join(parts, items.l_partkey == parts.p_partkey).select(
        F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"), p.alias("open"), p.alias("high"),
        (p - F.when(F.col("l_tax") == 0.08, F.lit(-1.0)).otherwise(0.0)).alias("low"), p.alias("close"), F.col("l_quantity").alias("volume"), seq.alias("seq"),
    )


def sessions(spark: SparkSession, d: str) -> DataFrame:
    """Intraday bars with daily session (the table has no market hours) for the session operators."""
    return ad.bars_intraday(spark, d)


def probes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in PROBES], "probe_date date")


def featured(spark: SparkSession, d: str) -> DataFrame:
    panel = daily(spark, d).withColumn("session_date", F.trunc("date", "month"))
    return ft.add_features(panel, time="date").drop("session_date")


# --- hygiene ---


@query
def dup_flags(spark, d):
    return hy.flag_duplicates(ad.raw_bars(spark, d), "symbol", "ts").select("symbol", "ts", "seq", "is_duplicate")


@query
def impossible_values(spark, d):
    return rounded(hy.flag_impossible(ad.raw_bars(spark, d)).where("is_impossible").select("symbol", "ts", "seq", "low", "volume"))


@query
def extreme_jumps(spark, d):
    from pyspark.sql import Window

    by = Window.partitionBy("symbol").orderBy("ts", "seq")
    return rounded(hy.flag_jumps(ad.raw_bars(spark, d), by, 0.5).where("is_jump").select("symbol", "ts", "seq", "close"))


@query
def regular_session(spark, d):
    return rounded(hy.regular_session(ad.raw_bars(spark, d), SESSION).select("symbol", "local_ts", "session_date", "seq", "close"))


@query
def halt_like_days(spark, d):
    bars = sessions(spark, d).withColumn("local_ts", F.col("ts"))
    return hy.halt_like_days(bars, HOURLY)


@query
def quality_report(spark, d):
    return hy.quality_report(ad.raw_bars(spark, d), SESSION)


@query
def clean_bars(spark, d):
    cfg = hy.SessionConfig(halt_gap=385)
    return rounded(hy.clean_bars(ad.raw_bars(spark, d), cfg).select("symbol", "session_date", "ts", "close", "volume"))


@query
def daily_quality(spark, d):
    return hy.daily_quality(arrivals(spark, d), 0.05)


@query
def discontinuity_split(spark, d):
    return rounded(hy.split_discontinuous(daily(spark, d), 0.08))


@query
def clean_daily_panel(spark, d):
    return rounded(hy.clean_daily_panel(arrivals(spark, d), 0.08).drop("seq"))


@query
def holdout_exclude(spark, d):
    period = (dt.date(1995, 5, 1), dt.date(1995, 7, 31))
    return rounded(hy.exclude_holdout(daily(spark, d), period=period))


@query
def fund_name_filter(spark, d):
    named = ad.read(spark, d, "part").select(F.col("p_partkey").alias("symbol"), _asset_name().alias("name"))
    return named.withColumn("is_fund", un.looks_like_fund("name"))


def _asset_name():
    """A company or fund name by part key."""
    kinds = ["Common Stock", "ETF", "Realty Trust", "Index Fund", "Holdings Inc", "Ultra Shares", "Bullfrog Spas", "Term Trust"]
    return F.concat(F.initcap("p_name"), F.lit(" "), F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 8 + 1).cast("int")))


def _assets(spark, d):
    return ad.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol"), _asset_name().alias("name"))


def _wanted(spark, d):
    """All parts as symbols, and some that no asset has."""
    extra = spark.createDataFrame([(s,) for s in ("TQQQ", "UVXY", "AAPL", "MSFT")], "symbol string")
    return ad.read(spark, d, "part").select(F.col("p_partkey").cast("string").alias("symbol")).union(extra)


@query
def exclude_funds(spark, d):
    return un.exclude_funds(_wanted(spark, d), _assets(spark, d))


@query
def asset_lookup(spark, d):
    return un.asset_names(_wanted(spark, d), _assets(spark, d))


@query
def candidate_assets(spark, d):
    assets = ad.read(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("symbol"), _asset_name().alias("name"), (F.col("p_size") > 5).alias("tradable"),
        F.when(F.col("p_partkey") % 3 == 0, "NYSE").when(F.col("p_partkey") % 3 == 1, "NASDAQ").otherwise("ARCA").alias("exchange"),
    )
    return un.candidate_assets(assets)


# --- universe ---


@query
def liquidity_filter(spark, d):
    return rounded(un.filter_by_liquidity(daily(spark, d), un.LiquidityConfig(min_dollar_volume=20_000.0)))


@query
def liquidity_screen(spark, d):
    cfg = un.ScreenConfig(min_dollar_volume=20_000.0, max_symbols=10)
    return rounded(un.screen_at_dates(daily(spark, d), probes(spark), cfg))


@query
def existence_probe(spark, d):
    return un.existing_symbols(daily(spark, d), probes(spark))


@query
def probe_sweep(spark, d):
    return un.existing_symbols(daily(spark, d), probes(spark), 2).groupBy("probe_date").agg(F.count("*").alias("n_symbols"))


@query
def union_universe(spark, d):
    return un.union_universe(un.screen_at_dates(daily(spark, d), probes(spark), un.ScreenConfig(min_dollar_volume=20_000.0, max_symbols=10)))


@query
def missing_symbols(spark, d):
    seen = un.existing_symbols(daily(spark, d), probes(spark), 1)
    return un.missing_symbols(daily(spark, d).select("symbol").distinct(), seen)


@query
def candidate_tickers(spark, d):
    return un.candidate_tickers(spark)


@query
def panel_cache_key(spark, d):
    from quantspark.sources import io

    return io.panel_key(daily(spark, d))


# --- features ---


def _feature(*names):
    def run(spark, d):
        return rounded(featured(spark, d).select("symbol", "date", *names))

    return run


for _name, _columns in {
    "feat_returns": FEATURES[:4], "feat_volatility": FEATURES[4:6], "feat_relvol": FEATURES[6:7], "feat_vwap_dev": FEATURES[7:8],
    "feat_rsi": FEATURES[8:9], "feat_range_pos": FEATURES[9:10], "feat_all": FEATURES,
}.items():
    QUERIES[_name] = _feature(*_columns)


@query
def feat_minutes(spark, d):
    local = hy.regular_session(ad.raw_bars(spark, d), SESSION)
    return local.select("symbol", "seq", ft.minutes_since_open(F.col("local_ts"), 570).cast("int").alias("minutes_since_open"))


@query
def po3_range(spark, d):
    return rounded(ft.add_sweeps(sessions(spark, d), SWEEP).select("symbol", "ts", "dist_to_accum_high", "dist_to_accum_low"))


@query
def po3_sweeps(spark, d):
    return ft.add_sweeps(sessions(spark, d), SWEEP).select(
        "symbol", "ts", "swept_accum_high_recent", "swept_accum_low_recent", "bars_since_sweep", "sweep_direction"
    )


@query
def fvg_bull(spark, d):
    return rounded(ft.add_gap(sessions(spark, d), "bull", 24).select("symbol", "ts", "bull_fvg_active", "bull_fvg_dist", "bars_since_bull_ifvg"))


@query
def fvg_bear(spark, d):
    return rounded(ft.add_gap(sessions(spark, d), "bear", 24).select("symbol", "ts", "bear_fvg_active", "bear_fvg_dist", "bars_since_bear_ifvg"))


# --- labels and folds ---


def labelled(spark, d):
    return lb.triple_barrier(daily(spark, d), BARRIER, "date")


@query
def triple_barrier(spark, d):
    return rounded(labelled(spark, d).select("symbol", "date", "label", "exit_bar_offset", "realized_return"))


@query
def class_balance(spark, d):
    return rounded(lb.class_balance(labelled(spark, d)))


@query
def walk_forward_folds(spark, d):
    return lb.walk_forward_folds(cal_.calendar(daily(spark, d)), 5, 4)


@query
def fold_split_counts(spark, d):
    panel = daily(spark, d)
    return lb.split_folds(panel, lb.walk_forward_folds(cal_.calendar(panel), 5, 4)).groupBy("fold_id", "part").agg(F.count("*").alias("n"))


@query
def dataset_rows(spark, d):
    panel = daily(spark, d).withColumn("session_date", F.trunc("date", "month"))
    kept = hy.exclude_holdout(panel, period=(dt.date(1995, 5, 1), dt.date(1995, 7, 31)))
    made = lb.dataset(ft.add_features(lb.triple_barrier(kept, BARRIER, "date"), time="date"), FEATURES)
    return rounded(made.select("symbol", "date", "target", "ret_5", "rsi_14"))


# --- cross-section ---


def scored(spark, d):
    return cs.momentum_scores(daily(spark, d), MOM)


def ends(spark, d):
    return cal_.month_ends(cal_.calendar(daily(spark, d)))


@query
def month_ends(spark, d):
    return ends(spark, d)


@query
def momentum_scores(spark, d):
    return rounded(scored(spark, d).where("score is not null").select("symbol", "date", "score"))


@query
def dollar_volume_21(spark, d):
    return rounded(scored(spark, d).where("dollar_volume is not null").select("symbol", "date", "dollar_volume"))


@query
def momentum_longs(spark, d):
    return rounded(cs.select_momentum(scored(spark, d), ends(spark, d), MOM))


@query
def momentum_shorts(spark, d):
    return rounded(cs.select_momentum(scored(spark, d), ends(spark, d), MOM, losers=True))


@query
def long_short_targets(spark, d):
    return rounded(cs.long_short_targets(scored(spark, d), ends(spark, d), MOM))


@query
def next_day_fill(spark, d):
    return cal_.next_session(ends(spark, d), cal_.calendar(daily(spark, d)))


def events(spark, d):
    return cs.detect_events(daily(spark, d), EVENT)


@query
def event_detect(spark, d):
    return rounded(events(spark, d).where("is_event").select("symbol", "date", "ret", "ret_sigma", "volume_multiple"))


@query
def event_summary(spark, d):
    return rounded(cs.event_summary(events(spark, d)))


@query
def forward_returns(spark, d):
    return rounded(cs.forward_returns(events(spark, d), EVENT))


@query
def drift_targets(spark, d):
    return rounded(cs.drift_targets(events(spark, d), EVENT))


# --- earnings ---


@query
def asof_reaction_day(spark, d):
    e = ad.earnings(spark, d).select("symbol", "announced", "order_key")
    return cal_.first_session(e, cal_.calendar(daily(spark, d)), "announced", True, "reaction_date")


def abnormal(spark, d):
    panel = daily(spark, d)
    bench = panel.where(F.col("symbol") == BENCHMARK).select("date", "close")
    return pe.abnormal_returns(ad.earnings(spark, d), panel, bench, cal_.calendar(panel), pe.PeadConfig(drift=10))


@query
def event_drift_ar(spark, d):
    return rounded(abnormal(spark, d).select("symbol", "announced", "order_key", "entry_date", "exit_date", "stock_return", "benchmark_return", "abnormal_return", "reaction_return"))


@query
def sue(spark, d):
    return rounded(pe.add_sue(ad.earnings(spark, d)).where("sue is not null").select("symbol", "announced", "order_key", "sue"))


def bucketed(spark, d):
    e = pe.add_sue(ad.earnings(spark, d))
    return pe.add_buckets(e.withColumn("sue", F.round("sue", 6)))


@query
def sue_buckets(spark, d):
    return bucketed(spark, d).select("symbol", "announced", "order_key", "bucket")


@query
def bucket_summary(spark, d):
    b = bucketed(spark, d).select("symbol", "order_key", "sue", "bucket")
    return rounded(pe.bucket_summary(b.join(abnormal(spark, d).select("symbol", "order_key", "abnormal_return"), ["symbol", "order_key"])))


# --- options ---


def one_brand(spark, d):
    return daily(spark, d).where(F.col("symbol") == BENCHMARK).select("date", "close")


def months(spark, d):
    p = one_brand(spark, d)
    return op.entry_days(op.option_months(p), p)


@query
def third_friday(spark, d):
    return op.option_months(one_brand(spark, d))


@query
def occ_symbols(spark, d):
    m = op.with_strike(months(spark, d), (1.0, 0.95))
    return m.select("expiry", "moneyness", op.occ_symbol(F.lit("SPY"), F.col("expiry"), F.lit("P"), F.col("strike")).alias("occ"))


@query
def option_entry_day(spark, d):
    return rounded(months(spark, d))


@query
def put_payoff(spark, d):
    return rounded(op.put_payoff(op.with_strike(months(spark, d))).drop("settle", "spot"))


@query
def moneyness_sweep(spark, d):
    return rounded(op.moneyness_summary(op.put_payoff(op.with_strike(months(spark, d)))))


@query
def crash_stress(spark, d):
    s = op.moneyness_summary(op.put_payoff(op.with_strike(months(spark, d))))
    return rounded(op.crash_stress(s))


@query
def straddle_pnl(spark, d):
    return rounded(op.straddle_pnl(op.with_strike(months(spark, d), (1.0,))))


# --- risk and costs ---


def orders(spark, d):
    return ad.read(spark, d, "orders")


@query
def sell_fees(spark, d):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return rounded(ad.read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.sum(rk.sell_fees(q * 1000, p)).alias("fees")), 2)


@query
def entry_fills(spark, d):
    limit = rk.FillConfig(kind="limit", limit_offset=0.001)
    return rounded(daily(spark, d).select("symbol", "date", rk.entry_fill(F.col("open"), F.col("low")).alias("market"), rk.entry_fill(F.col("open"), F.col("low"), limit).alias("limit_fill")))


@query
def exit_slippage(spark, d):
    return rounded(daily(spark, d).select("symbol", "date", rk.exit_fill(F.col("close")).alias("fill")))


@query
def fixed_fractional(spark, d):
    return orders(spark, d).select("o_orderkey", rk.fixed_fractional(F.col("o_totalprice"), F.lit(93.0), F.lit(0.01)).alias("shares"))


@query
def kelly(spark, d):
    p, b = F.col("o_orderkey") % 100 / 100, F.col("o_custkey") % 7 / 2
    return rounded(orders(spark, d).select("o_orderkey", rk.capped_kelly(p, b).alias("kelly")))


@query
def risk_gate(spark, d):
    o = orders(spark, d).select(
        "o_orderkey", F.col("o_totalprice").alias("equity"), F.lit(93.0).alias("price"), (F.col("o_totalprice") * (F.col("o_custkey") % 12 / 10)).alias("gross_exposure"),
        (F.col("o_custkey") % 5).alias("day_trades"), (F.col("o_orderkey") % 17 == 0).alias("drawdown_tripped"), (F.col("o_orderkey") % 13 == 0).alias("daily_tripped"),
    )
    return rk.risk_gate(o).select("o_orderkey", "shares", "reason")


def accounts(spark, d):
    """An equity track an account: events of a user type."""
    return ad.read(spark, d, "events").select(F.col("event_type").alias("account"), "ts", (F.lit(10_000.0) + F.col("value")).alias("equity"))


@query
def daily_loss_latch(spark, d):
    return rk.daily_loss_latch(accounts(spark, d), 0.004).select("account", "ts", "tripped")


@query
def drawdown_latch(spark, d):
    return rounded(rk.drawdown_latch(accounts(spark, d), 0.005).select("account", "ts", "peak", "tripped"))


@query
def pdt_window(spark, d):
    panel = daily(spark, d)
    trades = ad.read(spark, d, "lineitem").select(F.pmod("l_suppkey", F.lit(10)).alias("account"), F.col("l_shipdate").cast("date").alias("date"))
    return rk.pdt_window(trades.join(cal_.calendar(panel).select("date"), "date", "left_semi"), cal_.calendar(panel))


def curve(spark, d):
    """account, date, equity: closes of each brand."""
    return daily(spark, d).select(F.col("symbol").alias("account"), "date", F.col("close").alias("equity"))


@query
def vol_target_exposure(spark, d):
    return rounded(rk.vol_target_exposure(curve(spark, d), 0.5, 126).select("account", "date", "exposure"))


# --- metrics ---


def signals(spark, d):
    return labelled(spark, d).where("label is not null").select(F.lit("all").alias("account"), "symbol", "date", "label", "realized_return")


@query
def signal_metrics(spark, d):
    return rounded(mt.signal_metrics(signals(spark, d).withColumn("account", F.col("symbol"))))


def trades(spark, d):
    t = mon.fifo_trades(ad.fills(spark, d))
    return t.select(
        F.pmod("symbol", F.lit(5)).cast("string").alias("account"), F.col("symbol").cast("string").alias("symbol"), "exit_time", F.round("pnl", 4).alias("pnl"),
        (F.col("pnl") / F.nullif(F.col("qty") * F.col("entry_price"), F.lit(0.0))).alias("return_pct"),
        F.datediff("exit_time", "entry_time").alias("holding_bars"), (F.to_date("exit_time") == F.to_date("entry_time")).alias("is_day_trade"),
        F.when(F.col("pnl") > 0, "target").otherwise("stop").alias("exit_reason"),
    )


@query
def backtest_metrics(spark, d):
    # One brand for each of the five accounts.
    c = daily(spark, d).where(F.col("symbol").isin(*[f"Brand#{k}" for k in range(11, 16)])).select(
        (F.substring("symbol", -1, 1).cast("int") - 1).cast("string").alias("account"), "date", F.col("close").alias("equity")
    )
    return rounded(mt.backtest_metrics(trades(spark, d), c))


@query
def portfolio_metrics(spark, d):
    return rounded(mt.portfolio_metrics(curve(spark, d)))


@query
def equal_weight_bh(spark, d):
    return rounded(mt.equal_weight_curve(daily(spark, d)), 4)


@query
def benchmark_norm(spark, d):
    return rounded(mt.normalised(one_brand(spark, d)))


def two_curves(spark, d):
    p = daily(spark, d)
    pick = lambda s: p.where(F.col("symbol") == s).select("date", F.col("close").alias("equity"))
    return pick("Brand#12"), pick(BENCHMARK)


@query
def vol_matched(spark, d):
    return rounded(mt.vol_matched(*two_curves(spark, d)), 4)


@query
def paired_t(spark, d):
    return rounded(mt.paired_t(*two_curves(spark, d)))


@query
def welch_t(spark, d):
    from quantspark.functions.stats import welch_df
    from quantspark.functions.stats import welch_t as welch

    o = orders(spark, d)
    a, b = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))
    return rounded(o.agg(welch(a, b).alias("t_stat"), welch_df(a, b).alias("df")), 4)


@query
def regime_split(spark, d):
    v = featured(spark, d).select("symbol", "date", F.col("range_position_20").alias("vol"))
    s = signals(spark, d).join(v.where("vol is not null"), ["symbol", "date"])
    return rounded(mt.regime_split(s.withColumn("vol", F.round("vol", 6))))


@query
def buy_hold_baseline(spark, d):
    return rounded(mt.buy_and_hold(daily(spark, d)))


@query
def random_baseline(spark, d):
    s = signals(spark, d).withColumn("key", F.concat_ws("|", "symbol", "date"))
    return rounded(mt.signal_metrics(mt.random_entries(s, 500, "key")))


@query
def pnl_concentration(spark, d):
    return rounded(mt.pnl_concentration(trades(spark, d)), 4)


@query
def exit_reasons(spark, d):
    return rounded(mt.exit_reasons(trades(spark, d)))


# --- monitoring ---


@query
def fifo_trades(spark, d):
    return rounded(mon.fifo_trades(ad.fills(spark, d)))


@query
def daily_equity(spark, d):
    return rounded(mon.daily_equity(trades(spark, d)), 2)


@query
def divergence_flags(spark, d):
    m = rounded(mt.signal_metrics(signals(spark, d).withColumn("account", F.col("symbol"))))
    live, base = m.where(F.col("account") == "Brand#12"), m.where(F.col("account") == "Brand#13")
    return rounded(mon.divergence_flags(live, base, 0.05).drop("message"))


@query
def reconcile(spark, d):
    return mon.reconcile(*ad.positions(spark, d))


@query
def weekday_calendar(spark, d):
    return cal_.weekdays(daily(spark, d).agg(F.max("date").alias("date")), 30)


@query
def panel_without_benchmark(spark, d):
    return rounded(un.without_benchmark(daily(spark, d), BENCHMARK).groupBy("symbol").agg(F.count("*").alias("n_bars"), F.max("close").alias("high")))


@query
def live_metrics(spark, d):
    return rounded(mon.live_metrics(ad.fills(spark, d)), 4)


@query
def drawdown_resets(spark, d):
    """The latch of drawdown_latch, lifted by hand on two days for all accounts."""
    acc = accounts(spark, d)
    days = acc.agg(F.to_date(F.min("ts")).alias("d")).select(F.explode(F.array(F.date_add("d", 10), F.date_add("d", 20))).alias("day"))
    at = days.select(F.col("day").cast("timestamp_ntz").alias("reset_ts"))
    resets = acc.select("account").distinct().crossJoin(F.broadcast(at))  # two rows
    return rk.drawdown_latch(acc, 0.005, resets).groupBy("account").agg(F.count_if("tripped").alias("n_tripped"), F.count("*").alias("n"))


@query
def load_fills(spark, d):
    return rounded(ad.fills(spark, d))


@query
def signal_lookup(spark, d):
    from quantspark.operators.simulate import lookup_signals

    signals = arrivals(spark, d).select("symbol", "date", "seq", (F.col("volume") > 25).cast("int").alias("signal"))
    return lookup_signals(daily(spark, d).select("symbol", "date"), signals, "date")


@query
def option_legs(spark, d):
    m = op.with_strike(months(spark, d), (1.0,))
    right = F.explode(F.array(F.lit("C"), F.lit("P"))).alias("right")
    legs = m.select("expiry", "entry", "strike", "premium", right).where("not (right = 'P' and month(expiry) % 4 = 0)")
    bars = legs.select(
        op.occ_symbol(F.lit("SPY"), F.col("expiry"), F.col("right"), F.col("strike")).alias("occ"), F.col("entry").alias("date"),
        F.when(F.col("right") == "C", F.col("premium")).otherwise(F.col("premium") * 1.1).alias("close"),
    )
    return rounded(op.join_legs(m, bars, "SPY").select("expiry", "entry", "strike", "call_close", "put_close"))


@query
def accuracy(spark, d):
    s = labelled(spark, d).join(featured(spark, d).select("symbol", "date", "ret_5"), ["symbol", "date"]).where("label is not null and ret_5 is not null")
    return rounded(mt.accuracy(s.select((F.col("ret_5") > 0).cast("int").alias("predicted"), (F.col("label") == 1).cast("int").alias("target"))))


@query
def edge_rules(spark, d):
    i, o = F.col("high") / F.col("open") - 1, F.col("close") / F.col("open") - 1
    return daily(spark, d).select("symbol", "date", mon.sample_divergence(i, o).alias("diverges"), mon.baseline_edge(i, o).alias("edge"))


@query
def forward_fill(spark, d):
    panel = daily(spark, d)
    return rounded(mt.forward_filled(panel, cal_.calendar(panel)))


@query
def compounded_growth(spark, d):
    return rounded(mt.compounded(curve(spark, d)).select("account", "date", "growth"))


# --- simulators, learning, streaming: rows only ---


@query
def event_backtest(spark, d):
    """Long entries after a high close in the day's range; one account a brand."""
    from quantspark.operators import simulate as sm

    bars = featured(spark, d).select(
        F.col("symbol").alias("account"), "symbol", F.col("date").cast("timestamp").alias("ts"), "open", "high", "low", "close",
        (F.col("range_position_20") > 0.8).cast("int").alias("signal"),
    )
    cfg = sm.AccountConfig(equity=100_000.0, max_holding=5, risk=rk.RiskConfig(stop=0.03, target=0.03, daily_loss=0.5, drawdown=0.9))
    return rounded(sm.event_backtest(bars, cfg), 4)


@query
def portfolio_backtest(spark, d):
    from quantspark.operators import simulate as sm

    panel, plan = daily(spark, d), cs.long_short_targets(scored(spark, d), ends(spark, d), MOM)
    filled = cal_.next_session(plan, cal_.calendar(panel)).drop("date").withColumnRenamed("fill_date", "date")
    by_side = filled.where("side = 'long'").withColumn("account", F.lit("long_only")).unionByName(filled.withColumn("account", F.lit("long_short")))
    prices = panel.select(F.explode(F.array(F.lit("long_only"), F.lit("long_short"))).alias("account"), "date", "symbol", "open", "close")
    return rounded(sm.portfolio_backtest(prices, by_side), 4)


@query
def gbt_walk_forward(spark, d):
    """Accuracy and signal count of each fold's out-of-sample rows, with a small ensemble."""
    from quantspark.operators import ml

    panel = daily(spark, d).withColumn("session_date", F.trunc("date", "month"))
    data = lb.dataset(ft.add_features(lb.triple_barrier(panel, BARRIER, "date"), time="date"), FEATURES[:2] + FEATURES[9:]).drop("session_date").cache()
    folds = lb.walk_forward_folds(cal_.calendar(panel), 2, 4)
    out = ml.walk_forward(data, folds, FEATURES[:2] + FEATURES[9:], ml.ModelConfig(iterations=3, depth=3))
    return rounded(out.groupBy("fold_id").agg(F.count("*").alias("n"), F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"), F.sum("predicted").alias("n_signals")))


@query
def t_pvalue(spark, d):
    return rounded(mt.paired_t(*two_curves(spark, d), p_value=True))


@query
def stream_features(spark, d):
    """The hourly bars as a stream of daily files through keyed state."""
    import uuid

    from quantspark.session import shared_folder
    from quantspark.streaming import live

    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    bars = sessions(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    bars.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{at}/in")
    stream = live.stream_features(live.clean_stream(live.read_bars(spark, f"{at}/in", 100), "30 days"))
    run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.schema(live.OUT).parquet(f"{at}/out"))


@query
def stream_exits(spark, d):
    """Positions entered at the first close of each symbol, watched by keyed state over a stream of the hourly bars."""
    import uuid

    from quantspark.session import shared_folder
    from quantspark.streaming import live, loop

    at = f"{shared_folder(spark)}/exits-{uuid.uuid4().hex}"
    bars = sessions(spark, d).select("symbol", F.col("ts").cast("timestamp").alias("ts"), "open", "high", "low", "close", "volume")
    bars.write.parquet(f"{at}/bars")
    entry = spark.read.parquet(f"{at}/bars").groupBy("symbol").agg(F.min_by("close", "ts").alias("px"), F.min("ts").alias("ts"))
    opened = entry.select("symbol", "ts", (F.col("px") - 1000).alias("stop"), (F.col("px") * 3).alias("target"), (F.col("ts") + F.expr("interval 4 days")).alias("deadline"))
    opened.write.parquet(f"{at}/opened")
    source = spark.readStream.schema(opened.schema).parquet(f"{at}/opened")
    stream = loop.stream_exits(source, spark.readStream.schema(live.BAR).parquet(f"{at}/bars"), "30 days")
    run = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return rounded(spark.read.schema(stream.schema).parquet(f"{at}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz")))


@query
def entry_candidates(spark, d):
    """Symbols with enough hourly bars that end above their first open, and the gate's answer to them."""
    from quantspark.streaming import loop

    bars = sessions(spark, d)
    last, first = F.max_by("close", "ts"), F.min_by("open", "ts")
    scores = bars.groupBy("symbol").agg((last > first).cast("int").alias("predicted"), (last / (last + first)).alias("proba"))
    state = {"equity": F.lit(1e5), "gross_exposure": F.lit(9e4), "day_trades": F.lit(0), "drawdown_tripped": F.lit(False), "daily_tripped": F.lit(False)}
    asked = loop.candidates(bars, scores, ["signup"]).withColumns(state)
    return rounded(rk.risk_gate(asked).select("symbol", "price", "proba", "shares", "reason"))


@query
def position_exits(spark, d):
    """A position a brand, opened at its first close, against the bars after it."""
    from quantspark.streaming import live

    panel = daily(spark, d).withColumn("ts", F.col("date").cast("timestamp_ntz"))
    held = panel.groupBy("symbol").agg(F.min_by("close", "ts").alias("price"), F.min("ts").alias("since"))
    positions = held.select("symbol", (F.col("price") - 40).alias("stop"), (F.col("price") + 60).alias("target"), F.lit("1998-01-01").cast("timestamp_ntz").alias("deadline"))
    later = panel.join(held, "symbol").where("ts > since")
    return rounded(live.exits(positions, later, F.lit("1998-06-01").cast("timestamp_ntz")))
