"""Performance metrics and benchmarks over equity curves and trades."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.functions.stats import student_p, t_statistic

YEAR = 252


def _over_time(column: str = "date"):
    return Window.partitionBy("account").orderBy(column)


def with_returns(curve: DataFrame) -> DataFrame:
    """curve (account, date, equity) + ret, peak, drawdown (from the first observed equity on)."""
    by = _over_time()
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    e = curve.withColumn("ret", F.col("equity") / F.nullif(F.lag("equity").over(by), F.lit(0.0)) - 1).withColumn("peak", F.max("equity").over(upto))
    return e.withColumn("drawdown", F.col("equity") / F.nullif(F.col("peak"), F.lit(0.0)) - 1)


def sharpe(r, year: int = YEAR):
    return F.avg(r) / F.nullif(F.stddev_samp(r), F.lit(0.0)) * F.sqrt(F.lit(float(year)))


def sortino(r, year: int = YEAR):
    return F.avg(r) / F.nullif(F.stddev_samp(F.when(r < 0, r)), F.lit(0.0)) * F.sqrt(F.lit(float(year)))


def portfolio_metrics(curve: DataFrame) -> DataFrame:
    """account, n_days, total_return, cagr, annual_vol, sharpe, sortino, max_drawdown; null below two days."""
    r = F.col("ret")
    total = F.max_by("equity", "date") / F.nullif(F.min_by("equity", "date"), F.lit(0.0))
    return with_returns(curve).groupBy("account").agg(
        F.count("*").alias("n_days"), (total - 1).alias("total_return"),
        F.when(F.count("*") >= 2, F.pow(total, YEAR / F.count("*")) - 1).alias("cagr"), (F.stddev_samp(r) * F.sqrt(F.lit(float(YEAR)))).alias("annual_vol"),
        sharpe(r).alias("sharpe"), sortino(r).alias("sortino"), F.min("drawdown").alias("max_drawdown"),
    )


def backtest_metrics(trades: DataFrame, curve: DataFrame) -> DataFrame:
    """One row an account: n_trades, win_rate, expectancy, profit_factor, avg_duration, sharpe, sortino, max_drawdown,
    total_return. Without losses profit_factor is null (it has no bound)."""
    won = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")))
    lost = F.coalesce(-F.sum(F.when(F.col("pnl") < 0, F.col("pnl"))), F.lit(0.0))
    per = trades.groupBy("account").agg(
        F.count("*").alias("n_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg("return_pct").alias("expectancy"),
        (F.coalesce(won, F.lit(0.0)) / F.nullif(lost, F.lit(0.0))).alias("profit_factor"), F.avg("holding_bars").alias("avg_duration"),
    )
    return per.join(portfolio_metrics(curve).select("account", "sharpe", "sortino", "max_drawdown", "total_return"), "account", "left")


def signal_metrics(signals: DataFrame) -> DataFrame:
    """signals (account, date, label, realized_return): n_trades, win_rate, expectancy, and sharpe and max_drawdown of
    the daily mean returns, compounded."""
    head = signals.groupBy("account").agg(
        F.count("*").alias("n_trades"), F.avg((F.col("label") == 1).cast("double")).alias("win_rate"), F.avg("realized_return").alias("expectancy")
    )
    daily = signals.groupBy("account", "date").agg(F.avg("realized_return").alias("r"))
    upto = _over_time().rowsBetween(Window.unboundedPreceding, 0)
    c = daily.withColumn("_e", F.exp(F.sum(F.log1p("r")).over(upto)))
    c = c.withColumn("_dd", F.col("_e") / F.max("_e").over(upto) - 1)
    return head.join(c.groupBy("account").agg(sharpe(F.col("r")).alias("sharpe"), F.min("_dd").alias("max_drawdown")), "account", "left")


def equal_weight_curve(panel: DataFrame, start: float = 10_000.0) -> DataFrame:
    """(date, equity): equal parts of every symbol that trades on the first day, held; later listings aren't bought.

    Prices carry forward over missing days: on each day a symbol counts with its last known one.
    """
    first = panel.agg(F.min("date").alias("_f"))
    bought = panel.crossJoin(F.broadcast(first)).where("date = _f and close > 0").select("symbol", F.col("close").alias("_p0"))
    n = bought.agg(F.count("*").alias("_n"))
    held = panel.join(F.broadcast(bought), "symbol")
    change = held.withColumn("_v", F.col("close") / F.col("_p0")).withColumn("_d", F.col("_v") - F.coalesce(F.lag("_v").over(Window.partitionBy("symbol").orderBy("date")), F.lit(0.0)))
    # A day's total moves by the changes of those that trade; days on which none of them does keep the last total.
    per_day = change.groupBy("date").agg(F.sum("_d").alias("_d"))
    dates = panel.select("date").distinct().join(per_day, "date", "left").crossJoin(F.broadcast(n))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return dates.select("date", (F.sum(F.coalesce("_d", F.lit(0.0))).over(upto) * start / F.col("_n")).alias("equity"))


def normalised(prices: DataFrame, start: float = 10_000.0) -> DataFrame:
    """(date, equity) of one price series scaled to ``start`` on its first day."""
    whole = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return prices.select("date", (F.col("close") / F.first("close").over(whole) * start).alias("equity"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(date, a, b): returns of two curves on their common dates."""
    joined = a.select("date", F.col("equity").alias("ea")).join(b.select("date", F.col("equity").alias("eb")), "date")
    by = Window.orderBy("date")
    ret = lambda c: F.col(c) / F.nullif(F.lag(c).over(by), F.lit(0.0)) - 1
    return joined.select("date", ret("ea").alias("a"), ret("eb").alias("b")).where("a is not null and b is not null")


def vol_matched(strategy: DataFrame, benchmark: DataFrame, start: float = 10_000.0) -> DataFrame:
    """(date, leverage, equity): the benchmark levered to the strategy's volatility, compounded daily."""
    both = aligned(strategy, benchmark)
    lever = both.agg((F.stddev_samp("a") / F.nullif(F.stddev_samp("b"), F.lit(0.0))).alias("leverage"))
    upto = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return both.crossJoin(F.broadcast(lever)).select("date", "leverage", (F.product(1 + F.col("b") * F.col("leverage")).over(upto) * start).alias("equity"))


def paired_t(strategy: DataFrame, benchmark: DataFrame, p_value: bool = False) -> DataFrame:
    """n, mean_diff, t_stat of the daily differences (and p_value on request)."""
    out = aligned(strategy, benchmark).select((F.col("a") - F.col("b")).alias("d")).agg(F.count("*").alias("n"), F.avg("d").alias("mean_diff"), t_statistic(F.col("d")).alias("t_stat"))
    return out.withColumn("p_value", student_p("t_stat", (F.col("n") - 1).cast("double"))) if p_value else out


def regime_split(signals: DataFrame, vol: str = "vol") -> DataFrame:
    """signals (account, date, label, realized_return, vol): metrics of days with at least the median mean volatility
    (high_vol) and the others (low_vol)."""
    days = signals.groupBy("date").agg(F.avg(vol).alias("_v"))
    mid = days.agg(F.median("_v").alias("_m"))
    flags = days.crossJoin(F.broadcast(mid)).select("date", F.when(F.col("_v") >= F.col("_m"), "high_vol").otherwise("low_vol").alias("regime"))
    tagged = signals.join(F.broadcast(flags), "date").withColumn("account", F.col("regime"))
    return signal_metrics(tagged).withColumnRenamed("account", "regime")


def buy_and_hold(panel: DataFrame) -> DataFrame:
    """n_symbols, mean_return over the symbols with two rows or more."""
    per = panel.groupBy("symbol").agg((F.max_by("close", "date") / F.nullif(F.min_by("close", "date"), F.lit(0.0)) - 1).alias("r"), F.count("*").alias("n")).where("n >= 2")
    return per.agg(F.count("*").alias("n_symbols"), F.avg("r").alias("mean_return"))


def random_entries(candidates: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, alike in every run: those with the least hash of key and seed."""
    return candidates.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def pnl_concentration(trades: DataFrame) -> DataFrame:
    """n_symbols, n_positive, top_symbol, top_share of the positive result."""
    per = trades.groupBy("symbol").agg(F.sum("pnl").alias("p"))
    gain = F.sum(F.when(F.col("p") > 0, F.col("p")))
    return per.agg(
        F.count("*").alias("n_symbols"), F.count_if(F.col("p") > 0).alias("n_positive"), F.max_by("symbol", F.struct("p", "symbol")).alias("top_symbol"),
        (F.max("p") / F.nullif(gain, F.lit(0.0))).alias("top_share"),
    )


def exit_reasons(trades: DataFrame) -> DataFrame:
    """exit_reason, n, share of day trades."""
    return trades.groupBy("exit_reason").agg(F.count("*").alias("n"), F.avg(F.col("is_day_trade").cast("double")).alias("day_trade_share"))


def average_folds(folds: DataFrame) -> DataFrame:
    """Means of the folds' metrics, nulls skipped, and the sum of their trades."""
    return folds.agg(*[F.avg(c).alias(c) for c in ("win_rate", "expectancy", "sharpe", "max_drawdown")], F.sum("n_trades").alias("n_trades"))


def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("predicted") == F.col("target")).cast("double")).alias("accuracy"))


def forward_filled(panel: DataFrame, dates: DataFrame) -> DataFrame:
    """(symbol, date, close) for every symbol on every date from its first price on, gaps filled with the last one.

    The dates are a few thousand rows and are broadcast to the distinct symbols."""
    dense = panel.select("symbol").distinct().crossJoin(F.broadcast(dates.select("date")))
    upto = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    joined = dense.join(panel.select("symbol", "date", "close"), ["symbol", "date"], "left")
    return joined.withColumn("close", F.last("close", ignorenulls=True).over(upto)).where("close is not null")


def compounded(curve: DataFrame) -> DataFrame:
    """curve (account, date, equity) + growth: the running product of 1 + returns."""
    upto = _over_time().rowsBetween(Window.unboundedPreceding, 0)
    return with_returns(curve).withColumn("growth", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(upto)).drop("peak")


def trade_totals(trades: DataFrame, turnover: DataFrame) -> DataFrame:
    """n_trades, total_fees of trades (fees) and mean_turnover of rebalancings (turnover)."""
    return trades.agg(F.count("*").alias("n_trades"), F.sum("fees").alias("total_fees")).crossJoin(turnover.agg(F.avg("turnover").alias("mean_turnover")))
