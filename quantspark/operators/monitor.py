"""Monitoring: FIFO trades, daily equity, divergence, reconciliation."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantity in a slice of the join of intervals.
SLICE = 256


def fifo_trades(fills: DataFrame) -> DataFrame:
    """symbol, entry_time, exit_time, entry_price, exit_price, qty, pnl: sells matched with the oldest open buys.

    A queue as intervals: buys and sells of a symbol cover stretches of cumulative quantity, and a match is where two
    stretches overlap. Sells beyond what is held are discarded, which is the running minimum of the balance, reflected
    at zero. No row-by-row state is needed.
    """
    by = Window.partitionBy("symbol").orderBy("ts", "seq")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    q = lambda side: F.when(F.col("side") == side, F.col("qty")).otherwise(0)
    f = fills.withColumns({"_b": F.sum(q("buy")).over(upto), "_s": F.sum(q("sell")).over(upto)})
    f = f.withColumn("_x", F.greatest(F.lit(0), -F.min(F.col("_b") - F.col("_s")).over(upto)))
    f = f.withColumn("_e", F.col("_s") - F.col("_x")).withColumn("_pe", F.coalesce(F.lag("_e").over(by), F.lit(0)))
    buys = f.where("side = 'buy'").select("symbol", F.col("ts").alias("entry_time"), F.col("price").alias("entry_price"), (F.col("_b") - F.col("qty")).alias("b0"), F.col("_b").alias("b1"))
    sells = f.where("side = 'sell' and _e > _pe").select("symbol", F.col("ts").alias("exit_time"), F.col("price").alias("exit_price"), F.col("_pe").alias("s0"), F.col("_e").alias("s1"))
    # Stretches meet in slices of the quantity axis; of the slices a pair shares, the one where its overlap begins counts.
    cut = lambda df, a, b: df.withColumn("_k", F.explode(F.sequence(F.floor(F.col(a) / SLICE), F.floor((F.col(b) - 1) / SLICE))))
    matched = cut(buys, "b0", "b1").join(cut(sells, "s0", "s1"), ["symbol", "_k"]).where("b0 < s1 and s0 < b1").where(
        F.col("_k") == F.floor(F.greatest("b0", "s0") / SLICE)
    )
    size = F.least("b1", "s1") - F.greatest("b0", "s0")
    return matched.select(
        "symbol", "entry_time", "exit_time", "entry_price", "exit_price", size.alias("qty"),
        (size * (F.col("exit_price") - F.col("entry_price"))).alias("pnl"),
    )


def daily_equity(trades: DataFrame, start: float = 10_000.0) -> DataFrame:
    """(date, pnl, equity): results by exit date, cumulated on ``start``."""
    per = trades.groupBy(F.to_date("exit_time").alias("date")).agg(F.sum("pnl").alias("pnl"))
    return per.withColumn("equity", F.sum("pnl").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)) + start)


def divergence_flags(live: DataFrame, baseline: DataFrame, tolerance: float = 0.5, metrics: tuple[str, ...] = ("win_rate", "expectancy", "sharpe", "max_drawdown")) -> DataFrame:
    """metric, live, baseline, divergence of the metrics that differ by more than the tolerance, relative to a baseline
    that is known and not zero."""
    stack = lambda df, name: df.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("x")).select("x.*")
    both = stack(live, "live").join(F.broadcast(stack(baseline, "baseline")), "metric").where("live is not null and not isnan(live) and baseline is not null and not isnan(baseline) and baseline <> 0")
    d = F.abs(F.col("live") - F.col("baseline")) / F.abs("baseline")
    return both.withColumn("divergence", d).where(F.col("divergence") > tolerance).withColumn(
        "message", F.format_string("%s diverges: live %.4f, baseline %.4f", "metric", "live", "baseline")
    )


def reconcile(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """symbol, expected_qty, actual_qty where they differ; a missing side counts as 0."""
    e, a = expected.select("symbol", F.col("qty").alias("expected_qty")), actual.select("symbol", F.col("qty").alias("actual_qty"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return e.join(a, "symbol", "full").select("symbol", zero("expected_qty"), zero("actual_qty")).where("expected_qty <> actual_qty")


def sample_divergence(inside, outside):
    """In-sample against out-of-sample expectancy: a positive one that loses more than half and 5 bps."""
    gap = inside - outside
    return F.coalesce((inside > 0) & (gap > 0.5 * F.abs(inside)) & (gap > 0.0005), F.lit(False))


def baseline_edge(model, random_):
    """Whether the model's edge is less than half the random baseline's size: no clear edge."""
    return F.when(F.abs((model - random_) / F.nullif(random_, F.lit(0.0))) < 0.5, "no clear edge").otherwise("edge")


def live_metrics(fills: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Performance by account from a log of fills: matched trades, their metrics, and the equity that they make.

    account: fills' own, or the symbol. One row each: n_trades, win_rate, mean_return, pnl, final_equity, max_drawdown.
    """
    account = F.col("account") if "account" in fills.columns else F.col("symbol").cast("string")
    trades = fifo_trades(fills).withColumn("account", account)
    by = Window.partitionBy("account").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = trades.groupBy("account", F.to_date("exit_time").alias("date")).agg(F.sum("pnl").alias("pnl"))
    equity = days.withColumn("equity", F.lit(start) + F.sum("pnl").over(by))
    equity = equity.withColumn("fall", F.col("equity") / F.greatest(F.max("equity").over(by), F.lit(start)) - 1)
    curves = equity.groupBy("account").agg(F.max_by("equity", "date").alias("final_equity"), F.min("fall").alias("max_drawdown"))
    made = trades.groupBy("account").agg(
        F.count("*").alias("n_trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"),
        F.avg(F.col("pnl") / F.nullif(F.col("qty") * F.col("entry_price"), F.lit(0.0))).alias("mean_return"), F.sum("pnl").alias("pnl"),
    )
    return made.join(curves, "account")
