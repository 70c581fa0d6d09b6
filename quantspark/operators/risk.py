"""Costs, fills, sizing, risk gates and latches."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CostConfig:
    sec_rate: float = 23.10e-6
    taf: float = 0.000119
    taf_cap: float = 5.95
    commission: float = 0.0


@dataclass(frozen=True)
class FillConfig:
    kind: str = "market"
    slippage_bps: float = 5.0
    limit_offset: float = 0.0
    latency_bars: int = 0


@dataclass(frozen=True)
class RiskConfig:
    risk_per_trade: float = 0.01
    max_position: float = 0.25
    stop: float = 0.01
    target: float = 0.02
    daily_loss: float = 0.02
    drawdown: float = 0.10
    pdt_equity: float = 25_000.0
    pdt_trades: int = 3
    pdt_sessions: int = 5
    gross: float = 1.0


def sell_fees(shares, price, cfg: CostConfig = CostConfig()):
    return shares * price * cfg.sec_rate + F.least(shares * cfg.taf, F.lit(cfg.taf_cap)) + cfg.commission


def entry_fill(open_, low, cfg: FillConfig = FillConfig()):
    """Market: open with slippage. Limit: the limit below the open if the bar trades there, else null."""
    if cfg.kind == "market":
        return open_ * (1 + cfg.slippage_bps / 1e4)
    if cfg.kind == "limit":
        limit = open_ * (1 - cfg.limit_offset)
        return F.when(low <= limit, F.least(limit, open_))
    raise ValueError(f"unknown order type {cfg.kind}")


def exit_fill(price, cfg: FillConfig = FillConfig()):
    return price * (1 - cfg.slippage_bps / 1e4)


def fixed_fractional(equity, price, stop, cfg: RiskConfig = RiskConfig()):
    """Whole shares that risk the set share of equity, at most the largest position; 0 for invalid inputs."""
    by_risk = equity * cfg.risk_per_trade / F.nullif(price * stop, F.lit(0.0))
    by_size = equity * cfg.max_position / F.nullif(price, F.lit(0.0))
    ok = (equity > 0) & (price > 0) & (stop > 0)
    return F.when(ok, F.floor(F.least(by_risk, by_size))).otherwise(0).cast("long")


def capped_kelly(p, b, cap: float = 0.5, most: float = 0.05):
    return F.when(b > 0, F.least(F.greatest(p - (1 - p) / F.nullif(b, F.lit(0.0)), F.lit(0.0)) * cap, F.lit(most))).otherwise(0.0)


def risk_gate(orders: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """orders (equity, price, gross_exposure, day_trades, drawdown_tripped, daily_tripped) + shares, stop_price,
    target_price, reason. The first gate that refuses names the reason; what fits is trimmed to the headroom."""
    size = fixed_fractional(F.col("equity"), F.col("price"), F.lit(cfg.stop), cfg)
    head = F.col("equity") * cfg.gross - F.col("gross_exposure")
    fit = F.floor(head / F.nullif(F.col("price"), F.lit(0.0))).cast("long")
    pdt = (F.col("equity") < cfg.pdt_equity) & (F.col("day_trades") >= cfg.pdt_trades)
    reason = (
        F.when(F.col("drawdown_tripped"), "drawdown").when(F.col("daily_tripped"), "daily_loss").when(pdt, "pdt")
        .when(size <= 0, "size").when((head <= 0) | (F.least(size, fit) <= 0), "exposure").when(fit < size, "trimmed").otherwise("ok")
    )
    out = orders.withColumn("reason", reason).withColumn("shares", F.when(F.col("reason").isin("ok", "trimmed"), F.least(size, fit)).otherwise(0).cast("long"))
    return out.withColumn("stop_price", F.col("price") * (1 - cfg.stop)).withColumn("target_price", F.col("price") * (1 + cfg.target))


def daily_loss_latch(equity: DataFrame, limit: float = 0.02) -> DataFrame:
    """equity (account, ts, equity) + tripped: set for the rest of a date once equity falls the limit below the
    date's first."""
    day = Window.partitionBy("account", F.to_date("ts")).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    first = F.first("equity").over(day)
    return equity.withColumn("tripped", F.max(F.col("equity") <= first * (1 - limit)).over(day))


def drawdown_latch(equity: DataFrame, limit: float = 0.10, resets: DataFrame | None = None) -> DataFrame:
    """equity (account, ts, equity) + peak, tripped: set once equity falls the limit below its peak, until a manual reset.

    resets (account, reset_ts): from there on peak and latch start anew. Each epoch between resets is a partition.
    """
    epoch = ["account"]
    if resets is not None:
        both = equity.unionByName(resets.select("account", F.col("reset_ts").alias("ts")), allowMissingColumns=True)
        order = Window.partitionBy("account").orderBy("ts", F.col("equity").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
        equity = both.withColumn("epoch", F.count_if(F.col("equity").isNull()).over(order)).where("equity is not null")
        epoch = ["account", "epoch"]
    upto = Window.partitionBy(*epoch).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    e = equity.withColumn("peak", F.max("equity").over(upto))
    e = e.withColumn("tripped", F.max(F.col("equity") <= F.col("peak") * (1 - limit)).over(upto))
    return e.drop("epoch") if resets is not None else e


def pdt_window(day_trades: DataFrame, cal: DataFrame, equity: float = 10_000.0, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """(account, date, n_day_trades over the last sessions, allowed) for every session that has day trades."""
    per = day_trades.groupBy("account", "date").agg(F.count("*").alias("n")).join(F.broadcast(cal), "date")
    span = Window.partitionBy("account").orderBy("i").rangeBetween(-(cfg.pdt_sessions - 1), 0)
    total = F.sum("n").over(span)
    return per.select("account", "date", total.alias("n_day_trades"), ((F.lit(equity) >= cfg.pdt_equity) | (total < cfg.pdt_trades)).alias("allowed"))


def vol_target_exposure(curve: DataFrame, target: float, lookback: int = 126, most: float = 1.0) -> DataFrame:
    """curve (account, date, equity) + exposure for the day from the returns among the last ``lookback`` equities."""
    by = Window.partitionBy("account").orderBy("date")
    e = curve.withColumn("_r", F.col("equity") / F.nullif(F.lag("equity").over(by), F.lit(0.0)) - 1)
    span = by.rowsBetween(-(lookback - 2), 0)
    vol = F.stddev_samp("_r").over(span) * F.sqrt(F.lit(252.0))
    enough = (F.count("equity").over(by.rowsBetween(-(lookback - 1), 0)) >= 30) & (F.count("_r").over(span) >= 20) & (vol > 0)
    return e.withColumn("exposure", F.when(enough, F.least(F.lit(target) / F.nullif(vol, F.lit(0.0)), F.lit(most))).otherwise(most)).drop("_r")
