"""Sequential simulators: event-driven account and portfolio rebalancing.

What an account can buy depends on all it did before, so one account is one sequential pass; accounts, parameter sets and
strategies run side by side as groups of a grouped map.
"""

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.operators.risk import CostConfig, FillConfig, RiskConfig
from quantspark.schema import TRADE


def sale_fees(shares: float, price: float, cfg: CostConfig = CostConfig()) -> float:
    return shares * price * cfg.sec_rate + min(shares * cfg.taf, cfg.taf_cap) + cfg.commission


@dataclass(frozen=True)
class AccountConfig:
    equity: float = 10_000.0
    max_holding: int = 1170
    fill: FillConfig = FillConfig()
    risk: RiskConfig = RiskConfig()
    costs: CostConfig = CostConfig()


class Latches:
    """Daily loss (until the date ends), drawdown (for good) and day trades of the last sessions."""

    def __init__(self, cfg: RiskConfig, sessions: list) -> None:
        self.cfg, self.at = cfg, {d: i for i, d in enumerate(sessions)}
        self.day = self.first = self.peak = None
        self.daily = self.drawdown = False
        self.day_trades: list[int] = []

    def update(self, day, equity: float) -> None:
        if day != self.day:
            self.day, self.first, self.daily = day, equity, False
        self.peak = equity if self.peak is None else max(self.peak, equity)
        self.daily |= equity <= self.first * (1 - self.cfg.daily_loss)
        self.drawdown |= equity <= self.peak * (1 - self.cfg.drawdown)

    def shares(self, day, equity: float, price: float, gross: float) -> int:
        """Whole shares that every gate lets through; 0 if one refuses."""
        c = self.cfg
        recent = sum(self.at[day] - c.pdt_sessions < t <= self.at[day] for t in self.day_trades)
        stopped = self.drawdown or (self.daily and day == self.day) or (equity < c.pdt_equity and recent >= c.pdt_trades)
        if stopped or equity <= 0 or price <= 0:
            return 0
        size = int(min(equity * c.risk_per_trade / (price * c.stop), equity * c.max_position / price))
        head = equity * c.gross - gross
        return max(0, min(size, int(head // price))) if head > 0 else 0


@dataclass
class Position:
    time: object
    day: object
    price: float
    shares: int
    stop: float
    target: float
    bars: int = 0


class Account:
    """One account over the bars of all its symbols, in order of time and symbol.

    A bar of a symbol first may close its position (stop before target before holding time), then may fill its waiting
    order, then may leave one; equity is marked after each bar.
    """

    def __init__(self, cfg: AccountConfig, sessions: list) -> None:
        self.cfg, self.cash, self.latches = cfg, cfg.equity, Latches(cfg.risk, sessions)
        self.held: dict[str, Position] = {}
        self.waiting: dict[str, int] = {}
        self.seen: dict[str, int] = {}
        self.last: dict[str, float] = {}
        self.trades: list[tuple] = []
        self.equity: dict = {}

    def gross(self) -> float:
        return sum(p.shares * self.last.get(s, p.price) for s, p in self.held.items())

    def _exit(self, symbol: str, price: float, reason: str, time, day) -> None:
        p = self.held.pop(symbol)
        fees = sale_fees(p.shares, price, self.cfg.costs)
        self.cash += p.shares * price - fees
        pnl = (price - p.price) * p.shares - fees
        same = p.day == day
        if same:
            self.latches.day_trades.append(self.latches.at[p.day])
        self.trades.append((symbol, p.time, time, p.price, price, p.shares, reason, pnl, fees, pnl / (p.price * p.shares), p.bars, same))

    def _leave(self, symbol: str, high: float, low: float, close: float, time, day) -> None:
        p, slip = self.held[symbol], 1 - self.cfg.fill.slippage_bps / 1e4
        p.bars += 1
        for hit, price, reason in (
            (low <= p.stop, p.stop, "stop_loss"), (high >= p.target, p.target, "take_profit"), (p.bars >= self.cfg.max_holding, close, "max_holding"),
        ):
            if hit:
                return self._exit(symbol, price * slip, reason, time, day)

    def _enter(self, symbol: str, open_: float, low: float, time, day) -> None:
        f = self.cfg.fill
        price = open_ * (1 + f.slippage_bps / 1e4)
        if f.kind == "limit":
            price = open_ * (1 - f.limit_offset)
            if low > price:
                return
        shares = self.latches.shares(day, self.cash + self.gross(), price, self.gross())
        if shares and shares * price + self.cfg.costs.commission <= self.cash:
            self.cash -= shares * price + self.cfg.costs.commission
            r = self.cfg.risk
            self.held[symbol] = Position(time, day, price, shares, price * (1 - r.stop), price * (1 + r.target))

    def bar(self, symbol: str, time, day, open_: float, high: float, low: float, close: float, signal: bool) -> None:
        self.seen[symbol] = self.seen.get(symbol, 0) + 1
        self.last[symbol] = close
        if symbol in self.held:
            self._leave(symbol, high, low, close, time, day)
        if symbol not in self.held and self.waiting.get(symbol, np.inf) <= self.seen[symbol]:
            del self.waiting[symbol]
            self._enter(symbol, open_, low, time, day)
        if signal and symbol not in self.held and symbol not in self.waiting:
            self.waiting[symbol] = self.seen[symbol] + 1 + self.cfg.fill.latency_bars
        self.equity[day] = self.cash + self.gross()
        self.latches.update(day, self.equity[day])

    def finish(self, time, day) -> None:
        for symbol in list(self.held):
            self._exit(symbol, self.last[symbol] * (1 - self.cfg.fill.slippage_bps / 1e4), "end_of_data", time, day)


def lookup_signals(bars: DataFrame, signals: DataFrame, time: str = "ts", order: str = "seq") -> DataFrame:
    """bars + signal of their symbol and stamp: the last of several, 0 for none."""
    last = signals.groupBy("symbol", time).agg(F.max_by("signal", order).alias("signal"))
    return bars.join(last, ["symbol", time], "left").withColumn("signal", F.coalesce("signal", F.lit(0)))


EVENT = "account string, kind string, date date, equity double, " + TRADE


def event_backtest(bars: DataFrame, cfg: AccountConfig = AccountConfig()) -> DataFrame:
    """bars (account, symbol, ts, OHLC, signal) -> rows of kind `trade` (trade columns) and `equity` (date, equity).

    Positions left at the end are sold at their last close; the daily equity does not show that.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "symbol"], kind="stable")
        days = pdf["ts"].dt.date
        book = Account(cfg, sorted(days.unique()))
        columns = [pdf[c].tolist() for c in ("symbol", "ts")] + [days.tolist()] + [pdf[c].tolist() for c in ("open", "high", "low", "close", "signal")]
        for symbol, ts, day, o, h, lo, c, s in zip(*columns, strict=True):
            book.bar(symbol, ts, day, o, h, lo, c, s == 1)
        book.finish(pdf["ts"].iloc[-1], days.iloc[-1])
        name = pdf["account"].iloc[0]
        names = [c.split()[0] for c in TRADE.split(", ")]
        t = pd.DataFrame(book.trades, columns=names).assign(account=name, kind="trade", date=None, equity=np.nan)
        e = pd.DataFrame({"account": name, "kind": "equity", "date": list(book.equity), "equity": list(book.equity.values())})
        out = pd.concat([t.astype(object), e.astype(object)], ignore_index=True)
        return out[[c.split()[0] for c in EVENT.split(", ")]].where(lambda x: x.notna(), None)

    return bars.groupBy("account").applyInPandas(run, EVENT)


@dataclass(frozen=True)
class PortfolioConfig:
    equity: float = 10_000.0
    slippage_bps: float = 5.0
    vol_target: float | None = None
    vol_lookback: int = 126
    max_exposure: float = 1.0
    borrow: float = 0.03
    costs: CostConfig = field(default_factory=CostConfig)


class Portfolio:
    """Cash and whole shares of one strategy, rebalanced at opens, marked at closes."""

    def __init__(self, cfg: PortfolioConfig) -> None:
        self.cfg, self.cash, self.slip = cfg, cfg.equity, cfg.slippage_bps / 1e4
        self.held: dict[str, int] = {}
        self.curve: list[float] = []
        self.log: list[tuple] = []
        self.traded = 0.0

    def value(self, prices: dict[str, float]) -> float:
        """Holdings without a price count nothing that day."""
        return self.cash + sum(n * prices[s] for s, n in self.held.items() if s in prices)

    def exposure(self) -> float:
        c = self.cfg
        if c.vol_target is None or len(self.curve) < 30:
            return c.max_exposure
        r = np.diff(self.curve) / np.array(self.curve[:-1])
        r = r[-c.vol_lookback :]
        vol = r.std(ddof=1) * np.sqrt(252) if len(r) >= 20 else 0.0
        return min(c.vol_target / vol, c.max_exposure) if vol > 0 else c.max_exposure

    def trade(self, day, symbol: str, side: str, shares: int, price: float) -> None:
        out = side in ("sell", "short")
        fill = price * (1 - self.slip if out else 1 + self.slip)
        fees = sale_fees(shares, fill, self.cfg.costs) if out else 0.0
        self.cash += shares * fill - fees if out else -shares * fill
        self.traded += shares * fill
        self.held[symbol] = self.held.get(symbol, 0) + (-shares if out else shares)
        if not self.held[symbol]:
            del self.held[symbol]
        self.log.append((day, symbol, side, shares, fill, fees))

    def rebalance(self, day, longs: list[str], shorts: list[str], prices: dict[str, float]) -> None:
        """Cover dropped shorts, sell dropped longs, trim, buy in order of rank while cash lasts, then set shorts.

        A holding that is without a price and due to be touched vanishes without proceeds, as `drop_no_price`.
        """
        for short in (True, False):
            for symbol in [s for s, n in self.held.items() if (n < 0) == short]:
                if symbol in prices and symbol in (shorts if short else longs):
                    continue
                n = self.held[symbol]
                if symbol in prices:
                    self.trade(day, symbol, "cover" if short else "sell", abs(n), prices[symbol])
                else:
                    self.log.append((day, symbol, "drop_no_price", self.held.pop(symbol), None, 0.0))
        longs, shorts = ([s for s in side if s in prices] for side in (longs, shorts))
        if not longs and not shorts:
            return
        budget = self.value(prices) * self.exposure()
        each = {True: budget / max(len(longs), 1), False: budget / max(len(shorts), 1)}
        for symbol in [s for s in self.held if s in longs]:
            extra = self.held[symbol] - int(each[True] // prices[symbol])
            if extra > 0:
                self.trade(day, symbol, "sell", extra, prices[symbol])
        for symbol in longs:
            fill = prices[symbol] * (1 + self.slip)
            more = int(each[True] // fill) - self.held.get(symbol, 0)
            more = min(more, int(self.cash // fill))
            if more > 0:
                self.trade(day, symbol, "buy", more, prices[symbol])
        for symbol in shorts:
            gap = self.held.get(symbol, 0) + int(each[False] // (prices[symbol] * (1 - self.slip)))
            if gap:
                self.trade(day, symbol, "short" if gap > 0 else "cover", abs(gap), prices[symbol])

    def close(self, prices: dict[str, float]) -> float:
        if self.cfg.borrow > 0:
            self.cash -= sum(-n * prices[s] for s, n in self.held.items() if n < 0 and s in prices) * self.cfg.borrow / 252
        self.curve.append(self.value(prices))
        return self.curve[-1]


REBALANCED = "account string, kind string, date date, equity double, turnover double, n_positions int, symbols array<string>, symbol string, side string, shares long, price double, fees double"


def portfolio_backtest(prices: DataFrame, targets: DataFrame, cfg: PortfolioConfig = PortfolioConfig()) -> DataFrame:
    """prices (account, date, symbol, open, close) and targets (account, date of execution, side long or short, rank,
    symbol) -> rows of kind equity (date, equity), rebalance (date, turnover, n_positions, symbols) and trade.

    Turnover is over the equity after the rebalancing. Targets are joined to their prices first, so one group holds all
    that a strategy's pass needs: prices of the symbols it ever targets, and a row without a price for each of its dates.
    """
    keys = ["account", "date", "symbol"]
    wanted = targets.select(*keys, "side", "rank")
    ever = prices.select(*keys, "open", "close").join(wanted.select("account", "symbol").distinct(), ["account", "symbol"], "left_semi")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("open", "double"), ("close", "double"), ("side", "string"), ("rank", "int"))]
    planned = wanted.select("account", "date", F.lit(True).alias("_plan")).distinct()
    days = prices.select("account", "date").distinct().select("account", "date", F.lit("").alias("symbol"), *nothing)
    joined = ever.join(wanted, keys, "left").select(*keys, "open", "close", "side", "rank").unionByName(days)
    joined = joined.join(F.broadcast(planned), ["account", "date"], "left")  # one row a rebalancing
    names = [c.split()[0] for c in REBALANCED.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["date", "symbol"])
        book, name, rows = Portfolio(cfg), pdf["account"].iloc[0], []
        columns = {c: pdf[c].to_numpy() for c in ("date", "symbol", "open", "close", "side", "rank")}
        plan = pdf["_plan"].notna().to_numpy()
        edges = [0, *(np.flatnonzero(columns["date"][1:] != columns["date"][:-1]) + 1), len(pdf)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            day, symbols = columns["date"][a], columns["symbol"][a:b]
            known = lambda c: {s: p for s, p in zip(symbols, columns[c][a:b].tolist(), strict=True) if p == p}  # noqa: B023, E731
            if plan[a:b].any():
                opens, sides, ranks = known("open"), columns["side"][a:b], columns["rank"][a:b]
                pick = lambda side: [s for _, s in sorted((r, s) for r, s, x in zip(ranks, symbols, sides, strict=True) if x == side)]  # noqa: B023, E731
                book.traded = 0.0
                book.rebalance(day, pick("long"), pick("short"), opens)
                worth = book.value(opens)
                rows.append({"kind": "rebalance", "date": day, "turnover": book.traded / worth if worth > 0 else 0.0, "n_positions": len(book.held), "symbols": sorted(book.held)})
            rows.append({"kind": "equity", "date": day, "equity": book.close(known("close"))})
        rows += [dict(zip(("date", "symbol", "side", "shares", "price", "fees"), t, strict=True), kind="trade") for t in book.log]
        out = pd.DataFrame(rows, columns=names).assign(account=name).astype(object)
        return out.where(out.notna(), None)

    return joined.groupBy("account").applyInPandas(run, REBALANCED)
