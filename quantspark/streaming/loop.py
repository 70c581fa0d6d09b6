"""One iteration of live trading: gates, exits and entries over the bars of the session so far.

Bars and scores are DataFrames. What an account holds (its positions, latches and day trades) is a few rows: kept on the
driver, saved between iterations.
"""

import datetime as dt
import json
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantspark.operators.hygiene import SessionConfig, flag_duplicates, flag_impossible, regular_session
from quantspark.operators.risk import RiskConfig, risk_gate
from quantspark.sources.io import load_state, save_state
from quantspark.streaming.live import Broker, KillSwitch, exits


@dataclass(frozen=True)
class LoopConfig:
    min_bars: int = 60
    holding: dt.timedelta = dt.timedelta(minutes=390)
    risk: RiskConfig = RiskConfig()
    session: SessionConfig = SessionConfig()


@dataclass
class Tracked:
    price: float
    stop: float
    target: float
    date: str
    deadline: str


@dataclass
class LoopState:
    """What outlives an iteration: the date's first equity, the peak, both latches, day trades, positions."""

    date: str | None = None
    first: float | None = None
    peak: float | None = None
    daily_tripped: bool = False
    drawdown_tripped: bool = False
    day_trades: list[str] = field(default_factory=list)
    positions: dict[str, Tracked] = field(default_factory=dict)
    checked: str | None = None

    @classmethod
    def load(cls, path: str) -> "LoopState":
        raw = load_state(path)
        return cls(**{**raw, "positions": {s: Tracked(**p) for s, p in raw.get("positions", {}).items()}})

    def save(self, path: str) -> None:
        save_state(asdict(self), path)

    def mark(self, day: dt.date, equity: float, cfg: RiskConfig) -> None:
        """Both latches after a new equity: the daily one clears with the date, the drawdown one never by itself."""
        if self.date != day.isoformat():
            self.date, self.first, self.daily_tripped = day.isoformat(), equity, False
        self.peak = equity if self.peak is None else max(self.peak, equity)
        self.daily_tripped = self.daily_tripped or equity <= self.first * (1 - cfg.daily_loss)
        self.drawdown_tripped = self.drawdown_tripped or equity <= self.peak * (1 - cfg.drawdown)

    def recent_day_trades(self, day: dt.date, cfg: RiskConfig) -> int:
        """Day trades of the last weekdays up to ``day``."""
        first, left = day, cfg.pdt_sessions
        while True:
            left -= first.weekday() < 5
            if not left:
                break
            first -= dt.timedelta(days=1)
        return sum(first.isoformat() <= d <= day.isoformat() for d in self.day_trades)


def live_bars(bars: DataFrame, cfg: SessionConfig = SessionConfig(), order: str = "ts") -> DataFrame:
    """First arrivals (by ``order``) of possible bars in the session. Halt-like days stay: a short window always looks like one."""
    kept = flag_impossible(flag_duplicates(regular_session(bars, cfg), "symbol", "ts", order=order))
    return kept.where("not is_duplicate and not is_impossible").drop("is_duplicate", "is_impossible", "local_ts")


def candidates(bars: DataFrame, scores: DataFrame, held: list[str], min_bars: int = 60) -> DataFrame:
    """(symbol, price, proba): symbols not held with enough bars and a signal; price is the last close."""
    seen = bars.where(~F.col("symbol").isin(*held)) if held else bars
    last = seen.groupBy("symbol").agg(F.count("*").alias("n"), F.max_by("close", "ts").alias("price")).where(F.col("n") >= min_bars)
    return last.join(scores.where("predicted = 1").select("symbol", "proba"), "symbol").select("symbol", "price", "proba")


def reconciled(state: LoopState, broker: Broker) -> list[dict]:
    """Log events for tracked positions that the broker doesn't hold, which are forgotten, and held ones that aren't tracked."""
    gone = sorted(set(state.positions) - set(broker.positions))
    for s in gone:
        del state.positions[s]
    strange = sorted(set(broker.positions) - set(state.positions))
    return [{"event_type": "reconciliation_mismatch", "symbol": s, "kind": k} for k, found in (("missing", gone), ("untracked", strange)) for s in found]


def _leave(state: LoopState, broker: Broker, bars: DataFrame, now: dt.datetime, log: Callable[[dict], None]) -> None:
    """Closes tracked positions that hit stop, target or deadline in the bars since the last iteration."""
    if not state.positions:
        return
    spark = bars.sparkSession
    rows = [(s, p.stop, p.target, dt.datetime.fromisoformat(p.deadline)) for s, p in state.positions.items()]
    table = spark.createDataFrame(rows, "symbol string, stop double, target double, deadline timestamp_ntz")
    new = bars.where(F.col("symbol").isin(*state.positions))
    new = new if state.checked is None else new.where(F.col("ts") > F.lit(dt.datetime.fromisoformat(state.checked)).cast("timestamp_ntz"))
    for r in exits(table, new, F.lit(now).cast("timestamp_ntz")).orderBy("symbol").collect():  # at most the positions held
        price = r.price if r.price is not None else broker.prices.get(r.symbol)
        if price is None:
            continue  # neither a bar nor a mark: the next iteration tries again
        broker.submit(r.symbol, "sell", broker.positions[r.symbol], price)
        log({"event_type": "exit_signal", "symbol": r.symbol, "reason": r.reason, "price": price})
        if state.positions.pop(r.symbol).date == now.date().isoformat():
            state.day_trades.append(now.date().isoformat())


def _enter(state: LoopState, broker: Broker, bars: DataFrame, scores: DataFrame, now: dt.datetime, equity: float, cfg: LoopConfig, log: Callable[[dict], None]) -> None:
    """Sends the signalled symbols through the risk gate in order of symbol; each order sees the exposure that those before
    it left. Candidates are symbols of one market at one moment, so they are read one by one."""
    trades = state.recent_day_trades(now.date(), cfg.risk)
    asked = candidates(bars, scores, sorted({*broker.positions, *state.positions}), cfg.min_bars).withColumns({
        "equity": F.lit(equity), "gross_exposure": F.lit(broker.gross), "day_trades": F.lit(trades),
        "drawdown_tripped": F.lit(state.drawdown_tripped), "daily_tripped": F.lit(state.daily_tripped),
    })
    for r in risk_gate(asked, cfg.risk).orderBy("symbol").toLocalIterator():
        shares = min(r.shares, int(max(equity * cfg.risk.gross - broker.gross, 0.0) // r.price)) if r.shares else 0
        if shares <= 0:
            log({"event_type": "entry_rejected", "symbol": r.symbol, "reason": "exposure" if r.shares else r.reason, "proba": r.proba})
            continue
        broker.submit(r.symbol, "buy", shares, r.price)
        deadline = (now + cfg.holding).isoformat()
        state.positions[r.symbol] = Tracked(r.price, r.stop_price, r.target_price, now.date().isoformat(), deadline)


def iterate(
    bars: DataFrame, scorer: Callable[[DataFrame], DataFrame], broker: Broker, switch: KillSwitch, state_path: str, now: dt.datetime,
    cfg: LoopConfig = LoopConfig(), log: Callable[[dict], None] = lambda e: None,
) -> str:
    """One iteration; returns how it ended. bars: the clean session so far (symbol, ts without zone, OHLC, volume).

    scorer(bars) gives (symbol, predicted, proba). Order: kill switch, market clock, equity and latches, reconciliation,
    exits, entries; state is saved after each part that trades, so a crash between them loses no position.
    """
    for stop, why in ((switch.engaged, "kill_switch_engaged"), (not broker.open, "market_closed")):
        if stop:
            log({"event_type": "loop_skipped", "reason": why})
            return why
    state = LoopState.load(state_path)
    sent = len(broker.fills)
    held = sorted(broker.positions)
    if held:
        marks = bars.where(F.col("symbol").isin(*held)).groupBy("symbol").agg(F.max_by("close", "ts").alias("price"))
        broker.prices.update({r.symbol: r.price for r in marks.collect()})  # at most the positions held
    equity = broker.equity
    state.mark(now.date(), equity, cfg.risk)
    for event in reconciled(state, broker):
        log(event)
    state.save(state_path)
    for tripped, why in ((state.drawdown_tripped, "drawdown"), (state.daily_tripped, "daily_loss")):
        if tripped:
            log({"event_type": "loop_skipped", "reason": why})
            return why
    _leave(state, broker, bars, now, log)
    state.save(state_path)
    _enter(state, broker, bars, scorer(bars), now, equity, cfg, log)
    last = bars.agg(F.max("ts")).first()[0]
    state.checked = state.checked if last is None else last.isoformat()
    state.save(state_path)
    for symbol, side, qty, price in broker.fills[sent:]:
        log({"event_type": "fill", "symbol": symbol, "side": side, "qty": qty, "price": price})
    log({"event_type": "loop_completed", "equity": equity, "open_positions": len(state.positions)})
    return "completed"


def flatten(broker: Broker, switch: KillSwitch, why: str = "flattened") -> int:
    """Engages the switch and closes every position at its last price; the number closed. Those without a price stay open."""
    switch.engage(why)
    known = [s for s in sorted(broker.positions) if s in broker.prices]
    for s in known:
        qty = broker.positions[s]
        broker.submit(s, "sell" if qty > 0 else "buy", abs(qty), broker.prices[s])
    return len(known)


EXIT = "symbol string, ms bigint, reason string, price double"
EXIT_STATE = "stop double, target double, deadline bigint, close double"


def _watch(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The open position of a symbol against its bars; its deadline is an event-time timer."""
    held = tuple(state.get) if state.exists else None
    found = []

    def leave(at, reason: str, price) -> None:
        nonlocal held
        found.append((key[0], at, reason, price))
        held = None

    if state.hasTimedOut:
        if held is not None:
            leave(held[2], "max_holding", held[3])
    else:
        # A position counts from its stamp on, so that bar itself is watched too.
        rows = pd.concat(list(frames)).assign(bar=lambda x: x["stop"].isna()).sort_values(["ms", "bar"], kind="stable")
        for r in rows.itertuples():
            if not r.bar:
                held = (r.stop, r.target, int(r.deadline), None)
            elif held is not None:
                stop, target, deadline, _ = held
                if r.low <= stop:
                    leave(r.ms, "stop_loss", stop)
                elif r.high >= target:
                    leave(r.ms, "take_profit", target)
                elif r.ms >= deadline:
                    leave(r.ms, "max_holding", r.close)
                else:
                    held = (stop, target, deadline, r.close)
    if held is None:
        if state.exists:
            state.remove()
    else:
        state.update(held)
        state.setTimeoutTimestamp(max(held[2], state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame(found, columns=["symbol", "ms", "reason", "price"]).astype({"ms": "int64", "price": "float64"})


def stream_exits(opened: DataFrame, bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(symbol, ts, reason, price) for every position that closes: from streams opened (symbol, ts, stop, target, deadline) and
    bars (symbol, ts, low, high, close, ...).

    One position a symbol is kept in keyed state; a bar closes it at the stop before the target before the deadline, and
    a timer does at its last close once the watermark passes the deadline without a bar. Stamps reach Python as
    milliseconds, so the session's time zone doesn't matter.
    """
    opened = opened.select("symbol", "ts", "stop", "target", F.unix_millis("deadline").alias("deadline"))
    rows = opened.unionByName(bars.select("symbol", "ts", "low", "high", "close"), allowMissingColumns=True)
    seen = rows.withWatermark("ts", delay).withColumn("ms", F.unix_millis("ts")).groupBy("symbol")
    closed = seen.applyInPandasWithState(_watch, EXIT, EXIT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return closed.select("symbol", F.timestamp_millis("ms").alias("ts"), "reason", "price")


def log_lines(path: str) -> Callable[[dict], None]:
    """A log function that appends JSON lines with a UTC stamp to a file of the driver."""
    def log(event: dict) -> None:
        with open(path, "a", encoding="utf-8") as f:
            f.write(json.dumps({"timestamp": dt.datetime.now(dt.UTC).isoformat(), **event}) + "\n")

    return log
