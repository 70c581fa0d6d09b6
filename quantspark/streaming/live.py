"""Live path on Structured Streaming: bars in, the batch features out, exits and entries as micro-batches."""

from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quantspark.operators.features import FeatureConfig, add_features
from quantspark.operators.hygiene import impossible

BAR = "symbol string, ts timestamp, open double, high double, low double, close double, volume double"
#: Rows that the longest feature looks back on, the row itself included.
HISTORY = 61


def read_bars(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(BAR).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def clean_stream(bars: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Possible bars, each symbol and stamp once within the watermark; later arrivals drop out."""
    return bars.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["symbol", "ts"]).where(~F.coalesce(impossible(), F.lit(False)))


def hourly_volume(bars: DataFrame) -> DataFrame:
    return bars.groupBy(F.window("ts", "1 hour"), "symbol").agg(F.sum("volume").alias("volume"), F.count("*").alias("n"))


STATE = "rows string"
OUT = "symbol string, ts timestamp, ret_5 double, ret_60 double, range_position_20 double"


def _tail(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Keeps the last HISTORY bars of a symbol and gives the rolling features of the new ones."""
    import io

    kept = pd.read_json(io.StringIO(state.get[0]), orient="split", convert_dates=["ts"]) if state.exists else None
    new = pd.concat(list(frames)).sort_values("ts")
    bars = new if kept is None or kept.empty else pd.concat([kept.assign(ts=pd.to_datetime(kept["ts"])), new])
    bars = bars.sort_values("ts").reset_index(drop=True)
    span = bars["high"].rolling(20).max() - bars["low"].rolling(20).min()
    made = pd.DataFrame({
        "symbol": key[0], "ts": bars["ts"], "ret_5": bars["close"] / bars["close"].shift(5) - 1, "ret_60": bars["close"] / bars["close"].shift(60) - 1,
        "range_position_20": ((bars["close"] - bars["low"].rolling(20).min()) / span.where(span != 0)),
    })
    state.update((bars.tail(HISTORY).to_json(orient="split", date_format="iso"),))
    out = made.tail(len(new)).astype(object)
    yield out.where(out.notna(), None)


def stream_features(bars: DataFrame) -> DataFrame:
    """Features of each new bar from keyed state; equal to the batch features when bars arrive in order."""
    return bars.groupBy("symbol").applyInPandasWithState(_tail, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def batch_features(bars: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    day = bars.withColumn("session_date", F.to_date("ts"))
    return add_features(day, cfg).select("symbol", "ts", "ret_5", "ret_60", "range_position_20")


def exits(positions: DataFrame, bars: DataFrame, now) -> DataFrame:
    """positions (symbol, stop, target, deadline) that the new bars or the clock close: symbol, reason, price. All new
    bars count, not the last one alone; stop before target before deadline."""
    seen = bars.groupBy("symbol").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max_by("close", "ts").alias("close"))
    p = positions.join(seen, "symbol", "left")
    reason = F.when(F.col("low") <= F.col("stop"), "stop_loss").when(F.col("high") >= F.col("target"), "take_profit").when(F.lit(now) >= F.col("deadline"), "max_holding")
    price = F.when(reason == "stop_loss", F.col("stop")).when(reason == "take_profit", F.col("target")).otherwise(F.col("close"))
    return p.select("symbol", reason.alias("reason"), price.alias("price")).where("reason is not null")


class KillSwitch:
    """A flag file that stops the loop."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def engage(self, why: str = "") -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(why)

    def disengage(self) -> None:
        self.path.unlink(missing_ok=True)

    @property
    def engaged(self) -> bool:
        return self.path.exists()


class Broker:
    """In-memory stand-in for a paper-trading connection: positions, last prices, cash, fills."""

    def __init__(self, cash: float = 10_000.0, open_: bool = True, paper: bool = True) -> None:
        if not paper:
            raise ValueError("only paper trading is supported")
        self.cash, self.open, self.positions, self.prices, self.fills = cash, open_, {}, {}, []

    @property
    def gross(self) -> float:
        return sum(abs(n) * self.prices[s] for s, n in self.positions.items())

    @property
    def equity(self) -> float:
        return self.cash + sum(n * self.prices[s] for s, n in self.positions.items())

    def submit(self, symbol: str, side: str, qty: int, price: float) -> None:
        sign = 1 if side == "buy" else -1
        self.prices[symbol] = price
        self.cash -= sign * qty * price
        self.positions[symbol] = self.positions.get(symbol, 0) + sign * qty
        if not self.positions[symbol]:
            del self.positions[symbol]
        self.fills.append((symbol, side, qty, price))


def run_iterations(
    bars: DataFrame, checkpoint: str, broker: Broker, switch: KillSwitch, on_batch: Callable[[DataFrame, int, Broker], None], log: Callable[[dict], None] = lambda e: None
):
    """One micro-batch is one iteration: kill switch, market clock, reconciliation and trading in ``on_batch``, log."""
    def step(batch: DataFrame, n: int) -> None:
        if switch.engaged:
            log({"event_type": "kill_switch", "batch": n})
            return
        if not broker.open:
            log({"event_type": "market_closed", "batch": n})
            return
        before = len(broker.fills)
        on_batch(batch, n, broker)
        for symbol, side, qty, price in broker.fills[before:]:
            log({"event_type": "fill", "batch": n, "symbol": symbol, "side": side, "qty": qty, "price": price})
        log({"event_type": "loop_completed", "batch": n})

    return bars.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
