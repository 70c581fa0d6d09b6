"""Panel hygiene: duplicates, impossible values, jumps, sessions, halts, discontinuities, holdout."""

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.schema import require_columns


@dataclass(frozen=True)
class SessionConfig:
    """Regular session in minutes of the local day, end exclusive."""

    zone: str = "America/New_York"
    open_minute: int = 570
    close_minute: int = 960
    bar_minutes: int = 1
    halt_gap: int = 5
    max_jump: float = 0.5


HOLDOUT = (dt.date(2026, 5, 1), dt.date(2026, 7, 31))


def local_time(ts, zone: str = "America/New_York"):
    """Exchange-local clock of a UTC stamp."""
    return F.from_utc_timestamp(ts, zone)


def minute_of_day(ts):
    return F.hour(ts) * 60 + F.minute(ts)


def flag_duplicates(bars: DataFrame, *key: str, order: str = "seq") -> DataFrame:
    """+ is_duplicate: not the first arrival of its key."""
    return bars.withColumn("is_duplicate", F.row_number().over(Window.partitionBy(*key).orderBy(order)) > 1)


def impossible(prefix: str = ""):
    """A price at or below zero, high below low, or negative volume."""
    c = lambda n: F.col(prefix + n)
    return (F.least(c("open"), c("high"), c("low"), c("close")) <= 0) | (c("high") < c("low")) | (c("volume") < 0)


def flag_impossible(bars: DataFrame) -> DataFrame:
    require_columns(bars, ("open", "high", "low", "close", "volume"))
    return bars.withColumn("is_impossible", F.coalesce(impossible(), F.lit(False)))


def own_return(by: Window, column: str = "close", fill: bool = False):
    """Return on the symbol's previous row; with ``fill`` the previous known value stands in for gaps."""
    value = F.last(column, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0)) if fill else F.col(column)
    before = (
        F.last(column, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1)) if fill else F.lag(column).over(by)
    )
    return value / F.nullif(before, F.lit(0.0)) - 1


def flag_jumps(bars: DataFrame, by: Window, limit: float = 0.5) -> DataFrame:
    """+ is_jump: the return's size is beyond the limit. Reported, never dropped."""
    return bars.withColumn("is_jump", F.coalesce(F.abs(own_return(by, fill=True)) > limit, F.lit(False)))


def regular_session(bars: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Bars whose local time lies in the session; + local_ts, session_date."""
    local = bars.withColumn("local_ts", local_time("ts", cfg.zone).cast("timestamp_ntz"))
    m = minute_of_day(F.col("local_ts"))
    return local.withColumn("session_date", F.to_date("local_ts")).where((m >= cfg.open_minute) & (m < cfg.close_minute))


def halt_like_days(session_bars: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """(symbol, session_date, n_missing) of days that lack more than halt_gap of the expected stamps."""
    expected = (cfg.close_minute - cfg.open_minute) // cfg.bar_minutes
    slot = F.floor((minute_of_day(F.col("local_ts")) - cfg.open_minute) / cfg.bar_minutes)
    return (
        session_bars.groupBy("symbol", "session_date").agg((F.lit(expected) - F.count_distinct(slot)).cast("long").alias("n_missing"))
        .where(F.col("n_missing") > cfg.halt_gap)
    )


def quality_report(bars: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """Per symbol: n_rows, n_duplicates, n_impossible, n_jumps, halt_days, is_clean (jumps don't count)."""
    by = Window.partitionBy("symbol").orderBy("ts", "seq")
    flagged = flag_jumps(flag_impossible(flag_duplicates(bars, "symbol", "ts")), by, cfg.max_jump)
    halts = halt_like_days(regular_session(bars, cfg), cfg).groupBy("symbol").agg(F.count("*").alias("halts"))
    return (
        flagged.groupBy("symbol").agg(
            F.count("*").alias("n_rows"), F.count_if("is_duplicate").alias("n_duplicates"),
            F.count_if("is_impossible").alias("n_impossible"), F.count_if("is_jump").alias("n_jumps"),
        )
        .join(halts, "symbol", "left")
        .select(
            "symbol", "n_rows", "n_duplicates", "n_impossible", "n_jumps", F.coalesce("halts", F.lit(0)).cast("long").alias("n_halt_days"),
            ((F.col("n_duplicates") == 0) & (F.col("n_impossible") == 0) & F.col("halts").isNull()).alias("is_clean"),
        )
    )


def clean_bars(bars: DataFrame, cfg: SessionConfig = SessionConfig()) -> DataFrame:
    """First arrivals of possible bars in the session, without the halt-like days."""
    sessions = regular_session(bars, cfg)
    kept = flag_impossible(flag_duplicates(sessions, "symbol", "ts")).where("not is_duplicate and not is_impossible")
    return kept.drop("is_duplicate", "is_impossible").join(halt_like_days(sessions, cfg), ["symbol", "session_date"], "left_anti")


def daily_quality(panel: DataFrame, max_jump: float = 1.0) -> DataFrame:
    """One row: n_rows, n_symbols, n_duplicates, n_impossible, n_jumps of a daily panel (seq: order of arrival)."""
    by = Window.partitionBy("symbol").orderBy("date", "seq")
    flagged = flag_jumps(flag_impossible(flag_duplicates(panel, "symbol", "date")), by, max_jump)
    return flagged.agg(
        F.count("*").alias("n_rows"), F.count_distinct("symbol").alias("n_symbols"), F.count_if("is_duplicate").alias("n_duplicates"),
        F.count_if("is_impossible").alias("n_impossible"), F.count_if("is_jump").alias("n_jumps"),
    )


def split_discontinuous(panel: DataFrame, limit: float = 3.0) -> DataFrame:
    """Rows from each symbol's last return beyond the limit on; all of a symbol without one."""
    by = Window.partitionBy("symbol").orderBy("date")
    broken = panel.withColumn("_r", own_return(by)).withColumn("_b", F.when(F.abs("_r") > limit, F.col("date")))
    last = F.max("_b").over(Window.partitionBy("symbol"))
    return broken.withColumn("_l", last).where("_l is null or date >= _l").drop("_r", "_b", "_l")


def clean_daily_panel(panel: DataFrame, limit: float = 3.0) -> DataFrame:
    """First arrivals of possible rows, then split_discontinuous(); extreme moves stay."""
    kept = flag_impossible(flag_duplicates(panel, "symbol", "date")).where("not is_duplicate and not is_impossible")
    return split_discontinuous(kept.drop("is_duplicate", "is_impossible"), limit)


def exclude_holdout(df: DataFrame, column: str = "date", exclude: bool = True, period: tuple[dt.date, dt.date] = HOLDOUT) -> DataFrame:
    """Rows outside the holdout, both ends of which count as inside. A plain range predicate, so it reaches the scan."""
    day = F.col(column) if dict(df.dtypes)[column] == "date" else F.col(column).cast("date")
    return df.where(~day.between(*period)) if exclude else df
