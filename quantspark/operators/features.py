"""Lookahead-safe features: rolling, session, opening-range sweeps and fair-value gaps."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FeatureConfig:
    momentum: tuple[int, ...] = (5, 15, 30, 60)
    volatility: tuple[int, ...] = (30, 60)
    relative_volume: int = 30
    rsi: int = 14
    range_rows: int = 20
    #: Minute of the local day at which minutes_since_open is 0; session stamps are local already.
    open_minute: int = 570


@dataclass(frozen=True)
class SweepConfig:
    #: Minutes of the accumulation window, rows that a sweep counts as recent, cap of rows since.
    accumulation: int = 30
    lookback: int = 30
    cap: int = 390
    open_minute: int = 570


BASE_FEATURES = FeatureConfig()


def full(agg, column, window: Window, n: int):
    """An aggregate over the last n rows, null until n values are there."""
    frame = window.rowsBetween(-(n - 1), 0)
    return F.when(F.count(column).over(frame) == n, agg(column).over(frame))


def minutes_since_open(local_ts, open_minute: int):
    return F.hour(local_ts) * 60 + F.minute(local_ts) - open_minute


def add_features(bars: DataFrame, cfg: FeatureConfig = BASE_FEATURES, time: str = "ts", session: str = "session_date") -> DataFrame:
    """``bars`` (symbol, ``time``, ``session``, OHLCV) with the base features.

    All row windows share one order by symbol and time, and the session's cumulative sums partition by symbol and
    session, ordered alike: one exchange by symbol serves all of them. No frame reaches a following row.
    """
    rows = Window.partitionBy("symbol").orderBy(time)
    day = Window.partitionBy("symbol", session).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    step = bars.withColumns({
        "_r": ratio(F.col("close"), F.lag("close").over(rows)) - 1,
        "_d": F.col("close") - F.lag("close").over(rows),
        "_pv": F.col("close") * F.col("volume"),
    }).withColumns({
        "_gain": F.greatest("_d", F.lit(0.0)) + F.lit(0.0) * F.col("_d"),
        "_loss": F.greatest(-F.col("_d"), F.lit(0.0)) + F.lit(0.0) * F.col("_d"),
    })
    gain, loss = full(F.avg, "_gain", rows, cfg.rsi), full(F.avg, "_loss", rows, cfg.rsi)
    vwap = ratio(F.sum("_pv").over(day), F.sum("volume").over(day))
    low, high = full(F.min, "low", rows, cfg.range_rows), full(F.max, "high", rows, cfg.range_rows)
    out = {f"ret_{n}": ratio(F.col("close"), F.lag("close", n).over(rows)) - 1 for n in cfg.momentum}
    out |= {f"vol_{n}": full(F.stddev_samp, "_r", rows, n) for n in cfg.volatility}
    out |= {
        f"rel_vol_{cfg.relative_volume}": ratio(F.col("volume"), full(F.avg, "volume", rows, cfg.relative_volume)),
        "vwap_dev": ratio(F.col("close") - vwap, vwap),
        f"rsi_{cfg.rsi}": F.when((loss == 0) & (gain > 0), 100.0).when(loss > 0, 100 - 100 / (1 + ratio(gain, loss))),
        f"range_position_{cfg.range_rows}": ratio(F.col("close") - low, high - low),
    }
    if dict(bars.dtypes)[time].startswith("timestamp"):
        out["minutes_since_open"] = minutes_since_open(F.col(time), cfg.open_minute).cast("double")
    return step.withColumns(out).drop("_r", "_d", "_pv", "_gain", "_loss")


def add_sweeps(bars: DataFrame, cfg: SweepConfig = SweepConfig(), time: str = "ts") -> DataFrame:
    """+ the opening range (running over its first minutes, then fixed) and sweeps of it: a bar beyond the range that
    closes back inside, never within the window itself. Everything resets with the session."""
    day = Window.partitionBy("symbol", "session_date").orderBy(time)
    upto = day.rowsBetween(Window.unboundedPreceding, 0)
    inside = minutes_since_open(F.col(time), cfg.open_minute) < cfg.accumulation
    ranged = bars.withColumns({
        "_in": inside, "_i": F.row_number().over(day),
        "range_high": F.max(F.when(inside, F.col("high"))).over(upto), "range_low": F.min(F.when(inside, F.col("low"))).over(upto),
    }).withColumns({
        "_sh": F.coalesce(~F.col("_in") & (F.col("high") > F.col("range_high")) & (F.col("close") <= F.col("range_high")), F.lit(False)),
        "_sl": F.coalesce(~F.col("_in") & (F.col("low") < F.col("range_low")) & (F.col("close") >= F.col("range_low")), F.lit(False)),
    })
    recent = day.rowsBetween(-(cfg.lookback - 1), 0)
    last = F.last(F.when(F.col("_sh") | F.col("_sl"), F.col("_i")), ignorenulls=True).over(upto)
    sign = F.when(F.col("_sl"), 1).when(F.col("_sh"), -1)
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    return ranged.withColumns({
        "dist_to_accum_high": ratio(F.col("close") - F.col("range_high"), F.col("range_high")),
        "dist_to_accum_low": ratio(F.col("close") - F.col("range_low"), F.col("range_low")),
        "swept_accum_high_recent": F.max(F.col("_sh").cast("int")).over(recent),
        "swept_accum_low_recent": F.max(F.col("_sl").cast("int")).over(recent),
        "bars_since_sweep": F.coalesce(F.least(F.col("_i") - last, F.lit(cfg.cap)), F.lit(cfg.cap)),
        "sweep_direction": F.coalesce(F.last(sign, ignorenulls=True).over(upto), F.lit(0)),
    }).drop("_in", "_i", "_sh", "_sl", "range_high", "range_low")


def add_gap(bars: DataFrame, side: str, cap: int = 390, time: str = "ts") -> DataFrame:
    """+ {side}_fvg_active, {side}_fvg_dist, bars_since_{side}_ifvg for side bull or bear.

    Three bars form a gap (bull: the low lies above the high two bars before). Only the most recent gap counts; it
    is filled when price reaches its far edge and inverted when a bar closes beyond. Each bar first updates the gap of
    the bars before it, then may form one. As gaps and islands: the governing gap of a bar is the last one formed before
    it, a running count of hits since then says whether it still stood, and no state machine is needed.
    """
    day = Window.partitionBy("symbol", "session_date").orderBy(time)
    upto, before = day.rowsBetween(Window.unboundedPreceding, 0), day.rowsBetween(Window.unboundedPreceding, -1)
    bull = side == "bull"
    edge = F.lag("high" if bull else "low", 2).over(day)
    forms = (edge < F.col("low")) if bull else (edge > F.col("high"))
    far, near = edge, F.col("low" if bull else "high")
    b = bars.withColumn("_i", F.row_number().over(day)).withColumn(
        "_f", F.when(forms, F.struct(F.col("_i").alias("i"), far.alias("far"), near.alias("near")))
    )
    b = b.withColumn("_now", F.last("_f", ignorenulls=True).over(upto)).withColumn("_was", F.last("_f", ignorenulls=True).over(before))
    beyond = (F.col("close") < F.col("_was.far")) if bull else (F.col("close") > F.col("_was.far"))
    touch = (F.col("low") <= F.col("_was.far")) if bull else (F.col("high") >= F.col("_was.far"))
    b = b.withColumn("_g", F.coalesce(F.col("_was.i"), F.lit(0))).withColumn("_hit", F.coalesce(beyond | touch, F.lit(False)))
    hits = F.sum(F.col("_hit").cast("int")).over(
        Window.partitionBy("symbol", "session_date", "_g").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    )
    b = b.withColumn("_hits", hits)
    inverted = F.col("_hit") & (F.col("_hits") == 1) & beyond
    active = F.coalesce(forms, F.lit(False)) | (F.col("_was").isNotNull() & (F.col("_hits") == 0))
    b = b.withColumn("_inv", F.when(inverted, F.col("_i"))).withColumn("_active", active)
    ahead = (F.col("close") - F.col("_now.near")) * (1 if bull else -1)
    return b.withColumns({
        f"{side}_fvg_active": F.col("_active").cast("int"),
        f"{side}_fvg_dist": F.when(F.col("_active"), ahead / F.nullif(F.col("close"), F.lit(0.0))).otherwise(0.0),
        f"bars_since_{side}_ifvg": F.coalesce(F.least(F.col("_i") - F.last("_inv", ignorenulls=True).over(upto), F.lit(cap)), F.lit(cap)),
    }).drop("_i", "_f", "_now", "_was", "_g", "_hit", "_hits", "_inv", "_active")


def add_ict_features(bars: DataFrame, cfg: SweepConfig = SweepConfig(), time: str = "ts") -> DataFrame:
    return add_gap(add_gap(add_sweeps(bars, cfg, time), "bull", cfg.cap, time), "bear", cfg.cap, time)


def unchanged_before(features, bars: DataFrame, cutoff, time: str = "ts", bump: float = 2.0) -> bool:
    """No lookahead: with everything from ``cutoff`` on altered, what ``features`` gives before it is the same."""
    late = F.col(time) >= F.lit(cutoff)
    altered = bars.withColumns({c: F.when(late, F.col(c) * bump).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    early = [features(x).where(~late) for x in (bars, altered)]
    return early[0].exceptAll(early[1]).isEmpty() and early[1].exceptAll(early[0]).isEmpty()
