"""Cross-sectional selection: momentum and event drift."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.calendar import calendar, month_ends, with_ordinal


@dataclass(frozen=True)
class MomentumConfig:
    formation: int = 252
    skip: int = 21
    top: int = 20
    min_price: float = 5.0
    min_dollar_volume: float = 5_000_000.0
    volume_window: int = 21


@dataclass(frozen=True)
class EventConfig:
    sigma: float = 3.0
    volume: float = 2.0
    lookback: int = 60
    hold: int = 40
    top: int = 20
    min_price: float = 5.0
    min_dollar_volume: float = 5_000_000.0
    horizons: tuple[int, ...] = (5, 10, 20, 40, 60)


def momentum_scores(panel: DataFrame, cfg: MomentumConfig = MomentumConfig()) -> DataFrame:
    """panel + i, score (price skip market days ago over price formation days ago - 1), dollar_volume (mean of the last
    volume_window market days, null unless the symbol traded on all).

    Market days, not the symbol's rows: RANGE frames over the calendar ordinal find the price of an exact day without a
    join or a dense symbol x date table.
    """
    by = Window.partitionBy("symbol").orderBy("i")
    at = lambda n: F.max("close").over(by.rangeBetween(-n, -n))
    span = by.rangeBetween(-(cfg.volume_window - 1), 0)
    return with_ordinal(panel).withColumn("_dv", F.col("close") * F.col("volume")).withColumns({
        "score": at(cfg.skip) / F.nullif(at(cfg.formation), F.lit(0.0)) - 1,
        "dollar_volume": F.when(F.count("_dv").over(span) == cfg.volume_window, F.avg("_dv").over(span)),
    }).drop("_dv")


def select_momentum(scored: DataFrame, dates: DataFrame, cfg: MomentumConfig = MomentumConfig(), losers: bool = False) -> DataFrame:
    """(date, rank, symbol, score): best (or worst) of the eligible symbols at each date; ties by symbol."""
    ok = (F.col("close") >= cfg.min_price) & (F.col("dollar_volume") >= cfg.min_dollar_volume) & F.col("score").isNotNull()
    order = F.col("score").asc() if losers else F.col("score").desc()
    rank = F.row_number().over(Window.partitionBy("date").orderBy(order, "symbol"))
    return scored.join(F.broadcast(dates), "date", "left_semi").where(ok).withColumn("rank", rank).where(F.col("rank") <= cfg.top).select("date", "rank", "symbol", "score")


def long_short_targets(scored: DataFrame, dates: DataFrame, cfg: MomentumConfig = MomentumConfig()) -> DataFrame:
    """(date, side, rank, symbol, score)."""
    sides = [select_momentum(scored, dates, cfg, losers).withColumn("side", F.lit(name)) for losers, name in ((False, "long"), (True, "short"))]
    return sides[0].unionByName(sides[1]).select("date", "side", "rank", "symbol", "score")


def detect_events(panel: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """panel + ret, ret_sigma, volume_multiple, dollar_volume, is_event.

    Scales come from the lookback rows of the symbol before the row, all of which must have a value. A return other
    than zero on a scale of zero counts as beyond any threshold; its ret_sigma is null.
    """
    by = Window.partitionBy("symbol").orderBy("date")
    prior = by.rowsBetween(-cfg.lookback, -1)
    whole = lambda agg, c: F.when(F.count(c).over(prior) == cfg.lookback, agg(c).over(prior))
    e = panel.withColumn("ret", F.col("close") / F.nullif(F.lag("close").over(by), F.lit(0.0)) - 1).withColumn("dollar_volume", F.col("close") * F.col("volume"))
    e = e.withColumn("_sd", whole(F.stddev_samp, "ret")).withColumn("_mv", whole(F.avg, "volume"))
    e = e.withColumn("ret_sigma", F.col("ret") / F.nullif(F.col("_sd"), F.lit(0.0))).withColumn("volume_multiple", F.col("volume") / F.nullif(F.col("_mv"), F.lit(0.0)))
    far = (F.abs("ret_sigma") >= cfg.sigma) | ((F.col("_sd") == 0) & (F.col("ret") != 0))
    heavy = (F.col("volume_multiple") >= cfg.volume) | ((F.col("_mv") == 0) & (F.col("volume") > 0))
    ok = far & heavy & (F.col("close") >= cfg.min_price) & (F.col("dollar_volume") >= cfg.min_dollar_volume)
    return e.withColumn("is_event", F.coalesce(ok, F.lit(False))).drop("_sd", "_mv")


def event_summary(events: DataFrame, years: float = 10.3) -> DataFrame:
    return events.where("is_event").agg(
        F.count("*").alias("n_events"), F.count_distinct("symbol").alias("n_symbols"), F.count_if(F.col("ret") > 0).alias("n_up"),
        F.count_if(F.col("ret") < 0).alias("n_down"), F.median("ret").alias("median_ret"),
        (F.count("*") / F.nullif(F.count_distinct("symbol"), F.lit(0)) / years).alias("per_symbol_year"),
    )


def forward_returns(events: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """(horizon, direction, n, mean_return, median_return) of events, over rows of the symbol ahead."""
    by = Window.partitionBy("symbol").orderBy("date")
    ahead = [F.struct(F.lit(h).alias("horizon"), (F.lead("close", h).over(by) / F.nullif(F.col("close"), F.lit(0.0)) - 1).alias("fwd")) for h in cfg.horizons]
    return (
        events.withColumn("_f", F.array(*ahead)).where("is_event")
        .select(F.when(F.col("ret") > 0, "up").otherwise("down").alias("direction"), F.explode("_f").alias("f"))
        .where("f.fwd is not null").groupBy("f.horizon", "direction")
        .agg(F.count("*").alias("n"), F.avg("f.fwd").alias("mean_return"), F.median("f.fwd").alias("median_return"))
    )


def drift_targets(events: DataFrame, cfg: EventConfig = EventConfig()) -> DataFrame:
    """(date, rank, symbol, strength) at month ends: symbols with an upward event 1 to hold market days before, the
    strongest first. Few month ends are broadcast; each event meets at most those within its holding period."""
    cal = calendar(events)
    ends = month_ends(cal).join(cal, "date").select("date", F.col("i").alias("_e"))
    found = events.where("is_event and ret > 0").select("symbol", F.col("date").alias("_d"), F.abs("ret_sigma").alias("strength"))
    found = found.join(F.broadcast(cal.select(F.col("date").alias("_d"), "i")), "_d")
    held = found.join(F.broadcast(ends), (F.col("_e") >= F.col("i") + 1) & (F.col("_e") <= F.col("i") + cfg.hold))
    best = held.groupBy("date", "symbol").agg(F.max("strength").alias("strength"))
    rank = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("strength"), "symbol"))
    return best.withColumn("rank", rank).where(F.col("rank") <= cfg.top).select("date", "rank", "symbol", "strength")
