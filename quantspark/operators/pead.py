"""Post-earnings drift: reaction days, abnormal returns, standardised surprise, buckets."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantspark.operators.calendar import first_session
from quantspark.functions.stats import t_statistic


@dataclass(frozen=True)
class PeadConfig:
    drift: int = 60
    buckets: int = 5
    min_prior: int = 6
    #: Ranges of sue in which events are ranked.
    ranges: int = 256


def abnormal_returns(events: DataFrame, panel: DataFrame, benchmark: DataFrame, cal: DataFrame, cfg: PeadConfig = PeadConfig()) -> DataFrame:
    """Events with entry_date (the session after the reaction day), exit_date, reaction_return, stock_return,
    benchmark_return, abnormal_return. The reaction day is the first session after the announcement; events whose exit
    lies past the end, or whose prices lack, drop out."""
    dated = first_session(events, cal, "announced", strict=True, name="reaction_date")
    days = F.broadcast(cal.select(F.col("date").alias("reaction_date"), "i"))
    e = dated.join(days, "reaction_date")
    own = panel.join(F.broadcast(cal), "date").select("symbol", F.col("i").alias("_k"), "close")
    bench = benchmark.join(F.broadcast(cal), "date").select(F.col("i").alias("_k"), "close")
    for name, shift in (("before", -1), ("react", 0), ("entry", 1), ("exit", 1 + cfg.drift)):
        e = e.withColumn("_at", F.col("i") + shift)
        e = e.join(own.select("symbol", F.col("_k").alias("_at"), F.col("close").alias(f"px_{name}")), ["symbol", "_at"], "left")
        if name in ("entry", "exit"):
            e = e.join(F.broadcast(bench.select(F.col("_k").alias("_at"), F.col("close").alias(f"bench_{name}"))), "_at", "left")
            e = e.join(F.broadcast(cal.select(F.col("i").alias("_at"), F.col("date").alias(f"{name}_date"))), "_at", "left")
        e = e.drop("_at")
    e = e.where("px_entry > 0 and px_exit is not null and bench_entry > 0 and bench_exit is not null")
    e = e.withColumns({
        "stock_return": F.col("px_exit") / F.col("px_entry") - 1, "benchmark_return": F.col("bench_exit") / F.col("bench_entry") - 1,
        "reaction_return": F.col("px_react") / F.nullif(F.col("px_before"), F.lit(0.0)) - 1,
    })
    return e.withColumn("abnormal_return", F.col("stock_return") - F.col("benchmark_return")).drop("i", "px_before", "px_react", "px_entry", "px_exit", "bench_entry", "bench_exit", "reaction_date")


def add_sue(events: DataFrame, cfg: PeadConfig = PeadConfig()) -> DataFrame:
    """+ surprise, sue: the surprise against mean and deviation of the symbol's earlier ones, of which min_prior must be."""
    prior = Window.partitionBy("symbol").orderBy("announced", "order_key").rowsBetween(Window.unboundedPreceding, -1)
    e = events.withColumn("surprise", F.col("reported_eps") - F.col("estimate_eps"))
    sue = (F.col("surprise") - F.avg("surprise").over(prior)) / F.nullif(F.stddev_samp("surprise").over(prior), F.lit(0.0))
    return e.withColumn("sue", F.when(F.count("surprise").over(prior) >= cfg.min_prior, sue))


def add_buckets(events: DataFrame, cfg: PeadConfig = PeadConfig()) -> DataFrame:
    """+ bucket 1..n by rank of sue (ties by symbol, time, key): quantile cuts of the ranks, in whole numbers.

    Ranks over everything come from ranges of sue: each range is counted, the counts are summed, and rows rank within
    their range, so no task sorts all events. The ranges' bounds are estimated once, and are constants then: counts and
    rows agree whatever the bounds and however the plan is split.
    """
    order = ["sue", "symbol", "announced", "order_key"]
    known = events.where("sue is not null")
    cuts = known.agg(F.percentile_approx("sue", [k / cfg.ranges for k in range(1, cfg.ranges)], 10 * cfg.ranges)).first()[0] or []
    bounds = F.array(*[F.lit(float(x)) for x in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    known = known.withColumn("_p", F.size(F.filter(bounds, lambda x: x < F.col("sue"))))
    counts = known.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_b"), F.sum("_n").over(Window.partitionBy()).alias("_t"))
    ranked = known.join(F.broadcast(before), "_p").withColumn("_r", F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    bucket = F.greatest(F.lit(1), F.ceil((F.col("_r") - 1) * cfg.buckets / F.nullif(F.col("_t") - 1, F.lit(0))))
    return ranked.withColumn("bucket", F.coalesce(bucket, F.lit(1)).cast("int")).drop("_p", "_b", "_t", "_r")


def bucket_summary(events: DataFrame) -> DataFrame:
    """bucket, n, mean_sue, mean_ar, median_ar, win_rate, t_stat (null for n of 2 or less)."""
    ar = F.col("abnormal_return")
    return events.groupBy("bucket").agg(
        F.count("*").alias("n"), F.avg("sue").alias("mean_sue"), F.avg(ar).alias("mean_ar"), F.median(ar).alias("median_ar"),
        F.avg((ar > 0).cast("double")).alias("win_rate"), F.when(F.count("*") > 2, t_statistic(ar)).alias("t_stat"),
    )
