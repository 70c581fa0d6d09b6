"""Triple-barrier labels, class balance, walk-forward folds, datasets."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class BarrierConfig:
    profit: float = 0.02
    stop: float = 0.01
    horizon: int = 1170
    #: Longest horizon for which the rows ahead are carried as an array; beyond it, blocks go through numpy.
    array_horizon: int = 64
    block: int = 65_536


def triple_barrier(bars: DataFrame, cfg: BarrierConfig = BarrierConfig(), time: str = "ts") -> DataFrame:
    """``bars`` with label, exit_bar_offset, realized_return of a long entry at each close.

    1: the target is reached within the horizon; -1: the stop is, no later than the target; 0: neither in a whole
    horizon of rows; null: neither, in fewer rows. Null bars of a row ahead never reach a barrier.
    """
    return (_by_array if cfg.horizon <= cfg.array_horizon else _by_blocks)(bars, cfg, time)


def _by_array(bars: DataFrame, cfg: BarrierConfig, time: str) -> DataFrame:
    ahead = Window.partitionBy("symbol").orderBy(time).rowsBetween(1, cfg.horizon)
    first = lambda column, test: F.nullif(F.array_position(F.transform(column, test), True), F.lit(0))
    b = bars.withColumn("_a", F.collect_list(F.struct("high", "low", "close")).over(ahead)).withColumns({
        "_p": first(F.col("_a"), lambda x: F.coalesce(x["high"] >= F.col("close") * (1 + cfg.profit), F.lit(False))),
        "_s": first(F.col("_a"), lambda x: F.coalesce(x["low"] <= F.col("close") * (1 - cfg.stop), F.lit(False))),
    })
    stop = F.col("_s").isNotNull() & (F.col("_p").isNull() | (F.col("_s") <= F.col("_p")))
    whole = F.size("_a") == cfg.horizon
    last = F.element_at("_a", -1)["close"] / F.nullif(F.col("close"), F.lit(0.0)) - 1
    pick = lambda s, p, t: F.when(stop, s).when(F.col("_p").isNotNull(), p).when(whole, t)
    return b.withColumns({
        "label": pick(F.lit(-1), F.lit(1), F.lit(0)),
        "exit_bar_offset": pick(F.col("_s"), F.col("_p"), F.lit(cfg.horizon)).cast("int"),
        "realized_return": pick(F.lit(-cfg.stop), F.lit(cfg.profit), last),
    }).drop("_a", "_p", "_s")


def barrier_arrays(close, high, low, n: int, cfg: BarrierConfig):
    """(label, offset, return) of the first ``n`` rows; the rest are only looked at. One pass a row ahead over the rows
    that are still open, which are soon few."""
    label, offset, gain = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
    target, stop, live = close[:n] * (1 + cfg.profit), close[:n] * (1 - cfg.stop), np.arange(n)
    for k in range(1, cfg.horizon + 1):
        live = live[live + k < len(close)]
        if not len(live):
            break
        down, up = low[live + k] <= stop[live], high[live + k] >= target[live]
        hit = down | up
        at = live[hit]
        label[at], offset[at] = np.where(down[hit], -1, 1), k
        gain[at] = np.where(down[hit], -cfg.stop, cfg.profit)
        live = live[~hit]
        if k == cfg.horizon:
            label[live], offset[live], gain[live] = 0, k, close[live + k] / close[live] - 1
    return label, offset, gain


def _by_blocks(bars: DataFrame, cfg: BarrierConfig, time: str) -> DataFrame:
    """Blocks of consecutive rows with the horizon's rows after them, so a long symbol spans many tasks."""
    i = F.row_number().over(Window.partitionBy("symbol").orderBy(time)) - 1
    blocks = bars.withColumn("_i", i).withColumn("_own", F.floor(F.col("_i") / cfg.block))
    back = F.greatest(F.lit(0), F.floor((F.col("_i") - cfg.horizon) / cfg.block))
    dealt = blocks.withColumn("_block", F.explode(F.sequence(back, F.col("_own"))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        n = int((pdf["_own"] == pdf["_block"]).sum())
        label, offset, gain = barrier_arrays(*(pdf[c].to_numpy(dtype=float) for c in ("close", "high", "low")), n, cfg)
        out = pdf.iloc[:n].drop(columns=["_i", "_own", "_block"])
        return out.assign(label=pd.array(label).astype("Int32"), exit_bar_offset=pd.array(offset).astype("Int32"), realized_return=gain)

    schema = ", ".join(f"`{c}` {t}" for c, t in bars.dtypes) + ", label int, exit_bar_offset int, realized_return double"
    out = dealt.groupBy("symbol", "_block").applyInPandas(run, schema)
    return out.withColumn("realized_return", F.when(~F.isnan("realized_return"), F.col("realized_return")))


def class_balance(labels: DataFrame, threshold: float = 0.10) -> DataFrame:
    """label, n, proportion, is_skewed (any class below the threshold), n_valid, n_dropped (null labels)."""
    every = Window.partitionBy()
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    valid = F.sum(F.when(F.col("label").isNotNull(), F.col("n"))).over(every)
    dropped = F.coalesce(F.sum(F.when(F.col("label").isNull(), F.col("n"))).over(every), F.lit(0))
    share = counts.withColumn("n_valid", valid).withColumn("n_dropped", dropped).where("label is not null").withColumn("proportion", F.col("n") / F.col("n_valid"))
    return share.withColumn("is_skewed", F.min("proportion").over(every) < threshold)


def walk_forward_folds(cal: DataFrame, folds: int = 5, embargo: int = 4) -> DataFrame:
    """fold_id, train_start, train_end, test_start, test_end over the dates of ``cal`` (date, i from 1).

    Blocks of equal length; training expands, its end is moved back by the embargo; the last test takes the rest.
    ValueError if a block is not longer than the embargo.
    """
    n = cal.count()
    size = n // (folds + 1)
    if size < embargo + 1:
        raise ValueError("not enough trading dates for these folds and this embargo")
    spark = cal.sparkSession
    k = F.col("id")
    table = spark.range(folds).select(
        k.cast("int").alias("fold_id"), F.lit(1).alias("a"), F.greatest(F.lit(1), size * (k + 1) - embargo).alias("b"),
        (size * (k + 1) + 1).alias("c"), F.when(k < folds - 1, size * (k + 2)).otherwise(n).alias("d"),
    )
    for column, name in zip("abcd", ("train_start", "train_end", "test_start", "test_end"), strict=True):
        table = table.join(F.broadcast(cal.select(F.col("i").cast("long").alias(column), F.col("date").alias(name))), column)
    return table.select("fold_id", "train_start", "train_end", "test_start", "test_end")


def split_folds(df: DataFrame, folds: DataFrame) -> DataFrame:
    """``df`` with fold_id and part (train or test), a row for each part it belongs to. Folds are few: broadcast."""
    inside = lambda p: F.col("date").between(F.col(f"{p}_start"), F.col(f"{p}_end"))
    tagged = df.join(F.broadcast(folds), inside("train") | inside("test"))
    return tagged.withColumn("part", F.when(inside("test"), "test").otherwise("train")).drop("train_start", "train_end", "test_start", "test_end")


def dataset(labelled: DataFrame, features: list[str]) -> DataFrame:
    """Rows with a label and all features; + target (1 for label 1)."""
    return labelled.dropna(subset=["label", *features]).withColumn("target", (F.col("label") == 1).cast("int"))


def trading_dates(spark: SparkSession, dates: list) -> DataFrame:
    return spark.createDataFrame([(d, i + 1) for i, d in enumerate(sorted(dates))], "date date, i int")
