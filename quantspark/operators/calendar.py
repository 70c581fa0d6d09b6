"""Trading calendar: ordinals, month ends, next sessions, as-of look-ups."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def calendar(panel: DataFrame) -> DataFrame:
    """(date, i): the market's dates with their ordinal from 1. A few thousand rows, so one window task."""
    return panel.select("date").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")))


def with_ordinal(panel: DataFrame, cal: DataFrame | None = None) -> DataFrame:
    """``panel`` with i: windows over i in RANGE frames count market days, so a symbol's missing day counts too."""
    return panel.join(F.broadcast(calendar(panel) if cal is None else cal), "date")


def month_ends(cal: DataFrame) -> DataFrame:
    """(date): last date present in each month, a trailing partial month included."""
    return cal.groupBy(F.trunc("date", "month")).agg(F.max("date").alias("date")).select("date")


def next_session(signals: DataFrame, cal: DataFrame) -> DataFrame:
    """``signals`` (date) with fill_date, the following trading day; a signal on the last day drops out."""
    here, there = cal.select("date", "i"), cal.select(F.col("date").alias("fill_date"), (F.col("i") - 1).alias("i"))
    return signals.join(F.broadcast(here.join(there, "i").select("date", "fill_date")), "date")


def first_session(events: DataFrame, cal: DataFrame, column: str, strict: bool, name: str = "entry_date") -> DataFrame:
    """``events`` with the first trading day after ``column`` (strict) or on or after it; null if there is none.

    Every calendar day knows the day it maps to, so the look-up is an equality join on the few distinct days.
    """
    days = events.select(F.col(column).alias("_d")).distinct().select("_d", F.lit(None).cast("date").alias("_t"))
    both = days.union(cal.select(F.col("date").alias("_d"), F.col("date").alias("_t")))
    ahead = both.withColumn("_k", F.datediff("_d", F.lit("1970-01-01").cast("date")))
    frame = Window.orderBy("_k").rangeBetween(1 if strict else 0, Window.unboundedFollowing)
    found = ahead.withColumn(name, F.min("_t").over(frame)).select("_d", name).distinct()
    return events.join(F.broadcast(found), events[column] == found["_d"], "left").drop("_d")


def weekdays(end: DataFrame, days: int) -> DataFrame:
    """The Mondays to Fridays among the last ``days`` calendar days up to the one date in ``end``."""
    every = end.select(F.explode(F.sequence(F.date_sub("date", days - 1), F.col("date"))).alias("date"))
    return every.where(~F.dayofweek("date").isin(1, 7))
