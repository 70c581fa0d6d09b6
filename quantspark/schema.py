"""Canonical schemas and the required-column check."""

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR_COLUMNS = ("open", "high", "low", "close", "volume")
BARS = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("ts", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)
DAILY = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("date", T.DateType())]
    + [T.StructField(c, T.DoubleType()) for c in BAR_COLUMNS]
)
FILLS = T.StructType([
    T.StructField("timestamp", T.TimestampType()), T.StructField("event_type", T.StringType()), T.StructField("symbol", T.StringType()),
    T.StructField("side", T.StringType()), T.StructField("qty", T.LongType()), T.StructField("price", T.DoubleType()),
    T.StructField("order_id", T.StringType()),
])
TRADE = (
    "symbol string, entry_time timestamp, exit_time timestamp, entry_price double, exit_price double, shares long, exit_reason string, "
    "pnl double, fees double, return_pct double, holding_bars int, is_day_trade boolean"
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``df``, or ValueError naming the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def nan_to_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN counts as missing everywhere; Spark would compare it as the largest value."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def half_up(x, digits: int):
    """A double rounded half away from zero as SQL does, after scaling: F.round looks at the decimal text, so it makes
    9.155, whose product with 100 is below 915.5, 9.16. What can't be scaled stays."""
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled, 0) / 10.0**digits).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Every double column rounded: rolling aggregates differ between engines in the last places. Minus zero becomes zero."""
    return df.select(*[(half_up(F.col(c), digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
