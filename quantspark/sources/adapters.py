"""Driver tables as canonical inputs: daily panel, intraday bars, fills, earnings, positions."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume: line items by brand and ship date, priced by the part."""
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .groupBy(F.col("p_brand").alias("symbol"), F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.min_by("p_retailprice", order).alias("open"), F.max("p_retailprice").alias("high"), F.min("p_retailprice").alias("low"),
            F.max_by("p_retailprice", order).alias("close"), F.sum("l_quantity").alias("volume"),
        )
    )


def bars_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, ts, session_date, open, high, low, close, volume: hourly bars of the events by type."""
    order = F.struct("ts", "event_id")
    return (
        read(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("symbol"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("bar"))
        .agg(
            F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
            F.max_by("value", order).alias("close"), F.count("*").cast("double").alias("volume"),
        )
        .select("symbol", F.col("bar").alias("ts"), F.col("bar").cast("date").alias("session_date"), "open", "high", "low", "close", "volume")
    )


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars before hygiene, one for each event, at minute stamps: duplicates and jumps occur. seq: order of arrival."""
    return read(spark, sf_dir, "events").select(
        F.col("event_type").alias("symbol"), F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"),
        F.col("value").alias("open"), (F.col("value") + 1).alias("high"), (F.col("value") - 1).alias("low"), F.col("value").alias("close"),
        F.pmod("event_id", F.lit(100)).cast("double").alias("volume"), F.col("event_id").alias("seq"),
    )


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, seq, ts, side, qty, price: purchases buy, signups sell."""
    return (
        read(spark, sf_dir, "events").where("event_type in ('purchase', 'signup')")
        .select(
            F.col("user_id").alias("symbol"), F.col("event_id").alias("seq"), "ts",
            F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"),
            (F.col("event_id") % 10 + 1).cast("long").alias("qty"), F.col("value").alias("price"),
        )
    )


def earnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, announced, order_key, estimate_eps, reported_eps: an order reports, its predecessor is the estimate."""
    orders = read(spark, sf_dir, "orders").select(
        F.format_string("Brand#%d%d", (F.col("o_custkey") % 25 / 5).cast("int") + 1, (F.col("o_custkey") % 5).cast("int") + 1).alias("symbol"),
        F.col("o_orderdate").cast("date").alias("announced"), F.col("o_orderkey").alias("order_key"),
        (F.col("o_totalprice") / 1000).alias("reported_eps"),
    )
    by = Window.partitionBy("symbol").orderBy("announced", "order_key")
    return orders.withColumn("estimate_eps", F.lag("reported_eps").over(by)).where("estimate_eps is not null")


def equity_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, equity: ordered value by day."""
    return read(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date")).agg(
        F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")), 2).cast("double").alias("equity")
    )


def positions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(expected, actual) by symbol: returned and open quantities of suppliers."""
    items = read(spark, sf_dir, "lineitem")
    pick = lambda where: items.where(where).groupBy(F.col("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").cast("long").alias("qty"))
    return pick("l_linestatus = 'F'"), pick("l_returnflag <> 'N'")
