"""Option studies: third Fridays, OCC keys, entry days, payoffs, stress."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.functions.stats import t_statistic
from quantspark.schema import half_up

MONEYNESS = (1.00, 0.99, 0.98, 0.97, 0.95, 0.92, 0.90)
SHOCKS = (-0.10, -0.20, -0.30)


def third_friday(day):
    """Third Friday of the month of a date."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "month"), 1), "FRI"), 14)


def occ_symbol(root, expiry, right, strike):
    """Root, yymmdd, C or P, strike in thousandths over eight digits."""
    return F.concat(root, F.date_format(expiry, "yyMMdd"), right, F.lpad(F.round(strike * 1000).cast("long").cast("string"), 8, "0"))


def option_months(prices: DataFrame) -> DataFrame:
    """(expiry) for every month of ``prices`` (date, close)."""
    return prices.select(third_friday("date").alias("expiry")).distinct()


def entry_days(months: DataFrame, prices: DataFrame, days: int = 30) -> DataFrame:
    """months + entry (first trading day on or after expiry - days, before expiry) with spot, and settle (last close up
    to expiry); months without either drop out. Months are few, so they are broadcast."""
    met = prices.join(F.broadcast(months), (F.col("date") >= F.date_sub("expiry", days)) & (F.col("date") <= F.col("expiry")))
    before = F.col("date") < F.col("expiry")
    return met.groupBy("expiry").agg(
        F.min(F.when(before, F.col("date"))).alias("entry"), F.min_by(F.when(before, F.col("close")), F.col("date")).alias("spot"),
        F.max_by("close", "date").alias("settle"),
    ).where("entry is not null")


def with_strike(months: DataFrame, moneyness: tuple[float, ...] = MONEYNESS, premium_share: float = 0.01) -> DataFrame:
    """+ moneyness, strike (half to even), premium: one row for each moneyness."""
    m = F.explode(F.array(*[F.lit(x) for x in moneyness]))
    return months.withColumn("moneyness", m).withColumn("strike", F.bround(F.col("spot") * F.col("moneyness"), 0)).withColumn("premium", half_up(F.col("spot") * premium_share, 2))


def put_payoff(months: DataFrame) -> DataFrame:
    """+ assigned, pnl_per_share, ret_on_capital of a cash-secured put."""
    short = F.greatest(F.lit(0.0), F.col("strike") - F.col("settle"))
    return months.withColumn("assigned", F.col("settle") < F.col("strike")).withColumn("pnl_per_share", F.col("premium") - short).withColumn(
        "ret_on_capital", F.col("pnl_per_share") / F.nullif(F.col("strike"), F.lit(0.0))
    )


def moneyness_summary(months: DataFrame, min_months: int = 12) -> DataFrame:
    r = F.col("ret_on_capital")
    return months.groupBy("moneyness").agg(
        F.count("*").alias("n"), F.avg(r).alias("mean_ret"), F.min(r).alias("worst_ret"), F.max(r).alias("best_ret"),
        F.avg((r > 0).cast("double")).alias("win_rate"), F.count_if("assigned").alias("n_assigned"), (F.avg(r) * 12).alias("annualised"),
        t_statistic(r).alias("t_stat"), F.avg(F.col("premium") / F.col("spot")).alias("mean_premium"),
    ).where(F.col("n") >= min_months)


def crash_stress(summary: DataFrame, shocks: tuple[float, ...] = SHOCKS) -> DataFrame:
    """One month's result if spot falls by each shock, and years of the mean return to recover."""
    m = F.col("moneyness")
    loss = F.col("mean_premium") - F.greatest(F.lit(0.0), (m - (1 + F.col("shock"))) / m)
    years = F.when(loss < 0, -loss / F.nullif(F.col("annualised"), F.lit(0.0)))
    return summary.select("moneyness", "mean_premium", "annualised", F.explode(F.array(*[F.lit(x) for x in shocks])).alias("shock")).withColumn("stress_ret", loss).withColumn(
        "years_to_recover", years
    ).drop("annualised")


def straddle_pnl(months: DataFrame) -> DataFrame:
    """At-the-money straddle: cost, move, seller's result, implied and actual share of spot."""
    cost, move = 2 * F.col("premium"), F.abs(F.col("settle") - F.col("spot"))
    return months.select(
        "expiry", "entry", "spot", F.bround("spot", 0).alias("strike"), cost.alias("straddle_cost"), move.alias("actual_move"),
        (cost - move).alias("seller_pnl"), (cost / F.nullif(F.col("spot"), F.lit(0.0))).alias("implied_pct"), (move / F.nullif(F.col("spot"), F.lit(0.0))).alias("actual_pct"),
    )


def join_legs(months: DataFrame, option_bars: DataFrame, root: str) -> DataFrame:
    """Months of which both the call and the put have a bar on the entry day: + call_close, put_close."""
    key = lambda right: occ_symbol(F.lit(root), F.col("expiry"), F.lit(right), F.col("strike"))
    out = months.withColumns({"_c": key("C"), "_p": key("P")})
    for column, name in (("_c", "call_close"), ("_p", "put_close")):
        leg = option_bars.select(F.col("occ").alias(column), F.col("date").alias("entry"), F.col("close").alias(name))
        out = out.join(leg, [column, "entry"])
    return out.drop("_c", "_p")
