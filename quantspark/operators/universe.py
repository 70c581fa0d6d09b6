"""Universe: liquidity screens, probes, fund names, candidate tickers."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Words and phrases (as regular expressions) that name funds, and leveraged or volatility funds by ticker.
FUND_WORDS = (
    "ETF", "ETN", "ETP", "Fund", "Index", "Portfolio", "iShares", "ProShares", "Direxion", "SPDR", "Invesco", "Vanguard",
    "Xtrackers", "WisdomTree", "VanEck", "Global X", "Ultra", "UltraShort", "Bull", "Bear", "[23]X", "Term Trust",
    r"Physical\s+\w+\s+Trust", "Grayscale", "Sprott", r"Depositary\s+Receipt",
)
LEVERAGED = (
    "AAPU", "BOIL", "DUST", "FAS", "FAZ", "KOLD", "LABD", "LABU", "NUGT", "NVDL", "SCO", "SOXL", "SOXS", "SPXL", "SPXS",
    "SPXU", "SQQQ", "TMF", "TMV", "TNA", "TQQQ", "TSLL", "TZA", "UCO", "UPRO", "UVXY", "YINN", "VXX", "SVXY", "TSLQ",
)


@dataclass(frozen=True)
class LiquidityConfig:
    min_dollar_volume: float = 5_000_000.0
    min_price: float = 5.0
    max_price: float = 1000.0


@dataclass(frozen=True)
class ScreenConfig:
    min_price: float = 5.0
    min_dollar_volume: float = 5_000_000.0
    window_days: int = 90
    max_symbols: int = 5000

    @property
    def min_bars(self) -> int:
        return max(20, int(0.4 * self.window_days))


def filter_by_liquidity(panel: DataFrame, cfg: LiquidityConfig = LiquidityConfig()) -> DataFrame:
    """(symbol, avg_price, avg_dollar_volume) of symbols whose averages pass."""
    return panel.groupBy("symbol").agg(
        F.avg("close").alias("avg_price"), F.avg(F.col("close") * F.col("volume")).alias("avg_dollar_volume")
    ).where((F.col("avg_dollar_volume") >= cfg.min_dollar_volume) & F.col("avg_price").between(cfg.min_price, cfg.max_price))


def screen_at_dates(panel: DataFrame, dates: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """(probe_date, symbol, n_bars, median_price, median_dollar_volume): the trailing window before each date, medians
    exact, at most max_symbols a date by dollar volume. All dates in one job; they are few, so they are broadcast."""
    seen = panel.join(F.broadcast(dates), (F.col("date") <= F.col("probe_date")) & (F.col("date") > F.date_sub("probe_date", cfg.window_days)))
    passed = seen.groupBy("probe_date", "symbol").agg(
        F.count("*").alias("n_bars"), F.median("close").alias("median_price"), F.median(F.col("close") * F.col("volume")).alias("median_dollar_volume")
    ).where(
        (F.col("median_price") >= cfg.min_price) & (F.col("median_dollar_volume") >= cfg.min_dollar_volume) & (F.col("n_bars") >= cfg.min_bars)
    )
    rank = F.row_number().over(Window.partitionBy("probe_date").orderBy(F.desc("median_dollar_volume"), "symbol"))
    return passed.withColumn("_r", rank).where(F.col("_r") <= cfg.max_symbols).drop("_r")


def union_universe(per_date: DataFrame) -> DataFrame:
    return per_date.select("symbol").distinct()


def existing_symbols(panel: DataFrame, dates: DataFrame, days: int = 7) -> DataFrame:
    """(probe_date, symbol) with a bar in the days up to each date."""
    return panel.join(
        F.broadcast(dates), (F.col("date") <= F.col("probe_date")) & (F.col("date") >= F.date_sub("probe_date", days))
    ).select("probe_date", "symbol").distinct()


def asset_names(symbols: DataFrame, assets: DataFrame) -> DataFrame:
    """symbols + name, null for what the assets don't have."""
    return symbols.join(assets.select("symbol", "name"), "symbol", "left")


def without_benchmark(panel: DataFrame, benchmark: str) -> DataFrame:
    """The panel that a strategy may trade: all but the benchmark's bars."""
    return panel.where(F.col("symbol") != benchmark)


def symbol_of_file(path) -> F.Column:
    """The symbol that a bar file is named by: its name up to the first underscore."""
    return F.substring_index(F.substring_index(path, "/", -1), "_", 1)


def missing_symbols(wanted: DataFrame, returned: DataFrame) -> DataFrame:
    return wanted.join(returned.select("symbol").distinct(), "symbol", "left_anti")


def fund_pattern() -> str:
    return r"(?i)\b(" + "|".join(FUND_WORDS) + r")\b"


def looks_like_fund(name):
    return F.coalesce(F.col(name).rlike(fund_pattern()), F.lit(False))


def exclude_funds(symbols: DataFrame, assets: DataFrame) -> DataFrame:
    """``symbols`` without leveraged funds and those whose known name looks like a fund; unknown names stay."""
    named = symbols.join(assets.select("symbol", F.col("name").alias("_name")), "symbol", "left")
    return named.where(~F.col("symbol").isin(*LEVERAGED) & ~looks_like_fund("_name")).drop("_name")


def candidate_assets(assets: DataFrame) -> DataFrame:
    """Tradable assets of the two exchanges that aren't funds."""
    return assets.where("tradable and exchange in ('NYSE', 'NASDAQ')").where(~looks_like_fund("name")).select("symbol")


def candidate_tickers(spark: SparkSession, longest: int = 4) -> DataFrame:
    """Every ticker of 1 to ``longest`` letters: each numbered once, so no join of alphabets."""
    first = [sum(26**j for j in range(1, n)) for n in range(1, longest + 2)]
    ids = spark.range(first[-1])
    length = sum((F.col("id") >= F.lit(f)).cast("int") for f in first[:-1])
    rest = F.col("id") - F.element_at(F.array(*[F.lit(f) for f in first[:-1]]), length)
    letter = lambda k: F.when(length > k, F.char(65 + F.floor(rest / 26**k) % 26)).otherwise("")
    return ids.select(F.concat(*[letter(k) for k in reversed(range(longest))]).alias("symbol"))
