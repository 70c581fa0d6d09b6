"""Sources and sinks: bar cache, logs, experiment log, universe files, state."""

import hashlib
import json
import time
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.schema import FILLS, require_columns

EXPERIMENT_COLUMNS = (
    "run_id", "date", "git_commit", "phase", "data_start", "data_end", "params_json", "win_rate", "expectancy", "sharpe", "sortino", "max_drawdown", "notes",
)


def write_cache(bars: DataFrame, path: str, timeframe: str) -> None:
    """Bars under timeframe= and symbol= folders, so reads prune to what they ask for."""
    bars.withColumn("timeframe", F.lit(timeframe)).repartition("symbol").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("timeframe", "symbol").parquet(path)


def read_cache(spark: SparkSession, path: str, timeframe: str, symbols: list[str], start=None, end=None, time: str = "ts") -> DataFrame:
    df = spark.read.parquet(path).where((F.col("timeframe") == timeframe) & F.col("symbol").isin(*symbols))
    df = df if start is None else df.where(F.col(time) >= F.lit(start))
    return (df if end is None else df.where(F.col(time) <= F.lit(end))).drop("timeframe")


def cache_or_fetch(spark: SparkSession, path: str, timeframe: str, symbols: list[str], fetch, use_cache: bool = True, first=None, last=None) -> DataFrame:
    """Cached bars, and those of missing symbols from ``fetch(symbols)``, which are cached then. Each range from ``first`` to
    ``last`` is cached for itself, so a longer one never gets a shorter one's bars."""
    timeframe = timeframe if first is None and last is None else f"{timeframe}_{first}_{last}"
    have: set[str] = set()
    if use_cache and exists(spark, path):
        known = spark.read.parquet(path).where((F.col("timeframe") == timeframe) & F.col("symbol").isin(*symbols))
        have = {r["symbol"] for r in known.select("symbol").distinct().collect()}  # at most the symbols asked for
    missing = [s for s in symbols if s not in have]
    if missing:
        write_cache(fetch(missing), path, timeframe)
    return read_cache(spark, path, timeframe, symbols)


def panel_key(panel: DataFrame) -> DataFrame:
    """key, n_symbols, first, last: what names a panel's file, whatever order its symbols come in."""
    key = F.sha2(F.array_join(F.array_sort(F.collect_set("symbol")), ","), 256)
    return panel.agg(F.substring(key, 1, 12).alias("key"), F.count_distinct("symbol").alias("n_symbols"), F.min("date").alias("first"), F.max("date").alias("last"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists, in whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def panel_or_fetch(spark: SparkSession, folder: str, symbols: list[str], first, last, fetch) -> DataFrame:
    """The daily panel of the symbols from ``first`` to ``last``, from its file if there is one, else from
    fetch(symbols, first, last), which is written then."""
    key = hashlib.sha256(",".join(sorted(set(symbols))).encode()).hexdigest()[:12]
    path = f"{folder.rstrip('/')}/panel_{key}_{len(set(symbols))}_{first}_{last}"
    if not exists(spark, f"{path}/_SUCCESS"):
        fetch(symbols, first, last).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_retries(call, attempts: int = 4, wait: float = 3.0, sleep=time.sleep):
    """call(), again after wait, 2 * wait, ... seconds when it fails; the last failure is raised."""
    for n in range(1, attempts + 1):
        try:
            return call()
        except Exception:
            if n == attempts:
                raise
            sleep(wait * n)


def dashboard(equity: float, start: float, positions: dict, day_trades: int, limit: int = 3) -> str:
    """Text of an account's state: equity, profit since the start, open positions, day trades."""
    lines = [f"Equity: {equity:,.2f}", f"P&L: {equity - start:+,.2f} ({(equity / start - 1) * 100:+.2f} %)" if start else "P&L: n/a", f"Day trades: {day_trades}/{limit}"]
    lines += [f"  {s}: {q}" for s, q in sorted(positions.items())] or ["  no open positions"]
    return "\n".join(lines) + "\n"


def write_report(text: str, path: str) -> None:
    """A report's text as a file of the driver."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text)


def verified_fetch(fetch, symbols: DataFrame) -> DataFrame:
    """fetch(symbols) and once more for the symbols it did not return."""
    first = fetch(symbols)
    missing = symbols.join(first.select("symbol").distinct(), "symbol", "left_anti")
    return first.unionByName(fetch(missing))


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """One symbol a line; blank lines don't count."""
    return spark.read.text(path).select(F.trim("value").alias("symbol")).where("symbol <> ''")


def read_seed_universe(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.csv(path, header=True), ("symbol", "name"))


def write_universe(symbols: DataFrame, path: str) -> None:
    symbols.select("symbol").distinct().orderBy("symbol").coalesce(1).write.mode("overwrite").text(path)


def append_log(events: DataFrame, path: str) -> None:
    """JSON lines with a UTC stamp; a new part for each call."""
    events.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()) if "timestamp" in events.columns else F.current_timestamp()).write.mode("append").json(path)


def load_fills(spark: SparkSession, path: str) -> DataFrame:
    """Fill events of a JSON-lines log, typed; empty when there are none."""
    return spark.read.schema(FILLS).json(path).where("event_type = 'fill'")


def append_run(spark: SparkSession, path: str, **fields) -> int:
    """One row of the experiment log; its id follows the largest so far."""
    ids = read_runs(spark, path) if exists(spark, path) else None
    top = ids.agg(F.max("run_id")).first()[0] if ids is not None else None
    run_id = 1 if top is None else int(top) + 1
    row = {"run_id": run_id, "date": datetime.now(UTC).date().isoformat(), **fields}
    row["params_json"] = json.dumps(fields.get("params_json", {}), sort_keys=True)
    schema = ", ".join(f"{c} {'int' if c == 'run_id' else 'string'}" for c in EXPERIMENT_COLUMNS)
    values = [tuple(row.get(c) if c == "run_id" or row.get(c) is None else str(row[c]) for c in EXPERIMENT_COLUMNS)]
    spark.createDataFrame(values, schema).coalesce(1).write.mode("append").option("header", True).option("escape", '"').csv(path)
    return run_id


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'int' if c == 'run_id' else 'double' if c in ('win_rate', 'expectancy', 'sharpe', 'sortino', 'max_drawdown') else 'string'}" for c in EXPERIMENT_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def save_state(state: dict, path: str) -> None:
    """The state as JSON; a crash while writing leaves the earlier one."""
    part = Path(f"{path}.part")
    part.write_text(json.dumps(state, default=str))
    part.replace(path)


def load_state(path: str) -> dict:
    """The saved state; {} if there is none."""
    return json.loads(Path(path).read_text()) if Path(path).exists() else {}


def markdown_table(rows: list[dict], title: str = "") -> str:
    """A report table of a small collected result; null as n/a."""
    if not rows:
        return f"## {title}\n\nNo rows.\n"
    show = lambda v: "n/a" if v is None or v != v else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])]
    lines += ["| " + " | ".join(show(v) for v in r.values()) + " |" for r in rows]
    return (f"## {title}\n\n" if title else "") + "\n".join(lines) + "\n"
