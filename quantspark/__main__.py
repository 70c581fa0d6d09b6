"""Command-line studies: python -m quantspark STUDY PLACE [options].

PLACE is a folder of the driver's tables; for `loop` a folder of bar files, for `kill-switch` the flag file.
"""

import argparse
import datetime as dt
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantspark.operators import hygiene as hy
from quantspark.operators import ml
from quantspark.operators import simulate as sm
from quantspark.plans import queries as q
from quantspark.plans import studies as st
from quantspark.plans.queries import QUERIES
from quantspark.session import session
from quantspark.sources import adapters as ad
from quantspark.sources.io import markdown_table, write_report, write_universe
from quantspark.streaming import live, loop

#: Studies that are reports of catalogue queries.
REPORTS = {
    "data-quality": ["quality_report", "daily_quality"],
    "universe": ["liquidity_screen", "union_universe", "probe_sweep"],
    "pead": ["bucket_summary", "welch_t"],
    "options": ["moneyness_sweep", "crash_stress", "straddle_pnl"],
    "monitor": ["divergence_flags", "reconcile", "fifo_trades"],
}
STUDIES = [*REPORTS, "fetch", "train", "backtest", "momentum", "loop", "kill-switch", "query"]
SIGNAL_FEATURES = ("ret_5", "range_position_20")


def rendered(title: str, tables: dict[str, DataFrame], rows: int) -> str:
    """Markdown of the first rows of each table."""
    return f"# {title}\n\n" + "\n".join(markdown_table([r.asDict() for r in t.limit(rows).collect()], n) for n, t in tables.items())


def signal_data(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows to learn from, the daily panel) without the holdout."""
    panel = hy.exclude_holdout(ad.bars_daily(spark, sf_dir)).withColumn("session_date", F.trunc("date", "month"))
    made = q.ft.add_features(q.lb.triple_barrier(panel, q.BARRIER, "date"), time="date")
    return st.written(q.lb.dataset(made, list(SIGNAL_FEATURES))), panel


def tables(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    if a.study in REPORTS:
        return {n: QUERIES[n](spark, a.place) for n in REPORTS[a.study]}
    if a.study == "query":
        return {a.name: QUERIES[a.name](spark, a.place)}
    if a.study == "fetch":
        raw = ad.raw_bars(spark, a.place)
        symbols = [r.symbol for r in raw.select("symbol").distinct().orderBy("symbol").collect()]  # the seed universe
        fetch = lambda asked: raw.where(F.col("symbol").isin(*asked))
        return {"quality": st.training_data(spark, a.cache, "1Min", symbols, fetch, q.HOURLY)["quality"]}
    if a.study == "momentum":
        panel = ad.bars_daily(spark, a.place)
        if a.refresh_universe:
            chosen = QUERIES["union_universe"](spark, a.place)
            write_universe(chosen, a.refresh_universe)
            panel = panel.join(chosen.select("symbol").unionByName(spark.createDataFrame([(q.BENCHMARK,)], "symbol string")).distinct(), "symbol", "left_semi")
        return st.momentum_study(panel, q.BENCHMARK, q.MOM, shorts=a.shorts, include_holdout=a.include_holdout)
    data, panel = signal_data(spark, a.place)
    cfg = st.SignalStudy(
        SIGNAL_FEATURES, a.folds, model=ml.ModelConfig(iterations=a.trees, depth=a.depth),
        account=sm.AccountConfig(equity=100_000.0, max_holding=q.BARRIER.horizon, risk=q.rk.RiskConfig(stop=q.BARRIER.stop, target=q.BARRIER.profit)), time="date",
    )
    return st.train_study(data, panel, cfg, a.model, "range_position_20") if a.study == "train" else st.backtest_study(data, cfg)


def run_loop(spark: SparkSession, a: argparse.Namespace) -> int:
    """One iteration over the bars of a folder with the in-memory broker and a saved model of SIGNAL_FEATURES."""
    bars = loop.live_bars(spark.read.schema(live.BAR).parquet(a.place).withColumn("ts", F.col("ts").cast("timestamp_ntz")))
    model = ml.load_model(a.model)

    def scorer(seen: DataFrame) -> DataFrame:
        return ml.score_latest(model, q.ft.add_features(seen), list(SIGNAL_FEATURES))

    log = loop.log_lines(a.log) if a.log else lambda e: print(e)
    ended = loop.iterate(bars, scorer, live.Broker(), live.KillSwitch(a.flag), a.state, dt.datetime.now(dt.UTC).replace(tzinfo=None), log=log)
    return int(ended != "completed")


def kill_switch(a: argparse.Namespace) -> int:
    switch = live.KillSwitch(a.place)
    if a.action == "engage":
        switch.engage("command line")
    elif a.action == "disengage":
        switch.disengage()
    print("engaged" if switch.engaged else "not engaged")
    return 0


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quantspark", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("study", choices=STUDIES)
    p.add_argument("place")
    p.add_argument("--name", help="query: name of a catalogue query")
    p.add_argument("--rows", type=int, default=20, help="rows shown of a table")
    p.add_argument("--out", help="file for the report; standard output otherwise")
    p.add_argument("--cache", default="cache/bars", help="fetch: folder of cached bars")
    p.add_argument("--model", help="train: folder to save the model in; loop: the model")
    p.add_argument("--folds", type=int, default=5)
    p.add_argument("--trees", type=int, default=ml.ModelConfig().iterations)
    p.add_argument("--depth", type=int, default=ml.ModelConfig().depth)
    p.add_argument("--include-holdout", action="store_true", help="momentum: use the held-out period too")
    p.add_argument("--refresh-universe", metavar="FILE", help="momentum: screen the universe anew, write it there and trade it")
    p.add_argument("--shorts", action="store_true", help="momentum: sell the losers short as well")
    p.add_argument("--state", default="loop_state.json", help="loop: state between iterations")
    p.add_argument("--flag", default="kill_switch", help="loop: the kill switch's flag file")
    p.add_argument("--log", help="loop: file of JSON lines")
    p.add_argument("--action", choices=["status", "engage", "disengage"], default="status", help="kill-switch: what to do")
    a = p.parse_args(args)
    if a.study == "kill-switch":
        return kill_switch(a)
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    if a.study == "loop":
        return run_loop(spark, a)
    made = tables(spark, a)
    text = rendered(a.study, made, a.rows)
    write_report(text, a.out) if a.out else sys.stdout.write(text)
    if a.study == "data-quality":  # an unclean table ends with 1
        return int(made["quality_report"].where("not is_clean").limit(1).count())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
