"""The catalogue in SQL that DuckDB runs on the same tables. Written from the definitions, not from the plans."""

FUND_SQL = (
    r"(?i)\b(ETF|ETN|ETP|Fund|Index|Portfolio|iShares|ProShares|Direxion|SPDR|Invesco|Vanguard|Xtrackers|WisdomTree|VanEck|Global X|"
    r"Ultra|UltraShort|Bull|Bear|[23]X|Term Trust|Physical\s+\w+\s+Trust|Grayscale|Sprott|Depositary\s+Receipt)\b"
)
K = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
PART = {
    "daily": f"""SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, first(p_retailprice ORDER BY {K}) AS open,
        max(p_retailprice) AS high, min(p_retailprice) AS low, last(p_retailprice ORDER BY {K}) AS close, sum(l_quantity) AS volume
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
    "cal": "SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM daily)",
    "ends": "SELECT max(date) AS date FROM cal GROUP BY date_trunc('month', date)",
    "intra": """SELECT symbol, ts, CAST(ts AS DATE) AS session_date, open, high, low, close, volume FROM (
      SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, first(value ORDER BY events.ts, event_id) AS open, max(value) AS high,
        min(value) AS low, last(value ORDER BY events.ts, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM events GROUP BY 1, date_trunc('hour', events.ts))""",
    "raw": """SELECT event_type AS symbol, date_trunc('minute', ts) AS ts, value AS open, value + 1 AS high, value - 1 AS low,
        value AS close, CAST(event_id % 100 AS DOUBLE) AS volume, event_id AS seq FROM events""",
    # The events lie in winter, when the exchange's clock is five hours behind.
    "sess": """SELECT *, ts - INTERVAL 5 HOUR AS local_ts, CAST(ts - INTERVAL 5 HOUR AS DATE) AS session_date FROM raw
      WHERE hour(ts - INTERVAL 5 HOUR) * 60 + minute(ts - INTERVAL 5 HOUR) BETWEEN 570 AND 959""",
    "arr": f"""SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, p_retailprice AS open, p_retailprice AS high,
        p_retailprice + CASE WHEN l_tax = 0.08 THEN 1 ELSE 0 END AS low, p_retailprice AS close, l_quantity AS volume, {K}
      FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "fl": """SELECT user_id AS symbol, event_id AS seq, ts, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS side,
        CAST(event_id % 10 + 1 AS BIGINT) AS qty, value AS price FROM events WHERE event_type IN ('purchase', 'signup')""",
    "ord": """SELECT 'Brand#' || CAST(o_custkey % 25 // 5 + 1 AS VARCHAR) || CAST(o_custkey % 5 + 1 AS VARCHAR) AS symbol,
        CAST(o_orderdate AS DATE) AS announced, o_orderkey AS order_key, o_totalprice / 1000 AS reported_eps FROM orders""",
    "earn": """SELECT * FROM (SELECT *, lag(reported_eps) OVER (PARTITION BY symbol ORDER BY announced, order_key) AS estimate_eps FROM ord)
      WHERE estimate_eps IS NOT NULL""",
    "probes": "SELECT unnest([DATE '1996-06-28', DATE '1997-06-30', DATE '1998-06-30', DATE '1999-06-30']) AS probe_date",
    "screen": """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY probe_date ORDER BY median_dollar_volume DESC, symbol) AS r FROM (
        SELECT probe_date, symbol, count(*) AS n_bars, median(close) AS median_price, median(close * volume) AS median_dollar_volume
        FROM daily JOIN probes ON date <= probe_date AND date > probe_date - INTERVAL 90 DAY GROUP BY 1, 2)
      WHERE median_price >= 5 AND median_dollar_volume >= 20000 AND n_bars >= 36) WHERE r <= 10""",
    "r": """SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS ret, close - lag(close) OVER w AS d FROM daily
      WINDOW w AS (PARTITION BY symbol ORDER BY date)""",
    "feat": """SELECT symbol, date, close, volume, """ + ", ".join(f"close / nullif(lag(close, {n}) OVER w, 0) - 1 AS ret_{n}" for n in (5, 15, 30, 60)) + ", " + ", ".join(
        f"CASE WHEN count(ret) OVER w{n} = {n} THEN stddev_samp(ret) OVER w{n} END AS vol_{n}" for n in (30, 60)) + """,
        volume / nullif(CASE WHEN count(volume) OVER w30 = 30 THEN avg(volume) OVER w30 END, 0) AS rel_vol_30,
        (close - sum(close * volume) OVER m / nullif(sum(volume) OVER m, 0)) / nullif(sum(close * volume) OVER m / nullif(sum(volume) OVER m, 0), 0) AS vwap_dev,
        CASE WHEN count(d) OVER w14 = 14 THEN avg(greatest(d, 0)) OVER w14 END AS gain, CASE WHEN count(d) OVER w14 = 14 THEN avg(greatest(-d, 0)) OVER w14 END AS loss,
        (close - CASE WHEN count(low) OVER w20 = 20 THEN min(low) OVER w20 END) / nullif(max(high) OVER w20 - min(low) OVER w20, 0) AS range_position_20
      FROM r WINDOW w AS (PARTITION BY symbol ORDER BY date), """ + ", ".join(
        f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (14, 20, 30, 60)) + """,
        m AS (PARTITION BY symbol, date_trunc('month', date) ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "f": """SELECT *, CASE WHEN loss = 0 AND gain > 0 THEN 100.0 WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi_14 FROM feat""",
    "num": "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM daily",
    "hits": """SELECT a.symbol, a.date, a.close, min(b.k - a.k) FILTER (WHERE b.high >= a.close * 1.03) AS fp,
        min(b.k - a.k) FILTER (WHERE b.low <= a.close * (1 - 0.03)) AS fs, count(b.k) AS nb, arg_max(b.close, b.k) AS last_close
      FROM num a LEFT JOIN num b ON a.symbol = b.symbol AND b.k BETWEEN a.k + 1 AND a.k + 5 GROUP BY 1, 2, 3""",
    "lab": """SELECT symbol, date, CAST(CASE WHEN fs IS NOT NULL AND (fp IS NULL OR fs <= fp) THEN -1 WHEN fp IS NOT NULL THEN 1 WHEN nb = 5 THEN 0 END AS INT) AS label,
        CAST(CASE WHEN fs IS NOT NULL AND (fp IS NULL OR fs <= fp) THEN fs WHEN fp IS NOT NULL THEN fp WHEN nb = 5 THEN 5 END AS INT) AS exit_bar_offset,
        CASE WHEN fs IS NOT NULL AND (fp IS NULL OR fs <= fp) THEN -0.03 WHEN fp IS NOT NULL THEN 0.03 WHEN nb = 5 THEN last_close / close - 1 END AS realized_return
      FROM hits""",
    "blk": "SELECT count(*) AS n, count(*) // 6 AS size FROM cal",
    "fid": """SELECT CAST(f AS INT) AS fold_id, 1 AS a, greatest(1, size * (f + 1) - 4) AS b, size * (f + 1) + 1 AS c,
        CASE WHEN f < 4 THEN size * (f + 2) ELSE n END AS d FROM blk, range(5) t(f)""",
    "folds": """SELECT fold_id, x.date AS train_start, y.date AS train_end, z.date AS test_start, w.date AS test_end FROM fid
      JOIN cal x ON x.i = a JOIN cal y ON y.i = b JOIN cal z ON z.i = c JOIN cal w ON w.i = d""",
    "px": "SELECT daily.*, i FROM daily JOIN cal USING (date)",
    "scored": """SELECT p.symbol, p.date, p.close, p.i, s.close / nullif(f.close, 0) - 1 AS score,
        (SELECT CASE WHEN count(*) = 5 THEN avg(v.close * v.volume) END FROM px v WHERE v.symbol = p.symbol AND v.i BETWEEN p.i - 4 AND p.i) AS dollar_volume
      FROM px p LEFT JOIN px s ON s.symbol = p.symbol AND s.i = p.i - 5 LEFT JOIN px f ON f.symbol = p.symbol AND f.i = p.i - 20""",
    "elig": "SELECT s.* FROM scored s JOIN ends USING (date) WHERE score IS NOT NULL AND close >= 5 AND dollar_volume >= 1000",
    "longs": "SELECT * FROM (SELECT date, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS INT) AS rank, symbol, score FROM elig) WHERE rank <= 5",
    "shorts": "SELECT * FROM (SELECT date, CAST(row_number() OVER (PARTITION BY date ORDER BY score, symbol) AS INT) AS rank, symbol, score FROM elig) WHERE rank <= 5",
    "pri": """SELECT *, close * volume AS dv, CASE WHEN count(ret) OVER p = 60 THEN stddev_samp(ret) OVER p END AS sd,
        CASE WHEN count(volume) OVER p = 60 THEN avg(volume) OVER p END AS mv FROM r
      WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)""",
    "ev": """SELECT symbol, date, close, ret, ret / nullif(sd, 0) AS ret_sigma, volume / nullif(mv, 0) AS volume_multiple,
        coalesce((abs(ret / nullif(sd, 0)) >= 1.5 OR (sd = 0 AND ret <> 0)) AND volume / nullif(mv, 0) >= 1.5 AND close >= 5 AND dv >= 1000, false) AS is_event FROM pri""",
    "react": "SELECT e.*, (SELECT min(date) FROM cal WHERE date > announced) AS reaction_date FROM earn e",
    "ar": """SELECT e.symbol, announced, order_key, dn.date AS entry_date, dx.date AS exit_date, x.close / n.close - 1 AS stock_return,
        bx.close / bn.close - 1 AS benchmark_return, x.close / n.close - 1 - (bx.close / bn.close - 1) AS abnormal_return, t.close / nullif(b.close, 0) - 1 AS reaction_return
      FROM react e JOIN cal c ON c.date = reaction_date JOIN cal dn ON dn.i = c.i + 1 JOIN cal dx ON dx.i = c.i + 11
      JOIN px n ON n.symbol = e.symbol AND n.i = c.i + 1 JOIN px x ON x.symbol = e.symbol AND x.i = c.i + 11
      JOIN px bn ON bn.symbol = 'Brand#11' AND bn.i = c.i + 1 JOIN px bx ON bx.symbol = 'Brand#11' AND bx.i = c.i + 11
      LEFT JOIN px t ON t.symbol = e.symbol AND t.i = c.i LEFT JOIN px b ON b.symbol = e.symbol AND b.i = c.i - 1 WHERE n.close > 0 AND bn.close > 0""",
    "sues": """SELECT symbol, announced, order_key, round(sue, 6) AS sue FROM (
      SELECT *, CASE WHEN count(*) OVER p >= 6 THEN (s - avg(s) OVER p) / nullif(stddev_samp(s) OVER p, 0) END AS sue
      FROM (SELECT *, reported_eps - estimate_eps AS s FROM earn)
      WINDOW p AS (PARTITION BY symbol ORDER BY announced, order_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE sue IS NOT NULL""",
    "bk": """SELECT symbol, announced, order_key, sue, CAST(greatest(1, ceil((r - 1) * 5 / CAST(nullif(t - 1, 0) AS DOUBLE))) AS INT) AS bucket FROM (
      SELECT *, row_number() OVER (ORDER BY sue, symbol, announced, order_key) AS r, count(*) OVER () AS t FROM sues)""",
    "one": "SELECT date, close FROM daily WHERE symbol = 'Brand#11'",
    "fri": """SELECT DISTINCT CAST(d + CAST((12 - dayofweek(d)) % 7 + 14 AS INT) AS DATE) AS expiry FROM (SELECT CAST(date_trunc('month', date) AS DATE) AS d FROM one)""",
    "mo": """SELECT expiry, min(date) FILTER (WHERE date < expiry) AS entry, arg_min(close, date) FILTER (WHERE date < expiry) AS spot, arg_max(close, date) AS settle
      FROM fri JOIN one ON date >= expiry - 30 AND date <= expiry GROUP BY 1 HAVING min(date) FILTER (WHERE date < expiry) IS NOT NULL""",
    "st": """SELECT mo.*, m AS moneyness, round_even(spot * m, 0) AS strike, round(spot * 0.01, 2) AS premium
      FROM mo, (SELECT CAST(unnest([1.00, 0.99, 0.98, 0.97, 0.95, 0.92, 0.90]) AS DOUBLE) AS m)""",
    "put": """SELECT *, settle < strike AS assigned, premium - greatest(0, strike - settle) AS pnl_per_share,
        (premium - greatest(0, strike - settle)) / nullif(strike, 0) AS ret_on_capital FROM st""",
    "ms": """SELECT moneyness, count(*) AS n, avg(ret_on_capital) AS mean_ret, min(ret_on_capital) AS worst_ret, max(ret_on_capital) AS best_ret,
        avg(CASE WHEN ret_on_capital > 0 THEN 1.0 ELSE 0 END) AS win_rate, count(*) FILTER (WHERE assigned) AS n_assigned, avg(ret_on_capital) * 12 AS annualised,
        avg(ret_on_capital) / nullif(stddev_samp(ret_on_capital) / sqrt(count(*)), 0) AS t_stat, avg(premium / spot) AS mean_premium
      FROM put GROUP BY 1 HAVING count(*) >= 12""",
    "sig": "SELECT symbol, date, label, realized_return FROM lab WHERE label IS NOT NULL",
    "cum": """SELECT symbol AS account, date, ts, side, qty, price, seq, sum(CASE WHEN side = 'buy' THEN qty ELSE 0 END) OVER w AS b,
        sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) OVER w AS s FROM (SELECT *, CAST(ts AS DATE) AS date FROM fl)
      WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)""",
    "eff": """SELECT *, s - greatest(0, -min(b - s) OVER w) AS e FROM cum WINDOW w AS (PARTITION BY account ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "eff2": "SELECT *, coalesce(lag(e) OVER (PARTITION BY account ORDER BY ts, seq), 0) AS pe FROM eff",
    "fifo": """SELECT x.account AS symbol, x.ts AS entry_time, y.ts AS exit_time, x.price AS entry_price, y.price AS exit_price,
        CAST(least(x.b, y.e) - greatest(x.b - x.qty, y.pe) AS BIGINT) AS qty,
        (least(x.b, y.e) - greatest(x.b - x.qty, y.pe)) * (y.price - x.price) AS pnl
      FROM eff2 x JOIN eff2 y ON x.account = y.account AND x.side = 'buy' AND y.side = 'sell' AND y.e > y.pe AND x.b - x.qty < y.e AND y.pe < x.b""",
    "tr": """SELECT CAST(symbol % 5 AS VARCHAR) AS account, CAST(symbol AS VARCHAR) AS symbol, exit_time, round(pnl, 4) AS pnl, pnl / nullif(qty * entry_price, 0) AS return_pct,
        date_diff('day', CAST(entry_time AS DATE), CAST(exit_time AS DATE)) AS holding_bars, CAST(exit_time AS DATE) = CAST(entry_time AS DATE) AS is_day_trade,
        CASE WHEN pnl > 0 THEN 'target' ELSE 'stop' END AS exit_reason FROM fifo""",
    "cv": "SELECT symbol AS account, date, close AS equity FROM daily",
    "cvr": """SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS ret, equity / max(equity) OVER w - 1 AS dd FROM cv WINDOW w AS (PARTITION BY account ORDER BY date)""",
    "pm": """SELECT account, count(*) AS n_days, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return,
        CASE WHEN count(*) >= 2 THEN pow(arg_max(equity, date) / arg_min(equity, date), 252.0 / count(*)) - 1 END AS cagr, stddev_samp(ret) * sqrt(252) AS annual_vol,
        avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(252) AS sharpe, avg(ret) / nullif(stddev_samp(ret) FILTER (WHERE ret < 0), 0) * sqrt(252) AS sortino, min(dd) AS max_drawdown
      FROM cvr GROUP BY 1""",
    "al": """SELECT date, a.close / nullif(lag(a.close) OVER (ORDER BY date), 0) - 1 AS a, b.close / nullif(lag(b.close) OVER (ORDER BY date), 0) - 1 AS b
      FROM (SELECT date, close FROM daily WHERE symbol = 'Brand#12') a JOIN one b USING (date)""",
    "al2": "SELECT * FROM al WHERE a IS NOT NULL AND b IS NOT NULL",
    "acct": "SELECT event_type AS account, ts, 10000.0 + value AS equity FROM events",
    "assets": "SELECT CAST(p_partkey AS VARCHAR) AS symbol, name FROM named",
    "named": """SELECT p_partkey, p_size, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' ' ||
        ['Common Stock', 'ETF', 'Realty Trust', 'Index Fund', 'Holdings Inc', 'Ultra Shares', 'Bullfrog Spas', 'Term Trust'][CAST(p_partkey % 8 + 1 AS INT)] AS name FROM part""",
}
NEEDS = {
    "cal": ["daily"], "ends": ["cal"], "sess": ["raw"], "earn": ["ord"], "screen": ["daily", "probes"], "r": ["daily"], "feat": ["r"], "f": ["feat"],
    "num": ["daily"], "hits": ["num"], "lab": ["hits"], "blk": ["cal"], "fid": ["blk"], "folds": ["fid", "cal"], "px": ["daily", "cal"], "scored": ["px"],
    "elig": ["scored", "ends"], "longs": ["elig"], "shorts": ["elig"], "pri": ["r"], "ev": ["pri"], "react": ["earn", "cal"], "ar": ["react", "px"],
    "sues": ["earn"], "bk": ["sues"], "one": ["daily"], "fri": ["one"], "mo": ["fri", "one"], "st": ["mo"], "put": ["st"], "ms": ["put"], "sig": ["lab"],
    "cum": ["fl"], "eff": ["cum"], "eff2": ["eff"], "fifo": ["eff2"], "tr": ["fifo"], "cv": ["daily"], "cvr": ["cv"], "pm": ["cvr"], "al": ["daily", "one"],
    "al2": ["al"], "assets": ["named"],
}


def q(body: str, *parts: str) -> str:
    """A query over named parts and whatever these need, in order."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for n in NEEDS.get(name, ()):
                add(n)
            order.append(name)

    for p in parts:
        add(p)
    return ("WITH " + ",\n".join(f"{n} AS ({PART[n]})" for n in order) + "\n" if order else "") + body


def rr(*columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


SIGNAL = """WITH_PARTS SELECT h.account, n_trades, round(win_rate, 6) AS win_rate, round(expectancy, 6) AS expectancy, round(sharpe, 6) AS sharpe,
  round(max_drawdown, 6) AS max_drawdown FROM (
  SELECT account, count(*) AS n_trades, avg(CASE WHEN label = 1 THEN 1.0 ELSE 0 END) AS win_rate, avg(realized_return) AS expectancy FROM s GROUP BY 1) h
JOIN (SELECT account, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252) AS sharpe, min(e / m - 1) AS max_drawdown FROM (
  SELECT *, max(e) OVER (PARTITION BY account ORDER BY date) AS m FROM (
    SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY account ORDER BY date)) AS e FROM (
      SELECT account, date, avg(realized_return) AS r FROM s GROUP BY 1, 2))) GROUP BY 1) d ON d.account = h.account"""


def signal(source: str, *parts: str, account: str = "account") -> str:
    text = q("", *parts) + f", s AS ({source}) " + SIGNAL.removeprefix("WITH_PARTS ")
    return text.replace("SELECT h.account", f"SELECT h.account AS {account}", 1)


def gap(side: str) -> str:
    bull = side == "bull"
    lo, hi, lt, gt, le = ("low", "high", "<", ">", "<=") if bull else ("high", "low", ">", "<", ">=")
    return q(f""", g0 AS (SELECT *, row_number() OVER d AS i, CASE WHEN lag({hi}, 2) OVER d {lt} {lo} THEN row_number() OVER d END AS fi,
      lag({hi}, 2) OVER d AS far FROM intra WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ts)),
    g1 AS (SELECT *, last_value(fi IGNORE NULLS) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS now_i,
      last_value(fi IGNORE NULLS) OVER (d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS was_i FROM g0 WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ts)),
    g2 AS (SELECT a.*, n.{lo} AS near, w.far AS was_far FROM g1 a LEFT JOIN g0 n ON n.symbol = a.symbol AND n.session_date = a.session_date AND n.i = a.now_i
      LEFT JOIN g0 w ON w.symbol = a.symbol AND w.session_date = a.session_date AND w.i = a.was_i),
    g3 AS (SELECT *, coalesce(close {lt} was_far OR {lo} {le} was_far, false) AS hit, close {lt} was_far AS beyond FROM g2),
    g4 AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, session_date, coalesce(was_i, 0) ORDER BY ts) AS hits FROM g3),
    g5 AS (SELECT *, fi IS NOT NULL OR (was_i IS NOT NULL AND hits = 0) AS act,
      last_value(CASE WHEN hit AND hits = 1 AND beyond THEN i END IGNORE NULLS) OVER (PARTITION BY symbol, session_date ORDER BY ts) AS inv FROM g4)
    SELECT symbol, ts, CAST(act AS INT) AS {side}_fvg_active, round(CASE WHEN act THEN {'' if bull else '-'}(close - near) / nullif(close, 0) ELSE 0.0 END, 6) + 0.0 AS {side}_fvg_dist,
      CAST(coalesce(least(i - inv, 24), 24) AS INT) AS bars_since_{side}_ifvg FROM g5""", "intra").replace("\n, g0 AS", ", g0 AS", 1)


PO3 = """, p0 AS (SELECT *, hour(ts) * 60 + minute(ts) < 240 AS ins, row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts) AS i FROM intra),
p1 AS (SELECT *, max(CASE WHEN ins THEN high END) OVER d AS rh, min(CASE WHEN ins THEN low END) OVER d AS rl FROM p0 WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ts)),
p2 AS (SELECT *, coalesce(NOT ins AND high > rh AND close <= rh, false) AS sh, coalesce(NOT ins AND low < rl AND close >= rl, false) AS sl FROM p1)
"""


def po3(body: str) -> str:
    return q("", "intra").rstrip() + PO3 + body


ORACLE = {
    "dup_flags": q("SELECT symbol, ts, seq, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) > 1 AS is_duplicate FROM raw", "raw"),
    "impossible_values": q(f"SELECT symbol, ts, seq, {rr('low', 'volume')} FROM raw WHERE least(open, high, low, close) <= 0 OR high < low OR volume < 0", "raw"),
    "extreme_jumps": q(f"""SELECT symbol, ts, seq, {rr('close')} FROM (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) - 1) AS j FROM raw)
      WHERE j > 0.5""", "raw"),
    "regular_session": q(f"SELECT symbol, local_ts, session_date, seq, {rr('close')} FROM sess", "sess"),
    "halt_like_days": q("SELECT symbol, session_date, 24 - count(DISTINCT hour(ts)) AS n_missing FROM intra GROUP BY 1, 2 HAVING 24 - count(DISTINCT hour(ts)) > 2", "intra"),
    "quality_report": q("""SELECT symbol, count(*) AS n_rows, count(*) FILTER (WHERE dup) AS n_duplicates, count(*) FILTER (WHERE bad) AS n_impossible, count(*) FILTER (WHERE j > 0.5) AS n_jumps,
        coalesce(any_value(h.n), 0) AS n_halt_days, count(*) FILTER (WHERE dup) = 0 AND count(*) FILTER (WHERE bad) = 0 AND any_value(h.n) IS NULL AS is_clean
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) > 1 AS dup, least(open, high, low, close) <= 0 OR high < low OR volume < 0 AS bad,
        abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY ts, seq), 0) - 1) AS j FROM raw)
      LEFT JOIN (SELECT symbol, count(*) AS n FROM (SELECT symbol, session_date FROM sess GROUP BY 1, 2 HAVING 390 - count(DISTINCT local_ts) > 5) GROUP BY 1) h USING (symbol) GROUP BY symbol""", "sess"),
    "clean_bars": q(f"""SELECT symbol, session_date, ts, {rr('close', 'volume')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY seq) AS n FROM sess) s
      WHERE n = 1 AND NOT (least(open, high, low, close) <= 0 OR high < low OR volume < 0)
        AND NOT EXISTS (SELECT 1 FROM sess t WHERE t.symbol = s.symbol AND t.session_date = s.session_date HAVING 390 - count(DISTINCT t.local_ts) > 385)""", "sess"),
    "daily_quality": q(f"""SELECT count(*) AS n_rows, count(DISTINCT symbol) AS n_symbols, count(*) FILTER (WHERE n > 1) AS n_duplicates, count(*) FILTER (WHERE high < low OR low <= 0) AS n_impossible,
      count(*) FILTER (WHERE abs(j) > 0.05) AS n_jumps FROM (SELECT *, row_number() OVER w AS n, close / lag(close) OVER (PARTITION BY symbol ORDER BY date, {K}) - 1 AS j FROM arr
      WINDOW w AS (PARTITION BY symbol, date ORDER BY {K}))""", "arr"),
    "discontinuity_split": q(f"""SELECT symbol, date, {rr('open', 'high', 'low', 'close', 'volume')} FROM (
      SELECT *, max(CASE WHEN abs(ret) > 0.08 THEN date END) OVER (PARTITION BY symbol) AS l FROM r) WHERE l IS NULL OR date >= l""", "r"),
    "clean_daily_panel": q(f""", c0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY {K}) AS n FROM arr) WHERE n = 1 AND high >= low AND low > 0),
      c1 AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS ret FROM c0)
      SELECT symbol, date, {rr('open', 'high', 'low', 'close', 'volume')} FROM (SELECT *, max(CASE WHEN abs(ret) > 0.08 THEN date END) OVER (PARTITION BY symbol) AS l FROM c1)
      WHERE l IS NULL OR date >= l""", "arr").replace("\n, c0 AS", ", c0 AS", 1),
    "holdout_exclude": q(f"SELECT symbol, date, {rr('open', 'high', 'low', 'close', 'volume')} FROM daily WHERE date NOT BETWEEN DATE '1995-05-01' AND DATE '1995-07-31'", "daily"),
    "fund_name_filter": q(f"SELECT p_partkey AS symbol, name, coalesce(regexp_matches(name, '{FUND_SQL}'), false) AS is_fund FROM named", "named"),
    "exclude_funds": q(f"""SELECT w.symbol FROM (SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM part UNION ALL SELECT unnest(['TQQQ', 'UVXY', 'AAPL', 'MSFT'])) w LEFT JOIN assets a USING (symbol)
      WHERE w.symbol NOT IN ('TQQQ', 'UVXY') AND NOT coalesce(regexp_matches(a.name, '{FUND_SQL}'), false)""", "assets"),
    "asset_lookup": q("""SELECT w.symbol, a.name FROM (SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM part UNION ALL SELECT unnest(['TQQQ', 'UVXY', 'AAPL', 'MSFT'])) w
      LEFT JOIN assets a USING (symbol)""", "assets"),
    "candidate_assets": q(f"SELECT CAST(p_partkey AS VARCHAR) AS symbol FROM named WHERE p_size > 5 AND p_partkey % 3 < 2 AND NOT regexp_matches(name, '{FUND_SQL}')", "named"),
    "liquidity_filter": q("""SELECT symbol, round(avg(close), 6) AS avg_price, round(avg(close * volume), 6) AS avg_dollar_volume FROM daily GROUP BY 1
      HAVING avg(close * volume) >= 20000 AND avg(close) BETWEEN 5 AND 1000""", "daily"),
    "liquidity_screen": q(f"SELECT probe_date, symbol, n_bars, {rr('median_price', 'median_dollar_volume')} FROM screen", "screen"),
    "existence_probe": q("SELECT DISTINCT probe_date, symbol FROM daily JOIN probes ON date <= probe_date AND date >= probe_date - INTERVAL 7 DAY", "daily", "probes"),
    "probe_sweep": q("SELECT probe_date, count(DISTINCT symbol) AS n_symbols FROM daily JOIN probes ON date <= probe_date AND date >= probe_date - INTERVAL 2 DAY GROUP BY 1", "daily", "probes"),
    "union_universe": q("SELECT DISTINCT symbol FROM screen", "screen"),
    "missing_symbols": q("SELECT DISTINCT symbol FROM daily EXCEPT SELECT symbol FROM daily JOIN probes ON date <= probe_date AND date >= probe_date - INTERVAL 1 DAY", "daily", "probes"),
    "candidate_tickers": """WITH one AS (SELECT chr(CAST(65 + a AS INT)) AS x FROM range(26) t(a))
      SELECT x AS symbol FROM one UNION ALL SELECT a.x || b.x FROM one a, one b UNION ALL SELECT a.x || b.x || c.x FROM one a, one b, one c
      UNION ALL SELECT a.x || b.x || c.x || d.x FROM one a, one b, one c, one d""",
    "panel_cache_key": q("SELECT substr(sha256(string_agg(symbol, ',' ORDER BY symbol)), 1, 12) AS key, count(*) AS n_symbols, min(a) AS first, max(b) AS last FROM (SELECT symbol, min(date) AS a, max(date) AS b FROM daily GROUP BY 1)", "daily"),
    "feat_returns": q(f"SELECT symbol, date, {rr('ret_5', 'ret_15', 'ret_30', 'ret_60')} FROM f", "f"),
    "feat_volatility": q(f"SELECT symbol, date, {rr('vol_30', 'vol_60')} FROM f", "f"),
    "feat_relvol": q(f"SELECT symbol, date, {rr('rel_vol_30')} FROM f", "f"),
    "feat_vwap_dev": q(f"SELECT symbol, date, {rr('vwap_dev')} FROM f", "f"),
    "feat_rsi": q(f"SELECT symbol, date, {rr('rsi_14')} FROM f", "f"),
    "feat_range_pos": q(f"SELECT symbol, date, {rr('range_position_20')} FROM f", "f"),
    "feat_all": q(f"SELECT symbol, date, {rr('ret_5', 'ret_15', 'ret_30', 'ret_60', 'vol_30', 'vol_60', 'rel_vol_30', 'vwap_dev', 'rsi_14', 'range_position_20')} FROM f", "f"),
    "feat_minutes": q("SELECT symbol, seq, CAST(hour(local_ts) * 60 + minute(local_ts) - 570 AS INT) AS minutes_since_open FROM sess", "sess"),
    "po3_range": po3("SELECT symbol, ts, round((close - rh) / nullif(rh, 0), 6) AS dist_to_accum_high, round((close - rl) / nullif(rl, 0), 6) AS dist_to_accum_low FROM p2"),
    "po3_sweeps": po3("""SELECT symbol, ts, CAST(max(CAST(sh AS INT)) OVER n AS INT) AS swept_accum_high_recent, CAST(max(CAST(sl AS INT)) OVER n AS INT) AS swept_accum_low_recent,
      CAST(coalesce(least(i - max(CASE WHEN sh OR sl THEN i END) OVER d, 24), 24) AS INT) AS bars_since_sweep,
      CAST(coalesce(last_value(CASE WHEN sl THEN 1 WHEN sh THEN -1 END IGNORE NULLS) OVER d, 0) AS INT) AS sweep_direction FROM p2
      WINDOW d AS (PARTITION BY symbol, session_date ORDER BY ts), n AS (PARTITION BY symbol, session_date ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)"""),
    "fvg_bull": gap("bull"),
    "fvg_bear": gap("bear"),
    "triple_barrier": q(f"SELECT symbol, date, label, exit_bar_offset, {rr('realized_return')} FROM lab", "lab"),
    "class_balance": q("""SELECT label, n, n_valid, n_dropped, round(n / n_valid, 6) AS proportion, min(n / n_valid) OVER () < 0.1 AS is_skewed FROM (
      SELECT label, count(*) AS n FROM lab WHERE label IS NOT NULL GROUP BY 1),
      (SELECT CAST(count(label) AS BIGINT) AS n_valid, CAST(count(*) - count(label) AS BIGINT) AS n_dropped FROM lab)""", "lab"),
    "walk_forward_folds": q("SELECT * FROM folds", "folds"),
    "fold_split_counts": q("""SELECT fold_id, CASE WHEN date BETWEEN test_start AND test_end THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM daily
      JOIN folds ON date BETWEEN train_start AND train_end OR date BETWEEN test_start AND test_end GROUP BY 1, 2""", "daily", "folds"),
    "month_ends": q("SELECT date FROM ends", "ends"),
    "momentum_scores": q(f"SELECT symbol, date, {rr('score')} FROM scored WHERE score IS NOT NULL", "scored"),
    "dollar_volume_21": q(f"SELECT symbol, date, {rr('dollar_volume')} FROM scored WHERE dollar_volume IS NOT NULL", "scored"),
    "momentum_longs": q(f"SELECT date, rank, symbol, {rr('score')} FROM longs", "longs"),
    "momentum_shorts": q(f"SELECT date, rank, symbol, {rr('score')} FROM shorts", "shorts"),
    "long_short_targets": q(f"SELECT date, 'long' AS side, rank, symbol, {rr('score')} FROM longs UNION ALL SELECT date, 'short', rank, symbol, round(score, 6) FROM shorts", "longs", "shorts"),
    "next_day_fill": q("SELECT e.date, n.date AS fill_date FROM ends e JOIN cal c ON c.date = e.date JOIN cal n ON n.i = c.i + 1", "ends"),
    "event_detect": q(f"SELECT symbol, date, {rr('ret', 'ret_sigma', 'volume_multiple')} FROM ev WHERE is_event", "ev"),
    "event_summary": q("""SELECT count(*) AS n_events, count(DISTINCT symbol) AS n_symbols, count(*) FILTER (WHERE ret > 0) AS n_up, count(*) FILTER (WHERE ret < 0) AS n_down,
      round(median(ret), 6) AS median_ret, round(count(*) / nullif(count(DISTINCT symbol), 0) / 10.3, 6) AS per_symbol_year FROM ev WHERE is_event""", "ev"),
    "forward_returns": q("""SELECT CAST(h AS INT) AS horizon, direction, count(*) AS n, round(avg(fwd), 6) AS mean_return, round(median(fwd), 6) AS median_return FROM (""" + " UNION ALL ".join(
        f"SELECT {h} AS h, is_event, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS direction, lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS fwd FROM ev" for h in (5, 10, 20, 40, 60)
    ) + ") WHERE is_event AND fwd IS NOT NULL GROUP BY 1, 2", "ev"),
    "drift_targets": q("""SELECT date, rank, symbol, round(strength, 6) AS strength FROM (SELECT date, symbol, strength, CAST(row_number() OVER (PARTITION BY date ORDER BY strength DESC, symbol) AS INT) AS rank FROM (
      SELECT m.date, e.symbol, max(abs(ret_sigma)) AS strength FROM ev e JOIN cal c ON c.date = e.date JOIN (SELECT date, i FROM ends JOIN cal USING (date)) m ON m.i BETWEEN c.i + 1 AND c.i + 40
      WHERE is_event AND ret > 0 GROUP BY 1, 2)) WHERE rank <= 5""", "ev", "ends"),
    "asof_reaction_day": q("SELECT symbol, announced, order_key, reaction_date FROM react", "react"),
    "event_drift_ar": q(f"SELECT symbol, announced, order_key, entry_date, exit_date, {rr('stock_return', 'benchmark_return', 'abnormal_return', 'reaction_return')} FROM ar", "ar"),
    "sue": q("SELECT * FROM sues", "sues"),
    "sue_buckets": q("SELECT symbol, announced, order_key, bucket FROM bk", "bk"),
    "bucket_summary": q("""SELECT bucket, count(*) AS n, round(avg(sue), 6) AS mean_sue, round(avg(x), 6) AS mean_ar, round(median(x), 6) AS median_ar, round(avg(CASE WHEN x > 0 THEN 1.0 ELSE 0 END), 6) AS win_rate,
      round(CASE WHEN count(*) > 2 THEN avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) END, 6) AS t_stat
      FROM (SELECT bk.*, ar.abnormal_return AS x FROM bk JOIN ar USING (symbol, order_key)) GROUP BY 1""", "bk", "ar"),
    "third_friday": q("SELECT expiry FROM fri", "fri"),
    "occ_symbols": q("SELECT expiry, moneyness, 'SPY' || strftime(expiry, '%y%m%d') || 'P' || lpad(CAST(CAST(round(strike * 1000) AS BIGINT) AS VARCHAR), 8, '0') AS occ FROM st WHERE moneyness IN (1.0, 0.95)", "st"),
    "option_entry_day": q(f"SELECT expiry, entry, {rr('spot', 'settle')} FROM mo", "mo"),
    "put_payoff": q(f"SELECT expiry, entry, assigned, {rr('moneyness', 'strike', 'premium', 'pnl_per_share', 'ret_on_capital')} FROM put", "put"),
    "moneyness_sweep": q(f"SELECT n, n_assigned, {rr('moneyness', 'mean_ret', 'worst_ret', 'best_ret', 'win_rate', 'annualised', 't_stat', 'mean_premium')} FROM ms", "ms"),
    "crash_stress": q("""SELECT moneyness, round(mean_premium, 6) AS mean_premium, CAST(shock AS DOUBLE) AS shock, round(mean_premium - greatest(0, (moneyness - (1 + CAST(shock AS DOUBLE))) / moneyness), 6) AS stress_ret,
        round(CASE WHEN mean_premium - greatest(0, (moneyness - (1 + CAST(shock AS DOUBLE))) / moneyness) < 0
          THEN (greatest(0, (moneyness - (1 + CAST(shock AS DOUBLE))) / moneyness) - mean_premium) / nullif(annualised, 0) END, 6) AS years_to_recover
      FROM ms, (SELECT unnest([-0.10, -0.20, -0.30]) AS shock)""", "ms"),
    "straddle_pnl": q("""SELECT expiry, entry, round(spot, 6) AS spot, round(strike, 6) AS strike, round(2 * premium, 6) AS straddle_cost, round(abs(settle - spot), 6) AS actual_move,
      round(2 * premium - abs(settle - spot), 6) AS seller_pnl, round(2 * premium / spot, 6) AS implied_pct, round(abs(settle - spot) / spot, 6) AS actual_pct FROM st WHERE moneyness = 1.0""", "st"),
    "sell_fees": "SELECT l_returnflag, round(sum(l_quantity * 1000 * l_extendedprice * 23.10e-6 + least(l_quantity * 1000 * 0.000119, 5.95)), 2) AS fees FROM lineitem GROUP BY 1",
    "entry_fills": q("""SELECT symbol, date, round(open * (1 + 5.0 / 1e4), 6) AS market, round(CASE WHEN low <= open * (1 - 0.001) THEN open * (1 - 0.001) END, 6) AS limit_fill FROM daily""", "daily"),
    "exit_slippage": q("SELECT symbol, date, round(close * (1 - 5.0 / 1e4), 6) AS fill FROM daily", "daily"),
    "fixed_fractional": "SELECT o_orderkey, CAST(CASE WHEN o_totalprice > 0 THEN floor(least(o_totalprice * 0.01 / (93.0 * 0.01::DOUBLE), o_totalprice * 0.25 / 93.0)) ELSE 0 END AS BIGINT) AS shares FROM orders",
    "kelly": """SELECT o_orderkey, round(CASE WHEN b > 0 THEN least(greatest(p - (1 - p) / b, 0) * 0.5, 0.05) ELSE 0.0 END, 6) AS kelly
      FROM (SELECT o_orderkey, (o_orderkey % 100) / 100 AS p, (o_custkey % 7) / 2 AS b FROM orders)""",
    "risk_gate": """SELECT o_orderkey, CAST(CASE WHEN reason IN ('ok', 'trimmed') THEN least(size, fit) ELSE 0 END AS BIGINT) AS shares, reason FROM (
      SELECT *, CASE WHEN o_orderkey % 17 = 0 THEN 'drawdown' WHEN o_orderkey % 13 = 0 THEN 'daily_loss' WHEN o_totalprice < 25000 AND o_custkey % 5 >= 3 THEN 'pdt' WHEN size <= 0 THEN 'size'
        WHEN head <= 0 OR least(size, fit) <= 0 THEN 'exposure' WHEN fit < size THEN 'trimmed' ELSE 'ok' END AS reason FROM (
        SELECT *, CAST(floor(head / 93.0) AS BIGINT) AS fit FROM (SELECT *, CAST(floor(least(o_totalprice * 0.01 / (93.0 * 0.01::DOUBLE), o_totalprice * 0.25 / 93.0)) AS BIGINT) AS size,
          o_totalprice * 1.0 - o_totalprice * (o_custkey % 12 / 10) AS head FROM orders)))""",
    "daily_loss_latch": q("""SELECT account, ts, bool_or(equity <= f * (1 - 0.004::DOUBLE)) OVER d AS tripped FROM (SELECT *, first_value(equity) OVER (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts) AS f FROM acct)
      WINDOW d AS (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts)""", "acct"),
    "drawdown_latch": q("""SELECT account, ts, round(peak, 6) AS peak, bool_or(equity <= peak * (1 - 0.005::DOUBLE)) OVER (PARTITION BY account ORDER BY ts) AS tripped
      FROM (SELECT *, max(equity) OVER (PARTITION BY account ORDER BY ts) AS peak FROM acct)""", "acct"),
    "pdt_window": q("""SELECT account, date, CAST(sum(n) OVER w AS BIGINT) AS n_day_trades, sum(n) OVER w < 3 AS allowed FROM (
      SELECT l_suppkey % 10 AS account, CAST(l_shipdate AS DATE) AS date, count(*) AS n FROM lineitem GROUP BY 1, 2) JOIN cal USING (date)
      WINDOW w AS (PARTITION BY account ORDER BY i RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)""", "cal"),
    "vol_target_exposure": q("""SELECT account, date, round(CASE WHEN n >= 30 AND m >= 20 AND v > 0 THEN least(0.5 / v, 1.0) ELSE 1.0 END, 6) AS exposure FROM (
      SELECT account, date, count(*) OVER (PARTITION BY account ORDER BY date ROWS BETWEEN 125 PRECEDING AND CURRENT ROW) AS n, count(ret) OVER w AS m, stddev_samp(ret) OVER w * sqrt(252) AS v
      FROM cvr WINDOW w AS (PARTITION BY account ORDER BY date ROWS BETWEEN 124 PRECEDING AND CURRENT ROW))""", "cvr"),
    "signal_metrics": signal("SELECT symbol AS account, * FROM sig", "sig"),
    "backtest_metrics": q("""SELECT t.account, n_trades, round(win_rate, 6) AS win_rate, round(expectancy, 6) AS expectancy, round(profit_factor, 6) AS profit_factor, round(avg_duration, 6) AS avg_duration,
      round(sharpe, 6) AS sharpe, round(sortino, 6) AS sortino, round(max_drawdown, 6) AS max_drawdown, round(total_return, 6) AS total_return FROM (
      SELECT account, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(return_pct) AS expectancy,
        coalesce(sum(pnl) FILTER (WHERE pnl > 0), 0) / nullif(coalesce(-sum(pnl) FILTER (WHERE pnl < 0), 0), 0) AS profit_factor, avg(holding_bars) AS avg_duration FROM tr GROUP BY 1) t
      LEFT JOIN (SELECT CASE WHEN account IN ('Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15') THEN CAST(CAST(right(account, 1) AS INT) - 1 AS VARCHAR) END AS account, sharpe, sortino, max_drawdown, total_return FROM pm) p ON p.account = t.account""", "tr", "pm"),
    "portfolio_metrics": q(f"SELECT account, n_days, {rr('total_return', 'cagr', 'annual_vol', 'sharpe', 'sortino', 'max_drawdown')} FROM pm", "pm"),
    "equal_weight_bh": q(""", b AS (SELECT symbol, close AS p0 FROM daily WHERE date = (SELECT min(date) FROM cal)),
      g AS (SELECT c.date, b.symbol, b.p0, d.close FROM cal c CROSS JOIN b LEFT JOIN daily d ON d.symbol = b.symbol AND d.date = c.date),
      h AS (SELECT date, p0, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS px FROM g)
      SELECT date, round(sum(px / p0) * 10000.0 / count(*), 4) AS equity FROM h GROUP BY 1""", "cal").replace("\n, b AS", ", b AS", 1),
    "benchmark_norm": q("SELECT date, round(close / (SELECT arg_min(close, date) FROM one) * 10000.0, 6) AS equity FROM one", "one"),
    "vol_matched": q("""SELECT date, round(l, 4) AS leverage, round(product(1 + b * l) OVER (ORDER BY date) * 10000.0, 4) AS equity
      FROM al2, (SELECT stddev_samp(a) / nullif(stddev_samp(b), 0) AS l FROM al2)""", "al2"),
    "paired_t": q("SELECT count(*) AS n, round(avg(a - b), 6) AS mean_diff, round(avg(a - b) / nullif(stddev_samp(a - b) / sqrt(count(*)), 0), 6) AS t_stat FROM al2", "al2"),
    "welch_t": """SELECT round((ma - mb) / sqrt(va / na + vb / nb), 4) AS t_stat, round(pow(va / na + vb / nb, 2) / (pow(va / na, 2) / (na - 1) + pow(vb / nb, 2) / (nb - 1)), 4) AS df FROM (
      SELECT avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS ma, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS mb, var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS va,
        var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS vb, count(*) FILTER (WHERE o_orderstatus = 'F') AS na, count(*) FILTER (WHERE o_orderstatus = 'O') AS nb FROM orders)""",
    "regime_split": signal("""SELECT CASE WHEN v >= (SELECT median(v) FROM dv) THEN 'high_vol' ELSE 'low_vol' END AS account, sv.date, label, realized_return FROM sv JOIN dv USING (date)""", "sig", "f", account="regime").replace(
        ", s AS (SELECT CASE", ", sv AS (SELECT sig.*, round(range_position_20, 6) AS vol FROM sig JOIN f USING (symbol, date) WHERE range_position_20 IS NOT NULL), dv AS (SELECT date, avg(vol) AS v FROM sv GROUP BY 1), s AS (SELECT CASE", 1),
    "buy_hold_baseline": q("SELECT count(*) AS n_symbols, round(avg(x), 6) AS mean_return FROM (SELECT arg_max(close, date) / arg_min(close, date) - 1 AS x FROM daily GROUP BY symbol HAVING count(*) >= 2)", "daily"),
    "random_baseline": signal("SELECT 'all' AS account, * FROM sig ORDER BY md5('42:' || symbol || '|' || CAST(date AS VARCHAR)), symbol, date LIMIT 500", "sig"),
    "pnl_concentration": q("""SELECT count(*) AS n_symbols, count(*) FILTER (WHERE p > 0) AS n_positive, arg_max(symbol, p) AS top_symbol, round(max(p) / nullif(sum(p) FILTER (WHERE p > 0), 0), 4) AS top_share
      FROM (SELECT symbol, sum(pnl) AS p FROM tr GROUP BY 1)""", "tr"),
    "exit_reasons": q("SELECT exit_reason, count(*) AS n, round(avg(CASE WHEN is_day_trade THEN 1.0 ELSE 0 END), 6) AS day_trade_share FROM tr GROUP BY 1", "tr"),
    "fifo_trades": q(f"SELECT symbol, entry_time, exit_time, qty, {rr('entry_price', 'exit_price', 'pnl')} FROM fifo", "fifo"),
    "daily_equity": q("""SELECT date, round(pnl, 2) AS pnl, round(sum(pnl) OVER (ORDER BY date) + 10000.0, 2) AS equity FROM (SELECT CAST(exit_time AS DATE) AS date, sum(pnl) AS pnl FROM tr GROUP BY 1)""", "tr"),
    "reconcile": """SELECT symbol, expected_qty, actual_qty FROM (SELECT coalesce(e.s, a.s) AS symbol, coalesce(e.q, 0) AS expected_qty, coalesce(a.q, 0) AS actual_qty FROM
      (SELECT l_suppkey AS s, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1) e FULL JOIN
      (SELECT l_suppkey AS s, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) a ON e.s = a.s) WHERE expected_qty <> actual_qty""",
    "weekday_calendar": q("SELECT d AS date FROM (SELECT CAST(max(date) - CAST(k AS INT) AS DATE) AS d FROM cal, range(30) t(k) GROUP BY k) WHERE dayofweek(d) NOT IN (0, 6)", "cal"),
    "load_fills": q(f"SELECT symbol, seq, ts, side, qty, {rr('price')} FROM fl", "fl"),
}
ORACLE["dataset_rows"] = (
    q("", "daily").rstrip() + ", kept AS (SELECT * FROM daily WHERE date NOT BETWEEN DATE '1995-05-01' AND DATE '1995-07-31'), "
    + ", ".join(f"{n} AS ({PART[n].replace('FROM daily', 'FROM kept')})" for n in ("r", "feat", "f", "num", "hits", "lab"))
    + " SELECT symbol, date, CAST(label = 1 AS INT) AS target, round(ret_5, 6) AS ret_5, round(rsi_14, 6) AS rsi_14 FROM f JOIN lab USING (symbol, date) WHERE label IS NOT NULL AND "
    + " AND ".join(f"{c} IS NOT NULL" for c in ("ret_5", "ret_15", "ret_30", "ret_60", "vol_30", "vol_60", "rel_vol_30", "vwap_dev", "rsi_14", "range_position_20"))
)
ORACLE["divergence_flags"] = (
    "WITH m AS (" + ORACLE["signal_metrics"] + "), u AS (UNPIVOT (SELECT account, win_rate, expectancy, sharpe, max_drawdown FROM m) ON win_rate, expectancy, sharpe, max_drawdown INTO NAME metric VALUE v) "
    "SELECT l.metric, l.v AS live, b.v AS baseline, round(abs(l.v - b.v) / abs(b.v), 6) AS divergence FROM u l JOIN u b ON b.metric = l.metric AND b.account = 'Brand#13' "
    "WHERE l.account = 'Brand#12' AND b.v <> 0 AND abs(l.v - b.v) / abs(b.v) > 0.05"
)

ORACLE |= {
    "signal_lookup": q(f"""SELECT symbol, date, coalesce(s, 0) AS signal FROM daily LEFT JOIN (SELECT symbol, date, last(CAST(volume > 25 AS INT) ORDER BY {K}) AS s FROM arr GROUP BY 1, 2) USING (symbol, date)""", "daily", "arr"),
    "option_legs": q("""SELECT expiry, entry, round(strike, 6) AS strike, round(premium, 6) AS call_close, round(premium * 1.1::DOUBLE, 6) AS put_close FROM st WHERE moneyness = 1.0 AND month(expiry) % 4 <> 0""", "st"),
    "accuracy": q("SELECT round(avg(CASE WHEN (ret_5 > 0) = (label = 1) THEN 1.0 ELSE 0 END), 6) AS accuracy FROM lab JOIN f USING (symbol, date) WHERE label IS NOT NULL AND ret_5 IS NOT NULL", "lab", "f"),
    "edge_rules": q("""SELECT symbol, date, i > 0 AND i - o > 0.5 * abs(i) AND i - o > 0.0005 AS diverges, CASE WHEN abs((i - o) / nullif(o, 0)) < 0.5 THEN 'no clear edge' ELSE 'edge' END AS edge
      FROM (SELECT symbol, date, high / open - 1 AS i, close / open - 1 AS o FROM daily)""", "daily"),
    "forward_fill": q("""SELECT * FROM (SELECT symbol, date, round(last_value(d.close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), 6) AS close FROM (SELECT DISTINCT symbol FROM daily), cal LEFT JOIN daily d USING (symbol, date))
      WHERE close IS NOT NULL""", "daily", "cal").replace("(SELECT DISTINCT symbol FROM daily), cal LEFT JOIN", "(SELECT symbol, date FROM (SELECT DISTINCT symbol FROM daily) CROSS JOIN cal) LEFT JOIN"),
    "compounded_growth": q("SELECT account, date, round(product(1 + coalesce(ret, 0)) OVER (PARTITION BY account ORDER BY date), 6) AS growth FROM cvr", "cvr"),
}
ORACLE["panel_without_benchmark"] = q("SELECT symbol, count(*) AS n_bars, round(max(close), 6) AS high FROM daily WHERE symbol <> 'Brand#11' GROUP BY 1", "daily")
ORACLE["live_metrics"] = q("""SELECT t.account, n_trades, round(win_rate, 4) AS win_rate, round(mean_return, 4) AS mean_return, round(pnl, 4) AS pnl,
      round(final_equity, 4) AS final_equity, round(max_drawdown, 4) AS max_drawdown FROM (
      SELECT CAST(symbol AS VARCHAR) AS account, count(*) AS n_trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate,
        avg(pnl / nullif(qty * entry_price, 0)) AS mean_return, sum(pnl) AS pnl FROM fifo GROUP BY 1) t
      JOIN (SELECT account, arg_max(equity, date) AS final_equity, min(equity / greatest(peak, 10000) - 1) AS max_drawdown FROM (
        SELECT *, max(equity) OVER (PARTITION BY account ORDER BY date) AS peak FROM (
          SELECT *, 10000 + sum(pnl) OVER (PARTITION BY account ORDER BY date) AS equity FROM (
            SELECT CAST(symbol AS VARCHAR) AS account, CAST(exit_time AS DATE) AS date, sum(pnl) AS pnl FROM fifo GROUP BY 1, 2))) GROUP BY 1) c
      ON c.account = t.account""", "fifo")
ORACLE["drawdown_resets"] = q("""SELECT account, count(*) FILTER (WHERE tripped) AS n_tripped, count(*) AS n FROM (
      SELECT *, bool_or(equity <= peak * (1 - 0.005::DOUBLE)) OVER (PARTITION BY account, epoch ORDER BY ts) AS tripped FROM (
        SELECT *, max(equity) OVER (PARTITION BY account, epoch ORDER BY ts) AS peak FROM (
          SELECT *, CAST(ts >= d + INTERVAL 10 DAY AS INT) + CAST(ts >= d + INTERVAL 20 DAY AS INT) AS epoch
          FROM acct, (SELECT CAST(min(ts) AS DATE) AS d FROM acct)))) GROUP BY 1""", "acct")
ORACLE["entry_candidates"] = q("""SELECT symbol, round(price, 6) AS price, round(proba, 6) AS proba, CAST(CASE WHEN want <= 0 THEN 0 ELSE least(want, fit) END AS BIGINT) AS shares,
      CASE WHEN want <= 0 THEN 'size' WHEN fit <= 0 THEN 'exposure' WHEN fit < want THEN 'trimmed' ELSE 'ok' END AS reason
    FROM (SELECT symbol, price, price / (price + first) AS proba, CASE WHEN price > 0 THEN floor(1e5 * 0.25 / price) ELSE 0 END AS want, floor(1e4 / nullif(price, 0)) AS fit
      FROM (SELECT symbol, arg_max(close, ts) AS price, arg_min(open, ts) AS first, count(*) AS n FROM intra GROUP BY 1) WHERE n >= 60 AND price > first AND symbol <> 'signup')""", "intra")
ORACLE["position_exits"] = q("""SELECT symbol, reason, round(CASE reason WHEN 'stop_loss' THEN price - 40 WHEN 'take_profit' THEN price + 60 ELSE last END, 6) AS price
    FROM (SELECT *, CASE WHEN low <= price - 40 THEN 'stop_loss' WHEN high >= price + 60 THEN 'take_profit' ELSE 'max_holding' END AS reason FROM (
      SELECT h.symbol, any_value(h.price) AS price, min(low) AS low, max(high) AS high, arg_max(close, date) AS last
      FROM (SELECT symbol, arg_min(close, date) AS price, min(date) AS since FROM daily GROUP BY 1) h LEFT JOIN daily d ON d.symbol = h.symbol AND d.date > h.since GROUP BY 1))""", "daily")
ORACLE["stream_exits"] = q("""SELECT symbol, ts, CASE WHEN low <= px - 1000 THEN 'stop_loss' WHEN high >= px * 3 THEN 'take_profit' ELSE 'max_holding' END AS reason,
      round(CASE WHEN low <= px - 1000 THEN px - 1000 WHEN high >= px * 3 THEN px * 3 ELSE close END, 6) AS price
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM (
      SELECT *, first(close) OVER w AS px, first(ts) OVER w AS since FROM intra WINDOW w AS (PARTITION BY symbol ORDER BY ts))
      WHERE low <= px - 1000 OR high >= px * 3 OR ts >= since + INTERVAL 4 DAY) WHERE k = 1""", "intra")
