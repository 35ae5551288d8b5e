"""Queries of the relational shell, backtest, scores, significance and guards, with their SQL.

Probabilities are deterministic stand-ins for model output: an MD5 of symbol and row, held for a few bars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.functions.frames import ordered
from barloom.operators import backtest as bt
from barloom.operators import guard as gd
from barloom.operators import relational as rl
from barloom.operators import scoring as sc
from barloom.operators import significance as sg
from barloom.plans.bar_queries import BASE_SQL, bars_sql
from barloom.plans.registry import QUERIES, SQL
from barloom.sources.bars import event_bars


def hashed(text) -> object:
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long"), F.lit(1000)) / 1000.0


def scored(bars: DataFrame) -> DataFrame:
    """symbol, bar, open, p, q."""
    rn = F.row_number().over(ordered()) - 1
    key = lambda every, tag: F.concat_ws(":", "symbol", F.floor(F.col("rn") / every).cast("string"), F.lit(tag))
    return bars.withColumn("rn", rn).select("symbol", "bar", "open", "rn", hashed(key(3, "p")).alias("p"), hashed(key(10, "q")).alias("q"))


def scored_sql(hours: str = "4 hours") -> str:
    h = lambda every, tag: f"(('0x' || substr(md5(symbol || ':' || (rn // {every}) || ':{tag}'), 1, 7))::BIGINT % 1000) / 1000.0"
    return f"{bars_sql(hours)}, numbered AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS rn FROM bars), sc AS (SELECT symbol, bar, open, rn, {h(3, 'p')} AS p, {h(10, 'q')} AS q FROM numbered)"


WANT_SQL = """want AS (SELECT *, CASE WHEN q > 0.3 AND 1 - p > 0.5 THEN 1 WHEN q > 0.3 AND p > 0.5 THEN -1 ELSE 0 END AS want FROM sc)"""
TRADES_SQL = f"""{WANT_SQL}, marked AS (SELECT *, CASE WHEN want = lag(want) OVER w THEN 0 ELSE 1 END AS starts, lead(bar) OVER w AS nb, lead(open) OVER w AS no FROM want WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
isl AS (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY bar) AS island FROM marked),
runs AS (SELECT symbol, island, first(want) AS want, min(bar) AS entry_bar, first(open ORDER BY bar) AS paid, last(coalesce(nb, bar) ORDER BY bar) AS exit_bar, last(coalesce(no, open) ORDER BY bar) AS sold FROM isl WHERE want <> 0 GROUP BY ALL),
trades AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY island) - 1 AS trade_no, CASE WHEN want > 0 THEN 'buy' ELSE 'sell' END AS side, entry_bar, exit_bar, want * (sold - paid) AS profit FROM runs)"""
EQUITY_SQL = """equity AS (SELECT symbol, trade_no + 1 AS point, sum(profit) OVER (PARTITION BY symbol ORDER BY trade_no) AS equity FROM trades UNION ALL SELECT DISTINCT symbol, 0, 0.0 FROM trades)"""
HEAD = f"WITH {scored_sql()}, "


def trades(spark, sf, every: str = "4 hours") -> DataFrame:
    return bt.island_trades(scored(event_bars(spark, sf, every)), 0.5, 0.3)


def add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


add(
    "signals",
    lambda spark, sf: scored(event_bars(spark, sf)).select("symbol", "bar", *[c.alias(n) for c, n in zip(bt.signals(F.col("p"), F.col("q"), 0.4, 0.3), ("buy", "sell", "gate"))]),
    f"WITH {scored_sql()} SELECT symbol, bar, 1 - p > 0.4 AS buy, p > 0.4 AS sell, q > 0.3 AS gate FROM sc",
)
add("backtest_trades", lambda spark, sf: trades(spark, sf).withColumn("profit", F.round("profit", 6)), f"{HEAD}{TRADES_SQL} SELECT symbol, trade_no, side, entry_bar, exit_bar, round(profit, 6) AS profit FROM trades")
add(
    "backtest_general",
    lambda spark, sf: bt.backtest(scored(event_bars(spark, sf)), 0.5, 0.3).withColumn("profit", F.round("profit", 6)),
    f"{HEAD}{TRADES_SQL} SELECT symbol, trade_no, side, entry_bar, exit_bar, round(profit, 6) AS profit FROM trades",
)
add("backtest_overlapping", lambda spark, sf: bt.backtest(scored(event_bars(spark, sf)), 0.4, 0.3, "both", 2))
POS_SQL = f"{WANT_SQL}, pos AS (SELECT symbol, bar, open, CASE WHEN lag(want) OVER (PARTITION BY symbol ORDER BY bar) = want THEN want ELSE 0 END AS pos FROM want)"
RET_SQL = "ret AS (SELECT *, CASE WHEN lag(pos) OVER w IS NULL OR lag(pos) OVER w = 0 OR lag(open) OVER w = 0 THEN 0.0 ELSE lag(pos) OVER w * ((open - lag(open) OVER w) / lag(open) OVER w) END AS ret FROM pos WINDOW w AS (PARTITION BY symbol ORDER BY bar))"


def positions(spark, sf, every: str = "4 hours") -> DataFrame:
    return bt.position_series(scored(event_bars(spark, sf, every)), 0.5, 0.3)


add("position_series", lambda spark, sf: positions(spark, sf).select("symbol", "bar", F.col("pos").cast("int").alias("pos")), f"{HEAD}{POS_SQL} SELECT symbol, bar, CAST(pos AS INTEGER) AS pos FROM pos")
add("bar_returns", lambda spark, sf: bt.bar_returns(positions(spark, sf)).select("symbol", "bar", F.round("ret", 9).alias("ret")), f"{HEAD}{POS_SQL}, {RET_SQL} SELECT symbol, bar, round(ret, 9) AS ret FROM ret")
add(
    "trade_stats",
    lambda spark, sf: bt.trade_stats(trades(spark, sf)).withColumn("profit", F.round("profit", 6)),
    f"{HEAD}{TRADES_SQL} SELECT symbol, count(*) AS n_trades, count(*) FILTER (profit > 0) AS n_wins, count(*) FILTER (profit < 0) AS n_losses, round(sum(profit), 6) AS profit FROM trades GROUP BY symbol",
)
add("equity_curve", lambda spark, sf: bt.equity_curve(trades(spark, sf)).withColumn("equity", F.round("equity", 6)), f"{HEAD}{TRADES_SQL}, {EQUITY_SQL} SELECT symbol, point, round(equity, 6) AS equity FROM equity")
add(
    "drawdown",
    lambda spark, sf: sc.drawdown(bt.equity_curve(trades(spark, sf))).select("symbol", "point", F.round("drawdown", 6).alias("drawdown")),
    f"{HEAD}{TRADES_SQL}, {EQUITY_SQL} SELECT symbol, point, round(max(equity) OVER (PARTITION BY symbol ORDER BY point) - equity, 6) AS drawdown FROM equity",
)
METRICS_SQL = """dd AS (SELECT *, max(equity) OVER (PARTITION BY symbol ORDER BY point) - equity AS dd FROM equity),
m AS (SELECT symbol, count(*) AS n_points, last(equity ORDER BY point) - first(equity ORDER BY point) AS total, max(dd) AS max_dd, regr_slope(equity, point) AS slope,
 CASE WHEN var_pop(equity) < 1e-12 THEN 0 ELSE regr_r2(equity, point) END AS r2, CASE WHEN max(dd) = 0 THEN 0 ELSE (last(equity ORDER BY point) - first(equity ORDER BY point)) / max(dd) END AS rdd FROM dd GROUP BY symbol)"""
add(
    "report_metrics",
    lambda spark, sf: sc.curve_metrics(bt.equity_curve(trades(spark, sf))).select("symbol", "n_points", *[F.round(c, 6).alias(c) for c in ("total", "max_dd", "rdd", "slope", "r2")]),
    f"{HEAD}{TRADES_SQL}, {EQUITY_SQL}, {METRICS_SQL} SELECT symbol, n_points, round(total, 6) AS total, round(max_dd, 6) AS max_dd, round(rdd, 6) AS rdd, round(slope, 6) AS slope, round(r2, 6) AS r2 FROM m",
)


def walk_sql(p: sc.Profile) -> str:
    a, b, c = p.window_weights
    return f"""sums AS (SELECT symbol, trade_no + 1 AS k, sum(profit) OVER w AS eq, sum(CASE WHEN profit > 0 THEN 1 ELSE 0 END) OVER w AS wins FROM trades WINDOW w AS (PARTITION BY symbol ORDER BY trade_no) UNION ALL SELECT DISTINCT symbol, 0, 0.0, 0 FROM trades),
nn AS (SELECT symbol, count(*) AS n, greatest({p.base[0]}, count(*) // {p.base[1]}) AS w1 FROM trades GROUP BY symbol),
ww AS (SELECT *, least(2 * w1, n // 5) AS w2, least(3 * w1, n // 4) AS w3 FROM nn WHERE n >= w1),
sz AS (SELECT symbol, n, w1 AS size, {a} AS wt FROM ww WHERE w1 >= 5 UNION ALL SELECT symbol, n, w2, {b} FROM ww WHERE w2 > w1 AND w2 >= 5 UNION ALL SELECT symbol, n, w3, {c} FROM ww WHERE w3 > w2 AND w3 >= 5),
szn AS (SELECT symbol, n, size, wt / sum(wt) OVER (PARTITION BY symbol) AS wt FROM sz),
st AS (SELECT symbol, size, wt, unnest(range(0, n - size + 1, greatest(1, size // {p.step_part}))) AS f FROM szn WHERE n >= size),
se AS (SELECT st.symbol, size, wt, h.eq - l.eq AS r, (h.wins - l.wins) / size AS share FROM st JOIN sums l ON l.symbol = st.symbol AND l.k = f JOIN sums h ON h.symbol = st.symbol AND h.k = f + size),
so AS (SELECT symbol, size, wt, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) * avg(share) * CASE WHEN count(*) >= 3 AND stddev_pop(r) > 0 THEN 1 / (1 + {p.cv_factor} * stddev_pop(r) / (abs(avg(r)) + 1e-8)) ELSE 1 END AS s FROM se GROUP BY ALL),
walk AS (SELECT nn.symbol, least(1.0, pow(coalesce(t, 0), {p.power})) AS walk FROM nn LEFT JOIN (SELECT symbol, sum(s * wt) AS t FROM so GROUP BY symbol) USING (symbol))"""


def report_sql(p: sc.Profile) -> str:
    parts = {
        "trades": "1 / (1 + exp(-(n_points - 1 - 200) / 1000.0))",
        "rdd": "1 / (1 + exp(-(rdd - 2.0) / 6.0))",
        "r2": f"CASE WHEN r2 < {p.knee} THEN r2 * 0.4 ELSE 0.40 + (r2 - {p.knee}) * {0.6 / (1 - p.knee)!r} END",
        "slope": "1 / (1 + exp(-ln(1 + greatest(slope, -0.5)) / 3.0))",
        "walk": "walk",
    }
    bad = f"(n_points < 2 OR total <= 0 OR slope < 0 OR n_points - 1 < {p.least_trades} OR rdd < {max(p.least_rdd, -1e300)})"
    score = " + ".join(f"{w} * ({parts[k]})" for k, w in p.weights.items())
    cells = ", ".join(f"round(CASE WHEN {bad} THEN -1.0 ELSE {v} END, 6) AS {k}" for k, v in {**parts, "score": score}.items())
    return f"SELECT symbol, {cells} FROM m JOIN walk USING (symbol)"


for _name, _profile in (("research", sc.RESEARCH), ("terminal", sc.TERMINAL)):
    add(
        f"walk_forward_{_name}",
        lambda spark, sf, p=_profile: sc.walk_forward(trades(spark, sf, "1 hour"), p).withColumn("walk", F.round("walk", 6)),
        f"WITH {scored_sql('1 hour')}, {TRADES_SQL}, {walk_sql(_profile)} SELECT symbol, round(walk, 6) AS walk FROM walk",
    )
    add(
        f"score_{_name}",
        lambda spark, sf, p=_profile: (lambda df: df.select("symbol", *[F.round(c, 6).alias(c) for c in df.columns if c != "symbol"]))(sc.report(trades(spark, sf, "1 hour"), p)),
        f"WITH {scored_sql('1 hour')}, {TRADES_SQL}, {EQUITY_SQL}, {METRICS_SQL}, {walk_sql(_profile)} {report_sql(_profile)}",
    )

SHARPE_SQL = "coalesce(avg({0}) / nullif(stddev_pop({0}), 0), 0)"
add(
    "sharpe",
    lambda spark, sf: bt.bar_returns(positions(spark, sf)).groupBy("symbol").agg(F.round(sg.sharpe(F.col("ret")), 6).alias("sharpe")),
    f"{HEAD}{POS_SQL}, {RET_SQL} SELECT symbol, round({SHARPE_SQL.format('ret')}, 6) AS sharpe FROM ret GROUP BY symbol",
)
RUNS_SQL = """mk AS (SELECT *, CASE WHEN lag(pos) OVER (PARTITION BY symbol ORDER BY bar) = pos THEN 0 ELSE 1 END AS starts FROM pos), rr AS (SELECT *, sum(starts) OVER (PARTITION BY symbol ORDER BY bar) AS run FROM mk),
rl AS (SELECT symbol, run, any_value(pos) AS pos, count(*) AS length FROM rr GROUP BY symbol, run),
bs AS (SELECT symbol, CASE WHEN sum(length) < 10 THEN greatest(2, sum(length)) ELSE least(greatest(floor(quantile_cont(length, 0.5)), 5), 64) END::BIGINT AS block FROM rl GROUP BY symbol)"""
add("run_lengths", lambda spark, sf: sg.run_lengths(positions(spark, sf)).groupBy("symbol", "length").agg(F.count("*").alias("n_runs")), f"{HEAD}{POS_SQL}, {RUNS_SQL} SELECT symbol, length, count(*) AS n_runs FROM rl GROUP BY ALL")
add("block_size", lambda spark, sf: sg.block_size(positions(spark, sf)), f"{HEAD}{POS_SQL}, {RUNS_SQL} SELECT symbol, block FROM bs")
N_SIMS = 20
_draw = lambda tag: f"('0x' || substr(md5('1:' || symbol || ':' || sim || ':' || {tag}), 1, 7))::BIGINT"
SIMS_SQL = f"""bp AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY bar) - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n, lead(open) OVER (PARTITION BY symbol ORDER BY bar) AS nx FROM pos),
sz AS (SELECT DISTINCT bp.symbol, n, greatest(2, floor(block * 0.5)::BIGINT) AS low, least(64, floor(block * 1.5)::BIGINT) AS high FROM bp JOIN bs USING (symbol)),
sm AS (SELECT symbol, n, sim, least(n, low + {_draw("'size'")} % (greatest(high, low) - low + 1)) AS size, {_draw("'shift'")} % n AS shift FROM sz, range(0, {N_SIMS}) t(sim)),
rw AS (SELECT symbol, n, sim, size, shift, unnest(range(0, n)) AS t FROM sm),
pk AS (SELECT symbol, sim, t, CASE WHEN sim % 2 = 0 THEN ((t - shift) % n + n) % n ELSE ({_draw("(t // size)")} % n + t % size) % n END AS src FROM rw),
sims AS (SELECT pk.symbol, sim, t AS rn, b.pos FROM pk JOIN bp b ON b.symbol = pk.symbol AND b.rn = src),
ss AS (SELECT s.symbol, sim, {SHARPE_SQL.format("(s.pos * coalesce((b.nx - b.open) / nullif(b.open, 0), 0))")} AS sharpe FROM sims s JOIN bp b ON b.symbol = s.symbol AND b.rn = s.rn GROUP BY ALL)"""
add(
    "simulated_positions",
    lambda spark, sf: sg.simulations(positions(spark, sf), N_SIMS).groupBy("symbol", "sim").agg(F.count_if(F.col("pos") != 0).alias("exposed"), F.sum(F.col("pos") * F.col("rn")).alias("checksum")),
    f"{HEAD}{POS_SQL}, {RUNS_SQL}, {SIMS_SQL} SELECT symbol, sim, count(*) FILTER (pos <> 0) AS exposed, CAST(sum(pos * rn) AS BIGINT) AS checksum FROM sims GROUP BY ALL",
)
add("simulated_sharpes", lambda spark, sf: sg.simulated_sharpes(positions(spark, sf), N_SIMS).withColumn("sharpe", F.round("sharpe", 6)), f"{HEAD}{POS_SQL}, {RUNS_SQL}, {SIMS_SQL} SELECT symbol, sim, round(sharpe, 6) AS sharpe FROM ss")
add(
    "monkey_pvalue",
    lambda spark, sf: sg.monkey_test(positions(spark, sf, "1 hour"), N_SIMS).select("symbol", F.round("p_value", 6).alias("p_value"), F.round("percentile", 6).alias("percentile")),
    f"""WITH {scored_sql('1 hour')}, {POS_SQL}, {RET_SQL}, {RUNS_SQL}, {SIMS_SQL}, ac AS (SELECT symbol, {SHARPE_SQL.format('ret')} AS sr, count(*) AS n, count(*) FILTER (pos <> 0) AS ex FROM ret GROUP BY symbol),
en AS (SELECT symbol, count(*) FILTER (pos <> 0 AND coalesce(prev, 0) = 0) AS entries FROM (SELECT symbol, pos, lag(pos) OVER (PARTITION BY symbol ORDER BY bar) AS prev FROM pos) GROUP BY symbol),
pv AS (SELECT ac.symbol, n >= 50 AND ex >= 200 AND entries >= 30 AS enough, (count(*) FILTER (ss.sharpe >= sr) + 1.0) / (count(*) + 1.0) AS p FROM ac JOIN en USING (symbol) JOIN ss USING (symbol) GROUP BY ALL)
SELECT symbol, round(CASE WHEN enough THEN p ELSE 1 END, 6) AS p_value, round(CASE WHEN enough THEN 100 * (1 - p) ELSE 0 END, 6) AS percentile FROM pv""",
)

GUARD_HEAD = f"WITH RECURSIVE {scored_sql('1 hour')}, {TRADES_SQL}, {EQUITY_SQL}, er AS (SELECT symbol, point, coalesce(equity - lag(equity) OVER (PARTITION BY symbol ORDER BY point), 0.0) AS ret FROM equity)"


def curve(spark, sf) -> DataFrame:
    return bt.equity_curve(trades(spark, sf, "1 hour"))


add(
    "robust_scale",
    lambda spark, sf: gd.robust_scale(curve(spark, sf)).select("symbol", F.round("med", 6).alias("med"), F.round("scale", 6).alias("scale")),
    f"""{GUARD_HEAD}, x AS (SELECT symbol, list_median(list(ret)) AS med, list(ret) AS l FROM er WHERE point < 30 GROUP BY symbol)
SELECT symbol, round(med, 6) AS med, round(CASE WHEN 1.4826 * list_median(list_transform(l, lambda v: abs(v - med))) <= 1e-12 THEN 1 ELSE 1.4826 * list_median(list_transform(l, lambda v: abs(v - med))) END, 6) AS scale FROM x""",
)
add(
    "shock_index",
    lambda spark, sf: gd.shock_index(curve(spark, sf), gd.LEVELS["high"]),
    f"""{GUARD_HEAD}, x AS (SELECT symbol, point, ret, list(ret) OVER (PARTITION BY symbol ORDER BY point ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS l, count(*) OVER (PARTITION BY symbol) AS n FROM er),
y AS (SELECT *, list_median(l) AS med FROM x WHERE point >= 20 AND n > 21), z AS (SELECT *, 1.4826 * list_median(list_transform(l, lambda v: abs(v - med))) AS s FROM y)
SELECT symbol, min(point) AS idx_shock FROM z WHERE (ret - med) / CASE WHEN s <= 1e-12 THEN 1 ELSE s END < -2.5 GROUP BY symbol""",
)
add(
    "erosion_index",
    lambda spark, sf: gd.erosion_index(curve(spark, sf), gd.LEVELS["high"]),
    f"""{GUARD_HEAD}, ew AS (SELECT symbol, point, ret AS e FROM er WHERE point = 0 UNION ALL SELECT er.symbol, er.point, (2.0 / 49) * er.ret + (1 - 2.0 / 49) * ew.e FROM ew JOIN er ON er.symbol = ew.symbol AND er.point = ew.point + 1),
c AS (SELECT symbol, point, bool_and(e < 0) OVER w AS low, count(*) OVER w AS k, count(*) OVER (PARTITION BY symbol) AS n FROM ew WHERE point >= 35 WINDOW w AS (PARTITION BY symbol ORDER BY point ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
SELECT symbol, min(point) AS idx_erosion FROM c WHERE low AND k = 2 AND n + 35 > 36 GROUP BY symbol""",
)
add("change_point_guard", lambda spark, sf: gd.change_point_guard(curve(spark, sf), "high"))


def _features(spark, sf) -> DataFrame:
    return ft.features(event_bars(spark, sf), [(12, "mean", "main"), (5, "range", "meta")])


_FCOLS = ["12_mean_main_feature", "5_range_meta_feature"]
_F_SQL = f"""{bars_sql()}, {BASE_SQL}, f AS (SELECT symbol, bar, rn, CASE WHEN rn >= 13 THEN avg(r) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) END AS a,
 CASE WHEN rn >= 5 THEN max(close) OVER v - min(close) OVER v END AS b FROM base WINDOW v AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))"""
add(
    "null_trim",
    lambda spark, sf: rl.trim_warm_up(_features(spark, sf), _FCOLS).groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar"), F.max("bar").alias("last_bar")),
    f"""WITH {_F_SQL}, e AS (SELECT symbol, min(rn) FILTER (a IS NOT NULL AND b IS NOT NULL) AS x, max(rn) FILTER (a IS NOT NULL AND b IS NOT NULL) AS y FROM f GROUP BY symbol)
SELECT symbol, count(*) AS n, min(bar) AS first_bar, max(bar) AS last_bar FROM f JOIN e USING (symbol) WHERE rn BETWEEN x AND y GROUP BY symbol""",
)
add(
    "constant_columns",
    lambda spark, sf: rl.column_health(_features(spark, sf).withColumn("flat", F.lit(1.0)), [*_FCOLS, "flat"]).select("column", "n_bad", F.round("std", 6).alias("std"), "unstable"),
    f"""WITH {_F_SQL}, u AS (SELECT '12_mean_main_feature' AS "column", a AS x FROM f UNION ALL SELECT '5_range_meta_feature', b FROM f UNION ALL SELECT 'flat', 1.0 FROM f)
SELECT "column", count(*) FILTER (x IS NULL) AS n_bad, round(stddev_samp(x), 6) AS std, count(*) FILTER (x IS NULL) > 0 OR coalesce(stddev_samp(x) < 1e-6, true) AS unstable FROM u GROUP BY "column\"""",
)
TRAIN, TEST = ("2024-01-01 00:00:00", "2024-01-20 23:59:59"), ("2024-01-08 00:00:00", "2024-01-12 23:59:59")
_SPLIT_SQL = f"""CASE WHEN bar BETWEEN TIMESTAMP '{TEST[0]}' AND TIMESTAMP '{TEST[1]}' THEN 'OOS' WHEN bar BETWEEN TIMESTAMP '{TRAIN[0]}' AND TIMESTAMP '{TRAIN[1]}' THEN 'IS' WHEN bar > TIMESTAMP '{TRAIN[1]}' THEN 'REAL' END"""
add("split_is_oos_real", lambda spark, sf: event_bars(spark, sf).groupBy("symbol", rl.split(F.col("bar"), TRAIN, TEST).alias("split")).agg(F.count("*").alias("n_bars")), f"WITH {bars_sql()} SELECT symbol, {_SPLIT_SQL} AS split, count(*) AS n_bars FROM bars GROUP BY ALL")
add(
    "integrity_antijoin",
    lambda spark, sf: rl.missing(event_bars(spark, sf, "1 hour").withColumn("bar", F.col("bar")), event_bars(spark, sf).select("symbol", "bar")).groupBy("symbol").agg(F.count("*").alias("n_missing")),
    f"WITH {bars_sql('1 hour').replace('bars AS', 'h AS', 1)}, {bars_sql()} SELECT symbol, count(*) AS n_missing FROM h ANTI JOIN bars USING (symbol, bar) GROUP BY symbol",
)
add("class_balance", lambda spark, sf: rl.class_balance(QUERIES["label_random_both"](spark, sf)), f"SELECT symbol, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1, count(*) FILTER (label = 2) AS n2, count(*) FILTER (label = 0) >= 100 AND count(*) FILTER (label = 1) >= 100 AS enough FROM ({SQL['label_random_both']}) GROUP BY symbol")
add(
    "modal_step",
    lambda spark, sf: rl.modal_step(event_bars(spark, sf, "1 hour")),
    f"""WITH {bars_sql('1 hour')}, s AS (SELECT symbol, epoch(bar - lag(bar) OVER (PARTITION BY symbol ORDER BY bar))::BIGINT AS step_s FROM bars), c AS (SELECT symbol, step_s, count(*) AS n FROM s WHERE step_s IS NOT NULL GROUP BY ALL)
SELECT symbol, step_s FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, step_s) = 1""",
)
add(
    "context_padding",
    lambda spark, sf: rl.padded(event_bars(spark, sf, "1 hour"), "2024-01-15 00:00:00", 20).groupBy("symbol").agg(F.count("*").alias("n"), F.min("bar").alias("first_bar")),
    f"""WITH {bars_sql('1 hour')}, s AS (SELECT symbol, epoch(bar - lag(bar) OVER (PARTITION BY symbol ORDER BY bar))::BIGINT AS step_s FROM bars), c AS (SELECT symbol, step_s, count(*) AS n FROM s WHERE step_s IS NOT NULL GROUP BY ALL),
m AS (SELECT symbol, step_s FROM c QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY n DESC, step_s) = 1)
SELECT symbol, count(*) AS n, min(bar) AS first_bar FROM bars JOIN m USING (symbol) WHERE epoch(bar) >= epoch(TIMESTAMP '2024-01-15 00:00:00') - 20 * step_s GROUP BY symbol""",
)


def asof_bar_open(spark, sf) -> DataFrame:
    """The open of the latest bar at or before each hundredth-second-stamped event of its type."""
    ticks = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_type").alias("symbol"), "event_id", "ts")
    bars = event_bars(spark, sf).select("symbol", "bar", F.col("open").alias("bar_open"))
    return rl.asof(ticks, bars, "ts", "bar", "bar_open").select("event_id", F.round("bar_open", 6).alias("bar_open"))


add("asof_bar_open", asof_bar_open, f"WITH {bars_sql()} SELECT event_id, round(b.open, 6) AS bar_open FROM events e ASOF LEFT JOIN bars b ON b.symbol = e.event_type AND e.ts >= b.bar")
add(
    "deal_pairing",
    lambda spark, sf: (lambda t: t.select("symbol", "trade_no", F.col("entry_bar").alias("bar")).join(t.select("symbol", "trade_no", F.col("exit_bar").alias("out")), ["symbol", "trade_no"]).select("symbol", "trade_no", "bar", "out"))(trades(spark, sf)),
    f"{HEAD}{TRADES_SQL} SELECT symbol, trade_no, entry_bar AS bar, exit_bar AS out FROM trades",
)
add(
    "index_set_ops",
    lambda spark, sf: (lambda a, b: a.intersect(b).select(F.lit("both").alias("part"), "symbol", "bar").union(a.subtract(b).select(F.lit("only"), "symbol", "bar")).union(a.union(b).distinct().select(F.lit("either"), "symbol", "bar")).groupBy("part").agg(F.count("*").alias("n")))(event_bars(spark, sf, "1 hour").select("symbol", "bar"), event_bars(spark, sf).select("symbol", "bar")),
    f"""WITH {bars_sql('1 hour').replace('bars AS', 'h AS', 1)}, {bars_sql()}, a AS (SELECT symbol, bar FROM h), b AS (SELECT symbol, bar FROM bars)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)""",
)


def best_regime(spark, sf) -> DataFrame:
    """The symbol of the highest score, and the score: the top 1 is the feature."""
    return QUERIES["score_research"](spark, sf).groupBy().agg(F.max_by("symbol", F.struct("score", "symbol")).alias("symbol"), F.max("score").alias("score"))


add("best_of", best_regime, f"SELECT symbol, score FROM ({SQL['score_research']}) ORDER BY score DESC, symbol DESC LIMIT 1")
