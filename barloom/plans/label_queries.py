"""Queries of smoothers and labelers, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import smooth as sm
from barloom.functions.frames import every, incl, ordered
from barloom.operators import labels as lb
from barloom.plans.bar_queries import BASE_SQL, bars_sql
from barloom.plans.registry import QUERIES, SQL
from barloom.sources.bars import event_bars

W = "PARTITION BY symbol ORDER BY bar"
TR_SQL = f"""tr AS (SELECT *, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr,
 row_number() OVER w - 1 AS rn, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS ({W}))"""
ATR_SQL = """rec AS (SELECT symbol, rn, tr AS total, tr AS atr FROM tr WHERE rn = 0
 UNION ALL SELECT t.symbol, t.rn, rec.total + t.tr, CASE WHEN t.rn < 14 THEN (rec.total + t.tr) / (t.rn + 1) ELSE (rec.atr * 13 + t.tr) / 14 END
 FROM rec JOIN tr t ON t.symbol = rec.symbol AND t.rn = rec.rn + 1)"""


def prepared_sql(first: int = 1, last: int = 5) -> str:
    """Everything up to ``p``: bars with atr, rn, n and fwd."""
    return f"""WITH RECURSIVE {bars_sql()}, {TR_SQL}, {ATR_SQL},
p AS (SELECT tr.*, rec.atr, quantile_cont(close, 0.5) OVER (PARTITION BY tr.symbol ORDER BY bar ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING) AS fwd
 FROM tr JOIN rec ON rec.symbol = tr.symbol AND rec.rn = tr.rn)"""


QUERIES["true_range"] = lambda spark, sf: event_bars(spark, sf).select("symbol", "bar", F.round(sm.true_range(), 9).alias("tr"))
SQL["true_range"] = f"WITH {bars_sql()}, {TR_SQL} SELECT symbol, bar, round(tr, 9) AS tr FROM tr"
QUERIES["atr_wilder"] = lambda spark, sf: sm.atr(event_bars(spark, sf)).select("symbol", "bar", F.round("atr", 9).alias("atr"))
SQL["atr_wilder"] = f"{prepared_sql()} SELECT symbol, bar, round(atr, 9) AS atr FROM p"


def smoother(name: str, column, sql: str) -> None:
    """``column``: makes the column, once a session is there."""
    QUERIES[name] = lambda spark, sf: sm.with_size(event_bars(spark, sf)).select("symbol", "bar", F.round(column(), 6).alias("value"))
    SQL[name] = f"WITH {bars_sql()}, {BASE_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM base) SELECT symbol, bar, round({sql}, 6) AS value FROM s"


def _frame(a: int, b: int) -> str:
    side = lambda x: "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"
    return f"({W} ROWS BETWEEN {side(a)} AND {side(b)})"


GRADIENT_SQL = f"coalesce((lead(close) OVER ({W}) - lag(close) OVER ({W})) / 2, lead(close) OVER ({W}) - close, close - lag(close) OVER ({W}))"
smoother("sma", lambda: sm.sma("close", 10), f"avg(close) OVER {_frame(-9, 0)}")
smoother("rolling_std", lambda: sm.rolling_std("close", 10), f"stddev_pop(close) OVER {_frame(-9, 0)}")
smoother("gradient", lambda: sm.gradient("close"), GRADIENT_SQL)
smoother("norm_trend", lambda: F.try_divide(sm.gradient("close"), sm.rolling_std("close", 20)), f"{GRADIENT_SQL} / nullif(stddev_pop(close) OVER {_frame(-19, 0)}, 0)")
smoother("rolling_quantile", lambda: F.percentile("close", 0.45).over(incl(30)), f"quantile_cont(close, 0.45) OVER {_frame(-29, 0)}")
smoother("forward_median", lambda: sm.forward_median(1, 5), f"quantile_cont(close, 0.5) OVER {_frame(1, 5)}")
smoother("recency_weight", lambda: F.col("close") * F.exp(F.col("rn") * 0.95 / F.col("n")), "close * exp(rn * 0.95 / n)")


def circular_shift(spark, sf, k: int = 3):
    """Row i takes the value of row i - k, wrapped around the ends of the series; an equi-join on the row number."""
    s = sm.with_size(event_bars(spark, sf))
    values = s.select("symbol", F.pmod(F.col("rn") + k, F.col("n")).alias("rn"), F.col("close").alias("value"))
    return s.join(values, ["symbol", "rn"]).select("symbol", "bar", F.round("value", 6).alias("value"))


QUERIES["circular_shift"] = circular_shift
SQL["circular_shift"] = f"WITH {bars_sql()}, {BASE_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM base) SELECT a.symbol, a.bar, round(b.close, 6) AS value FROM s a JOIN s b ON a.symbol = b.symbol AND a.rn = (b.rn + 3) % b.n"

QUERIES["ema"] = lambda spark, sf: sm.ema(event_bars(spark, sf), 10).select("symbol", "bar", F.round("ema", 6).alias("value"))
SQL["ema"] = f"""WITH RECURSIVE {bars_sql()}, {BASE_SQL}, e AS (SELECT symbol, rn, bar, close AS v FROM base WHERE rn = 0
 UNION ALL SELECT b.symbol, b.rn, b.bar, (2.0 / 11) * b.close + (1 - 2.0 / 11) * e.v FROM e JOIN base b ON b.symbol = e.symbol AND b.rn = e.rn + 1) SELECT symbol, bar, round(v, 6) AS value FROM e"""

SG_W, SG_P = 9, 3


def _savgol_sql(x: str = "close") -> str:
    half = SG_W // 2
    dot = lambda w, start: " + ".join(f"{c!r} * {'lag' if start + k < 0 else 'lead'}({x}, {abs(start + k)}) OVER ({W})" for k, c in enumerate(w.tolist()))
    whens = [f"WHEN rn >= {half} AND rn < n - {half} THEN {dot(sm.savgol_weights(SG_W, SG_P), -half)}"]
    for k in range(half):
        whens.append(f"WHEN rn = {k} THEN {dot(sm.savgol_weights(SG_W, SG_P, k), -k)}")
        whens.append(f"WHEN rn = n - 1 - {k} THEN {dot(sm.savgol_weights(SG_W, SG_P, SG_W - 1 - k), k + 1 - SG_W)}")
    return "CASE " + " ".join(whens) + " END"


SAVGOL_SQL = _savgol_sql()


def _savgol():
    return sm.savgol("close", SG_W, SG_P, F.col("n"), F.col("rn"))


smoother("savgol", _savgol, SAVGOL_SQL)

QUERIES["global_quantile"] = lambda spark, sf: event_bars(spark, sf).groupBy("symbol").agg(*[F.round(F.percentile("close", q), 6).alias(f"q{int(100 * q)}") for q in (0.45, 0.55)])
SQL["global_quantile"] = f"WITH {bars_sql()} SELECT symbol, round(quantile_cont(close, 0.45), 6) AS q45, round(quantile_cont(close, 0.55), 6) AS q55 FROM bars GROUP BY symbol"


def vol_bins(spark, sf):
    vol = event_bars(spark, sf).withColumn("vol", sm.rolling_std("close", 20))
    return vol.join(sm.quantile_bins(vol, "vol"), "symbol").select("symbol", "bar", sm.bin_of(F.col("vol"), F.col("edges")).cast("long").alias("bin")).groupBy("symbol", "bin").agg(F.count("*").alias("n_bars"))


QUERIES["vol_bins"] = vol_bins
_STEPS = ", ".join(str(k / 20) for k in range(21))
SQL["vol_bins"] = f"""WITH {bars_sql()}, v AS (SELECT *, stddev_pop(close) OVER {_frame(-19, 0)} AS vol FROM bars),
e AS (SELECT symbol, list_sort(list_distinct(quantile_cont(vol, [{_STEPS}]))) AS edges FROM v GROUP BY symbol)
SELECT symbol, CAST(greatest(len(list_filter(edges, lambda x: x < vol)) - 1, 0) AS BIGINT) AS bin, count(*) AS n_bars FROM v JOIN e USING (symbol) GROUP BY ALL"""


def labeler(name: str, build, sql: str, first: int = 1, last: int = 5, extra: str = "") -> None:
    """``build``: prepared frame -> frame with label; ``sql``: the label over ``p``."""
    QUERIES[name] = lambda spark, sf: build(lb.prepared(event_bars(spark, sf), first, last)).select("symbol", "bar", "label")
    SQL[name] = f"{prepared_sql(first, last)}{extra} SELECT symbol, bar, CAST({sql} AS DOUBLE) AS label FROM {'q' if extra else 'p'}"


def whole_sql(label: str, last: int) -> str:
    return f"CASE WHEN rn < n - {last} THEN ({label}) ELSE 2 END"


def zone_sql(buy: str, sell: str, gain: str, fall: str, direction: str = "both") -> str:
    if direction == "both":
        return f"CASE WHEN {sell} AND {fall} THEN 1 WHEN {buy} AND {gain} THEN 0 ELSE 2 END"
    zone, good = (buy, gain) if direction == "buy" else (sell, fall)
    return f"CASE WHEN {zone} AND {good} THEN 1 WHEN {zone} THEN 0 ELSE 2 END"


UP, DOWN = "fwd >= close + 0.5 * atr", "fwd <= close - 0.5 * atr"
UPS, DOWNS = "fwd > close + 0.5 * atr", "fwd < close - 0.5 * atr"
GAIN, FALL = "fwd - 0.5 * atr > close", "fwd + 0.5 * atr < close"

for _d, _case in {
    "both": f"CASE WHEN {UPS} THEN 0 WHEN {DOWNS} THEN 1 ELSE 2 END",
    "buy": f"CASE WHEN {UPS} THEN 1 WHEN {DOWNS} THEN 0 ELSE 2 END",
    "sell": f"CASE WHEN {DOWNS} THEN 1 WHEN {UPS} THEN 0 ELSE 2 END",
}.items():
    labeler(f"label_random_{_d}", lambda df, d=_d: df.withColumn("label", lb.random(0.5, 5, d)), whole_sql(_case, 5))

QUERIES["label_counts"] = lambda spark, sf: QUERIES["label_random_both"](spark, sf).groupBy("symbol", "label").agg(F.count("*").alias("n_bars"))
SQL["label_counts"] = f"SELECT symbol, label, count(*) AS n_bars FROM ({SQL['label_random_both']}) GROUP BY ALL"

_MW = [5, 10, 20]
_LONGS = " + ".join(f"CASE WHEN close > max(close) OVER {_frame(-w, -1)} + 0.5 * atr THEN 1 ELSE 0 END" for w in _MW)
_SHORTS = " + ".join(f"CASE WHEN close < min(close) OVER {_frame(-w, -1)} - 0.5 * atr THEN 1 ELSE 0 END" for w in _MW)
for _d in lb.DIRECTIONS:
    _buy, _sell = ("longs > shorts", "shorts > longs") if _d == "both" else ("longs > 0", "shorts > 0")
    labeler(
        f"label_multi_window_{_d}" if _d != "both" else "label_multi_window",
        lambda df, d=_d: df.withColumn("label", lb.multi_window(_MW, 0.5, 5, d)),
        f"CASE WHEN rn >= 20 THEN {whole_sql(zone_sql(_buy, _sell, UP, DOWN, _d), 5)} ELSE 2 END",
        extra=f", q AS (SELECT *, {_LONGS} AS longs, {_SHORTS} AS shorts FROM p)",
    )


def _levels(df, smooth):
    """lvl (weighted deviation from a smoothed curve) and its quantiles over the series."""
    weight = F.exp(F.col("rn") * 0.95 / F.col("n"))
    df = df.withColumn("curve", smooth).withColumn("lvl", F.round((F.col("close") - F.col("curve")) * weight, 6))
    q = df.groupBy("symbol").agg(F.percentile("lvl", 0.45).alias("lo"), F.percentile("lvl", 0.55).alias("hi"))
    return df.join(q, "symbol")


def _levels_sql(curve: str) -> str:
    return f""", c AS (SELECT *, round((close - ({curve})) * exp(rn * 0.95 / n), 6) AS lvl FROM p),
qs AS (SELECT symbol, quantile_cont(lvl, 0.45) AS lo, quantile_cont(lvl, 0.55) AS hi FROM c GROUP BY symbol), q AS (SELECT * FROM c JOIN qs USING (symbol))"""


SMA_SQL = f"avg(close) OVER {_frame(-9, 0)}"
for _name, _curve in (("label_filter", SAVGOL_SQL), ("label_mean_rev_mean", SMA_SQL)):
    for _d in lb.DIRECTIONS:
        labeler(
            _name if _d == "both" else f"{_name}_{_d}",
            lambda df, d=_d, mean=_curve is SMA_SQL: _levels(df, sm.sma("close", 10) if mean else _savgol()).withColumn("label", lb.deviation(F.col("lvl"), F.col("lo"), F.col("hi"), 0.5, 15, d)),
            whole_sql(zone_sql("lvl < lo", "lvl > hi", GAIN, FALL, _d), 15),
            last=15,
            extra=_levels_sql(_curve),
        )


def _trend(df, curve):
    return df.withColumn("curve", F.round(curve, 6)).withColumn("strength", F.round(F.try_divide(sm.gradient("curve"), sm.rolling_std("curve", 20)), 6))


def _trend_sql(curve: str) -> str:
    g = GRADIENT_SQL.replace("close", "curve")
    return f", c AS (SELECT *, round({curve}, 6) AS curve FROM p), q AS (SELECT *, round({g} / nullif(stddev_pop(curve) OVER {_frame(-19, 0)}, 0), 6) AS strength FROM c)"


for _name, _mean, _curve in (("label_trend", False, SAVGOL_SQL), ("label_trend_filters_sma", True, SMA_SQL)):
    for _d in lb.DIRECTIONS:
        labeler(
            _name if _d == "both" else f"{_name}_{_d}",
            lambda df, d=_d, mean=_mean: _trend(df, sm.sma("close", 10) if mean else _savgol()).withColumn("label", lb.trend(F.col("strength"), 0.3, 0.5, 15, d)),
            whole_sql(zone_sql("strength > 0.3", "strength < -0.3", UP, DOWN, _d), 15),
            last=15,
            extra=_trend_sql(_curve),
        )

_PERIODS = [5, 10, 20]


def _trend_multi(df, direction: str = "both"):
    df = df.withColumns({f"c{k}": F.round(sm.sma("close", k), 6) for k in _PERIODS})
    df = df.withColumns({f"s{k}": F.round(F.try_divide(sm.gradient(f"c{k}"), sm.rolling_std(f"c{k}", 20)), 6) for k in _PERIODS})
    return df.withColumn("label", lb.trend_multi([F.col(f"s{k}") for k in _PERIODS], 0.3, 0.5, 15, direction))


_C = ", ".join(f"round(avg(close) OVER {_frame(1 - k, 0)}, 6) AS c{k}" for k in _PERIODS)
_S = ", ".join(f"round({GRADIENT_SQL.replace('close', f'c{k}')} / nullif(stddev_pop(c{k}) OVER {_frame(-19, 0)}, 0), 6) AS s{k}" for k in _PERIODS)
_B = "(" + " OR ".join(f"coalesce(s{k} > 0.3, false)" for k in _PERIODS) + f") AND {UP}"
_E = "(" + " OR ".join(f"coalesce(s{k} < -0.3, false)" for k in _PERIODS) + f") AND {DOWN}"
labeler("label_trend_multi", _trend_multi, whole_sql(f"CASE WHEN ({_B}) AND NOT ({_E}) THEN 0 WHEN ({_E}) AND NOT ({_B}) THEN 1 ELSE 2 END", 15), last=15, extra=f", c AS (SELECT *, {_C} FROM p), q AS (SELECT *, {_S} FROM c)")


def _filter_multi(df):
    df = df.withColumns({f"l{k}": F.round(F.col("close") - sm.sma("close", k), 6) for k in (5, 20)})
    bounds = [(F.col(f"l{k}"), F.percentile(f"l{k}", 0.45).over(incl(50)), F.percentile(f"l{k}", 0.55).over(incl(50))) for k in (5, 20)]
    return df.withColumn("label", lb.consensus(bounds, 0.5, 15))


_L = ", ".join(f"round(close - avg(close) OVER {_frame(1 - k, 0)}, 6) AS l{k}" for k in (5, 20))
_QS = ", ".join(f"quantile_cont(l{k}, 0.45) OVER {_frame(-49, 0)} AS lo{k}, quantile_cont(l{k}, 0.55) OVER {_frame(-49, 0)} AS hi{k}" for k in (5, 20))
labeler("label_filter_multi", _filter_multi, whole_sql(zone_sql("l5 < lo5 AND l20 < lo20", "l5 > hi5 AND l20 > hi20", UP, DOWN), 14), last=15, extra=f", c AS (SELECT *, {_L} FROM p), q AS (SELECT *, {_QS} FROM c)")


def _filter_binary(df):
    """Selling zone by one curve, buying zone by another."""
    df = df.withColumns({"a": F.round(F.col("close") - sm.sma("close", 5), 6), "b": F.round(F.col("close") - sm.sma("close", 20), 6)})
    df = df.join(df.groupBy("symbol").agg(F.percentile("a", 0.55).alias("hi"), F.percentile("b", 0.45).alias("lo")), "symbol")
    gain, fall = F.col("fwd") - 0.5 * F.col("atr") > F.col("close"), F.col("fwd") + 0.5 * F.col("atr") < F.col("close")
    label = lb.zones(F.col("b") < F.col("lo"), F.col("a") > F.col("hi"), gain, fall, "both")
    return df.withColumn("label", F.when(F.col("rn") < F.col("n") - 15, label).otherwise(2.0))


labeler(
    "label_filter_binary",
    _filter_binary,
    whole_sql(zone_sql("b < lo", "a > hi", GAIN, FALL), 15),
    last=15,
    extra=f""", c AS (SELECT *, round(close - avg(close) OVER {_frame(-4, 0)}, 6) AS a, round(close - avg(close) OVER {_frame(-19, 0)}, 6) AS b FROM p),
qs AS (SELECT symbol, quantile_cont(a, 0.55) AS hi, quantile_cont(b, 0.45) AS lo FROM c GROUP BY symbol), q AS (SELECT * FROM c JOIN qs USING (symbol))""",
)


def _mean_rev_vol(df):
    """Quantiles by volatility bin of the series."""
    df = df.withColumns({"vol": sm.rolling_std("close", 20), "lvl": F.round(F.col("close") - sm.sma("close", 10), 6)})
    df = df.join(sm.quantile_bins(df, "vol"), "symbol").withColumn("bin", sm.bin_of(F.col("vol"), F.col("edges")))
    q = df.groupBy("symbol", "bin").agg(F.percentile("lvl", 0.45).alias("lo"), F.percentile("lvl", 0.55).alias("hi"))
    return df.join(q, ["symbol", "bin"]).withColumn("label", lb.deviation(F.col("lvl"), F.col("lo"), F.col("hi"), 0.5, 15))


labeler(
    "label_mean_rev_vol_mean",
    _mean_rev_vol,
    whole_sql(zone_sql("lvl < lo", "lvl > hi", GAIN, FALL), 15),
    last=15,
    extra=f""", v AS (SELECT *, stddev_pop(close) OVER {_frame(-19, 0)} AS vol, round(close - {SMA_SQL}, 6) AS lvl FROM p),
e AS (SELECT symbol, list_sort(list_distinct(quantile_cont(vol, [{_STEPS}]))) AS edges FROM v GROUP BY symbol),
c AS (SELECT v.*, greatest(len(list_filter(edges, lambda x: x < vol)) - 1, 0) AS bin FROM v JOIN e USING (symbol)),
qs AS (SELECT symbol, bin, quantile_cont(lvl, 0.45) AS lo, quantile_cont(lvl, 0.55) AS hi FROM c GROUP BY ALL), q AS (SELECT * FROM c JOIN qs USING (symbol, bin))""",
)

_PEAK, _TROUGH = ("coalesce(close {0} lag(close) OVER ({1}) AND close {0} lead(close) OVER ({1}), false)".format(op, W) for op in "><")
for _d, _event, _value in (
    ("both", f"CASE WHEN peak AND {DOWN} THEN 1 WHEN trough AND {UP} THEN 0 END", f"CASE WHEN state = 1 AND {DOWN} THEN 1 WHEN state = 0 AND {UP} THEN 0 ELSE 2 END"),
    ("buy", f"CASE WHEN trough THEN CASE WHEN {UP} THEN 0 ELSE -1 END END", f"CASE WHEN trough AND NOT {UP} THEN 0 WHEN state = 0 AND {UP} THEN 1 ELSE 2 END"),
    ("sell", f"CASE WHEN peak THEN CASE WHEN {DOWN} THEN 1 ELSE -1 END END", f"CASE WHEN peak AND NOT {DOWN} THEN 0 WHEN state = 1 AND {DOWN} THEN 1 ELSE 2 END"),
):
    labeler(
        "label_zigzag" if _d == "both" else f"label_zigzag_{_d}",
        lambda df, d=_d: lb.label_zigzag(lb.local_extremes(df), 0.5, 5, d),
        whole_sql(_value, 5),
        extra=f""", x AS (SELECT *, {_PEAK} AS peak, {_TROUGH} AS trough FROM p), e AS (SELECT *, CASE WHEN rn < n - 5 THEN {_event} END AS event FROM x),
q AS (SELECT *, last_value(event IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM e)""",
    )

labeler(
    "label_first_touch",
    lambda df: df.withColumn("label", lb.first_touch(df, 0.5, 1, 5)),
    whole_sql("CASE WHEN a < b THEN 0 WHEN b < a THEN 1 ELSE 2 END", 5),
    extra=f""", x AS (SELECT *, list(high) OVER {_frame(1, 5)} AS hs, list(low) OVER {_frame(1, 5)} AS ls FROM p),
q AS (SELECT *, coalesce(list_min(list_filter(range(1, len(hs) + 1), lambda i: hs[i] >= close + 0.5 * atr)), 99) AS a,
 coalesce(list_min(list_filter(range(1, len(ls) + 1), lambda i: ls[i] <= close - 0.5 * atr)), 99) AS b FROM x)""",
)
