"""Queries over bars and features, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.functions.frames import chunked, ordered, with_base
from barloom.plans.registry import QUERIES, SQL
from barloom.sources.bars import event_bars, order_bars

P = 12


def bars_sql(hours: str = "4 hours", symbol: str = "event_type") -> str:
    return f"""bars AS (SELECT {symbol} AS symbol, time_bucket(INTERVAL '{hours}', ts) AS bar, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
 min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*) AS volume FROM events GROUP BY ALL)"""


BASE_SQL = """base AS (SELECT *, row_number() OVER w - 1 AS rn, close - lag(close) OVER w AS d,
 CASE WHEN lag(close) OVER w IS NULL THEN NULL WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) ELSE 0.0 END AS r
 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar))"""

for _name, _every, _by_type, _sql in (
    ("bars_4h", "4 hours", True, bars_sql()),
    ("bars_1h", "1 hour", True, bars_sql("1 hour")),
    ("bars_1h_all", "1 hour", False, bars_sql("1 hour", "'all'")),
    ("bars_5m_all", "5 minutes", False, bars_sql("5 minutes", "'all'")),
):
    QUERIES[_name] = lambda spark, sf, e=_every, b=_by_type: event_bars(spark, sf, e, b)
    SQL[_name] = f"WITH {_sql} SELECT * FROM bars"

QUERIES["bars_1d_orders"] = order_bars
SQL["bars_1d_orders"] = """SELECT 'orders' AS symbol, time_bucket(INTERVAL '1 day', o_orderdate::TIMESTAMP) AS bar, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS open,
 max(o_totalprice) AS high, min(o_totalprice) AS low, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS close, count(*) AS volume FROM orders GROUP BY ALL"""

QUERIES["log_returns"] = lambda spark, sf: with_base(event_bars(spark, sf)).select("symbol", "bar", F.round("r", 9).alias("r"))
SQL["log_returns"] = f"WITH {bars_sql()}, {BASE_SQL} SELECT symbol, bar, round(r, 9) AS r FROM base"

#: Each over the lists a (closes), q (returns) of the frame, n = its length.
_MEAN, _SD = "list_avg(a)", "list_aggregate(a, 'stddev_samp')"
_DIFF = "list_transform(range(2, 13), lambda i: a[i] - a[i-1])"
_UP, _DOWN = (f"list_transform({_DIFF}, lambda x: greatest({s}x, 0.0))" for s in ("", "-"))
_MOM = "(a[1] / nullif(a[12], 0) - 1)"
_LOGS = "list_transform(range(1, 12), lambda i: ln(a[i] / a[i+1]))"
FEATURE_SQL = {
    "std": "list_aggregate(q, 'stddev_samp')",
    "mean": "list_avg(q)",
    "median": "list_median(q)",
    "iqr": "list_sort(q)[9] - list_sort(q)[3]",
    "mad": "list_avg(list_transform(q, lambda x: abs(x - list_avg(q))))",
    "sharpe": "CASE WHEN list_aggregate(q, 'stddev_samp') = 0 THEN 0 ELSE list_avg(q) / list_aggregate(q, 'stddev_samp') END",
    "autocorr": "coalesce(list_sum(list_transform(range(1, 12), lambda i: (q[i] - list_avg(q)) * (q[i+1] - list_avg(q)))) / nullif(list_sum(list_transform(range(1, 12), lambda i: (q[i] - list_avg(q)) ** 2)), 0), 0)",
    "skew": f"CASE WHEN {_SD} = 0 THEN 0 ELSE list_avg(list_transform(a, lambda x: ((x - {_MEAN}) / {_SD}) ** 3)) END",
    "kurt": f"CASE WHEN {_SD} = 0 THEN 0 ELSE list_avg(list_transform(a, lambda x: ((x - {_MEAN}) / {_SD}) ** 4)) - 3 END",
    "zscore": f"CASE WHEN {_SD} = 0 THEN 0 ELSE (a[12] - {_MEAN}) / {_SD} END",
    "range": "list_max(a) - list_min(a)",
    "cv": f"coalesce({_SD} / nullif({_MEAN}, 0), 0)",
    "var": "list_aggregate(a, 'var_pop')",
    "entropy": """CASE WHEN list_max(a) = list_min(a) THEN 0 ELSE -list_sum(list_transform(range(0, 10), lambda k: coalesce(
      (len(list_filter(a, lambda x: least(floor((x - list_min(a)) / ((list_max(a) - list_min(a)) / 10)), 9) = k)) / 12.0)
      * ln(nullif(len(list_filter(a, lambda x: least(floor((x - list_min(a)) / ((list_max(a) - list_min(a)) / 10)), 9) = k)), 0) / 12.0), 0))) END""",
    "slope": f"list_sum(list_transform(range(1, 13), lambda i: (i - 6.5) * (a[i] - {_MEAN}))) / 143.0",
    "momentum": _MOM,
    "fractal": f"CASE WHEN {_SD} = 0 OR len(list_filter({_DIFF}, lambda x: abs(x) > {_SD} / 4)) = 0 THEN 1.0 ELSE 1.0 + ln(len(list_filter({_DIFF}, lambda x: abs(x) > {_SD} / 4))) / ln(12) END",
    "hurst": """coalesce(list_avg(list_transform(list_filter(range(2, 13), lambda k: list_aggregate(a[1:k], 'stddev_samp') > 0 AND list_max(a[1:k]) > list_min(a[1:k])),
      lambda k: ln((list_max(a[1:k]) - list_min(a[1:k])) / list_aggregate(a[1:k], 'stddev_samp')))) / ln(12), 0.5)""",
    "maxdd": "list_max(list_transform(range(1, 13), lambda i: (list_max(a[1:i]) - a[i]) / list_max(a[1:i])))",
    "fisher": f"CASE WHEN abs({_MOM}) < 1 THEN 0.5 * ln((1 + {_MOM}) / (1 - {_MOM})) END",
    "chande": f"coalesce((list_sum({_UP}) - list_sum({_DOWN})) / nullif(list_sum({_UP}) + list_sum({_DOWN}), 0), 0)",
    "approxentropy": f"""(SELECT CASE WHEN c2 > 0 THEN ln(c2 / 11.0) ELSE 0 END - CASE WHEN c3 > 0 THEN ln(c3 / 10.0) ELSE 0 END FROM (SELECT
      list_sum(list_transform(range(1, 12), lambda i: len(list_filter(range(1, 12), lambda j: i <> j AND abs(a[i]-a[j]) <= 0.2*{_SD} AND abs(a[i+1]-a[j+1]) <= 0.2*{_SD})))) AS c2,
      list_sum(list_transform(range(1, 11), lambda i: len(list_filter(range(1, 11), lambda j: i <> j AND abs(a[i]-a[j]) <= 0.2*{_SD} AND abs(a[i+1]-a[j+1]) <= 0.2*{_SD} AND abs(a[i+2]-a[j+2]) <= 0.2*{_SD})))) AS c3))""",
    "effratio": f"coalesce((a[12] - a[1]) / nullif(list_sum(list_transform({_DIFF}, lambda x: abs(x))), 0), 0)",
    "corrskew": """coalesce(2 * list_sum(list_transform(range(1, 8), lambda i: (a[i] - list_avg(a[1:7])) * (a[i+5] - list_avg(a[6:12]))))
      / nullif(7 * list_aggregate(a[1:7], 'stddev_samp') * list_aggregate(a[6:12], 'stddev_samp'), 0), 0)""",
    "jumpvol": f"""CASE WHEN list_median(list_transform({_LOGS}, lambda x: abs(x - list_median({_LOGS})))) = 0 THEN 0 ELSE
      len(list_filter({_LOGS}, lambda x: abs(x - list_median({_LOGS})) > 3.0 * list_median(list_transform({_LOGS}, lambda y: abs(y - list_median({_LOGS})))))) / 11.0 END""",
    "volskew": f"coalesce((list_aggregate({_UP}, 'stddev_samp') - list_aggregate({_DOWN}, 'stddev_samp')) / nullif(list_aggregate({_UP}, 'stddev_samp') + list_aggregate({_DOWN}, 'stddev_samp'), 0), 0)",
    "vwapdevz": f"(a[12] - CASE WHEN list_sum(v) > 0 THEN list_sum(list_transform(range(1, 13), lambda i: t[i] * v[i])) / list_sum(v) ELSE t[12] END) / greatest({_SD}, 1e-8)",
    "volzscore": "CASE WHEN list_aggregate(v[1:11], 'stddev_pop') <= 1e-8 THEN 0 ELSE (v[12] - list_avg(v[1:11])) / list_aggregate(v[1:11], 'stddev_pop') END",
}
_LISTS_SQL = """f AS (SELECT symbol, bar, rn, list(close) OVER w AS a, list(r) OVER w AS q, list(volume) OVER w AS v, list((high + low + close) / 3.0) OVER w AS t
 FROM base WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""

for _stat in ft.STATISTICS:
    QUERIES[f"feat_{_stat}"] = lambda spark, sf, s=_stat: ft.feature(event_bars(spark, sf), s, P)
    _from = P + (_stat in ft.ON_RETURNS)
    SQL[f"feat_{_stat}"] = f"WITH {bars_sql()}, {BASE_SQL}, {_LISTS_SQL} SELECT symbol, bar, round(CASE WHEN rn >= {_from} THEN {FEATURE_SQL[_stat]} END, 6) AS value FROM f"

MATRIX = [(5, "mean", "main"), (12, "zscore", "main"), (12, "entropy", "main"), (5, "maxdd", "meta"), (12, "slope", "meta")]


def feature_matrix(spark, sf):
    """Several periods, statistics and roles in one pass over the series."""
    df = ft.features(event_bars(spark, sf), MATRIX)
    return df.select("symbol", "bar", *[F.round(c, 6).alias(f"f_{c}") for c in df.columns if c.endswith("_feature")])


QUERIES["feature_matrix"] = feature_matrix
_M5 = "list(r) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS q5, list(close) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS a5"
SQL["feature_matrix"] = f"""WITH {bars_sql()}, {BASE_SQL}, f AS (SELECT symbol, bar, rn, list(close) OVER w AS a, {_M5}
 FROM base WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT symbol, bar, round(CASE WHEN rn >= 6 THEN list_avg(q5) END, 6) AS f_5_mean_main_feature, round(CASE WHEN rn >= 12 THEN {FEATURE_SQL["zscore"]} END, 6) AS f_12_zscore_main_feature,
 round(CASE WHEN rn >= 12 THEN {FEATURE_SQL["entropy"]} END, 6) AS f_12_entropy_main_feature,
 round(CASE WHEN rn >= 5 THEN list_max(list_transform(range(1, 6), lambda i: (list_max(a5[1:i]) - a5[i]) / list_max(a5[1:i]))) END, 6) AS f_5_maxdd_meta_feature,
 round(CASE WHEN rn >= 12 THEN {FEATURE_SQL["slope"]} END, 6) AS f_12_slope_meta_feature FROM f"""


def halo_features(spark, sf):
    """A finite-frame statistic over one long series, chunked with a halo instead of one task per series."""
    base = with_base(event_bars(spark, sf, "5 minutes", False)).select("symbol", "bar", "close", "rn")
    w = ordered("symbol", "chunk").rowsBetween(-P, -1)
    z = (F.max("close").over(w) - F.min("close").over(w)).alias("v")
    parts = chunked(base, 2048, P).select("symbol", "bar", "rn", "own", z)
    return parts.where("own").select("symbol", "bar", F.round(F.when(F.col("rn") >= P, F.col("v")), 6).alias("value"))


QUERIES["halo_range"] = halo_features
SQL["halo_range"] = f"""WITH {bars_sql("5 minutes", "'all'")}, {BASE_SQL} SELECT symbol, bar, round(CASE WHEN rn >= 12 THEN max(close) OVER w - min(close) OVER w END, 6) AS value FROM base
 WINDOW w AS (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"""
