"""Queries of stateful labelers, regimes, models, search, sinks and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.operators import backtest as bt
from barloom.operators import dispatch as dp
from barloom.operators import labels as lb
from barloom.operators import models as ml
from barloom.operators import regimes as rg
from barloom.operators import search as se
from barloom.operators import stateful_labels as sl
from barloom.plans.bar_queries import bars_sql
from barloom.plans.label_queries import prepared_sql
from barloom.plans.registry import QUERIES, SQL
from barloom.plans.strategy_queries import HEAD, WANT_SQL, scored
from barloom.sources.bars import event_bars
from barloom.streaming import live


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors see; a local one only where the session names none and the master is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
    return f"{base.rstrip('/')}/barloom/{uuid.uuid4().hex}/{name}"


def _prepared(spark, sf, last: int = 5) -> DataFrame:
    return lb.prepared(event_bars(spark, sf), 1, last)


QUERIES["label_fractal"] = lambda spark, sf: sl.fractal(_prepared(spark, sf), 6, 12, 0.7, 0.5, 5).select("symbol", "bar", "label")
SQL["label_fractal"] = f"""{prepared_sql()}, st AS (SELECT symbol, rn AS start, list(close) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) AS a FROM p),
sz AS (SELECT symbol, start, w, a[1:w//2] AS x, list_transform(list_reverse(a[w//2+1:w]), lambda v: -v) AS y FROM st, (VALUES (6), (8), (10), (12)) t(w) WHERE len(a) >= w),
mm AS (SELECT symbol, start, w, x, y, list_avg(x) AS mx, list_avg(y) AS my FROM sz),
su AS (SELECT symbol, start, w, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - mx) * (y[i] - my))) AS xy, list_sum(list_transform(x, lambda v: (v - mx) * (v - mx))) AS xx, list_sum(list_transform(y, lambda v: (v - my) * (v - my))) AS yy FROM mm),
co AS (SELECT symbol, start, w, round(xy / sqrt(xx * yy), 9) AS corr FROM su WHERE sqrt(xx / (w / 2.0)) > 1e-9 AND sqrt(yy / (w / 2.0)) > 1e-9),
be AS (SELECT symbol, start, w, corr FROM co QUALIFY row_number() OVER (PARTITION BY symbol, start ORDER BY abs(corr) DESC, w) = 1),
po AS (SELECT symbol, start, abs(corr) >= 0.7 AS reliable, unnest(range(start, start + w)) AS rn FROM be),
la AS (SELECT symbol, rn, arg_max(reliable, start) AS reliable FROM po GROUP BY ALL),
f AS (SELECT *, lead(close, 5) OVER (PARTITION BY symbol ORDER BY bar) AS later FROM p)
SELECT f.symbol, bar, CAST(CASE WHEN coalesce(reliable, false) THEN CASE WHEN later IS NULL THEN 2 WHEN later > close + 0.5 * atr THEN 0 WHEN later < close - 0.5 * atr THEN 1 ELSE 2 END ELSE 2 END AS DOUBLE) AS label
FROM f LEFT JOIN la ON la.symbol = f.symbol AND la.rn = f.rn"""


def _given_clusters(df: DataFrame) -> DataFrame:
    return df.withColumn("cluster", F.pmod(F.floor(F.col("close") / 20), F.lit(4)).cast("long"))


QUERIES["label_clusters"] = lambda spark, sf: sl.cluster_jumps(_given_clusters(_prepared(spark, sf)), "cluster", 0.5).select("symbol", "bar", "label")
SQL["label_clusters"] = f"""{prepared_sql()}, k AS (SELECT *, floor(close / 20)::BIGINT % 4 AS cluster FROM p),
j AS (SELECT symbol, rn, bar, cluster AS cur, close AS price, 2.0 AS label FROM k WHERE rn = 0
 UNION ALL SELECT k.symbol, k.rn, k.bar, CASE WHEN k.cluster <> j.cur AND abs(k.close - j.price) > 0.5 * k.atr THEN k.cluster ELSE j.cur END,
 CASE WHEN k.cluster <> j.cur AND abs(k.close - j.price) > 0.5 * k.atr THEN k.close ELSE j.price END,
 CASE WHEN k.cluster <> j.cur AND abs(k.close - j.price) > 0.5 * k.atr THEN CASE WHEN k.close > j.price THEN 0.0 ELSE 1.0 END ELSE 2.0 END FROM j JOIN k ON k.symbol = j.symbol AND k.rn = j.rn + 1)
SELECT symbol, bar, CAST(label AS DOUBLE) AS label FROM j"""
QUERIES["label_validated_levels"] = lambda spark, sf: sl.validated_levels(_prepared(spark, sf, 15), 20, 2, 0.5, 15).select("symbol", "bar", "label")

QUERIES["prominent_extremes"] = lambda spark, sf: sl.prominent_extremes(event_bars(spark, sf), 5.0).select("symbol", "bar", "peak", "trough")


def _extreme_sql(side: str) -> str:
    """Points of ``c`` (signed close) that are strict local maxima and stand out by 5."""
    return f"""{side}0 AS (SELECT a.symbol, a.rn, a.c, max(b.rn) FILTER (b.rn < a.rn AND b.c > a.c) AS lo, min(b.rn) FILTER (b.rn > a.rn AND b.c > a.c) AS hi
 FROM {side} a JOIN {side} b ON a.symbol = b.symbol WHERE a.c > a.p AND a.c > a.q GROUP BY ALL),
{side}1 AS (SELECT a.symbol, a.rn, a.c - greatest(min(b.c) FILTER (b.rn <= a.rn AND b.rn > coalesce(a.lo, -1)), min(b.c) FILTER (b.rn >= a.rn AND b.rn < coalesce(a.hi, 1000000))) AS prom FROM {side}0 a JOIN {side} b ON a.symbol = b.symbol GROUP BY a.symbol, a.rn, a.c)"""


SQL["prominent_extremes"] = f"""WITH {bars_sql()}, s AS (SELECT *, row_number() OVER w - 1 AS rn, lag(close) OVER w AS pv, lead(close) OVER w AS nx FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
u AS (SELECT symbol, rn, close AS c, pv AS p, nx AS q FROM s), v AS (SELECT symbol, rn, -close AS c, -pv AS p, -nx AS q FROM s), {_extreme_sql("u")}, {_extreme_sql("v")}
SELECT s.symbol, s.bar, coalesce(a.prom >= 5, false) AS peak, coalesce(b.prom >= 5, false) AS trough FROM s LEFT JOIN u1 a ON a.symbol = s.symbol AND a.rn = s.rn LEFT JOIN v1 b ON b.symbol = s.symbol AND b.rn = s.rn"""


def labelled_data(spark, sf) -> DataFrame:
    """The data set of a trial: features, label and split, counted by split and label."""
    wanted = [(12, "zscore", "main"), (5, "mean", "main"), (10, "range", "meta")]
    span = (("2024-01-01 00:00:00", "2024-01-20 23:59:59"), ("2024-01-08 00:00:00", "2024-01-12 23:59:59"))
    data = dp.labelled_data(event_bars(spark, sf), wanted, "trend_filters", {"kind": "sma", "rolling": 10, "threshold": 0.3, "vol_window": 20}, *span)
    return data.groupBy("symbol", "split", "label").agg(F.count("*").alias("n_bars"))


QUERIES["labelled_data"] = labelled_data

FEATURES = ["12_std_meta_feature", "12_zscore_meta_feature", "12_range_meta_feature"]


def _matrix(spark, sf) -> DataFrame:
    return ft.features(event_bars(spark, sf), [(12, "std", "meta"), (12, "zscore", "meta"), (12, "range", "meta")]).select("symbol", "bar", "open", *FEATURES)


def _sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("symbol", "regime").agg(F.count("*").alias("n_bars"))


QUERIES["kmeans_global"] = lambda spark, sf: _sizes(rg.kmeans(_matrix(spark, sf), FEATURES, 4))
QUERIES["kmeans_vote"] = lambda spark, sf: _sizes(rg.kmeans_vote(_matrix(spark, sf), FEATURES, 4, 60, 20))
QUERIES["gmm_regimes"] = lambda spark, sf: _sizes(rg.gaussian_mixture(_matrix(spark, sf), FEATURES, 3, 20))
QUERIES["markov_regimes"] = lambda spark, sf: _sizes(rg.markov(_matrix(spark, sf), FEATURES, 3, 10))


def _labelled(spark, sf) -> DataFrame:
    return _matrix(spark, sf).join(QUERIES["label_random_both"](spark, sf), ["symbol", "bar"])


QUERIES["conformal_mask"] = lambda spark, sf: ml.conformal_mask(_labelled(spark, sf), FEATURES, "label").groupBy("symbol", "keep").agg(F.count("*").alias("n_bars"))
QUERIES["oob_mask"] = lambda spark, sf: ml.oob_mask(_labelled(spark, sf), FEATURES, "label", 3).groupBy("symbol", "keep").agg(F.count("*").alias("n_bars"))


def out_of_sample(spark, sf, share: float = 0.7) -> DataFrame:
    """Probabilities p and q of the signal and the gate model on the bars after the first ``share`` of every symbol's time; the models
    learn from the bars before, are written, and score as read back."""
    rows = _labelled(spark, sf)
    seconds = F.unix_timestamp(F.col("bar").cast("timestamp"))
    ends = rows.groupBy("symbol").agg((F.min(seconds) + share * (F.max(seconds) - F.min(seconds))).alias("cut"))
    path = scratch(spark, "rows")
    rows.join(ends, "symbol").withColumn("late", seconds > F.col("cut")).drop("cut").write.parquet(path)
    early, late = (spark.read.parquet(path).where(x).drop("late") for x in ("not late", "late"))
    main = ml.stored(ml.train(early.where("label in (0.0, 1.0)"), FEATURES, "label", 5), scratch(spark, "main"))
    gate = ml.stored(ml.train(early.withColumn("gate", (F.col("label") != 2.0).cast("double")), FEATURES, "gate", 5), scratch(spark, "gate"))
    scored_rows = ml.score(gate, ml.score(main, late, FEATURES, "p"), FEATURES, "q")
    return scored_rows.select("symbol", "bar", "open", F.col("p").cast("double").alias("p"), F.col("q").cast("double").alias("q"))


def train_score(spark, sf) -> DataFrame:
    """Trades of the bars that the models have not seen, and their score."""
    return bt.trade_stats(bt.backtest(out_of_sample(spark, sf), 0.5, 0.3))


QUERIES["train_score"] = train_score
QUERIES["meta_targets"] = lambda spark, sf: QUERIES["label_random_both"](spark, sf).join(QUERIES["signals"](spark, sf), ["symbol", "bar"]).select("symbol", "bar", F.when(F.col("label").isin(0.0, 1.0) & F.col("gate"), 1).otherwise(0).alias("target"))
SQL["meta_targets"] = f"SELECT symbol, bar, CASE WHEN label IN (0, 1) AND gate THEN 1 ELSE 0 END AS target FROM ({SQL['label_random_both']}) JOIN ({SQL['signals']}) USING (symbol, bar)"
QUERIES["trial_grid"] = lambda spark, sf: se.trials(spark, 200)
QUERIES["best_trial"] = lambda spark, sf: se.best(se.trials(spark, 200).withColumn("score", F.col("main_threshold") - F.col("meta_threshold"))).select("trial", "score")


def stream_bars(spark, sf) -> DataFrame:
    """The batch bars by way of a stream, as far as they are closed: all but the last window."""
    return live.run_to_table(spark, live.stream_bars(live.read_events(spark, sf)), scratch(spark, "bars"), scratch(spark, "offsets"))


QUERIES["stream_bars"] = stream_bars
SQL["stream_bars"] = f"WITH {bars_sql()} SELECT * FROM bars WHERE bar + INTERVAL 4 HOURS <= (SELECT max(ts) FROM events)"


def stream_positions(spark, sf) -> DataFrame:
    """Positions kept by a stream over bars with wanted sides; equal to the batch series."""
    want = bt.desired(*bt.signals(F.col("p"), F.col("q"), 0.5, 0.3, "both"))
    path = scratch(spark, "wants")
    scored(event_bars(spark, sf)).select("symbol", "bar", "open", want.alias("want")).write.parquet(path)
    source = spark.readStream.schema("symbol string, bar timestamp_ntz, open double, want int").parquet(path)
    return live.run_to_table(spark, live.stream_positions(source), scratch(spark, "positions"), scratch(spark, "offsets")).select("symbol", "bar", "pos")


QUERIES["stream_positions"] = stream_positions
SQL["stream_positions"] = f"{HEAD}{WANT_SQL} SELECT symbol, bar, CAST(CASE WHEN lag(want) OVER (PARTITION BY symbol ORDER BY bar) = want THEN want ELSE 0 END AS INTEGER) AS pos FROM want"
