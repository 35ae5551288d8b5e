"""Price history: the text reader, and bars built from events or orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("symbol", "bar", "open", "high", "low", "close", "volume")


def read_history(spark: SparkSession, path: str, symbol: str) -> DataFrame:
    """Bars of one instrument from a white-space separated file with a header:
    date (yyyy.MM.dd), time (HH:mm:ss or HH:mm), open, high, low, close, tick volume.

    Rows with a missing field go. Bars of equal prices and volume collapse to the earliest, as the history format asks.
    """
    parts = F.split(F.trim("value"), r"\s+")
    field = lambda i: F.try_element_at(parts, F.lit(i))
    number = lambda i: F.expr("cast(null as double)") if i is None else field(i).try_cast("double")
    clock = F.when(F.length(field(2)) == 5, F.concat(field(2), F.lit(":00"))).otherwise(field(2))
    when = F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace(field(1), r"\.", "-"), clock)).cast("timestamp_ntz")
    rows = spark.read.text(path).select(
        F.lit(symbol).alias("symbol"), when.alias("bar"), number(3).alias("open"), number(4).alias("high"), number(5).alias("low"), number(6).alias("close"), field(7).try_cast("bigint").alias("volume")
    )
    rows = rows.dropna()
    values = ("open", "high", "low", "close", "volume")
    return rows.groupBy("symbol", *values).agg(F.min("bar").alias("bar")).select(*BAR_COLUMNS)


def aggregate_bars(ticks: DataFrame, every: str, symbol: Column, ts: str, value: str, tie: str) -> DataFrame:
    """Bars of ``every`` (a window length) from ticks: partial aggregation before the shuffle, no sort."""
    order = F.struct(ts, tie)
    return (
        ticks.groupBy(symbol.alias("symbol"), F.window(ts, every).alias("w"))
        .agg(
            F.min_by(value, order).alias("open"),
            F.max(value).alias("high"),
            F.min(value).alias("low"),
            F.max_by(value, order).alias("close"),
            F.count("*").alias("volume"),
        )
        .select("symbol", F.col("w.start").alias("bar"), "open", "high", "low", "close", "volume")
    )


def event_bars(spark: SparkSession, sf_dir: str, every: str = "4 hours", by_type: bool = True) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "event_type", "value")
    return aggregate_bars(events, every, F.col("event_type") if by_type else F.lit("all"), "ts", "value", "event_id")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars over order prices, ties of a day ordered by key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_orderkey", "o_totalprice")
    return aggregate_bars(orders, "1 day", F.lit("orders"), "o_orderdate", "o_totalprice", "o_orderkey")
