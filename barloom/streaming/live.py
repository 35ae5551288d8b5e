"""The live path: ticks to closed bars, and positions kept bar by bar."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barloom.sources.bars import aggregate_bars

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_bars(ticks: DataFrame, every: str = "4 hours", late: str = "0 seconds") -> DataFrame:
    """Bars of a tick stream; in append mode a bar comes out once, when the watermark has passed its end."""
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # watermarks need the zoned type; the session is in UTC
    bars = aggregate_bars(timed, every, F.col("event_type"), "ts", "value", "event_id")
    return bars.withColumn("bar", F.col("bar").cast("timestamp_ntz"))


def run_to_table(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run a stream over all data that is there, and read what it wrote."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


POSITIONS = "symbol string, bar timestamp_ntz, pos int, closed_profit double"


def stream_positions(signals: DataFrame) -> DataFrame:
    """Positions of a stream of (symbol, bar, open, want): closes when the wanted side changes, then opens; one order at a time.

    State per symbol is the side, the paid price and the last bar, so it does not grow; repeated bars are ignored.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        side, paid, last = state.get if state.exists else (0, 0.0, 0)
        rows = []
        for r in pd.concat(list(batches)).sort_values("bar").itertuples():
            at = r.bar.value
            if at <= last:
                continue
            last, profit = at, 0.0
            if side and r.want != side:
                profit, side = side * (r.open - paid), 0
            rows.append((key[0], r.bar, side, profit))
            if side == 0 and r.want:
                side, paid = int(r.want), float(r.open)
        state.update((side, paid, last))
        yield pd.DataFrame(rows, columns=["symbol", "bar", "pos", "closed_profit"])

    return signals.groupBy("symbol").applyInPandasWithState(step, POSITIONS, "side int, paid double, last long", "append", GroupStateTimeout.NoTimeout)
