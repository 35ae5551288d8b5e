"""Window frames over an ordered series, its base columns, and halo chunking for one long series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

SERIES = "symbol"


def ordered(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or (SERIES,))).orderBy("bar")


def trail(p: int, *keys: str) -> WindowSpec:
    """The p rows before the current one."""
    return ordered(*keys).rowsBetween(-p, -1)


def incl(p: int, *keys: str) -> WindowSpec:
    """The p rows that end with the current one."""
    return ordered(*keys).rowsBetween(-(p - 1), 0)


def ahead(first: int, last: int, *keys: str) -> WindowSpec:
    return ordered(*keys).rowsBetween(first, last)


def every(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or (SERIES,)))


def with_base(bars: DataFrame, *keys: str) -> DataFrame:
    """Adds rn (from 0), the log return r (0 where a price is not positive, null on the first row) and the difference d."""
    w = ordered(*keys)
    prev = F.lag("close").over(w)
    r = F.when(prev.isNull(), None).when((F.col("close") > 0) & (prev > 0), F.ln(F.try_divide(F.col("close"), prev))).otherwise(0.0)
    return bars.withColumns({"rn": F.row_number().over(w) - 1, "r": r, "d": F.col("close") - prev})


def chunked(bars: DataFrame, rows: int, before: int, after: int = 0) -> DataFrame:
    """Split every series into chunks of ``rows`` rows with a halo of neighbours, so that finite frames over (symbol, chunk)
    run in parallel within one series. Rows of the halo have own = false and are dropped after the frames are computed.

    Needs the global row number ``rn``, which takes one sort of the series; the copies are (before + after) / rows of the input.
    """
    first, last = F.floor((F.col("rn") - after) / rows), F.floor((F.col("rn") + before) / rows)
    spread = F.sequence(F.greatest(first, F.lit(0)).cast("long"), last.cast("long"))
    return bars.withColumn("chunk", F.explode(spread)).withColumn("own", F.floor(F.col("rn") / rows) == F.col("chunk"))
