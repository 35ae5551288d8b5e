"""The relational shell around the series: trimming, pruning, splits, guards and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import every, ordered


def select_role(df: DataFrame, role: str) -> DataFrame:
    """Key and the feature columns of one role (main or meta)."""
    return df.select("symbol", "bar", *[c for c in df.columns if c.endswith(f"_{role}_feature")])


def between(df: DataFrame, first: str, last: str) -> DataFrame:
    """Rows of an inclusive time range; reaches the scan as a filter if ``df`` has no window yet."""
    return df.where(F.col("bar").between(F.lit(first).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz")))


def finite(columns: list[str]) -> Column:
    """Whether all columns have a finite value."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return ok


def trim_warm_up(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows from the first to the last one whose columns are all finite; rows between them stay even if they are not."""
    rn = F.row_number().over(ordered())
    marked = df.withColumn("__rn", rn).withColumn("__ok", F.when(finite(columns), F.col("__rn")))
    ends = marked.withColumns({"__a": F.min("__ok").over(every()), "__b": F.max("__ok").over(every())})
    return ends.where(F.col("__rn").between(F.col("__a"), F.col("__b"))).drop("__rn", "__ok", "__a", "__b")


def column_health(df: DataFrame, columns: list[str], least_std: float = 1e-6) -> DataFrame:
    """(column, n_bad, std, unstable) of every column, from one aggregate over the table."""
    sums = []
    for c in columns:
        sums += [F.count_if(~F.coalesce(finite([c]), F.lit(False))).alias(f"{c}__bad"), F.stddev_samp(F.when(finite([c]), F.col(c))).alias(f"{c}__std")]
    row = df.agg(*sums)
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}__bad").alias("n_bad"), F.col(f"{c}__std").alias("std")) for c in columns])).alias("x")
    return row.select(cells).select("x.*").withColumn("unstable", (F.col("n_bad") > 0) | F.coalesce(F.col("std") < least_std, F.lit(True)))


def drop_unstable(df: DataFrame, columns: list[str], least_std: float = 1e-6) -> DataFrame:
    """``df`` without the columns that are not finite everywhere or nearly constant (one action)."""
    return df.drop(*[r["column"] for r in column_health(df, columns, least_std).where("unstable").collect()])


def modal_step(bars: DataFrame) -> DataFrame:
    """(symbol, step_s): the most frequent distance of neighbouring bars in seconds, the smallest of equals."""
    step = F.unix_timestamp(F.col("bar").cast("timestamp")) - F.unix_timestamp(F.lag("bar").over(ordered()).cast("timestamp"))
    counts = bars.select("symbol", step.alias("step_s")).where("step_s is not null").groupBy("symbol", "step_s").agg(F.count("*").alias("n"))
    return counts.groupBy("symbol").agg(F.max_by("step_s", F.struct("n", -F.col("step_s"))).alias("step_s"))


def padded(bars: DataFrame, first: str, rows: int) -> DataFrame:
    """Bars from ``rows`` modal steps before ``first`` on: context for the longest window."""
    steps = modal_step(bars)
    start = F.unix_timestamp(F.lit(first).cast("timestamp")) - rows * F.col("step_s")
    return bars.join(F.broadcast(steps) if steps.count() <= 100_000 else steps, "symbol").where(F.unix_timestamp(F.col("bar").cast("timestamp")) >= start).drop("step_s")


def split(bar: Column, train: tuple[str, str], test: tuple[str, str]) -> Column:
    """OOS inside the test range, IS in the rest of the training range, REAL after both, else null."""
    t = lambda x: F.lit(x).cast("timestamp_ntz")
    return F.when(bar.between(t(test[0]), t(test[1])), "OOS").when(bar.between(t(train[0]), t(train[1])), "IS").when(bar > F.greatest(t(train[1]), t(test[1])), "REAL")


def missing(expected: DataFrame, got: DataFrame) -> DataFrame:
    """Bars of ``expected`` that ``got`` lacks."""
    return expected.select("symbol", "bar").join(got.select("symbol", "bar"), ["symbol", "bar"], "left_anti")


def class_balance(labelled: DataFrame) -> DataFrame:
    """(symbol, n0, n1, n2, enough): counts of the labels, and whether both classes have at least ``100``."""
    count = lambda v: F.count_if(F.col("label") == v)
    return labelled.groupBy("symbol").agg(count(0.0).alias("n0"), count(1.0).alias("n1"), count(2.0).alias("n2")).withColumn("enough", (F.col("n0") >= 100) & (F.col("n1") >= 100))


def asof(left: DataFrame, right: DataFrame, left_time: str, right_time: str, value: str, key: str = "symbol") -> DataFrame:
    """``left`` with the latest ``value`` of ``right`` at or before its time: one sort of the union, no range join."""
    from pyspark.sql import Window

    a = left.select("*", F.col(left_time).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[value].dataType).alias("__v"))
    b = right.select(key, F.col(right_time).alias("__t"), F.lit(0).alias("__side"), F.col(value).alias("__v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("__v", ignorenulls=True).over(w)).where("__side = 1").drop("__t", "__side", "__v")
