"""Forward-looking labels. Direction both: 0 buy, 1 sell, 2 none; one direction: 1 success, 0 failure, 2 none.

Every labeler takes a frame with close, atr, rn, n and fwd (the median of the coming bars) and returns a column; rows without a whole
future are 2. m is markup * atr.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import ordered, trail
from barloom.functions.smooth import atr, forward_median, with_size

DIRECTIONS = ("both", "buy", "sell")


def prepared(bars: DataFrame, first: int = 1, last: int = 5, atr_period: int = 14) -> DataFrame:
    """``bars`` with atr, rn, n and fwd: what every labeler reads."""
    if not 0 <= first <= last:
        raise ValueError("the horizon must not be empty")
    return with_size(atr(bars, atr_period)).withColumn("fwd", forward_median(first, last))


def _check(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")


def _whole(label: Column, horizon: int) -> Column:
    return F.when(F.col("rn") < F.col("n") - horizon, label).otherwise(2.0)


def up(markup: float, strict: bool = False) -> Column:
    target = F.col("close") + markup * F.col("atr")
    return F.col("fwd") > target if strict else F.col("fwd") >= target


def down(markup: float, strict: bool = False) -> Column:
    target = F.col("close") - markup * F.col("atr")
    return F.col("fwd") < target if strict else F.col("fwd") <= target


def zones(buy: Column, sell: Column, gain: Column, fall: Column, direction: str) -> Column:
    """Zone rule: in a zone, success is profit in its direction; outside 2. ``both`` reports only successes, selling first."""
    _check(direction)
    if direction == "both":
        return F.when(sell & fall, 1.0).when(buy & gain, 0.0).otherwise(2.0)
    zone, good = (buy, gain) if direction == "buy" else (sell, fall)
    return F.when(zone & good, 1.0).when(zone, 0.0).otherwise(2.0)


def random(markup: float = 0.5, last: int = 5, direction: str = "both") -> Column:
    _check(direction)
    rise, fall = up(markup, True), down(markup, True)
    first, second = (fall, rise) if direction == "sell" else (rise, fall)
    one, zero = (0.0, 1.0) if direction == "both" else (1.0, 0.0)
    return _whole(F.when(first, one).when(second, zero).otherwise(2.0), last)


def deviation(level: Column, low: Column, high: Column, markup: float, last: int, direction: str = "both") -> Column:
    """Reversion zones: a level above ``high`` sells, below ``low`` buys (filter and mean-reversion labels)."""
    gain = F.col("fwd") - markup * F.col("atr") > F.col("close")
    fall = F.col("fwd") + markup * F.col("atr") < F.col("close")
    return _whole(zones(level < low, level > high, gain, fall, direction), last)


def consensus(levels: list[tuple[Column, Column, Column]], markup: float, last: int, direction: str = "both") -> Column:
    """All of (level, low, high) in one zone; reads one bar more than the others."""
    buy = reduce(lambda a, b: a & b, [x < low for x, low, _ in levels])
    sell = reduce(lambda a, b: a & b, [x > high for x, _, high in levels])
    return _whole(zones(buy, sell, up(markup), down(markup), direction), last - 1)


def trend(strength: Column, threshold: float, markup: float, last: int, direction: str = "both") -> Column:
    return _whole(zones(strength > threshold, strength < -threshold, up(markup), down(markup), direction), last)


def trend_multi(strengths: list[Column], threshold: float, markup: float, last: int, direction: str = "both") -> Column:
    """A signal counts only with its profit; signals of both sides cancel."""
    _check(direction)
    some = lambda hits: F.greatest(*[F.when(h, 1).otherwise(0) for h in hits], F.lit(0)) > 0
    buy, sell = some([(s > threshold) & up(markup) for s in strengths]), some([(s < -threshold) & down(markup) for s in strengths])
    only_buy, only_sell = buy & ~sell, sell & ~buy
    if direction == "buy":
        only_buy, only_sell = only_sell, only_buy
    return _whole(F.when(only_buy, 0.0).when(only_sell, 1.0).otherwise(2.0), last)


def multi_window(windows: list[int], markup: float, last: int, direction: str = "both") -> Column:
    """Breakouts over several look-back windows, by majority."""
    m = markup * F.col("atr")
    count = lambda hits: sum((F.when(h, 1).otherwise(0) for h in hits), F.lit(0))
    longs = count([F.col("close") > F.max("close").over(trail(w)) + m for w in windows])
    shorts = count([F.col("close") < F.min("close").over(trail(w)) - m for w in windows])
    buy, sell = (longs > shorts, shorts > longs) if direction == "both" else (longs > 0, shorts > 0)
    label = zones(buy, sell, up(markup), down(markup), direction)
    return F.when(F.col("rn") >= max(windows), _whole(label, last)).otherwise(2.0)


def zigzag(peak: Column, trough: Column, markup: float, last: int, direction: str = "both") -> Column:
    """Labels at profitable extremes, carried between them while the profit still holds."""
    _check(direction)
    fall, rise = down(markup), up(markup)
    if direction == "both":
        event = F.when(peak & fall, 1).when(trough & rise, 0)
        here = F.when((F.col("last_event") == 1) & fall, 1.0).when((F.col("last_event") == 0) & rise, 0.0)
        fixed = F.when(peak & fall, 1.0).when(trough & rise, 0.0)
    elif direction == "buy":
        event = F.when(trough, F.when(rise, 0).otherwise(-1))
        here, fixed = F.when((F.col("last_event") == 0) & rise, 1.0), F.when(trough, F.when(rise, 1.0).otherwise(0.0))
    else:
        event = F.when(peak, F.when(fall, 1).otherwise(-1))
        here, fixed = F.when((F.col("last_event") == 1) & fall, 1.0), F.when(peak, F.when(fall, 1.0).otherwise(0.0))
    whole = F.when(F.col("rn") < F.col("n") - last, event)
    return whole, F.coalesce(fixed, here)


def label_zigzag(df: DataFrame, markup: float, last: int, direction: str = "both") -> DataFrame:
    """``df`` (with boolean peak and trough) and its zigzag label; two window steps, because the state reads the events."""
    event, value = zigzag(F.coalesce("peak", F.lit(False)), F.coalesce("trough", F.lit(False)), markup, last, direction)
    states = ordered().rowsBetween(Window.unboundedPreceding, 0)
    with_state = df.withColumn("event", event).withColumn("last_event", F.last("event", ignorenulls=True).over(states))
    return with_state.withColumn("label", _whole(F.coalesce(value, F.lit(2.0)), last)).drop("event", "last_event")


def local_extremes(df: DataFrame) -> DataFrame:
    """Strict local peaks and troughs of close."""
    before, after = F.lag("close").over(ordered()), F.lead("close").over(ordered())
    return df.withColumns({"peak": (F.col("close") > before) & (F.col("close") > after), "trough": (F.col("close") < before) & (F.col("close") < after)})


def first_touch(df: DataFrame, markup: float, first: int, last: int) -> Column:
    """Barrier label: which of close + m (high) and close - m (low) is reached first; both in one bar, or neither, is 2."""
    hi, lo = F.col("close") + markup * F.col("atr"), F.col("close") - markup * F.col("atr")
    w = ordered().rowsBetween(first, last)
    where = lambda x, test: F.array_position(F.transform(F.collect_list(x).over(w), test), True)
    a, b = where("high", lambda v: v >= hi), where("low", lambda v: v <= lo)
    far = F.lit(1 << 30)
    a, b = F.when(a > 0, a).otherwise(far), F.when(b > 0, b).otherwise(far)
    return _whole(F.when(a < b, 0.0).when(b < a, 1.0).otherwise(2.0), last)
