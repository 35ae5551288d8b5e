"""Search space, deterministic trial grids and the trial table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.features import STATISTICS
from barloom.operators.significance import draw

#: Ranges of the sampled parameters, (low, high, logarithmic).
RANGES = {
    "main_period": (5, 200, True),
    "meta_period": (5, 45, True),
    "label_markup": (0.2, 6.5, True),
    "label_atr_period": (8, 120, True),
    "label_min_val": (1, 5, True),
    "label_max_val": (5, 20, True),
    "main_threshold": (0.3, 0.7, False),
    "meta_threshold": (0.3, 0.7, False),
}
WHOLE = ("main_period", "meta_period", "label_atr_period", "label_min_val", "label_max_val")


def trials(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """(trial, parameters...): hashed draws over the ranges; the same trial number always gives the same parameters."""
    unit = lambda tag: draw(F.lit(seed), F.col("trial"), F.lit(tag), below=F.lit(1 << 20)) / float(1 << 20)
    cells = [F.col("trial")]
    for name, (low, high, logged) in RANGES.items():
        value = F.exp(F.log(F.lit(float(low))) + unit(name) * (F.log(F.lit(float(high))) - F.log(F.lit(float(low))))) if logged else low + unit(name) * (high - low)
        cells.append((F.round(value).cast("long") if name in WHOLE else F.round(value, 6)).alias(name))
    for role in ("main", "meta"):
        pick = draw(F.lit(seed), F.col("trial"), F.lit(role), below=F.lit(len(STATISTICS))).cast("int")
        cells.append(F.get(F.array(*[F.lit(s) for s in STATISTICS]), pick).alias(f"{role}_statistic"))
    return spark.range(n).select(F.col("id").alias("trial")).select(*cells)


def best(scored: DataFrame, score: str = "score") -> DataFrame:
    """The trial of the highest score, the smallest number of equals."""
    return scored.groupBy().agg(F.max_by(F.struct("*"), F.struct(score, -F.col("trial"))).alias("t")).select("t.*")
