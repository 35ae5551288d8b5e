"""Classifiers and the filters that decide which samples they may trust.

Folds and bootstraps are hashes of the row key, so they are repeatable and need no shuffle to assign.
"""

from __future__ import annotations

import math

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chance(seed: int, *keys: str) -> Column:
    """A number in [0, 1) of the row's key."""
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 30)) / float(1 << 30)


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds weight: both classes weigh the same in sum."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    return df.withColumn("weight", F.element_at(F.create_map(*[x for k, v in n.items() for x in (F.lit(float(k)), F.lit(total / (len(n) * v)))]), F.col(label).cast("double")))


def train(df: DataFrame, features: list[str], label: str, trees: int = 20, seed: int = 1) -> PipelineModel | None:
    """Gradient-boosted trees with balanced weights and a fifth of every class for validation; a sample too small for both parts is learned
    without validation, and one without rows gives no model."""
    own = df.dropna(subset=features).withColumn("held", chance(seed, "symbol", "bar", label) < 0.2)
    parts = {r["held"] for r in own.select("held").distinct().collect()}
    if not parts:
        return None
    ready = balanced(own, label).withColumn(label, F.col(label).cast("double"))
    assembler = VectorAssembler(inputCols=features, outputCol="__x")
    model = GBTClassifier(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=trees, maxDepth=4, seed=seed)
    if len(parts) == 2:
        model.setValidationIndicatorCol("held")
    return Pipeline(stages=[assembler, model]).fit(ready)


def linear(df: DataFrame, features: list[str], label: str) -> Column:
    """The positive-class probability of a logistic regression, as an expression over the features. The fitted model itself holds a summary and with
    it the session, which no task can carry once a query of that session was observed."""
    ready = balanced(df.dropna(subset=features), label).withColumn(label, F.col(label).cast("double"))
    fitted = LogisticRegression(featuresCol="__x", labelCol=label, weightCol="weight", maxIter=30, regParam=0.01).fit(VectorAssembler(inputCols=features, outputCol="__x").transform(ready))
    margin = F.lit(float(fitted.intercept))
    for c, w in zip(features, fitted.coefficients):
        margin = margin + F.lit(float(w)) * F.col(c)
    return 1 / (1 + F.exp(-margin))


def score(model: PipelineModel | Column | None, df: DataFrame, features: list[str], out: str = "p") -> DataFrame:
    """Adds the positive-class probability, as a float, null without a model; rows without all features are left out."""
    if model is None:
        model = F.lit(None)
    if isinstance(model, Column):
        return df.dropna(subset=features).select("*", model.cast("float").alias(out))
    scored = model.transform(df.dropna(subset=features))
    p = vector_to_array(F.col("probability"))[1].cast("float").alias(out)
    return scored.select(*df.columns, p)


def stored(model: PipelineModel | None, path: str) -> PipelineModel | None:
    """``model`` as read back from ``path``, where it is written (an earlier one there is replaced)."""
    if model is None:
        return None
    model.write().overwrite().save(path)
    return PipelineModel.load(path)


def inner_folds(rows: int, folds: int, confidence: float) -> int:
    """Folds such that each is larger than a conformal quantile needs; 0 if two are too many already."""
    need = math.ceil(max(1 / confidence, 1 / (1 - confidence)) + 1)
    while folds >= 2 and rows // folds <= need:
        folds -= 1
    return folds if folds >= 2 else 0


def conformal_mask(df: DataFrame, features: list[str], label: str, folds: int = 3, confidence: float = 0.9, least_rows: int = 100) -> DataFrame:
    """(symbol, bar, keep): rows whose conformal prediction set is one label, and the right one.

    Folds follow time; each fold is judged by a model of the rows before it, and the nonconformity quantile comes from
    rows that this model has not seen. Rows of the first fold, and all rows of small or one-sided samples, are 0.
    """
    whole = df.where(F.col(label).isin(0.0, 1.0)).dropna(subset=features)
    keys = whole.select("symbol", "bar")
    cuts = whole.agg(F.count("*").alias("n"), F.countDistinct(label).alias("k"), F.percentile(F.unix_timestamp(F.col("bar").cast("timestamp")), F.array(*[F.lit(i / (folds + 1)) for i in range(1, folds + 1)])).alias("cuts")).first()
    if cuts["n"] < least_rows or cuts["k"] < 2:
        return keys.withColumn("keep", F.lit(0))
    stamped = whole.withColumn("__t", F.unix_timestamp(F.col("bar").cast("timestamp")))
    kept, edges = None, [*cuts["cuts"], float("inf")]
    for low, high in zip(edges[:-1], edges[1:]):
        past, test = stamped.where(F.col("__t") <= low), stamped.where((F.col("__t") > low) & (F.col("__t") <= high))
        held = chance(7, "symbol", "bar") < 0.3
        if past.where(~held).select(label).distinct().count() < 2:
            continue
        model = linear(past.where(~held), features, label)
        calibration = score(model, past.where(held), features).select(F.when(F.col(label) == 1, 1 - F.col("p")).otherwise(F.col("p")).alias("s"))
        q = calibration.agg(F.percentile("s", confidence).alias("q")).first()["q"]
        if q is None:
            continue
        judged = score(model, test, features).withColumn("one", F.col("p") >= 1 - q).withColumn("zero", F.col("p") <= q)
        right = F.when(F.col("one") & ~F.col("zero"), F.col(label) == 1).when(F.col("zero") & ~F.col("one"), F.col(label) == 0).otherwise(False)
        part = judged.select("symbol", "bar", right.cast("int").alias("keep"))
        kept = part if kept is None else kept.union(part)
    return keys.withColumn("keep", F.lit(0)) if kept is None else keys.join(kept, ["symbol", "bar"], "left").withColumn("keep", F.coalesce("keep", F.lit(0)))


def oob_mask(df: DataFrame, features: list[str], label: str, learners: int = 5, fraction: float = 0.5, percentile: float = 0.8, seed: int = 1) -> DataFrame:
    """(symbol, bar, keep): 0 for rows that models trained without them get wrong more often than the given percentile of their class."""
    whole = df.where(F.col(label).isin(0.0, 1.0)).dropna(subset=features)
    errors = None
    for k in range(learners):
        bag = chance(seed + 100 + k, "symbol", "bar") < fraction
        if whole.where(bag).select(label).distinct().count() < 2:
            continue
        out = score(linear(whole.where(bag), features, label), whole.where(~bag), features)
        part = out.select("symbol", "bar", label, ((F.col("p") >= 0.5).cast("double") != F.col(label)).cast("int").alias("wrong"))
        errors = part if errors is None else errors.union(part)
    if errors is None:
        return whole.select("symbol", "bar").withColumn("keep", F.lit(1))
    rates = errors.groupBy("symbol", "bar", label).agg(F.avg("wrong").alias("rate"))
    limits = rates.groupBy(label).agg(F.percentile("rate", percentile).alias("limit"))
    judged = rates.join(F.broadcast(limits), label).select("symbol", "bar", (F.col("rate") <= F.col("limit")).cast("int").alias("keep"))  # two rows
    return whole.select("symbol", "bar").join(judged, ["symbol", "bar"], "left").withColumn("keep", F.coalesce("keep", F.lit(1)))
