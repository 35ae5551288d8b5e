"""Market regimes from feature columns: k-means, sliding k-means votes, Gaussian mixtures and hidden Markov models.

A row without a regime gets -1. Global fits run on pyspark.ml; windows and the Markov chain are numpy kernels on one group at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.frames import ordered


def _vectors(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="__x", handleInvalid="skip").transform(df)


def kmeans(df: DataFrame, features: list[str], k: int, seed: int = 1) -> DataFrame:
    """Adds regime: the cluster of each row with all features; centres are ordered by their first coordinate, so ids repeat."""
    model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c").fit(_vectors(df, features))
    order = np.argsort([c[0] for c in model.clusterCenters()], kind="stable")
    rank = F.create_map(*[x for new, old in enumerate(order) for x in (F.lit(int(old)), F.lit(new))])
    found = model.transform(_vectors(df, features)).select("symbol", "bar", F.element_at(rank, F.col("__c")).alias("regime"))
    return df.join(found, ["symbol", "bar"], "left").withColumn("regime", F.coalesce("regime", F.lit(-1)))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of every row in the cheapest one-to-one assignment of a square cost matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.full(n + 1, n)
    for row in range(n):
        match[n] = row
        best, way, used, j = np.full(n + 1, np.inf), np.full(n + 1, n), np.zeros(n + 1, bool), n
        while True:
            used[j] = True
            free = np.flatnonzero(~used[:n])
            slack = cost[match[j], free] - u[match[j]] - v[free]
            closer = slack < best[free]
            best[free[closer]], way[free[closer]] = slack[closer], j
            nxt = free[np.argmin(best[free])]
            step = best[nxt]
            u[match[used]] += step
            v[used] -= step
            best[free] -= step
            j = nxt
            if match[j] == n:
                break
        while j != n:
            match[j], j = match[way[j]], way[j]
    out = np.empty(n, int)
    out[match[:n]] = np.arange(n)
    return out


def lloyd(x: np.ndarray, k: int, seed: int, rounds: int = 25) -> np.ndarray:
    """Centres of k-means from a deterministic spread of starting rows."""
    centres = x[np.random.default_rng(seed).choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        moved = np.array([x[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def kmeans_vote(df: DataFrame, features: list[str], k: int, width: int, step: int, seed: int = 1) -> DataFrame:
    """Adds regime: windows of ``width`` rows every ``step`` rows are clustered by themselves, their clusters are matched to the global ones
    at least total distance, and every row takes the cluster with most votes (of equals the lowest; without a vote -1).
    Each window is a group of its own, so one long series spreads over the cluster."""
    centres = np.array(KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c").fit(_vectors(df, features)).clusterCenters())
    centres = centres[np.argsort(centres[:, 0], kind="stable")]
    whole = df.dropna(subset=features).select("symbol", "bar", *features)
    rows = whole.withColumn("i", F.row_number().over(ordered()) - 1).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    low = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / step)).cast("long")
    high = F.least(F.floor(F.col("i") / step), F.floor((F.col("n") - width) / step)).cast("long")
    spread = rows.where("n >= " + str(width)).where(high >= low).withColumn("win", F.explode(F.sequence(low, high)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("i")[features].to_numpy(float)
        local = lloyd(x, k, seed)
        to = assignment(((local[:, None] - centres[None]) ** 2).sum(axis=2) ** 0.5)
        own = ((x[:, None] - local[None]) ** 2).sum(axis=2).argmin(axis=1)
        return pd.DataFrame({"symbol": pdf["symbol"].to_numpy(), "bar": pdf.sort_values("i")["bar"].to_numpy(), "c": to[own].astype(np.int32)})

    votes = spread.groupBy("symbol", "win").applyInPandas(run, "symbol string, bar timestamp_ntz, c int").groupBy("symbol", "bar", "c").agg(F.count("*").alias("votes"))
    best = votes.groupBy("symbol", "bar").agg(F.max_by("c", F.struct("votes", -F.col("c"))).alias("regime"))
    return df.join(best, ["symbol", "bar"], "left").withColumn("regime", F.coalesce("regime", F.lit(-1)))


def gaussian_mixture(df: DataFrame, features: list[str], k: int, rounds: int = 100, seed: int = 1) -> DataFrame:
    """Adds regime from a full-covariance mixture."""
    model = GaussianMixture(k=k, seed=seed, maxIter=rounds, featuresCol="__x", predictionCol="regime").fit(_vectors(df, features))
    found = model.transform(_vectors(df, features)).select("symbol", "bar", "regime")
    return df.join(found, ["symbol", "bar"], "left").withColumn("regime", F.coalesce("regime", F.lit(-1)))


def viterbi(x: np.ndarray, k: int, rounds: int = 30, seed: int = 1) -> np.ndarray:
    """Most likely states of a diagonal Gaussian hidden Markov model fitted by Baum-Welch; states are ordered by their first mean."""
    x = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    means, spread = lloyd(x, k, seed), np.ones((k, x.shape[1]))
    start, move = np.full(k, 1 / k), np.full((k, k), 0.1 / max(1, k - 1))
    np.fill_diagonal(move, 0.9 if k > 1 else 1.0)

    def densities() -> np.ndarray:
        return -0.5 * (((x[:, None] - means) ** 2 / spread) + np.log(2 * np.pi * spread)).sum(axis=2)

    for _ in range(rounds):
        log = densities()
        b = np.exp(log - log.max(axis=1, keepdims=True))
        alpha, beta, scale = np.empty_like(b), np.empty_like(b), np.empty(len(b))
        for t in range(len(b)):
            a = (start if t == 0 else alpha[t - 1] @ move) * b[t]
            scale[t] = a.sum() + 1e-300
            alpha[t] = a / scale[t]
        beta[-1] = 1
        for t in range(len(b) - 2, -1, -1):
            beta[t] = move @ (b[t + 1] * beta[t + 1]) / scale[t + 1]
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        pairs = move * (alpha[:-1].T @ (b[1:] * beta[1:] / scale[1:, None]))
        start, move = gamma[0], (pairs + 1e-6) / (pairs + 1e-6).sum(axis=1, keepdims=True)
        weight = gamma.sum(axis=0)[:, None] + 1e-9
        means = gamma.T @ x / weight
        spread = np.stack([(gamma[:, j : j + 1] * (x - means[j]) ** 2).sum(axis=0) for j in range(k)]) / weight + 1e-3
    log, score = densities(), np.log(start + 1e-300)
    score = score + log[0]
    back = np.zeros((len(x), k), int)
    for t in range(1, len(x)):
        options = score[:, None] + np.log(move + 1e-300)
        back[t], score = options.argmax(axis=0), options.max(axis=0) + log[t]
    path = np.empty(len(x), int)
    path[-1] = score.argmax()
    for t in range(len(x) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return np.argsort(np.argsort(means[:, 0], kind="stable"), kind="stable")[path]


def markov(df: DataFrame, features: list[str], k: int, rounds: int = 30, seed: int = 1) -> DataFrame:
    """Adds regime: Viterbi states of every series; one group per series, because the chain carries state along it."""
    whole = df.dropna(subset=features).select("symbol", "bar", *features)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar")
        return pd.DataFrame({"symbol": pdf["symbol"], "bar": pdf["bar"], "regime": viterbi(pdf[features].to_numpy(float), k, rounds, seed).astype(np.int32)})

    found = whole.groupBy("symbol").applyInPandas(run, "symbol string, bar timestamp_ntz, regime int")
    return df.join(found, ["symbol", "bar"], "left").withColumn("regime", F.coalesce("regime", F.lit(-1)))


def density(df: DataFrame, features: list[str], least: int) -> DataFrame:
    """Adds regime from hierarchical density clusters; not offered, because it needs all pairs of a group."""
    raise NotImplementedError("density clustering compares all pairs of rows; use kmeans_vote, gaussian_mixture or markov")
