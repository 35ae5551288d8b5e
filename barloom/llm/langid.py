"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features: hashed character 1- to 3-grams of the lower-cased letters (every other character is a space), raw
counts times IDF, scaled to unit length. Document frequencies come from *all* learnable documents. Weights are fitted
by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty (l1 makes them sparse, l2 shrinks them)
on a bounded sample, at most ``per_language`` documents of each language, chosen by hash. A temperature,
fitted on a fifth of the sample kept apart, calibrates the probabilities.

Null text, empty text and text without a letter get ``und`` and score 0. Texts are read whole. With fewer than one learnable
document every text is ``und``. Rows with a null id take part like others. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.textvec import slices

BITS = 14
SIZE = 1 << BITS
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> lower-cased letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


def _counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents x features counts as float32, has a letter) of the texts of a slice."""
    n_docs = len(offsets) - 1
    lead = (data & 0xC0) != 0x80
    doc_of = np.repeat(np.arange(n_docs, dtype=np.int64), _per_doc(lead, offsets))
    cp = _letters()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    letters = np.bincount(doc_of[cp != 32], minlength=n_docs) > 0
    out = np.zeros(n_docs * SIZE, np.int64)
    for size in (1, 2, 3):
        m = len(cp) - size + 1
        if m <= 0:
            continue
        h = np.full(m, 0x9E3779B1 * size & 0xFFFFFFFF, np.uint32)
        some = np.zeros(m, bool)
        for k in range(size):
            h = (h ^ cp[k : k + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            some |= cp[k : k + m] != 32
        some &= doc_of[:m] == doc_of[size - 1 :]
        h = h * np.uint32(0xC2B2AE35)
        out += np.bincount((doc_of[:m] * SIZE + (h >> np.uint32(32 - BITS)))[some], minlength=n_docs * SIZE)
    return out.reshape(n_docs, SIZE).astype(np.float32), letters


def _per_doc(lead: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(lead)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


SLICE = 1 << 18
#: Texts counted at once: their dense counts take MOST * SIZE * 8 bytes.
MOST = 256


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df = np.zeros(SIZE, np.int64)
    for batch in batches:
        for _, _, data, offsets in slices(batch.column(0), SLICE, MOST):
            df += (_counts(data, offsets)[0] > 0).sum(axis=0)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at], pa.int64())], ["feature", "df"])


def _sparse_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(0), SLICE, MOST):
            counts, letters = _counts(data, offsets)
            at = [np.flatnonzero(row).astype(np.int32) for row in counts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, pa.list_(pa.int32())), pa.array([row[i] for row, i in zip(counts, at)], pa.list_(pa.float32())), batch.column(1)[first:end], batch.column(2)[first:end]],
                ["at", "n", "lang", "apart"],
            )


@dataclass
class Model:
    """``weights`` (features x languages) for unit-length TF-IDF rows; probabilities are softmax(logits / temperature)."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        norm = np.sqrt((counts * counts) @ (self.idf * self.idf))[:, None]
        logits = counts @ (self.weights * self.idf[:, None]) / np.maximum(norm, 1e-9) + self.bias
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal with elastic net over sparse rows (features, values); a last, unpenalised feature is the bias."""
    z = np.zeros((n_classes, SIZE + 1))
    n = np.zeros((n_classes, SIZE + 1))
    order = np.random.default_rng(3)
    penalty1, penalty2 = np.full(SIZE + 1, l1), np.full(SIZE + 1, l2)
    penalty1[SIZE] = penalty2[SIZE] = 0

    def solve(i):
        zi = z[:, i]
        return np.where(np.abs(zi) > penalty1[i], -(zi - np.sign(zi) * penalty1[i]) / ((beta + np.sqrt(n[:, i])) / alpha + penalty2[i]), 0.0)

    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x = rows[k]
            w = solve(at)
            p = w @ x
            p = np.exp(p - p.max())
            p /= p.sum()
            p[labels[k]] -= 1
            g = p[:, None] * x[None, :]
            sq = g * g
            z[:, at] += g - (np.sqrt(n[:, at] + sq) - np.sqrt(n[:, at])) / alpha * w
            n[:, at] += sq
    w = solve(np.arange(SIZE + 1))
    return w[:, :SIZE].T.astype(np.float32), w[:, SIZE].astype(np.float32)


def fit(docs: DataFrame, learnable: Column, per_language: int = 600) -> Model | None:
    """Fit on the rows of ``docs`` (text, lang) for which ``learnable`` holds; lang and text must not be null.

    ``per_language`` (on average) times the number of languages bounds the sample; every language is learned.
    """
    known = docs.where(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    total = sum(sizes.values())
    if not total:
        return None
    df = np.zeros(SIZE)
    for r in known.select("text").mapInArrow(_document_frequencies, "feature int, df long").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]  # SIZE rows at most
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    chance = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(min(1.0, per_language / v)))])
    sample = (
        known.where(F.col("lang").isin(list(sizes)) & (chance < F.element_at(rate, F.col("lang"))))
        .select("text", "lang", (F.pmod(F.xxhash64(F.lit("apart"), "doc_id", "text"), F.lit(5)) == 0).alias("apart"))
        .mapInArrow(_sparse_rows, "at array<int>, n array<float>, lang string, apart boolean")
        .toPandas()
    )
    languages = sorted(sizes)
    of = {x: i for i, x in enumerate(languages)}
    rows, labels = [], []
    for at, n in zip(sample["at"], sample["n"]):
        at, x = np.asarray(at, np.int64), np.asarray(n, np.float64)
        x = x * idf[at]
        rows.append((np.append(at, SIZE), np.append(x / max(np.sqrt(x @ x), 1e-9), 1.0)))
    labels = np.array([of[x] for x in sample["lang"]], np.int64)
    apart = sample["apart"].to_numpy(bool)
    order = np.lexsort((labels, [len(r[0]) for r in rows], [r[1][: len(r[1]) - 1].sum() for r in rows])) if rows else []
    own = [i for i in order if not apart[i]] or list(order)
    if not own:
        return None
    weights, bias = ftrl([rows[i] for i in own], labels[own], len(languages))
    held = [i for i in order if apart[i]]
    temperature = 1.0
    if len(held) >= 20:
        logits = np.array([weights[rows[i][0][:-1]].T @ rows[i][1][:-1] + bias for i in held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(10), 60))
        losses = [-np.log(softmax(logits / t)[np.arange(len(held)), labels[held]] + 1e-12).mean() for t in grid]
        temperature = float(grid[int(np.argmin(losses))])
    return Model(languages, idf, weights, bias, temperature)


def predict(docs: DataFrame, model: Model | None, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs``, and lang_pred and score, for every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SIZE x languages floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column(batch.schema.names.index("__text"))
            for first, end, data, offsets in slices(text, SLICE, MOST):
                langs, scores = np.full(end - first, UNDETERMINED, object), np.zeros(end - first)
                if model:
                    counts, letters = _counts(data, offsets)
                    p = model.probabilities(counts)
                    best = p.argmax(axis=1)
                    langs = np.where(letters, np.array(model.languages, object)[best], UNDETERMINED)
                    scores = np.where(letters, p[np.arange(len(best)), best], 0.0)
                part = batch.slice(first, end - first)
                own = [part.column(i) for i, c in enumerate(part.schema.names) if c != "__text"]
                yield pa.RecordBatch.from_arrays([*own, pa.array(langs, pa.string()), pa.array(scores.astype(float), pa.float64())], [*(c for c in part.schema.names if c != "__text"), "lang_pred", "score"])

    narrow = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, lang_pred string, score double")
