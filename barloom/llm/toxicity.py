"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (A-Z lower-cased, closing marks dropped) are hashed, and so are their prefixes of 4, 5 and 6 bytes, for words that vary by
endings; a word's embedding is the sum of these four. Filters of widths 1, 2 and 3
run over the whole text, each is max-pooled, and a logistic layer reads the pooled values. One coordinate of each
embedding starts at its smoothed log-odds in the labelled documents, the rest near zero; words and prefixes that these
do not hold stay at zero. Training (Adam, class-balanced log loss) goes over all labelled documents but those kept apart: in each of
``ROUNDS`` rounds every task trains a copy on its rows, and the copies are averaged, each parameter over the tasks that touched it.

Thresholds are calibrated by language on the third of the labelled documents kept apart, counted by logits to 1 / ``LOGIT_STEPS``. The language
is guessed from the text itself (naive Bayes over the same hashed words), so labels, lang, source and doc_id never enter a score. The
threshold of a language is mapped to 0.5 by a shift of the logit; rare languages use the common one.

Null and empty texts get the score of a text without words. Texts are read whole. Without labels every score is 0.
Repeated rows score alike; of repeated labels of a document the smallest counts, null ones never.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize, scratch, small
from barloom.llm.textvec import U64, Words, slices

BITS = 15
PREFIXES = (4, 5, 6)
PARTS = 1 + len(PREFIXES)
#: One table for the words and one for each prefix length; row 0 is padding.
BUCKETS = PARTS << BITS
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 6
#: Passes over the labelled documents, and documents a step.
ROUNDS, STEP_ROWS = 2, 32
RATE = 0.02
LOGIT_STEPS = 1024


def _word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words x PARTS rows of the embedding table, words by text) of a slice."""
    w = Words(data, offsets)
    ends = w.stripped_ends()
    out = np.zeros((len(ends), PARTS), np.int64)
    for k, cut in enumerate((ends, *(np.minimum(ends, w.starts + n) for n in PREFIXES))):
        out[:, k] = (w.span_hashes(cut) >> U64(64 - BITS)).astype(np.int64) + (k << BITS) + 1
    return out, w.per_doc


def _windows(ids: np.ndarray, per_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` with two paddings after every text, and the place of each text's first word."""
    begin = np.concatenate([[0], np.cumsum(per_doc + 2)])
    out = np.zeros((begin[-1], PARTS), np.int64)
    place = np.arange(len(ids)) + 2 * np.repeat(np.arange(len(per_doc)), per_doc)
    out[place] = ids
    return out, begin


@dataclass
class Network:
    embeddings: np.ndarray  # (BUCKETS + 1) x DIM
    filters: list[np.ndarray]  # width x DIM x FILTERS
    bias: list[np.ndarray]
    top: np.ndarray
    top_bias: float
    languages: list[str]
    language_odds: np.ndarray  # (BUCKETS + 1) x languages, of whole words
    shift: np.ndarray  # by language

    def pooled(self, ids: np.ndarray, begin: np.ndarray, where: bool = False):
        """Largest response of every filter in every text (and where it is)."""
        e = self.embeddings[ids[:, 0]]
        for k in range(1, PARTS):
            e += self.embeddings[ids[:, k]]
        n = len(begin) - 1
        tops, places = [], []
        for w, b in zip(self.filters, self.bias):
            width = len(w)
            out = np.zeros((len(ids), FILTERS), np.float32)
            for k in range(width):
                out[: len(ids) - k] += e[k:] @ w[k]
            out += b
            best = np.maximum.reduceat(out, begin[:-1], axis=0)
            tops.append(best)
            if where:
                at = np.zeros((n, FILTERS), np.int64)
                for d in range(n):
                    at[d] = begin[d] + out[begin[d] : begin[d + 1]].argmax(axis=0)
                places.append(at)
        return np.maximum(np.concatenate(tops, axis=1), 0), places

    def logits(self, ids: np.ndarray, per_doc: np.ndarray, shifted: bool = True) -> np.ndarray:
        padded, begin = _windows(ids, per_doc)
        z = self.pooled(padded, begin)[0] @ self.top + self.top_bias
        return z - self.shift[self.language(ids, per_doc)] if shifted else z

    def language(self, ids: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, self.language_odds.shape[1])), np.cumsum(self.language_odds[ids[:, 0]], axis=0)])
        ends = np.cumsum(per_doc)
        return (sums[ends] - sums[ends - per_doc]).argmax(axis=1)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(word ids, words by text, rows) of runs of whole rows (text, toxic, lang, apart)."""
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(0)):
            yield *_word_ids(data, offsets), batch.slice(first, end - first)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, lang, row, n): documents by class that hold an embedding row (kind 0 and 1) and words by language (2), of rows not apart; documents
    by class, those apart two later (3)."""
    seen, words, rows = np.zeros((2, BUCKETS + 1), np.int64), {}, np.zeros(4, np.int64)
    for ids, per_doc, part in _features(batches):
        toxic, apart = np.asarray(part.column(1)).astype(np.int64), part.column(3).to_numpy(zero_copy_only=False)
        rows += np.bincount(toxic + 2 * apart, minlength=4)
        doc = np.repeat(np.arange(len(per_doc)), per_doc)
        own = ~apart[doc]
        held = np.unique((doc[own][:, None] * (BUCKETS + 1) + ids[own]).reshape(-1))
        for y in (0, 1):
            seen[y] += np.bincount(held[toxic[held // (BUCKETS + 1)] == y] % (BUCKETS + 1), minlength=BUCKETS + 1)
        langs = np.array(part.column(2).to_pylist(), object)
        for lang in {x for x in langs[~apart] if x is not None}:
            counts = words.setdefault(lang, np.zeros((1 << BITS) + 1, np.int64))
            counts += np.bincount(ids[own & (langs == lang)[doc], 0], minlength=len(counts))
    for kind, lang, n in [(0, None, seen[0]), (1, None, seen[1]), *((2, k, v) for k, v in words.items()), (3, None, rows)]:
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["kind", "lang", "row", "n"])


def start(seen: np.ndarray, n0: int, n1: int, names: list[str], words: np.ndarray) -> Network:
    """The network before training; ``seen``: documents by class and embedding row, ``words``: by embedding row and language."""
    rng = np.random.default_rng(11)
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    known = seen.sum(axis=0) > 0
    emb = np.where(known[:, None], rng.normal(0, 0.05, (BUCKETS + 1, DIM)), 0).astype(np.float32)
    worth = np.where(known, np.clip(odds, -3, 3) * np.minimum(1, seen.sum(axis=0) / 8), 0)
    for k in range(PARTS):
        own_rows = slice((k << BITS) + 1, ((k + 1) << BITS) + 1)
        emb[own_rows, k] = worth[own_rows]
    emb[0] = 0
    filters = [rng.normal(0, 0.1, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[0, :PARTS] += np.linspace(0.1, 0.6, FILTERS)
    counts = np.full((BUCKETS + 1, len(names)), 0.1)
    counts[: len(words)] += words
    language_odds = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    language_odds[0] = 0
    return Network(emb, filters, [np.zeros(FILTERS, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS), 0.3, np.float32), -1.0, names, language_odds, np.zeros(len(names)))


class Trainer:
    """Adam on a copy of ``net``; ``known``: the embedding rows that may change, ``n0`` and ``n1``: rows of the classes in all."""

    def __init__(self, net: Network, known: np.ndarray, n0: int, n1: int):
        self.net = net = replace(net, embeddings=net.embeddings.copy(), filters=[f.copy() for f in net.filters], bias=[b.copy() for b in net.bias], top=net.top.copy())
        self.known, self.n0, self.n1 = known, n0, n1
        self.slots = [net.embeddings, *net.filters, *net.bias, net.top]
        self.first, self.second = [np.zeros_like(s) for s in self.slots], [np.zeros_like(s) for s in self.slots]
        self.b1 = self.b2 = 0.0
        self.steps = self.rows = 0
        self.touched = np.zeros(BUCKETS + 1, bool)

    def step(self, ids: np.ndarray, per_doc: np.ndarray, y: np.ndarray) -> None:
        net, n = self.net, len(y)
        self.steps, self.rows = self.steps + 1, self.rows + n
        ids, begin = _windows(ids, per_doc)
        h, places = net.pooled(ids, begin, True)
        p = 1 / (1 + np.exp(-(h @ net.top + net.top_bias)))
        g = ((p - y) * np.where(y == 1, 0.5 / self.n1, 0.5 / self.n0) * (self.n0 + self.n1) / n).astype(np.float32)
        grads = [np.zeros_like(s) for s in self.slots[1:]]
        grads[-1] = h.T @ g + 1e-3 * net.top
        gh = (g[:, None] * net.top) * (h > 0)
        touched, values = [], []
        for j, (w, at) in enumerate(zip(net.filters, places)):
            gj = gh[:, j * FILTERS : (j + 1) * FILTERS]
            grads[len(WIDTHS) + j] = gj.sum(axis=0)
            for t in range(len(w)):
                pos = np.minimum(at + t, len(ids) - 1)
                real = (at + t < len(ids))[..., None]
                e = net.embeddings[ids[pos]].sum(axis=2) * real
                grads[j][t] = np.einsum("dfk,df->kf", e, gj) + 1e-4 * w[t]
                touched.append(np.where(real, ids[pos], 0).reshape(-1))
                values.append(np.repeat((gj[..., None] * w[t].T[None]).reshape(-1, DIM), PARTS, axis=0))
        rows, into = np.unique(np.concatenate(touched), return_inverse=True)
        ge = np.zeros((len(rows), DIM), np.float32)
        np.add.at(ge, into, np.concatenate(values))
        ge *= self.known[rows][:, None]
        self.touched[rows] = True
        scale = RATE * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for s, m, v, gr in zip(self.slots[1:], self.first[1:], self.second[1:], grads):
            m += 0.1 * (gr - m)
            v += 0.001 * (gr * gr - v)
            s -= scale * m / (np.sqrt(v) + 1e-8)
        m, v = self.first[0], self.second[0]
        m[rows] += 0.1 * (ge - m[rows])
        v[rows] += 0.001 * (ge * ge - v[rows])
        net.embeddings[rows] -= 0.5 * scale * m[rows] / (np.sqrt(v[rows]) + 1e-8)
        net.embeddings[0] = 0
        gb = float(g.sum())
        self.b1 += 0.1 * (gb - self.b1)
        self.b2 += 0.001 * (gb * gb - self.b2)
        net.top_bias -= scale * self.b1 / (np.sqrt(self.b2) + 1e-8)


def _flat(net: Network) -> np.ndarray:
    """All parameters as rows of ``DIM``: the embeddings, then the others, padded."""
    rest = np.concatenate([*(x.reshape(-1) for x in (*net.filters, *net.bias, net.top)), [net.top_bias]]).astype(np.float64)
    return np.concatenate([net.embeddings.astype(np.float64), np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])


def _unflat(net: Network, flat: np.ndarray) -> Network:
    rest, parts, at = flat[BUCKETS + 1 :].reshape(-1), [], 0
    for x in (*net.filters, *net.bias, net.top):
        parts.append(rest[at : at + x.size].reshape(x.shape).astype(np.float32))
        at += x.size
    w = len(WIDTHS)
    return replace(net, embeddings=flat[: BUCKETS + 1].astype(np.float32), filters=parts[:w], bias=parts[w : 2 * w], top=parts[-1], top_bias=float(rest[at]))


def train(rows: DataFrame, net: Network, known: np.ndarray, n0: int, n1: int) -> Network:
    """One round over ``rows`` (text, toxic, lang, apart): what the tasks change, averaged by their rows."""
    shared = rows.sparkSession.sparkContext.broadcast((net, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, known = shared.value
        own = Trainer(net, known, n0, n1)
        for ids, per_doc, part in _features(batches):
            y, ends = np.asarray(part.column(1)).astype(np.float64), np.concatenate([[0], np.cumsum(per_doc)])
            for k in range(0, len(y), STEP_ROWS):
                end = min(k + STEP_ROWS, len(y))
                own.step(ids[ends[k] : ends[end]], per_doc[k:end], y[k:end])
        if own.rows:
            change = _flat(own.net) - _flat(net)
            at = np.concatenate([np.flatnonzero(own.touched & known), np.arange(BUCKETS + 1, len(change))])
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.full(len(at), float(own.rows))), *(pa.array(change[at, d] * own.rows) for d in range(DIM))], ["row", "n", *(f"d{d}" for d in range(DIM))])

    changes = rows.mapInArrow(run, "row int, n double, " + ", ".join(f"d{d} double" for d in range(DIM)))
    sums = changes.groupBy("row").agg(*[(F.sum(f"d{d}") / F.sum("n")).alias(f"d{d}") for d in range(DIM)]).toPandas()  # as many rows as parameters
    shared.unpersist()
    flat = _flat(net)
    flat[sums["row"].to_numpy()] += sums[[f"d{d}" for d in range(DIM)]].to_numpy()
    return _unflat(net, flat)


def calibrated(rows: DataFrame, net: Network) -> Network:
    """``net`` with the thresholds of the languages, off all of ``rows``."""
    shared = rows.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, per_doc, part in _features(batches):
            z = np.rint(np.clip(shared.value.logits(ids, per_doc, False), -1000, 1000) * LOGIT_STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.language(ids, per_doc).astype(np.int32)), pa.array(z), part.column(1)], ["lang", "z", "toxic"])

    found = rows.mapInArrow(run, "lang int, z int, toxic int").groupBy("lang", "z").agg(F.sum("toxic").alias("y"), F.count("*").alias("n")).toPandas()  # languages x distinct logits
    shared.unpersist()
    of = lambda x: x.groupby("z", as_index=False)[["y", "n"]].sum().sort_values("z")
    threshold = lambda x, default: best_threshold(x["z"].to_numpy() / LOGIT_STEPS, x["y"].to_numpy(np.float64), x["n"].to_numpy(np.float64), default)
    common = threshold(of(found), 0.0)
    shift = np.full(len(net.languages), common)
    for j in range(len(shift)):
        mine = of(found[found["lang"] == j])
        if min(mine["y"].sum(), (mine["n"] - mine["y"]).sum()) >= 20:
            shift[j] = threshold(mine, common)
    return replace(net, shift=shift)


def best_threshold(z: np.ndarray, y: np.ndarray, n: np.ndarray, default: float) -> float:
    """Middle of the widest gap among the thresholds of the highest F1; ``z`` ascending, with ``n`` rows and ``y`` positives each."""
    if not len(z) or not y.any():
        return default
    below = np.cumsum(y) - y  # positives lost if the threshold lies just under z[k]
    kept = n.sum() - (np.cumsum(n) - n)
    f1 = 2 * (y.sum() - below) / (kept + y.sum())
    gap = np.diff(z, prepend=z[0] - 1)
    good = np.flatnonzero(f1 >= f1.max() - 1e-9)
    k = good[np.argmax(gap[good])]
    return float(z[k] - gap[k] / 2)


def fit(docs: DataFrame, labels: DataFrame, learnable: Column) -> Network | None:
    """Fit on all labelled rows for which ``learnable`` (over doc_id) holds."""
    given = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where(learnable & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    with scratch(docs.sparkSession):
        given = materialize(given, "labels")
        joined = docs.where(F.col("text").isNotNull()).select("doc_id", "text", "lang").join(small(given), "doc_id")
        apart = F.pmod(F.xxhash64(F.lit("apart"), "doc_id"), F.lit(3)) == 0
        rows = joined.sortWithinPartitions(F.xxhash64(F.lit("toxicity"), "doc_id"), "text").select("text", "toxic", "lang", apart.alias("apart"))
        rows = materialize(rows, "labelled")
        found = rows.mapInArrow(_counts, "kind int, lang string, row int, n long").groupBy("kind", "lang", "row").agg(F.sum("n").alias("n")).toPandas()
        by_class = np.zeros(4, np.int64)
        seen = np.zeros((2, BUCKETS + 1))
        for kind, into in ((0, seen[0]), (1, seen[1]), (3, by_class)):
            mine = found[found["kind"] == kind]
            into[mine["row"].to_numpy()] = mine["n"].to_numpy()
        if not by_class[1::2].any() or not by_class[::2].any():
            return None
        spoken = found[found["kind"] == 2]
        names = sorted(spoken["lang"].unique()) or [""]
        words = np.zeros(((1 << BITS) + 1, len(names)))
        if len(spoken):
            words[spoken["row"].to_numpy(), np.searchsorted(names, spoken["lang"].to_numpy(str))] = spoken["n"].to_numpy()
        n0, n1 = max(1, int(by_class[0])), max(1, int(by_class[1]))
        net, known = start(seen, n0, n1, names, words), seen.sum(axis=0) > 0
        del found, spoken
        for _ in range(ROUNDS):
            net = train(rows.where("not apart"), net, known, n0, n1)
        return calibrated(rows.where("apart") if by_class[2:].min() >= 8 else rows, net)


def score(docs: DataFrame, net: Network | None, keep: list[str]) -> DataFrame:
    """``keep`` columns, and score and predicted, of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # (BUCKETS + 1) x (DIM + languages) floats

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for batch in batches:
            names = batch.schema.names
            for first, end, data, offsets in slices(batch.column(names.index("__text"))):
                p = np.zeros(end - first)
                if net:
                    p = 1 / (1 + np.exp(-np.clip(net.logits(*_word_ids(data, offsets)).astype(np.float64), -30, 30)))
                part = batch.slice(first, end - first)
                own = [c for c in names if c != "__text"]
                yield pa.RecordBatch.from_arrays([*(part.column(names.index(c)) for c in own), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*own, "score", "predicted"])

    narrow = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    return narrow.mapInArrow(run, f"{schema}, score double, predicted int")
