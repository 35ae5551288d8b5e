"""MinHash near-duplicate documents by fast similarity sketching.

A document's set is its distinct 5-word shingles (A-Z lower-cased; fewer words: the whole sequence as one shingle; no words
or null text: the empty set, linked with nothing). The sketch has ``BINS`` coordinates filled by rounds: in round i every
shingle is thrown into one random bin (rounds below ``BINS``) or into bin i - ``BINS`` (later rounds), and a bin
keeps its smallest (round, hash). Rounds stop once all bins are filled, after 2 * ``BINS`` at the latest, so every coordinate is
filled, coordinates of two sets agree with probability J, and the share that agrees is concentrated as for
independent MinHash values.

Bands and the agreement bound follow from the least similarity of a link (``banding``): at 0.85 there are 48 bands of 8
coordinates, at 0.8 there are 50 of 6, and a pair at that similarity shares none with probability < 3e-7. One bit a coordinate
forms a 2048-bit sketch; its agreement bound lies five standard deviations below what a pair of that similarity shows.
Links are confirmed on the full sets of shingle hashes, made once for each class in an open bucket. Exact copies of a set are one
class (128-bit fingerprint; named by its first half among the candidates) and never multiply pairs.

Results do not depend on row order. Repeated rows of a doc_id are judged alike; rows of one doc_id with other texts by their own text each.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import fitted, materialize, scratch, small
from barloom.llm.linkage import all_equal_bits, equal_bits, link
from barloom.llm.textvec import U64, Words, distinct, mix, shingles, slices

BINS = 2048
SKETCH_WORDS = BINS // 64
#: Bands tried first; groups of near copies come together in these.
FIRST_BANDS = 6
#: A pair at the least similarity shares no band with at most this probability.
MISSED = 3e-7
#: Least similarity of a link, in per cent.
SIMILARITY = 85
_FULL = U64(2**64 - 1)


def banding(similarity: int) -> tuple[int, int]:
    """(rows, bands) for links of ``similarity`` per cent or more."""
    s = similarity / 100
    if not 50 <= similarity <= 95:  # beyond, the bands may need more coordinates than there are
        raise ValueError("similarity must be from 50 to 95 per cent")
    rows = round(log(0.85**8) / log(s))  # a band is shared about as often as at 0.85
    return rows, ceil(log(MISSED) / log(1 - s**rows))


def agreement(a: str, b: str, similarity: int) -> str:
    """SQL: whether the sketches of two structs agree in as many bits as a pair of ``similarity`` must, first in a quarter of them. A pair of 85 agrees in
    1894 of 2048 bits on average, with a standard deviation of 12; the bounds lie five of these below."""
    p = (1 + similarity / 100) / 2
    least = {w: int(64 * w * p - 5 * sqrt(64 * w * p * (1 - p))) for w in (SKETCH_WORDS // 4, SKETCH_WORDS)}
    quarter, whole = least
    a, b = f"{a}.sketch", f"{b}.sketch"
    return f"{equal_bits(a, b, quarter)} >= {least[quarter]} and {all_equal_bits(a, b, whole)} >= {least[whole]}"


def sketch(hashes: np.ndarray, doc: np.ndarray, n_docs: int, bins: int = BINS) -> np.ndarray:
    """(n_docs x bins) fast similarity sketches of distinct ``hashes`` by ``doc``; a text without any keeps all ones."""
    out = np.full((n_docs, bins), _FULL, U64)
    flat = out.reshape(-1)
    shift, round_shift = U64(64 - bins.bit_length() + 1), U64(64 - (2 * bins - 1).bit_length())  # all rounds fit above the hash
    for i in range(2 * bins):
        if not len(hashes):
            break
        x = mix(hashes + U64((i + 1) * 0x9E3779B97F4A7C15 % 2**64))
        low = (x & ((U64(1) << round_shift) - U64(1))) | (U64(i) << round_shift)
        at = doc * bins + ((x >> shift).astype(np.int64) if i < bins else i - bins)
        np.minimum.at(flat, at, low)
        if i % 16 == 15 or i < 16 and i % 3 == 2:  # later rounds never change a full sketch, so it may be looked at seldom
            left = np.unique(doc)
            open_ = np.zeros(n_docs, bool)
            open_[left] = (out[left] == _FULL).any(axis=1)
            open_ = open_[doc]
            hashes, doc = hashes[open_], doc[open_]
    return out


def _prints(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Two 64-bit fingerprints of every set, whatever its order."""
    out = np.zeros((2, n_docs), U64)
    size = np.bincount(doc, minlength=n_docs)
    some = np.flatnonzero(size)
    if len(some):
        begin = np.concatenate([[0], np.cumsum(size)])[:-1][some]
        out[0, some] = np.add.reduceat(mix(h ^ U64(0xA5A5)), begin)
        out[1, some] = np.add.reduceat(mix(h ^ U64(0x5A5A5A)), begin)
    return out


def _signatures(batches: Iterator[pa.RecordBatch], rows: int, bands: int) -> Iterator[pa.RecordBatch]:
    salt = mix(np.arange(1, bands + 1, dtype=U64))
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(1), most=512):
            n_docs = end - first
            h, doc = distinct(*shingles(Words(data, offsets))[:2])
            size = np.bincount(doc, minlength=n_docs)
            prints = _prints(h, doc, n_docs)
            full = sketch(h, doc, n_docs)
            bits = np.packbits((mix(full) >> U64(17) & U64(1)).astype(np.uint8), axis=1).view(np.int64)
            acc = np.broadcast_to(salt, (n_docs, bands)).copy()
            for k in range(rows):
                acc = mix(acc * U64(0xD6E8FEB86659FD93) + full[:, k : rows * bands : rows])
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[first:end], batch.column(2)[first:end], pa.array(size.astype(np.int64)), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), lists(bits), lists(acc.view(np.int64))],
                ["id", "text_hash", "size", "p", "q", "sketch", "bands"],
            )


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in slices(batch.column(0), most=512):
            h, doc = distinct(*shingles(Words(data, offsets))[:2])
            edges = np.searchsorted(doc, np.arange(end - first + 1)).astype(np.int32)
            own = pa.ListArray.from_arrays(pa.array(edges), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(_prints(h, doc, end - first)[0].view(np.int64)), own], ["id", "content"])


def judge(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """As ``near_duplicates``, with text_hash, which tells rows of one doc_id with other texts apart."""
    rows, bands = banding(similarity)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    signed = texts.mapInArrow(partial(_signatures, rows=rows, bands=bands), "id long, text_hash long, size long, p long, q long, sketch array<long>, bands array<long>")
    with scratch(docs.sparkSession) as tables:
        signed = materialize(signed, "signatures")
        classes = materialize(signed.where("size > 0 and id is not null").groupBy("p", "q").agg(F.min("id").alias("rep")), "classes", signed.n_rows)
        # a class stands for itself by the row of its smallest doc_id, and is named by p
        items = signed.where("size > 0").join(classes.select("p", "q", F.col("rep").alias("id")), ["p", "q", "id"]).select(F.col("p").alias("id"), "size", "sketch", "bands")
        items = materialize(items.withColumn("bands", F.array(F.slice("bands", 1, FIRST_BANDS), F.slice("bands", FIRST_BANDS + 1, bands))), "items", signed.n_rows)

        def contents(ids: DataFrame) -> DataFrame:
            reps = materialize(classes.select(F.col("p").alias("id"), F.col("rep").alias("doc_id")).join(small(ids), "id"), "reps")
            needed = texts.join(small(reps.select("doc_id"), reps.n_rows), "doc_id", "left_semi").select("text")
            return needed.mapInArrow(_set_batches, "id long, content array<long>").join(small(ids), "id", "left_semi").dropDuplicates(["id"])

        def similar(x: Column, y: Column) -> Column:
            both = F.size(F.array_intersect(x, y))
            return (both > 0) & (100 * both >= similarity * (F.size(x) + F.size(y) - both))

        comps = link(items, contents, similar, similarity / 100, lambda a, b: agreement(a, b, similarity), [n * items.n_rows for n in (FIRST_BANDS, bands - FIRST_BANDS)])
        of_class = fitted(classes).join(small(comps.withColumnRenamed("id", "p"), comps.n_rows), "p")
        least = of_class.groupBy("comp").agg(F.min("rep").alias("component_id"))
        of_class = materialize(of_class.join(least, "comp").select("p", "q", "component_id"), "of_class", classes.n_rows)
        copies = fitted(classes).join(small(of_class), ["p", "q"], "left").select("p", "q", F.coalesce("component_id", "rep").alias("component_id"))
        out = (
            signed.select("id", "text_hash", "size", "p", "q")
            .join(copies, ["p", "q"], "left")
            .select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"), "text_hash")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        )
        return tables.keep(materialize(out, "judged", signed.n_rows))


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text).

    Two documents link if 100 * intersection >= ``similarity`` * union of their sets; component_id is the smallest doc_id
    reachable; kept marks that one. A null doc_id has no component of its own: it is kept, and names the component its text belongs to.
    """
    return judge(docs, similarity).select("doc_id", "n_shingles", "component_id", "kept")
