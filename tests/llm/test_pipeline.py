"""The pipeline's stages on awkward rows and on the smallest tables, against plain versions."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from barloom.llm import common
from barloom.llm.queries import vocabulary
from tests.llm import data


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5


def test_stages_keep_columns_and_survive_awkward_rows(spark, sf):
    docs, seen = data.frame(spark), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = common.fresh_path(spark, f"stage{i}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if i < 4:
            assert docs.columns == list(common.DOCUMENT_COLUMNS)
    assert all(b <= a for a, b in zip(seen, seen[1:]))
    assert not seen[0] & {0, 1, 2, 12} and {14, 15, 16} <= seen[-1]
    assert not seen[-1] & {6, 7}  # copies of 5


def test_stages_take_empty_tables(spark, sf):
    docs = data.frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, sf), "stage")
        assert docs.count() == 0


def test_run_on_the_smallest_tables(spark, sf):
    from tokenizers import Tokenizer

    docs = common.table(spark, sf, "documents").select(*common.DOCUMENT_COLUMNS)
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = common.materialize(stage(spark, docs, sf), "stage")
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = set()
    for r in docs.collect():
        ids = tok.encode(r.text, add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
        assert r.n_chars == len(r.text)
    got = corpus_pipeline.run(spark, sf)
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in got.collect()} == want
    whole = common.table(spark, sf, "documents")
    assert 0.6 * whole.count() < len(want) < whole.count()
    bench = [r.text for r in common.table(spark, sf, "benchmark").collect()]
    kept = [x.text for x in docs.collect()]
    assert not any(b in t for b in bench for t in kept)
    assert docs.select(F.countDistinct("text")).first()[0] == len(kept)


def test_near_dedup_takes_pairs_from_four_fifths_on(spark, sf):
    """Pairs of similarity 0.8 to 0.85 lose their second document, pairs below 0.8 stay."""
    texts, want = [], set()
    for n in (8, 9, 12, 20, 40, 90, 300):
        for k in range(8):
            w = [f"w{n}x{k}x{i}" for i in range(n + 4)]
            more = next(m for m in range(1, n) if 100 * n < (80 if k % 2 else 85) * (n + m))
            a, b = " ".join(w), " ".join([*w, *(f"m{i}" for i in range(more))])
            want.add(len(texts))
            if data.jaccard(set(data.shingles(a)), set(data.shingles(b))) < 0.8:
                want.add(len(texts) + 1)
            texts += [a, b]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == want
    assert len(texts) / 2 < len(want) < len(texts)
