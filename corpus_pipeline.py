"""The corpus pipeline: language ID, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of ``documents``; the last
one returns a row of token counts and digests per document. Every stage works on all its predecessor kept.
A null text has no language and goes at the first stage. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontam, langid, line_dedup, minhash
from barloom.llm.common import DOCUMENT_COLUMNS, fresh_path, materialize, small, table
from barloom.llm.queries import vocabulary

#: Documents whose best calibrated language probability is lower are rejected, and those without any letter.
LEAST_LANGUAGE_SCORE = 0.35
#: Per cent of the five-word shingles; op7 itself links from 85 on.
NEAR_SIMILARITY = 80


def own_columns(docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; others could clash with those that an operator adds."""
    return docs.select(*DOCUMENT_COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = own_columns(docs)
    model = langid.fit(docs, F.lit(True))
    scored = langid.predict(docs, model, list(docs.columns))
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return scored.where(kept).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat elsewhere go; a document that keeps no word of its own goes with them, all others stay."""
    out = line_dedup.deduplicate(own_columns(docs))
    out = out.where(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "") != "")
    return own_columns(out.withColumn("n_chars", F.length("text").cast("long")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (similarity 0.8 or more) stays, that of the smallest doc_id; of repeated rows one stays.
    Rows of a null doc_id stay; rows of one doc_id with other texts are judged by their own text each."""
    docs = own_columns(docs)
    judged = minhash.judge(docs, NEAR_SIMILARITY).where(F.col("doc_id").isNotNull())
    gone = judged.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    repeated = materialize(judged.where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash"), "repeated")
    keyed = docs.withColumn("__text_hash", F.xxhash64("text"))
    on = lambda x: (keyed["doc_id"] == x["doc_id"]) & (keyed["__text_hash"] == x["text_hash"])
    gone = small(materialize(gone, "gone"))
    if not repeated.n_rows:
        return keyed.join(gone, on(gone), "left_anti").drop("__text_hash")
    once = keyed.join(small(repeated), on(repeated), "left_semi").dropDuplicates(["doc_id", "__text_hash"])
    rest = keyed.join(small(repeated), on(repeated), "left_anti").join(gone, on(gone), "left_anti")
    return rest.unionByName(once).drop("__text_hash")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, those of a null doc_id, too, if any of them does."""
    docs = own_columns(docs)
    found = small(materialize(decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "found"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["doc_id"]), "left_anti")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs, vocabulary("word_bpe_49k.json"), digest=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", language_id),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", encode),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
