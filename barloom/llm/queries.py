"""One query per text operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bpe, decontam, langid, licenses, line_dedup, minhash, quality_rules, token_counts, toxicity, warc
from barloom.llm.common import fresh_path, materialize, table


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents enter with a provisional count, are revised to exact ones, and leave if they have no token; one batch is sent twice."""
    import public_tokenizers

    files = {"byte-50k": vocabulary("byte_bpe_50k.tiktoken"), "byte-multi-50k": vocabulary("byte_bpe_multi_50k.tiktoken")}
    counts = materialize(token_counts.count(table(spark, sf_dir, "documents"), files, public_tokenizers.PATTERN), "counts")
    store = token_counts.TokenRollup(spark, fresh_path(spark, "rollup"))
    store.commit("load", token_counts.signed(counts, 1, "words"))
    store.commit("revise", token_counts.revised(counts, "words", "n_tokens"))
    store.commit("revise", token_counts.revised(counts, "words", "n_tokens"))
    store.compact()
    store.commit("withdraw", token_counts.signed(counts.where("n_tokens = 0"), -1))
    return store.totals()


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH base AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, row_number() OVER () AS k FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
t AS (SELECT k, i, ws[i] || chr(0) || ws[i+1] || chr(0) || ws[i+2] AS g FROM (SELECT k, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT k, count(DISTINCT i + o) AS n FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM t), (VALUES (0), (1), (2)) v(o) WHERE c > 1 GROUP BY k),
m AS (SELECT w.k, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN r USING (k)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
v AS (SELECT f.*, rule, CAST(floor(1000 * CASE rule WHEN 'symbols' THEN n_symbols WHEN 'dup_lines' THEN n_dup_lines WHEN 'repeats' THEN n_repeat_words ELSE word_chars END
             / CAST(greatest(CASE rule WHEN 'dup_lines' THEN n_lines ELSE n_words END, 1) AS DOUBLE)) AS BIGINT) AS x, spread, below
      FROM f, (VALUES ('symbols', 60, false), ('dup_lines', 200, false), ('repeats', 130, false), ('word_length', 500, true)) s(rule, spread, below)),
h AS (SELECT lang, source, rule, spread, below, CASE WHEN x > 0 THEN 1 + floor(ln(x) / ln(1.02)) ELSE 0 END AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
hs AS (SELECT 0 AS level, lang, source, rule, spread, below, bucket, n FROM h
       UNION ALL SELECT 1, lang, NULL, rule, spread, below, bucket, sum(n) FROM h GROUP BY ALL
       UNION ALL SELECT 2, NULL, NULL, rule, spread, below, bucket, sum(n) FROM h GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, rule ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, rule) AS total,
             CASE WHEN bucket = 0 THEN 0.0 ELSE pow(1.02::DOUBLE, bucket - 1) END AS value FROM hs),
q AS (SELECT level, lang, source, rule, spread, below, max(total) AS total, min(value) FILTER (upto >= 0.25 * total) AS q25, min(value) FILTER (upto >= 0.75 * total) AS q75 FROM c GROUP BY ALL),
e AS (SELECT *, CASE WHEN below THEN q25 - 3 * greatest(q75 - q25, spread) ELSE -1 END AS low, q75 + 3 * greatest(q75 - q25, spread) AS high FROM q),
j AS (SELECT v.k, bool_and(v.x BETWEEN CASE WHEN a.total >= 200 THEN a.low WHEN b.total >= 200 THEN b.low ELSE d.low END
                                   AND CASE WHEN a.total >= 200 THEN a.high WHEN b.total >= 200 THEN b.high ELSE d.high END) AS fine
      FROM v JOIN e a ON a.level = 0 AND a.rule = v.rule AND a.lang IS NOT DISTINCT FROM v.lang AND a.source IS NOT DISTINCT FROM v.source
             JOIN e b ON b.level = 1 AND b.rule = v.rule AND b.lang IS NOT DISTINCT FROM v.lang
             JOIN e d ON d.level = 2 AND d.rule = v.rule GROUP BY v.k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fine, false) AS kept FROM f LEFT JOIN j USING (k)
"""


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "archive")
    warc.write_archive(warc.resolve(warc.headers(table(spark, sf_dir, "pages"))), path)
    return warc.read_archive(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, h,
             list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (5 * (3 - i % 4))) & 31)::INTEGER, 1)), 'string_agg', '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM m
"""


def op4_bpe_chunk_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), digest=True)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = langid.fit(docs, ~held_out)
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model, ["doc_id", "held_out"])


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), net, ["doc_id", "held_out"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.dropped(docs).withColumnRenamed("doc_id", "id")
    sizes = docs.select("doc_id", F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"))
    return sizes.join(gone, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op3_warc_revisits": OP3_SQL}
