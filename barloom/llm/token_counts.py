"""Token-count rollups by source, language and tokenizer version, maintained by signed deltas.

A batch of changes is a table of signed rows: +1 inserts a document's count, -1 takes one back, and a revision is
the old row with -1 and the new one with +1. A batch is added up by (source, lang, tokenizer) before it is stored, so a hot
source is one row per task, and the store grows with groups, not with documents. Totals are the sums of
all committed batches, so their order does not matter.

Commits are idempotent: a batch lives in a folder named by its id, and the writer's ``_SUCCESS`` file commits it. A batch that is
committed already is left alone; the remains of a failed attempt are overwritten. ``compact`` folds
committed batches into one snapshot that names them, so a batch is never counted twice, however far a compaction got.

Null sources and languages are groups of their own; null counts count as 0; a batch without rows commits as an empty one; groups that
fall to zero documents and zero tokens leave the totals. A batch id must be a non-empty string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import hadoop, remove
from barloom.llm.textvec import slices

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


class TokenRollup:
    """A rollup store below ``path``, in any file system Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, batch_id: str) -> str:
        if not batch_id:
            raise ValueError("a batch needs an id")
        return f"{self.path}/batches/{hashlib.sha256(batch_id.encode()).hexdigest()}"

    def _complete(self, folder: str) -> bool:
        fs, p = hadoop(self.spark, f"{folder}/_SUCCESS")
        return fs.exists(p)

    def _children(self, name: str) -> list[str]:
        fs, p = hadoop(self.spark, f"{self.path}/{name}")
        return sorted(f"{self.path}/{name}/{s.getPath().getName()}" for s in fs.listStatus(p)) if fs.exists(p) else []

    def _snapshot(self) -> tuple[str | None, set[str]]:
        """(newest complete snapshot, folders that it holds)."""
        done = [s for s in self._children("snapshots") if self._complete(s + "/totals") and self._complete(s + "/batches")]
        if not done:
            return None, set()
        last = max(done, key=lambda s: int(s.rpartition("/")[2]))
        return last, {f"{self.path}/batches/{r[0]}" for r in self.spark.read.parquet(last + "/batches").collect()}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Commit signed rows (source, lang, tokenizer, sign, n_tokens); False if the batch was committed before."""
        folder = self._folder(batch_id)
        if self._complete(folder) or folder in self._snapshot()[1]:
            return False
        delta(changes).write.mode("overwrite").parquet(folder)
        return True

    def totals(self) -> DataFrame:
        snapshot, folded = self._snapshot()
        parts = [b for b in self._children("batches") if b not in folded and self._complete(b)]
        paths = [*parts, *([snapshot + "/totals"] if snapshot else [])]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        summed = self.spark.read.schema(SCHEMA).parquet(*paths).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> None:
        """Fold the committed batches into a new snapshot, then drop what it replaces."""
        snapshot, folded = self._snapshot()
        own = [b for b in self._children("batches") if self._complete(b)]
        held = sorted(folded | set(own))
        number = int(snapshot.rpartition("/")[2]) + 1 if snapshot else 1
        target = f"{self.path}/snapshots/{number}"
        self.totals().write.mode("overwrite").parquet(target + "/totals")
        names = self.spark.createDataFrame([(x.rpartition("/")[2],) for x in held], "batch string")
        names.coalesce(1).write.mode("overwrite").parquet(target + "/batches")
        for gone in [*own, *([snapshot] if snapshot else [])]:
            remove(self.spark, gone)


def delta(changes: DataFrame) -> DataFrame:
    """Signed sums of a batch."""
    sign = F.coalesce(F.col("sign"), F.lit(0)).cast("long")
    return changes.groupBy(*[F.col(k).cast("string").alias(k) for k in KEYS]).agg(F.sum(sign).alias("n_docs"), F.sum(sign * F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")).alias("n_tokens"))


@lru_cache(maxsize=8)
def _encoding(path: str, pattern: str):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def count(docs: DataFrame, tokenizers: dict[str, str], pattern: str) -> DataFrame:
    """(source, lang, tokenizer, n_tokens, words): a row per document and tokenizer (version -> vocabulary file); ``words`` is the number
    of white-space runs, a provisional count. Whole texts; null text has none."""
    versions = list(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [_encoding(tokenizers[v], pattern) for v in versions]
        for batch in batches:
            for first, end, data, offsets in slices(batch.column(2)):
                raw = data.tobytes()
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                words = pa.array([len(t.split()) for t in texts], pa.int64())
                for v, coder in zip(versions, coders):
                    n = pa.array([len(coder.encode_ordinary(t)) for t in texts], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[first:end], batch.column(1)[first:end], pa.array([v] * len(texts)), n, words], ["source", "lang", "tokenizer", "n_tokens", "words"])

    narrow = docs.select(F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "source string, lang string, tokenizer string, n_tokens long, words long")


def signed(rows: DataFrame, sign: int, n_tokens: str = "n_tokens") -> DataFrame:
    return rows.select(*KEYS, F.lit(sign).alias("sign"), F.col(n_tokens).alias("n_tokens"))


def revised(rows: DataFrame, old: str, new: str) -> DataFrame:
    """A revision of every row from count ``old`` to count ``new``."""
    both = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col(old).alias("n")), F.struct(F.lit(1).alias("sign"), F.col(new).alias("n")))).alias("x")
    return rows.select(*KEYS, both).select(*KEYS, "x.sign", F.col("x.n").alias("n_tokens"))
