"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame functions only.

Each rule has a per-mille value per document. A sketch is a histogram over geometric buckets (relative error 2 %):
counts by (language, source, rule, bucket), so sketches merge by adding counts, and a hot source is pre-aggregated before
the shuffle. Sketches of sources with fewer than ``least_group`` documents give way to the merged sketch of their language,
and those of rare languages to the merged sketch of all. A threshold is a fence, q75 + 3 * max(q75 - q25, spread),
and for word length also one below. Documents that fail the base rules do not enter the sketches.

Null text has no words and fails the base; null languages and sources are groups of their own. Repeated rows are judged alike,
ties at a fence are kept, an empty table gives none, extra columns are ignored. Repeats of word triples are
told apart by 64-bit hashes within a text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import materialize

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
GAMMA = 1.02
#: rule -> (numerator, denominator, least spread in per mille, fence below too)
RULES = {
    "symbols": ("n_symbols", "n_words", 60, False),
    "dup_lines": ("n_dup_lines", "n_lines", 200, False),
    "repeats": ("n_repeat_words", "n_words", 130, False),
    "word_length": ("word_chars", "n_words", 500, True),
}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, evaluated once however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, SPACES, " " * len(SPACES)), " "), "")


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3)))), F.lit(0), lambda x, y: x + y)

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: (x.h == F.get(s, k - 1).h) | (x.h == F.get(s, k + 1).h))
        return let(F.sort_array(F.transform(twice, lambda x: x.i)), covered)

    def of_hashes(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs, repeated))

    def of_words(w: Column) -> Column:
        triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) >= 4, let(triples, of_hashes)).otherwise(F.lit(0))

    return let(words, of_words)


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep``, and n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    out = docs.select(
        *keep,
        let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).cast("long").alias("r"))).alias("w"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))).alias("l"),
    )
    failed = (F.col("w.n") < 50) | (100 * F.col("w.r") > 50 * F.col("w.n"))
    return out.select(*keep, F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.n").alias("n_lines"), F.col("l.d").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), failed.alias("base_failed"))


def permille(rule: str) -> Column:
    top, below, _, _ = RULES[rule]
    return F.floor(1000 * F.col(top) / F.greatest(F.col(below), F.lit(1))).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, rule, bucket, n): one mergeable sketch per language, source and rule."""
    values = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), permille(r).alias("v")) for r in RULES])).alias("x")
    bucket = F.when(F.col("x.v") > 0, 1 + F.floor(F.log(F.col("x.v")) / F.log(F.lit(GAMMA)))).otherwise(0).cast("long")
    return measured.where(~F.col("base_failed")).select("lang", "source", values).groupBy("lang", "source", F.col("x.rule").alias("rule"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge(sketch: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups."""
    return sketch.groupBy(*keys, "rule", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame, *keys: str) -> DataFrame:
    """(keys, rule, total, low, high) of every sketch."""
    from pyspark.sql import Window

    own = Window.partitionBy(*keys, "rule")
    ranked = sketch.withColumn("upto", F.sum("n").over(own.orderBy("bucket"))).withColumn("total", F.sum("n").over(own))
    value = F.when(F.col("bucket") == 0, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket") - 1))
    q = {x: F.min(F.when(F.col("upto") >= x / 100 * F.col("total"), value)).alias(f"q{x}") for x in (25, 75)}
    out = ranked.groupBy(*keys, "rule").agg(F.max("total").alias("total"), q[25], q[75])
    spread = F.coalesce(*[F.when(F.col("rule") == r, F.lit(float(s))) for r, (_, _, s, _) in RULES.items()])
    below = F.coalesce(*[F.when(F.col("rule") == r, F.lit(b)) for r, (_, _, _, b) in RULES.items()])
    step = 3 * F.greatest(F.col("q75") - F.col("q25"), spread)
    return out.select(*keys, "rule", "total", F.when(below, F.col("q25") - step).otherwise(-1.0).alias("low"), (F.col("q75") + step).alias("high"))


def thresholds(sketch: DataFrame, least_group: int = 200) -> DataFrame:
    """(lang, source, t_<rule>_low, t_<rule>_high): the finest sketch that is large enough decides."""
    by_source = fences(sketch, "lang", "source")
    by_lang = fences(merge(sketch, "lang"), "lang").select(F.col("lang").alias("lang_"), F.col("rule").alias("rule_"), F.col("total").alias("total_"), F.col("low").alias("low_"), F.col("high").alias("high_"))
    overall = fences(merge(sketch)).select(F.col("rule").alias("rule__"), F.col("low").alias("low__"), F.col("high").alias("high__"))
    both = by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("rule") == F.col("rule_"))).join(overall, F.col("rule") == F.col("rule__"))
    pick = lambda x: F.when(F.col("total") >= least_group, F.col(x)).when(F.col("total_") >= least_group, F.col(x + "_")).otherwise(F.col(x + "__"))
    ends = [F.max(F.when(F.col("rule") == r, pick(x))).alias(f"t_{r}_{x}") for r in RULES for x in ("low", "high")]
    return both.groupBy("lang", "source").agg(*ends)


def judge(docs: DataFrame, least_group: int = 200) -> DataFrame:
    """Every document with its measures, base_failed and kept. A group whose documents all fail the base has no sketch and needs none."""
    measured = materialize(measures(docs), "measures")
    limits = materialize(thresholds(materialize(sketches(measured), "sketches"), least_group), "thresholds")
    limits = limits.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), *[c for c in limits.columns if c.startswith("t_")])
    fine = ~F.col("base_failed")
    for r in RULES:
        fine = fine & permille(r).between(F.col(f"t_{r}_low"), F.col(f"t_{r}_high"))
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce(fine, F.lit(False)).alias("kept"))
