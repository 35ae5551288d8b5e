"""Near-duplicate linkage from band buckets: candidates, exact verification, distributed union-find.

Used by the document and the line operator. Equal bands share a bucket, and buckets may be huge (a third of all rows), so no
step lists all pairs of a bucket at first:

1. The bands are tried in groups, a few first. One aggregation per group finds the *open* buckets, those that hold more than
   one component; all others are done without a join, whatever their size. Groups of near copies come together in the
   first, small group of bands, so their buckets in the later groups are closed.
2. An open bucket of two rows is its one pair; where the items have a brief sketch, the aggregation holds the exclusive or of the two, and excludes
   most unlike pairs without any lookup. The rows of fuller buckets are looked up, and while they hold more than ``pairs_a_row`` pairs
   across components by row, and turns yield links, turns follow: each component is represented by one row, drawn by
   hash, and compared with ``HUBS`` rows of the bucket's largest component (with a brief sketch, in the first turn with one).
3. What remains is compared exactly: every pair across components, except those whose sizes or sketches exclude the similarity.

So every pair of a bucket is verified, connected already, or excluded by its bounds. Nothing is capped. Intermediate tables
are dropped once the components are written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BROADCAST_ROWS, fitted, materialize, release, scratch, small

#: Pairs across components in open buckets, by row of them, up to which they are compared at once.
PAIRS_A_ROW = 16
#: Rows of a bucket's largest component that every other component is compared with in a turn.
HUBS = 8
#: Share of a turn's pairs that must link for another turn.
LEAST_YIELD = 0.04
#: Contents, and pairs of contents to compare, by task.
CONTENTS_A_TASK = 512
#: Rows of a bucket by task that compares them with the whole bucket.
ROWS_A_SALT = 256


def equal_bits(a: str, b: str, words: int) -> str:
    """SQL: equal bits in the first ``words`` longs of two sketches. For a few: written out, a method past 8000 bytes is never compiled by the JVM."""
    return f"{64 * words} - " + " - ".join(f"bit_count({a}[{i}] ^ {b}[{i}])" for i in range(words))


def all_equal_bits(a: str, b: str, words: int) -> str:
    """SQL: equal bits of two whole sketches of ``words`` longs."""
    return f"{64 * words} - aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the edges and the smallest id reachable from each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    comp = np.arange(len(ids))
    while (comp[u] != comp[v]).any():
        cu, cv = comp[u], comp[v]
        np.minimum.at(comp, np.maximum(cu, cv), np.minimum(cu, cv))
        while (comp[comp] != comp).any():
            comp = comp[comp]
    return ids, ids[comp]


def few_components(edges: DataFrame) -> DataFrame:
    """As ``components``, of edges few enough to broadcast: the driver finds them, without a query for each round."""
    got = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).toArrow()
    ids, comp = union_find(*(got[c].to_numpy().astype(np.int64) for c in "ab"))
    found = edges.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "comp": pa.array(comp, pa.int64())}))
    return materialize(found, "labels", len(ids))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, comp): the smallest id reachable from every id of ``edges`` (a, b), by distributed union-find.

    Each round hooks every component on the smallest component next to it and then halves the pointer paths. The labels are a
    written table after each round, so a round never recomputes an earlier one. Ends when no label changes;
    an empty ``edges`` gives an empty table; repeated edges and loops do no harm.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    labels = materialize(
        edges.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("comp")).union(edges.select(F.least("a", "b"), F.least("a", "b"))).groupBy("id").agg(F.min("comp").alias("comp")),
        "labels",
    )
    for _ in range(most_rounds):
        la, lb = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca")), labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
        across = edges.join(la, "a").join(lb, "b").where("ca <> cb")
        hooks = materialize(across.select(F.greatest("ca", "cb").alias("comp"), F.least("ca", "cb").alias("to")).groupBy("comp").agg(F.min("to").alias("to")), "hooks")
        if not hooks.n_rows:
            break
        for _ in range(most_rounds):  # shorten chains of hooks, fourfold
            step = small(hooks).select(F.col("comp").alias("to"), F.col("to").alias("next"))
            then = step.toDF("next", "after")
            far = hooks.join(step, "to", "left").join(then, "next", "left")
            hooks = materialize(far.select("comp", F.coalesce("after", "next", "to").alias("to"), F.col("after").isNotNull().alias("moved")), "hooks", n_moved=F.count_if("moved"))
            done = not hooks.n_moved
            shorter = hooks.select("comp", "to")
            shorter.n_rows, hooks = hooks.n_rows, shorter
            if done:
                break
        labels = materialize(labels.join(small(hooks), "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")
    else:
        raise RuntimeError("components did not settle")
    return labels


class Linker:
    """Links of ``items`` (id long, size long, sketch, bands array<array<long>>: a group of bands each; brief long, if ``near`` is given), a written
    table; rows of one id are equal but for their place.

    ``contents``: takes ids, returns (id, content), one row per id. ``similar``: whether two contents link. ``least_ratio``: smallest
    size ratio of a linked pair; ``agrees``: SQL, whether two structs of size, sketch and what ``finer`` adds may belong to one;
    with ``finer``, a third argument tells whether they hold that.
    ``finer``: takes (id, content) of buckets that turns leave open with more than ``pairs_a_row`` pairs a row, returns (id, ...), bounds that are too
    dear for all items. ``near``: SQL, whether two rows may link, of the exclusive or of their ``brief``.
    """

    def __init__(self, items: DataFrame, contents: Callable[[DataFrame], DataFrame], similar: Callable[[Column, Column], Column], least_ratio: float, agrees: Callable[..., str], finer: Callable[[DataFrame], DataFrame] | None = None, near: str | None = None, pairs_a_row: int = PAIRS_A_ROW):
        self.items, self.contents, self.similar, self.least_ratio, self.agrees, self.finer = items, contents, similar, least_ratio, agrees, finer
        self.near, self.pairs_a_row = near, pairs_a_row
        self.links: list[DataFrame] = []
        self.comps: DataFrame | None = None

    def label(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the component of every id so far."""
        if self.comps is None:
            return rows.withColumn("comp", F.col("id"))
        return rows.join(small(self.comps), "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def possible(self, bound: DataFrame, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, b) that sizes and sketches allow."""
        a, b = (fitted(bound).select(F.col("id").alias(x), F.col("k").alias("k" + x)) for x in "ab")
        near = pairs.select("a", "b").distinct().join(b, "b").join(a, "a")
        return near.where(self.may_link("ka", "kb", bound)).select("a", "b")

    def may_link(self, u: str, v: str, bound: DataFrame) -> Column:
        ratio = f"least({u}.size, {v}.size) >= {self.least_ratio} * greatest({u}.size, {v}.size)"
        agrees = self.agrees(u, v, len(bound.schema["k"].dataType.fields) > 2) if self.finer is not None else self.agrees(u, v)
        return F.expr(f"{ratio} and ({agrees})")

    def confirm(self, held: DataFrame, pairs: DataFrame, at_most: int | None = None) -> float:
        """Add the pairs that link, of ``at_most`` pairs; their share."""
        pairs = materialize(pairs, "pairs", at_most)
        if not pairs.n_rows:
            return 0.0
        ids = materialize(fitted(pairs).select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids", 2 * pairs.n_rows)
        held = held.join(small(ids), "id", "left_semi")
        left, right = held.toDF("a", "x"), held.toDF("b", "y")
        both = small(pairs).join(right, "b").join(left, "a").where(self.similar(F.col("x"), F.col("y"))).select("a", "b")
        found = materialize(fitted(both, pairs.n_rows, CONTENTS_A_TASK), "links")
        if not found.n_rows:
            return 0.0
        self.links.append(found)
        edges = reduce(DataFrame.union, self.links)
        self.comps = (few_components if sum(x.n_rows for x in self.links) <= BROADCAST_ROWS else components)(edges)
        return found.n_rows / pairs.n_rows

    def group(self, k: int, entries: int, most_turns: int) -> None:
        brief = ["brief"] if self.near else []
        rows = self.label(self.items.select("id", *brief, F.col("bands")[k].alias("own"))).select("id", *brief, "comp", F.explode("own").alias("bucket"))
        ends = [F.min("id").alias("a"), F.max("id").alias("b"), *([F.min("comp").alias("ca"), F.max("comp").alias("cb")] if self.comps is not None else [])]
        open_ = rows.groupBy("bucket").agg(*ends, *[F.expr(f"bit_xor({x})").alias(x) for x in brief], F.count("*").alias("n")).where("ca <> cb" if self.comps is not None else "a <> b")
        if self.near:
            open_ = open_.where(f"n > 2 or {self.near}")
        open_ = materialize(open_.select("bucket", "a", "b", "n"), "open", entries // 2, twos=F.count_if(F.col("n") == 2), more=F.sum(F.when(F.col("n") > 2, F.col("n"))))
        if not open_.n_rows:
            return
        twos = fitted(open_).where("n = 2").select("a", "b")
        if self.near:
            twos = materialize(twos.distinct(), "twos", open_.twos)
        n_twos = twos.n_rows if self.near else open_.twos
        full = small(open_.where("n > 2").select("bucket"), open_.n_rows - open_.twos)
        members = materialize(rows.join(full, "bucket").select("bucket", "id").distinct(), "members", open_.more or 0)
        ids = fitted(twos.select(F.explode(F.array("a", "b")).alias("id")).union(fitted(members).select("id")), 2 * n_twos + members.n_rows).distinct()
        ids = materialize(ids, "ids", 2 * n_twos + members.n_rows)
        release(self.items.sparkSession)  # the buckets' exchange
        held = materialize(fitted(self.contents(ids), ids.n_rows, CONTENTS_A_TASK), "contents")
        bounded = materialize(fitted(members).select("id").distinct(), "crowded", members.n_rows) if self.near else ids
        bound = self.items.select("id", "size", "sketch").join(small(bounded), "id").dropDuplicates(["id"])
        bound = materialize(bound.select("id", F.struct("size", "sketch").alias("k")), "bound", bounded.n_rows)
        self.confirm(held, twos if self.near else self.possible(bound, twos), n_twos)
        for turn in range(most_turns + 1):
            at = self.label(fitted(members))
            hubs = 1 if self.near and not turn else HUBS
            reps = [F.min_by("id", F.xxhash64(F.lit(turn), F.lit(i), "id")).alias(f"r{i}") for i in range(hubs)]
            parts = materialize(at.groupBy("bucket", "comp").agg(*reps, F.count("*").cast("double").alias("m")), "parts", members.n_rows)
            main = F.max_by(F.struct("comp", *[f"r{i}" for i in range(hubs)]), F.struct("m", F.xxhash64(F.lit(turn), "comp"))).alias("main")
            over = fitted(parts).groupBy("bucket").agg(main, F.count("*").alias("k"), F.ceil(F.sum("m") / ROWS_A_SALT).cast("int").alias("salts"), ((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("pairs")).where("k > 1")
            over = materialize(over.select("bucket", F.col("main.comp").alias("main"), F.array(*[F.col(f"main.r{i}") for i in range(hubs)]).alias("hubs"), "salts", "pairs"), "over", parts.n_rows, left=F.sum("pairs"))
            if (over.left or 0) <= self.pairs_a_row * members.n_rows or turn == most_turns:
                break
            tries = fitted(parts).join(small(over), "bucket").where("comp <> main").select(F.col("r0").alias("u"), F.explode(F.array_distinct("hubs")).alias("v"))
            if self.confirm(held, self.possible(bound, tries.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))), hubs * parts.n_rows) < LEAST_YIELD:
                break
        if not over.n_rows:
            return
        rest = materialize(at.join(small(over).select("bucket", "main", "salts"), "bucket"), "rest", members.n_rows)
        if self.finer is not None and over.left > self.pairs_a_row * members.n_rows:
            left = small(materialize(fitted(rest).select("id").distinct(), "left", members.n_rows))
            bound = bound.join(left, "id").join(self.finer(held.join(left, "id", "left_semi")), "id", "left")
            bound = materialize(bound.select("id", F.struct("k.*", *[c for c in bound.columns if c not in ("id", "k")]).alias("k")), "bound", members.n_rows)
        own = fitted(rest).groupBy("id").agg(F.collect_set("bucket").alias("own"))
        every = materialize(fitted(rest).join(own, "id").join(fitted(bound), "id"), "every", rest.n_rows)
        u = every.where("comp <> main").select("bucket", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"), F.col("id").alias("u"), F.col("comp").alias("cu"), F.col("k").alias("ku"), F.col("own").alias("ou"))
        v = every.select("bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("id").alias("v"), F.col("comp").alias("cv"), F.col("k").alias("kv"), "main", F.col("own").alias("ov"))
        across = (F.col("cu") != F.col("cv")) & ((F.col("cv") == F.col("main")) | (F.col("u") < F.col("v")))
        once = F.col("bucket") == F.array_min(F.array_intersect("ou", "ov"))  # a pair of many buckets comes from the first of them
        pairs = u.hint("merge").join(v, ["bucket", "salt"]).where(across & self.may_link("ku", "kv", bound) & once).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        self.confirm(held, pairs, int(over.left))


def link(items: DataFrame, contents, similar, least_ratio: float, agrees, entries: list[int], most_turns: int = 10, **more) -> DataFrame:
    """(id, comp) of the items that link with another one; see ``Linker``. ``entries``: rows in all buckets of each group of bands, at most."""
    linker = Linker(items, contents, similar, least_ratio, agrees, **more)
    with scratch(items.sparkSession) as tables:
        for k, n in enumerate(entries):
            linker.group(k, n, most_turns)
            release(items.sparkSession)
        none = items.select("id", F.col("id").alias("comp")).limit(0)
        return tables.keep(materialize(none, "comps") if linker.comps is None else materialize(linker.comps, "comps", linker.comps.n_rows))
