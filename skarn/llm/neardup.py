"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set is its distinct word shingles, as 63-bit hashes. Its sketch is
the k smallest. Inverted lists over sketch values generate overlaps, the
bottom-k sketch of a pair's union estimates its similarity, and the full sets
decide. What keeps this linear where texts repeat:

* Documents with equal sets are one class from the start; copies never meet.
* Sketch values are ordered by how many classes hold them, rarest first. Two
  sketches that share at least m values share one among the first k - m + 1 of
  each, so only those are listed: a passage that many texts hold is listed only
  for texts that consist of little else.
* A list's members are first compared with its most central member alone (the
  one whose values are the most common, as an original among its edited copies).
  Two members of one list thus stand in the group of the same centre: where a group
  has members that aren't linked yet, their full sets are laid out as a grid of
  blocks, and each cell of the grid gives only the links that join two components.
  Hashes that a single open set has bound its overlap with any other, which keeps
  heavily edited copies of one original, whose sketches still look alike, out of
  the grid. No pair between components stays unchecked, and no pair is a row.

m is chosen so that a pair at the threshold misses it with probability below
1e-9 (the shared values of two bottom-k sketches are at least binomial).
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, slices, table
from .graph import components

K = 64
#: Hashes of one side of a grid's cell, about.
GRID = 200_000


def safe_overlap(k: int, percent: int, miss: float = 1e-9) -> int:
    """Largest m with P(Binomial(k, percent/100) < m) <= miss."""
    p, total = percent / 100, 0.0
    for x in range(k + 1):
        total += comb(k, x) * p**x * (1 - p) ** (k - x)
        if total > miss:
            return x
    return k


class Shingler:
    """Distinct k-word shingles of a text as sorted 63-bit hashes; word hashes are kept for up to ``limit`` words."""

    def __init__(self, size: int, limit: int = 400_000) -> None:
        self.size, self.limit = size, limit
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is folded and splits
        if not tokens:
            return np.empty(0, np.int64)
        known = self.known
        if len(known) > self.limit:
            known.clear()
        try:
            h = np.array([known[w] for w in tokens], np.uint64)
        except KeyError:
            for w in tokens:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.array([known[w] for w in tokens], np.uint64)
        n = min(self.size, len(tokens))
        acc = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            acc = (acc ^ h[k : len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            acc ^= acc >> np.uint64(29)
        acc = (acc ^ (acc >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        acc ^= acc >> np.uint64(32)
        return np.unique(acc >> np.uint64(1)).view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sketches(docs: DataFrame, size: int, k: int = K) -> DataFrame:
    """(doc, n, fp1, fp2, sketch): set size, a 128-bit digest of the set, and its k smallest hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in slices(batches, 1024):
            sets = [shingle(t) for t in batch.column(1).to_pylist()]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), _lists([s[:k] for s in sets])],
                names=["doc", "n", "fp1", "fp2", "sketch"],
            )

    return docs.select(F.col("doc"), F.col("text")).mapInArrow(run, "doc long, n long, fp1 long, fp2 long, sketch array<long>")


def _full_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(size)
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle(t) for t in batch.column(1).to_pylist()])], names=["doc", "hashes"])

    return docs.select("doc", "text").mapInArrow(run, "doc long, hashes array<long>")


def _close(a: Column, b: Column, low: float) -> Column:
    """Union-sketch estimate: the share of the union's k smallest values that both hold."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, K)
    return F.size(F.array_intersect(union, F.array_intersect(a, b))) >= F.floor(low * F.size(union))


def _blocks(rows: DataFrame, sets: DataFrame, side: str) -> DataFrame:
    """(g, xb, yb, roots, sizes, hashes): the full sets of the rows (g, rep, root, nx, ny), block by block, in every cell of the group's grid that needs them."""
    own, other, n, m = ("xb", "yb", "nx", "ny") if side == "x" else ("yb", "xb", "ny", "nx")
    dealt = rows.join(sets.toDF("rep", "hashes"), "rep").withColumn(own, F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    each = dealt.groupBy("g", own, m).agg(F.collect_list(F.struct("root", "hashes")).alias("m"))
    return each.select(
        "g", own, F.explode(F.sequence(F.lit(0), F.col(m).cast("int") - 1)).alias(other),
        F.transform("m", lambda e: e["root"]).alias(f"{side}_roots"),
        F.transform("m", lambda e: F.size(e["hashes"])).alias(f"{side}_sizes"),
        F.flatten(F.transform("m", lambda e: e["hashes"])).alias(f"{side}_hashes"),
    )


def cell_links(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], percent: int) -> list[tuple[int, int]]:
    """Links (root, root) that join the components of two blocks' sets, each block as roots, sizes and hashes of its sets.

    Every pair of sets under different roots is compared in full; a link between
    roots that earlier ones already joined isn't given, so there are fewer than roots.
    """
    (x_roots, x_sizes, x_hashes), (y_roots, y_sizes, y_hashes) = x, y
    names, of = np.unique(np.concatenate([x_roots, y_roots]), return_inverse=True)
    of_x, of_y = of[: len(x_roots)], of[len(x_roots) :]
    label = np.arange(len(names))
    order = np.argsort(y_hashes, kind="stable")
    values, first = np.unique(y_hashes[order], return_index=True)
    ends = np.append(first[1:], len(order))
    owner = np.repeat(np.arange(len(y_sizes)), y_sizes)[order]
    at, out = 0, []
    for k, n in zip(of_x.tolist(), x_sizes.tolist(), strict=True):
        h = x_hashes[at : at + n]
        at += n
        place = np.minimum(np.searchsorted(values, h), len(values) - 1)
        place = place[values[place] == h]
        span = ends[place] - first[place]
        total = int(span.sum())
        if not total:
            continue
        inter = np.bincount(owner[np.repeat(first[place] - np.cumsum(span) + span, span) + np.arange(total)], minlength=len(y_sizes))
        close = np.flatnonzero((100 * inter >= percent * (n + y_sizes - inter)) & (inter > 0))
        for j in np.unique(of_y[close]).tolist():
            if label[j] != label[k]:
                out.append((int(names[k]), int(names[j])))
                label[label == label[j]] = label[k]
    return out


def _links_between(xs: DataFrame, ys: DataFrame, percent: int) -> DataFrame:
    """(a, b): the links between roots that the cells of all grids give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x, y = (tuple(batch.column(k + i).flatten().to_numpy() for i in range(3)) for k in (0, 3))
            a, b = zip(*found, strict=True) if (found := cell_links(x, y, percent)) else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    both = xs.join(ys, ["g", "xb", "yb"]).select("x_roots", "x_sizes", "x_hashes", "y_roots", "y_sizes", "y_hashes")
    return both.mapInArrow(run, "a long, b long").distinct()


def near_components(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Linked are documents whose sets' intersection is at least ``percent`` hundredths
    of their union; a component is what links connect, named by its smallest id.
    Texts shorter than a shingle are one shingle of all their words. Texts without
    words (null, empty) are linked with nothing. Rows with a null id are linked with
    nothing and kept, their component_id null. Rows that repeat an id and text are
    the same document. Other columns aren't read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    m = safe_overlap(K, percent)
    low = m / K
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text).alias("text"))
    every = scratch.write(sketches(own, size), "sketches", "snappy")
    usable = every.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    reps = usable.groupBy("fp1", "fp2", "n").agg(F.min("doc").alias("rep"), F.min_by("sketch", "doc").alias("sketch"))
    reps = scratch.write(reps, "classes", "snappy")

    values = reps.select("rep", "n", F.size("sketch").alias("c"), F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    need = F.greatest(F.lit(1), F.floor(F.col("c") * low))
    # values that no one else holds come first in the order and list nothing; what they leave of the prefix is taken
    listed = (
        values.join(shared, "v").groupBy("rep", "n", "c")
        .agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("o"), F.sum(F.log("df")).alias("central"))
        .withColumn("take", F.size("o") - need + 1).where("take > 0")
        .select("rep", "n", "central", F.explode(F.slice("o", 1, F.col("take").cast("int"))).alias("x"))
        .select("rep", "n", "central", F.col("x.v").alias("v"))
    )
    listed = scratch.write(listed, "listed", "snappy")

    def full_sets(ids: DataFrame, name: str) -> DataFrame:
        return scratch.write(_full_sets(own.join(ids, "doc", "left_semi"), size), name, "snappy")

    def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
        """Of candidate pairs (a, b), those whose full sets are close enough."""
        left, right = sets.toDF("a", "ha"), sets.toDF("b", "hb")
        both = pairs.join(right, "b").join(left, "a")
        inter = F.size(F.array_intersect("ha", "hb"))
        good = both.where(100 * inter >= percent * (F.size("ha") + F.size("hb") - inter)).select("a", "b")
        return scratch.write(good, name)

    sk = reps.select("rep", "sketch")
    centres = listed.groupBy("v").agg(F.max_by("rep", F.struct("central", -F.col("rep"))).alias("a"), F.count("*").alias("s")).where("s > 1").select("v", "a")
    met = scratch.write(listed.join(centres, "v").where("rep <> a").select("a", F.col("rep").alias("b")).distinct(), "met", "snappy")
    stars = met.join(sk.toDF("b", "sb"), "b").join(sk.toDF("a", "sa"), "a").where(_close(F.col("sa"), F.col("sb"), low)).select("a", "b")
    stars = scratch.write(stars, "star_pairs")
    ids = stars.select(F.col("a").alias("doc")).union(stars.select("b")).distinct()
    links = verified(stars, full_sets(ids, "star_sets"), "star_links")
    scratch.drop("star_sets")
    comp = scratch.write(components(links, scratch, "first"), "comp1")

    # two members of a list have its centre in common: groups of centres hold every pair that shares a list
    group = met.toDF("g", "rep").union(met.select("a", "a").distinct())
    group = group.join(comp.toDF("rep", "root"), "rep", "left").select("g", "rep", F.coalesce("root", "rep").alias("root"))
    apart = lambda df: df.join(df.groupBy("g").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("g"), "g")
    open_ = scratch.write(apart(scratch.write(group, "groups", "snappy")), "open", "snappy")
    # a hash that only one open set has is in no overlap between them: this bounds overlaps before any pair is formed
    sets = full_sets(open_.select(F.col("rep").alias("doc")).distinct(), "open_sets")
    alone = sets.select("doc", F.explode("hashes").alias("h")).groupBy("h").agg(F.count("*").alias("s"), F.min("doc").alias("rep")).where("s = 1")
    alone = alone.groupBy("rep").agg(F.count("*").alias("u"))
    sized = sets.select(F.col("doc").alias("rep"), F.size("hashes").alias("n"))
    able = sized.join(alone, "rep", "left").withColumn("most", F.col("n") - F.coalesce("u", F.lit(0))).where(100 * F.col("most") >= percent * F.col("n"))
    able = scratch.write(apart(scratch.write(open_.join(able.drop("u"), "rep"), "bounded", "snappy")), "able", "snappy")
    # members of a group's largest component aren't compared with each other; the others must have room for a link within the group's bounds
    big = able.groupBy("g", "root").agg(F.count("*").alias("s")).groupBy("g").agg(F.max_by("root", F.struct("s", "root")).alias("big"))
    bounds = able.groupBy("g").agg(F.max("most").alias("m1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    asked = able.join(big, "g").join(bounds, "g").where(
        (F.col("root") != F.col("big"))
        & ((100 + percent) * F.least("most", "m1") >= percent * (F.col("n") + F.col("n0")))
        & (100 * F.least("n", "n1") >= percent * F.greatest("n", "n0"))
    )
    asked = scratch.write(asked.select("g", "rep", "root", "n"), "asked", "snappy")
    blocks = lambda df, name: df.groupBy("g").agg(F.ceil(F.sum("n") / GRID).alias(name))
    grid = scratch.write(blocks(asked, "nx").join(blocks(able, "ny"), "g"), "grid")
    laid = lambda df: df.select("g", "rep", "root").join(grid, "g")
    more = scratch.write(_links_between(_blocks(laid(asked), sets, "x"), _blocks(laid(able), sets, "y"), percent), "cross_links")
    scratch.drop("open_sets")
    final = comp.toDF("rep", "top")
    if not more.isEmpty():  # what the second round links: components of components
        root = comp.toDF("rep", "root")
        up = lambda df, c: df.join(root.withColumnRenamed("rep", c), c, "left").withColumn(c, F.coalesce("root", c)).drop("root")
        again = components(up(up(more, "a"), "b"), scratch, "second").toDF("root", "top")
        merged = root.join(again, "root", "left").select("rep", F.coalesce("top", "root").alias("top"))
        lone = again.toDF("rep", "top").join(comp.select(F.col("node").alias("rep")), "rep", "left_anti")
        final = scratch.write(merged.union(lone), "final")

    named = reps.select("fp1", "fp2", "n", "rep").join(final, "rep", "left").select("fp1", "fp2", "n", F.coalesce("top", "rep").alias("component"))
    out = every.select("doc", "n", "fp1", "fp2").join(named, ["fp1", "fp2", "n"], "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc").isNotNull(), F.col("component"))).otherwise(F.col("doc"))
    out = out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that are their component's smallest document, with their columns as they were."""
    kept = near_components(docs, size, percent).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["_kept"]), "left_semi")


def op6_bottom_k_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` linked at 0.85 over three-word shingles."""
    return near_components(table(spark, sf_dir, "documents"), 3, 85)
