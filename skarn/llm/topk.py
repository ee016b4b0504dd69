"""Exact top-k inner products by branch and bound over dimension blocks in vertical layout.

Candidates are stored by dimension. For a block of queries, scores accumulate one
block of dimensions at a time. The norms of what remains of query and candidate
bound the rest of a score (Cauchy-Schwarz); a candidate whose upper bound is below
the k-th best lower bound is dropped, and the survivors are compacted before the
next dimensions are read. A query takes its k-th best score along from one candidate
block to the next. Blocks are laid out once, with their norms, and only read where
they meet. Sums are exact: doubles where they hold every sum of two blocks, else
64-bit integers, else integers of any size; only bounds are rounded, upwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions, slices, table

#: Rows of one candidate block, of one query block, and dimensions accumulated at a time.
CANDIDATES, QUERIES, DIMS = 2048, 256, 16
#: Sums below this are exact in doubles, and below that in 64-bit integers.
EXACT, LONG = 2.0**53, 2.0**63


def tails(x: np.ndarray, dims: int) -> np.ndarray:
    """Norms of what is left of each row from each block of dimensions on, rounded up."""
    if not x.shape[1]:
        return np.zeros((len(x), 1))
    left = np.cumsum(np.add.reduceat(x * x, np.arange(0, x.shape[1], dims), axis=1)[:, ::-1], axis=1)[:, ::-1]
    return np.hstack([np.sqrt(left) * (1 + 1e-9), np.zeros((len(x), 1))])


class Block:
    """Vectors of one length: their ids in order, components by dimension, and the norms of their tails."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, tails_: np.ndarray, dims: int = DIMS) -> None:
        self.ids, self.columns, self.tails, self.dims = ids, columns, tails_, dims
        self.largest = float(np.abs(columns).max(initial=0))

    @classmethod
    def of(cls, ids: np.ndarray, vectors: np.ndarray, dims: int = DIMS) -> Block:
        order = np.argsort(ids, kind="stable")
        return cls(ids[order], np.ascontiguousarray(vectors[order].T), tails(vectors[order], dims), dims)


def as_exact(x: np.ndarray, largest: float) -> np.ndarray:
    """Components in a type that sums up to ``largest`` are exact in."""
    if largest < EXACT:
        return x
    return x.astype(np.int64) if largest < LONG else np.array([[int(v) for v in row] for row in x], object).reshape(x.shape)


def search_block(queries: Block, block: Block, k: int, known: dict[int, float] | None = None) -> list[tuple[int, int, int]]:
    """(query id, candidate id, score): for each query its k best candidates of the block, ties to smaller ids.

    ``known`` has by the query's place a score that k candidates of other blocks reach:
    candidates that stay below it may be left out, and it is raised.
    """
    out = []
    known = {} if known is None else known
    d, dims = queries.columns.shape[0], block.dims
    most = max(1.0, d * max(1.0, queries.largest) * max(1.0, block.largest))
    q_all, cols_all = as_exact(queries.columns.T, most), as_exact(block.columns, most)
    rounding = 0.0 if most < EXACT else most * 2.0**-50  # of scores taken as doubles for bounds
    first = min(dims, d)
    start = q_all[:, :first] @ cols_all[:first]  # the first dimensions of all pairs at once
    for q, query in enumerate(queries.ids.tolist()):
        score, alive, at, step = start[q], None, first, 1
        if (own := np.flatnonzero(block.ids == query)).size:
            alive = np.delete(np.arange(len(block.ids)), own)
            score = score[alive]
        while len(score):
            n = len(score)
            approx = score.astype(np.float64)
            slack = queries.tails[q, step] * (block.tails[:, step] if alive is None else block.tails[alive, step]) + rounding
            floor = known.get(q, -np.inf)
            if n > k:
                floor = max(floor, np.partition(approx - slack, n - k)[n - k])
            keep = np.flatnonzero(approx + slack >= floor)
            if len(keep) < n:
                alive = keep if alive is None else alive[keep]
                score = score[keep]
            if at >= d or not len(score):
                break
            end = min(at + dims, d)
            part = cols_all[at:end] if alive is None else cols_all[at:end, alive]
            score = score + q_all[q, at:end] @ part
            at, step = end, step + 1
        names = block.ids if alive is None else block.ids[alive]
        scores = [int(x) for x in score]
        best = sorted(range(len(scores)), key=lambda b: (-scores[b], names[b]))[:k]
        if len(best) == k:
            known[q] = max(known.get(q, -np.inf), float(scores[best[-1]]) - rounding)
        out += [(query, int(names[b]), scores[b]) for b in best]
    return out


def _pack(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length each, within partitions: ids, components by dimension and tails, laid out once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids, xs = held.pop(dim)
            b = Block.of(np.array(ids, np.int64), np.concatenate(xs).reshape(len(ids), dim))
            raw = [b.ids.astype("<i8").tobytes(), b.columns.astype("<f8").tobytes(), b.tails.astype("<f8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *(pa.array([x], pa.binary()) for x in raw)], names=["dim", f"{name}_ids", f"{name}_data", f"{name}_tails"])

        for batch in batches:
            lists = batch.column(1)
            flat, lengths = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            ids = batch.column(0).to_numpy()
            at = 0
            for i, n in zip(ids.tolist(), lengths.tolist(), strict=True):
                keep = held.setdefault(n, ([], []))
                keep[0].append(i)
                keep[1].append(flat[at : at + n])
                at += n
                if len(keep[0]) >= size:
                    yield out(n)
        for dim in list(held):
            yield out(dim)

    return rows.mapInArrow(run, f"dim int, {name}_ids binary, {name}_data binary, {name}_tails binary")


def quantise(x: Column) -> Column:
    """floor(256 x) of each component, null where the vector or a component is null, NaN or infinite."""
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    return F.when(finite, F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("double")))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` best candidates.

    Both tables have (vec_id, vector) with a vector of integral doubles or null; null
    ids and vectors take no part, nor do pairs of different lengths or a row with
    itself. Empty vectors are vectors of
    length 0. Vectors are gathered in blocks; every query block meets every candidate
    block of its length, so the pairs that Spark sees are pairs of blocks. Rows
    that repeat are separate candidates. A score that no 64-bit integer holds is an error.
    """
    scratch = Scratch(queries.sparkSession, "topk")
    some = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), "vector").where("vec_id is not null and vector is not null")
    q = scratch.write(_pack(some(queries), QUERIES, "q"), "queries", "snappy")
    c = scratch.write(_pack(some(candidates), CANDIDATES, "c"), "candidates", "snappy")
    # a grid of cells: a block goes to the cells of its own row or column, so no task meets all blocks
    side = max(1, round(shuffle_partitions(queries.sparkSession) ** 0.5))
    own, every = (lambda ids: F.pmod(F.xxhash64(ids), F.lit(side)).cast("int")), F.explode(F.sequence(F.lit(0), F.lit(side - 1)))
    pairs = q.withColumn("qg", own("q_ids")).withColumn("cg", every).join(c.withColumn("cg", own("c_ids")).withColumn("qg", every), ["dim", "qg", "cg"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, known = None, {}  # a query block meets its candidate blocks one after another
        for batch in slices(batches, 1):
            dim = batch.column(0)[0].as_py()

            def block(i: int) -> Block:
                ids, data, norms = (np.frombuffer(batch.column(i + k)[0].as_py(), kind) for k, kind in ((0, "<i8"), (1, "<f8"), (2, "<f8")))  # noqa: B023
                return Block(ids, data.reshape(dim, len(ids)), norms.reshape(len(ids), -1))  # noqa: B023

            mine = block(1)
            if now is None or (dim, mine.ids.tobytes()) != now:
                now, known = (dim, mine.ids.tobytes()), {}
            rows = search_block(mine, block(4), k, known)
            if rows and max(abs(r[2]) for r in rows) >= 1 << 63:
                raise ValueError("a score is too large for a 64-bit integer")
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=["query_id", "vec_id", "score"])

    found = pairs.select("dim", "q_ids", "q_data", "q_tails", "c_ids", "c_data", "c_tails").mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op7_block_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products for each 50th row of ``embeddings``, against every row."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", quantise(F.col("embedding")).alias("vector"))
    return top_k(rows.where(F.col("vec_id") % 50 == 0), rows, 5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL
    AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)), TRUE)
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= 5
"""
