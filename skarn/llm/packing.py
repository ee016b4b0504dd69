"""Vector bin packing of examples into training sequences by the dot-product heuristic.

Every task packs the rows of its own partition: one pass over the input, no
shuffle, a fixed number of open sequences in memory. Sequence ids carry the
partition's number, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partition_id, slices, table
from .tokens import ByteEncoder


@dataclass(frozen=True)
class Limits:
    """What one sequence holds at most."""

    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024


@dataclass
class Item:
    """A whole example or a piece of one: where it starts in its example, and what it weighs."""

    key: object
    start: int
    length: int
    loss: np.ndarray  # 0/1 for each token
    payload: object = None


@dataclass
class _Open:
    items: list[Item] = field(default_factory=list)


class Packer:
    """Places items one by one under three limits at once.

    An item goes to the open sequence with the largest dot product between the
    item's and the sequence's remaining vector (each component relative to its
    limit), among those where it fits. If none has room, a new sequence is
    opened, at most ``max_open`` of them; beyond that the fullest one is closed,
    or, if items may be cut, filled with the item's first part. Longer items
    than a sequence are cut if ``cut``, else an error names them.
    ``flush`` with ``cut`` joins what is left into full sequences and a rest
    in lengths of powers of two, which need no padding.
    """

    def __init__(self, limits: Limits, cut: bool, emit: Callable[[list[Item]], None], max_open: int = 32) -> None:
        self.cap = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        if (self.cap < 1).any():
            raise ValueError("limits must be at least 1")
        self.limits, self.cut, self.emit, self.max_open = limits, cut, emit, max_open
        self.left = np.empty((0, 3))
        self.open: list[_Open] = []

    @staticmethod
    def part(item: Item, n: int) -> tuple[Item, Item]:
        return (
            Item(item.key, item.start, n, item.loss[:n], item.payload),
            Item(item.key, item.start + n, item.length - n, item.loss[n:], item.payload),
        )

    def _room(self, item: Item, left: np.ndarray) -> int:
        """How many of the item's first tokens fit."""
        if left[1] < 1:
            return 0
        n = int(min(item.length, left[0]))
        if item.loss[:n].sum() > left[2]:
            n = int(np.searchsorted(np.cumsum(item.loss[:n]), left[2], side="right"))
        return n

    def _put(self, k: int, item: Item) -> None:
        self.open[k].items.append(item)
        self.left[k] -= (item.length, 1, item.loss.sum())
        if self.left[k, 0] < 1 or self.left[k, 1] < 1 or (self.left[k, 2] < 1 and not self.cut):
            self._close(k)

    def _close(self, k: int) -> None:
        self.emit(self.open.pop(k).items)
        self.left = np.delete(self.left, k, 0)

    def add(self, item: Item) -> None:
        while item.length:
            size = np.array([item.length, 1, item.loss.sum()])
            if (size > self.cap).any():
                if not self.cut:
                    raise ValueError(f"example {item.key} exceeds a sequence: {size.tolist()}")
                head, item = self.part(item, self._room(item, self.cap))
                if head.length == self.limits.tokens:
                    self.emit([head])
                else:
                    self.open.append(_Open())
                    self.left = np.vstack([self.left, self.cap])
                    self._put(len(self.open) - 1, head)
                continue
            fits = (self.left >= size).all(1)
            if fits.any():
                score = np.where(fits, (self.left / self.cap) @ (size / self.cap), -1.0)
                self._put(int(score.argmax()), item)
                return
            if len(self.open) < self.max_open:
                self.open.append(_Open())
                self.left = np.vstack([self.left, self.cap])
                self._put(len(self.open) - 1, item)
                return
            k = int(self.left[:, 0].argmin())
            n = self._room(item, self.left[k]) if self.cut else 0
            if n:
                head, item = self.part(item, n)
                self._put(k, head)
            else:
                self._close(k)

    def flush(self) -> None:
        if not self.cut:
            while self.open:
                self._close(0)
            return
        rest = [x for o in self.open for x in o.items]
        self.open, self.left = [], np.empty((0, 3))
        total = sum(x.length for x in rest)
        rest.reverse()
        while rest:
            goal = min(self.limits.tokens, 1 << (total.bit_length() - 1))
            left, now = self.cap.copy(), []
            left[0] = goal
            while rest and (n := self._room(rest[-1], left)):
                head, tail = self.part(rest.pop(), n)
                if tail.length:
                    rest.append(tail)
                now.append(head)
                left -= (n, 1, head.loss.sum())
                total -= n
            self.emit(now)


OUT = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("loss_tokens", pa.int64()), ("ids", pa.binary()),
])


def pack_texts(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text: str = "text",
    end_id: int = 0,
    limits: Limits = Limits(),
    cut: bool = True,
    max_open: int = 32,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens, and the piece's ids (little-endian unsigned 32 bits).

    Each text becomes its ids by the tokenizer file and ``end_id``; all but a
    text's first token bear loss, as nothing predicts that one. Null and empty
    texts are one ``end_id``. Equal rows are packed as often as they occur; null
    ids stay null; no rows give no pieces; other columns aren't read.
    """
    names = [f.name for f in OUT if with_ids or f.name != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = ByteEncoder(tokenizer)
        rows: list[tuple] = []
        count = 0

        def emit(items: list[Item]) -> None:
            nonlocal count
            at, seq = 0, (partition_id() << 36) + count
            count += 1
            for x in items:
                ids = x.payload[x.start : x.start + x.length].astype("<u4").tobytes()
                rows.append((x.key, x.start, x.length, zlib.crc32(ids), len(x.payload), seq, at, int(x.loss.sum()), ids)[: len(names)])
                at += x.length

        packer = Packer(limits, cut, emit, max_open)

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            batch = pa.RecordBatch.from_arrays([pa.array(c, OUT.field(n).type) for c, n in zip(cols, names, strict=True)], names=names)
            rows.clear()
            return batch

        end = np.array([end_id], enc.dtype)
        for batch in slices(batches):
            keys = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(keys, enc.encode(texts), strict=True):
                ids = np.concatenate([ids, end])
                loss = np.ones(len(ids), np.int8)
                loss[0] = 0
                packer.add(Item(key, 0, len(ids), loss, ids))
            if len(rows) >= 512:
                yield out()
        packer.flush()
        yield out()

    kinds = {"ids": "binary"}
    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, ", ".join(f"{n} {kinds.get(n, 'long')}" for n in names))


def pack_examples(rows: DataFrame, id_col: str, tokens: str, loss_tokens: str, limits: Limits, max_open: int = 64) -> DataFrame:
    """Whole examples of instruction data, never cut: id, sequence_id, offset.

    ``tokens`` and ``loss_tokens`` are counts; null counts as 0 and an example
    without tokens gets no place. An example beyond a limit is an error that names it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        count = 0

        def emit(items: list[Item]) -> None:
            nonlocal count
            at = 0
            for x in items:
                rows.append((x.key, (partition_id() << 36) + count, at))
                at += x.length
            count += 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "sequence_id", "offset"])
            rows.clear()
            return batch

        packer = Packer(limits, False, emit, max_open)
        for batch in batches:
            for key, n, m in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                loss = np.zeros(n or 0, np.int8)
                loss[: min(m or 0, n or 0)] = 1
                packer.add(Item(key, 0, n or 0, loss))
            yield out()
        packer.flush()
        yield out()

    return rows.select(F.col(id_col).cast("long"), F.col(tokens).cast("long"), F.col(loss_tokens).cast("long")).mapInArrow(
        run, "id long, sequence_id long, offset long"
    )


def op5_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 1024 tokens."""
    return pack_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
