"""Class-based bigram language model with classes from exchange clustering.

P(text) is the product over its tokens of P(class | class before) P(word | class).

Words are counted over the whole corpus. The most frequent ones are the core, up to
a number that bounds the model's tables (2**17 words); texts are written once as
numbers of core words, with the hashes of the words outside the core beside them.
Exchange clustering has three steps. The most frequent core words and hashed endings
of all others are units of a matrix of fixed size, in which units move one at a time
to the class that raises the likelihood most. Then all core words move, at the same
time, by the same gain, from counts of the classes next to each; twice. Last, each word
outside the core moves by the classes next to it, its gain taken to first order, as
its few occurrences hardly change a class's counts, if that is more than chance would
give a word of one or two occurrences. Words that training never saw have the class of
their hashed ending.

Counts of fixed size are summed in each task and merged block by block in a tree of
tasks; what grows with the vocabulary is a table that meets the texts in a join. A
word outside the core makes up less than 1 in 2**17 of all tokens, so no key is hot.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partition_id, shuffle_partitions, slices, table

#: The end of a text: its hash, shape, unit and class.
END = 0
ADD = 0.1


@dataclass(frozen=True)
class Shape:
    """Units for frequent words, units for endings, classes (256 at most), the backing-off weight, passes of the exchange of units and of core words, the core's size, and by how much (in nats) its contexts must speak for another class before a word outside the core leaves that of its ending."""

    words: int = 3072
    endings: int = 1023
    classes: int = 64
    weight: float = 100.0
    passes: int = 8
    core: int = 1 << 17
    core_passes: int = 2
    proof: float = 3.0

    @property
    def units(self) -> int:
        return 1 + self.words + self.endings


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only ASCII is folded and splits


def word_hash(word: bytes) -> int:
    """63-bit hash by which a word is known; 0 is the end's."""
    return (xxhash.xxh3_64_intdigest(word) >> 1) or 1


def ending(word: bytes, n: int) -> int:
    return zlib.crc32(word[-3:] + bytes([min(len(word) // 4, 4)])) % n


def held_out(doc: Column) -> Column:
    """crc32 of the id as text, modulo 10, is 0; a null id is in training."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(docs: DataFrame, shape: Shape) -> DataFrame:
    """(h, ending, n) of the training texts; the end has h 0 and ending -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        ends = 0

        def out() -> pa.RecordBatch:
            words = list(counts)
            h = [*map(word_hash, words), END]
            e = [*(ending(w, shape.endings) for w in words), -1]
            batch = pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(e, pa.int32()), pa.array([*counts.values(), ends], pa.int64())], names=["h", "ending", "n"])
            counts.clear()
            return batch

        for batch in slices(batches, 512):
            for text in batch.column(0).to_pylist():
                counts.update(tokens(text))
            ends += batch.num_rows
            if len(counts) > 300_000:
                yield out()
                ends = 0
        if ends:
            yield out()

    rows = docs.where("not held_out").select("text").mapInArrow(run, "h long, ending int, n long")
    return rows.groupBy("h").agg(F.min("ending").alias("ending"), F.sum("n").alias("n"))


def core_words(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(h, ending, n) of at most ``most`` words, most frequent first: all that occur at least as often as a bound, found from counts of counts."""
    n = F.col("n")
    bins = F.when(n < 1024, n).otherwise(1024 + F.floor(F.log2(n / 1024) * 64)).cast("long")
    words = counts.where(F.col("h") != END)
    have, least = 0, None
    for r in sorted(words.groupBy(bins.alias("bin")).agg(F.count("*").alias("words"), F.min("n").alias("least")).collect(), key=lambda r: -r["bin"]):
        have += r["words"]
        if have > most:
            break
        least = r["least"]
    rows = [] if least is None else words.where(n >= least).select("h", "ending", "n").toArrow().to_pylist()
    rows.sort(key=lambda r: (-r["n"], r["h"]))
    return tuple(np.array([r[k] for r in rows], np.int64) for k in ("h", "ending", "n"))


def numbered(docs: DataFrame, core: np.ndarray, shape: Shape) -> DataFrame:
    """(row, doc_id, held_out, ids, rare, endings) of each text: ids (32 bits each) are 0 for the end, the place of a core word from 1 on, and beyond the core the places in ``rare`` (hashes) and ``endings`` of the text's distinct other words."""
    last = len(core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = dict(zip(core.tolist(), range(1, last + 1), strict=True))
        known: dict[bytes, int] = {}
        hashes, ends = [], []

        def learn(words: list[bytes]) -> None:
            if len(known) > 300_000:
                known.clear()
                hashes.clear()
                ends.clear()
            for w in words:
                if w not in known:
                    h = word_hash(w)
                    if h in place:
                        known[w] = place[h]
                    else:
                        hashes.append(h)
                        ends.append(ending(w, shape.endings))
                        known[w] = last + len(hashes)

        row = partition_id() << 36
        for batch in slices(batches, 256):
            ids, rare, endings = [], [], []
            for text in batch.column(2).to_pylist():
                words = tokens(text)
                try:
                    u = np.array([known[w] for w in words], np.int64)
                except KeyError:
                    learn(words)
                    u = np.array([known[w] for w in words], np.int64)
                at = np.flatnonzero(u > last)
                own, inverse = np.unique(u[at], return_inverse=True)
                own = (own - last - 1).tolist()
                u[at] = last + 1 + inverse
                ids.append(np.append(u, END).astype("<u4").tobytes())
                rare.append(np.array([hashes[k] for k in own], np.int64))
                endings.append(np.array([ends[k] for k in own], "<u2").tobytes())
            offsets = pa.array(np.cumsum([0, *map(len, rare)]), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*rare, np.empty(0, np.int64)])))
            rows = pa.array(np.arange(row, row + batch.num_rows))
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([rows, *batch.columns[:2], pa.array(ids, pa.binary()), lists, pa.array(endings, pa.binary())], names=["row", "doc_id", "held_out", "ids", "rare", "endings"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "row long, doc_id long, held_out boolean, ids binary, rare array<long>, endings binary")


class Tally:
    """Sums of counts under many keys, an array of fixed size; sent as compressed blocks of keys."""

    def __init__(self, size: int, block: int) -> None:
        self.total, self.block = np.zeros(size, np.int32), block
        self.held, self.have = [], 0

    def add(self, *keys: np.ndarray) -> None:
        self.held += keys
        self.have += sum(map(len, keys))
        if self.have > 2_000_000:
            self.settle()

    def settle(self) -> None:
        if self.held:
            keys, counts = np.unique(np.concatenate(self.held), return_counts=True)
            self.total[keys] += counts.astype(np.int32)
            self.held, self.have = [], 0

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for lo in range(0, len(self.total), self.block):
            part = self.total[lo : lo + self.block]
            if len(at := np.flatnonzero(part)):
                yield packed(lo // self.block, partition_id(), at, part[at])


def packed(lo: int, part: int, at: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    raw = zstandard.ZstdCompressor(level=1).compress(np.diff(at, prepend=0).astype("<u4").tobytes() + counts.astype("<u8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([lo], pa.int32()), pa.array([part], pa.int32()), pa.array([len(at)], pa.int64()), pa.array([raw], pa.binary())], names=["lo", "part", "size", "raw"])


def unpacked(size: int, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    return np.cumsum(np.frombuffer(raw, "<u4", size), dtype=np.int64), np.frombuffer(raw, "<u8", size, 4 * size).astype(np.int64)


PACKED = "lo int, part int, size long, raw binary"


def summed(parts: DataFrame, tasks: int, block: int, fan: int = 64) -> DataFrame:
    """One row a block: the parts of up to ``fan`` tasks are summed in one place, then those sums, until each block is one."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for lo, part, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lo, part) != now:
                    if now is not None:
                        at = np.flatnonzero(total)
                        yield packed(*now, at, total[at])
                    now, total = (lo, part), np.zeros(block, np.int64)
                at, counts = unpacked(size, raw)
                total[at] += counts
        if now is not None:
            at = np.flatnonzero(total)
            yield packed(*now, at, total[at])

    while True:
        tasks = -(-tasks // fan)
        parts = parts.withColumn("part", F.floor(F.col("part") / fan).cast("int") if tasks > 1 else F.lit(0))
        parts = parts.repartition("lo", "part").sortWithinPartitions("lo", "part").mapInArrow(merge, PACKED)
        if tasks <= 1:
            return parts


def class_ids(ids: np.ndarray, endings: bytes, of_core: np.ndarray, of_ending: np.ndarray) -> np.ndarray:
    """What two tables say of core words and endings, for each token of a text."""
    last = len(of_core) - 1
    out = of_core[np.minimum(ids, last)]
    at = ids > last
    if at.any():
        out[at] = of_ending[np.frombuffer(endings, "<u2")][ids[at] - last - 1]
    return out


def unit_bigrams(texts: DataFrame, unit_of: np.ndarray, shape: Shape, tasks: int, block: int = 1 << 18) -> np.ndarray:
    """The matrix of unit bigram counts over the training texts, each text between two ends: units x units numbers, whatever the corpus."""
    n = shape.units

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(n * n, block)
        of_ending = np.arange(1 + shape.words, n)
        for batch in slices(batches, 512):
            for ids, endings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                u = class_ids(np.frombuffer(ids, "<u4"), endings, unit_of, of_ending)
                tally.add(np.append(END, u[:-1]) * n + u)
        yield from tally.batches()

    parts = texts.where("not held_out").select("ids", "endings").mapInArrow(run, PACKED)
    matrix = np.zeros(-(-n * n // block) * block)  # doubles at once, as the exchange wants them: 134 MB on the driver
    for row in summed(parts, tasks, block).toLocalIterator():
        at, counts = unpacked(row["size"], bytes(row["raw"]))
        matrix[row["lo"] * block + at] += counts
    return matrix[: n * n].reshape(n, n)


#: Core words of which the counts of classes next to them are one block.
WORDS_A_BLOCK = 1024


def move_core(texts: DataFrame, scratch: Scratch, of_core: np.ndarray, of_ending: np.ndarray, k: int, tasks: int, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(classes of core words after all have moved at the same time, counts of class bigrams before)."""
    last = len(of_core) - 1
    block = WORDS_A_BLOCK * 2 * k
    size = -(-(last + 1) // WORDS_A_BLOCK) * block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, pair = Tally(size, block), Tally(k * k, k * k)
        for batch in slices(batches, 512):
            for ids, endings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(ids, "<u4").astype(np.int64)
                c = class_ids(ids, endings, of_core, of_ending).astype(np.int64)
                before, after = np.append(END, c[:-1]), np.append(c[1:], END)
                own = np.flatnonzero((ids > END) & (ids <= last))
                tally.add(ids[own] * (2 * k) + before[own], ids[own] * (2 * k) + k + after[own])
                pair.add(before * k + c)
        yield from tally.batches()
        for row in pair.batches():
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), *row.columns[1:]], names=row.schema.names)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, size, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, counts = unpacked(size, raw)
                total = np.zeros(block, np.int64)
                total[at] = counts
                words = np.arange(lo * WORDS_A_BLOCK, min((lo + 1) * WORDS_A_BLOCK, last + 1))
                total = total.reshape(-1, 2, k)[: len(words)].astype(np.float64)
                best = np.concatenate([best_classes(pair, of_core[words[i : i + 64]].astype(np.int64), total[i : i + 64, 0], total[i : i + 64, 1]) for i in range(0, len(words), 64)])
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(best, pa.int32())], names=["word", "of"])

    parts = texts.where("not held_out").select("ids", "endings").mapInArrow(run, PACKED)
    sums = scratch.write(summed(parts, tasks, max(block, k * k)), name, "none")
    pair = np.zeros(k * k)
    for row in sums.where("lo = -1").collect():
        at, counts = unpacked(row["size"], bytes(row["raw"]))
        pair[at] = counts
    pair = pair.reshape(k, k)
    out = of_core.copy()
    moved = sums.where("lo >= 0").mapInArrow(assign, "word long, of int").toArrow()
    out[moved.column("word").to_numpy()] = moved.column("of").to_numpy()
    out[END] = END
    return out, pair


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchange(counts: np.ndarray, k: int, passes: int) -> np.ndarray:
    """A class below ``k`` for each unit; class 0 is the end's alone.

    Maximises the sum of N(a,b) log N(a,b) over class pairs less that of N(a) log N(a)
    for both margins. Units start by rank of frequency in turn; in each pass every
    unit, most frequent first, moves to its best class, all class counts exact at any
    time. Ends when a pass moves nothing. Units that don't occur stay where they are.
    """
    n = len(counts)
    c = counts.astype(np.float64, copy=False)
    freq = c.sum(1) + c.sum(0)
    order = np.argsort(-freq[1:], kind="stable") + 1
    cls = np.zeros(n, np.int64)
    if k < 2:
        return cls
    cls[order] = 1 + np.arange(n - 1) % (k - 1)
    onehot = np.zeros((n, k))
    onehot[np.arange(n), cls] = 1
    pair = onehot.T @ c @ onehot
    ct = np.ascontiguousarray(c.T)
    order = [u for u in order.tolist() if freq[u]]
    for _ in range(passes):
        moved = 0
        for u in order:
            a, own = cls[u], c[u, u]
            right = np.bincount(cls, c[u], k)
            left = np.bincount(cls, ct[u], k)
            right[a] -= own
            left[a] -= own
            pair[a] -= right  # u leaves its class
            pair[:, a] -= left
            pair[a, a] -= own
            rows, cols = pair.sum(1), pair.sum(0)
            # gain of joining b: row b gets `right`, column b gets `left`, the corner both and u's own pair
            gain = (_xlogx(pair + right) - _xlogx(pair)).sum(1) + (_xlogx(pair + left[:, None]) - _xlogx(pair)).sum(0)
            corner = np.diag(pair)
            gain += _xlogx(corner + right + left + own) + _xlogx(corner) - _xlogx(corner + right) - _xlogx(corner + left)
            gain -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            gain[0] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9 * abs(gain[a]):
                b = a
            cls[u] = b
            pair[b] += right
            pair[:, b] += left
            pair[b, b] += own
            moved += b != a
        if not moved:
            break
    return cls


@dataclass
class Model:
    """All of fixed size: the core's hashes, counts and classes, classes of endings, class masses and log10 transitions; and the written texts as classes."""

    shape: Shape
    core: np.ndarray
    core_counts: np.ndarray
    of_core: np.ndarray
    of_ending: np.ndarray
    mass: np.ndarray
    unknown: np.ndarray
    step: np.ndarray
    total: int
    distinct: int
    ends: int
    texts: DataFrame


def best_classes(pair: np.ndarray, now: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The class of most exchange gain for each word, by its class now and how often each class stands before and after it."""
    m = np.arange(len(now))
    p = np.repeat(pair[None], len(now), 0)
    p[m, now] -= right
    p[m, :, now] -= left
    p = np.maximum(p, 0)
    base = _xlogx(p)
    gain = (_xlogx(p + right[:, None, :]) - base).sum(2) + (_xlogx(p + left[:, :, None]) - base).sum(1)
    corner, rows, cols = np.diagonal(p, 0, 1, 2), p.sum(2), p.sum(1)
    gain += _xlogx(corner + right + left) + _xlogx(corner) - _xlogx(corner + right) - _xlogx(corner + left)
    gain -= _xlogx(rows + right.sum(1)[:, None]) - _xlogx(rows) + _xlogx(cols + left.sum(1)[:, None]) - _xlogx(cols)
    gain[:, END] = -np.inf
    best = gain.argmax(1)
    return np.where(gain[m, best] > gain[m, now] + 1e-9 * np.abs(gain[m, now]), best, now)


def first_order(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What a word gains in each class by a class before it, one after it, and by each of its occurrences."""
    follow = np.log(pair + 1.0)
    return follow, follow.T.copy(), np.log(pair.sum(1) + 1.0) + np.log(pair.sum(0) + 1.0)


def rare_classes(texts: DataFrame, of_core: np.ndarray, of_ending: np.ndarray, pair: np.ndarray, shape: Shape, parts: int) -> DataFrame:
    """(h, c, of): count and class of each word of the training texts outside the core."""
    last, k = len(of_core) - 1, shape.classes
    gain_before, gain_after, gain_each = first_order(pair)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            hashes = batch.column(2)
            lists, cuts = hashes.flatten(), hashes.offsets.to_numpy()
            around, counts, start = [], [], []
            for ids, endings, lo, hi in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                ids = np.frombuffer(ids, "<u4").astype(np.int64)
                c = class_ids(ids, endings, of_core, of_ending)
                at = np.flatnonzero(ids > last)
                at = at[np.argsort(ids[at], kind="stable")]
                around.append(np.stack([np.where(at > 0, c[at - 1], END), c[at + 1]], 1).astype(np.uint8))
                counts.append(np.bincount(ids[at] - last - 1, minlength=hi - lo))
                start.append(of_ending[np.frombuffer(endings, "<u2")])
            if counts:
                n = np.concatenate(counts)
                offsets = np.concatenate([[0], np.cumsum(2 * n)]).astype(np.int32)
                both = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.concatenate(around).tobytes())])
                yield pa.RecordBatch.from_arrays([lists, pa.array(np.concatenate(start).astype(np.int16)), both], names=["h", "start", "around"])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last word of a batch can go on in the next one

        def done(h: np.ndarray, start: np.ndarray, before: np.ndarray, after: np.ndarray) -> pa.RecordBatch:
            n = before.sum(1)
            gain = before @ gain_before + after @ gain_after - n[:, None] * gain_each
            gain[:, END] = -np.inf
            best, each = gain.argmax(1), np.arange(len(n))
            best = np.where(gain[each, best] > gain[each, start] + shape.proof, best, start)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64)), pa.array(best.astype(np.int32))], names=["h", "c", "of"])

        for batch in slices(batches, 4096):  # sorted by h
            h, start, around = (batch.column(i) for i in range(3))
            h, start = h.to_numpy(), start.to_numpy()
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            offsets = np.frombuffer(around.buffers()[1], np.int32)[around.offset : around.offset + len(around) + 1]
            seen = np.frombuffer(around.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 2)
            group = np.repeat(np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h)))), np.diff(offsets) // 2) * k
            before, after = (np.bincount(group + seen[:, i], minlength=len(first) * k).reshape(-1, k).astype(np.float64) for i in (0, 1))
            names, start = h[first], start[first]
            if rest is not None:
                if rest[0][0] == names[0]:
                    before[0] += rest[2][0]
                    after[0] += rest[3][0]
                else:
                    yield done(*rest)
            if len(names) > 1:
                yield done(names[:-1], start[:-1], before[:-1], after[:-1])
            rest = names[-1:], start[-1:], before[-1:], after[-1:]
        if rest is not None:
            yield done(*rest)

    rows = texts.where("not held_out").select("ids", "endings", "rare").mapInArrow(contexts, "h long, start short, around binary")
    return rows.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(assign, "h long, c long, of int")


def train(docs: DataFrame, scratch: Scratch, shape: Shape = Shape()) -> tuple[Model, DataFrame]:
    """The model, and the table (h, c, of: count and class) of all training words, the end included."""
    if not 2 <= shape.classes <= 256:
        raise ValueError("there can be 2 to 256 classes")
    spark, k = scratch.spark, shape.classes
    counts = scratch.write(word_counts(docs, shape), "words", "snappy")
    core, core_ending, core_n = core_words(counts, shape.core)
    texts = scratch.write(numbered(docs, core, shape), "numbers")
    tasks = texts.rdd.getNumPartitions()
    unit_of = np.concatenate([[END], np.arange(1, len(core) + 1)])
    unit_of[1 + shape.words :] = 1 + shape.words + core_ending[shape.words :]
    units = exchange(unit_bigrams(texts, unit_of, shape, tasks), k, shape.passes)
    of_core, of_ending = units[unit_of].astype(np.uint8), units[1 + shape.words :].astype(np.uint8)
    for i in range(shape.core_passes):
        of_core, _ = move_core(texts, scratch, of_core, of_ending, k, tasks, f"core{i}")
    own = texts.select("ids", "endings", "held_out")
    pair = class_counts(own, of_core, of_ending, k)
    rare = scratch.write(rare_classes(texts, of_core, of_ending, pair, shape, shuffle_partitions(spark)), "rare", "snappy")

    mass, unknown = np.zeros(k), np.full(k, ADD)
    np.add.at(mass, of_core[1:], core_n + ADD)
    np.add.at(unknown, of_core[1:][core_n == 1], 1)
    total, distinct = int(core_n.sum()), len(core)
    for r in rare.groupBy("of").agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count(F.when(F.col("c") == 1, 1)).alias("once")).collect():
        mass[r["of"]] += r["n"] + ADD * r["v"]
        unknown[r["of"]] += r["once"]
        total, distinct = total + r["n"], distinct + r["v"]
    ends = next((r["n"] for r in counts.where(F.col("h") == END).collect()), 0)
    total, distinct = total + ends, distinct + (ends > 0)
    unknown[END] = 0
    mass += unknown
    mass[END] = ends + ADD
    m = Model(shape, core, core_n, of_core, of_ending, mass, unknown, np.zeros((k, k)), total, distinct, ends, docs)
    m.texts = scratch.write(as_classes(texts, m, rare), "texts")
    scratch.drop("numbers")
    pair = np.zeros((k, k))
    for r in class_bigrams(m.texts, k).collect():
        pair[r["a"] // k, r["a"] % k] = r["n"]
    m.step = np.log10((pair + shape.weight * mass / mass.sum()) / (pair.sum(1, keepdims=True) + shape.weight))
    inner = [*zip(core.tolist(), core_n.tolist(), of_core[1:].tolist(), strict=True), *([(END, ends, END)] if ends else [])]
    return m, rare.union(spark.createDataFrame(inner, "h long, c long, of int"))


def class_counts(texts: DataFrame, of_core: np.ndarray, of_ending: np.ndarray, k: int) -> np.ndarray:
    """Counts of class bigrams in the training texts, words outside the core by their endings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in slices(batches, 512):
            for ids, endings in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = class_ids(np.frombuffer(ids, "<u4"), endings, of_core, of_ending).astype(np.int64)
                total += np.bincount(np.append(END, c[:-1]) * k + c, minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["a", "n"])

    pair = np.zeros(k * k)
    for r in texts.where("not held_out").select("ids", "endings").mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n")).collect():
        pair[r["a"]] = r["n"]
    return pair.reshape(k, k)


def class_bigrams(texts: DataFrame, k: int) -> DataFrame:
    """(a, n): how often each pair of classes, as one number, stands in the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, np.int64)
        for batch in slices(batches, 512):
            for raw in batch.column(0).to_pylist():
                c = np.frombuffer(raw, np.uint8).astype(np.int64)
                total += np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["a", "n"])

    return texts.where("not held_out").select("classes").mapInArrow(run, "a int, n long").groupBy("a").agg(F.sum("n").alias("n"))


def as_classes(texts: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, emitted and classes (8 bits each, between two ends) of each row.

    The distinct words outside the core that a text holds go, as hashes with their
    places in its list, to where their counts and classes are, and those come back.
    """
    m = model
    floor = math.log10(m.total + ADD * (m.distinct + 1)) if m.total + m.distinct else math.log10(ADD)
    log_mass = np.log10(np.maximum(m.mass, 1e-300))
    count = np.concatenate([[m.ends], m.core_counts])
    base_core = np.log10(count + ADD) - floor
    emit_core = np.log10(count + ADD) - log_mass[m.of_core]
    emit_core[END] = 0.0
    unseen = np.log10(np.maximum(m.unknown, 1e-300)) - log_mass
    of_core, of_ending, ends, last = m.of_core, m.of_ending, m.ends, len(m.core)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            n_tokens, n_known, bases, scores, raw = [], [], [], [], []
            found = batch.column(4)
            at, c, of = (x.to_numpy() for x in found.flatten().flatten())
            cuts = np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())]).tolist()
            for ids, endings, lo, hi in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), cuts[:-1], cuts[1:], strict=True):
                ids = np.frombuffer(ids, "<u4").astype(np.int64)
                own = ids <= last
                core = ids[own]
                known, base, score = int((core > END).sum()) + (ends > 0), base_core[core].sum(), emit_core[core].sum()
                cls = of_core[np.minimum(ids, last)]
                if len(core) < len(ids):
                    start = of_ending[np.frombuffer(endings, "<u2")].astype(np.int64)
                    counts = np.zeros(len(start), np.int64)
                    start[at[lo:hi]], counts[at[lo:hi]] = of[lo:hi], c[lo:hi]
                    j = ids[~own] - last - 1
                    cls[~own] = start[j]
                    known += int((counts[j] > 0).sum())
                    logs = np.log10(counts + ADD)
                    base += (logs - floor)[j].sum()
                    score += np.where(counts > 0, logs - log_mass[start], unseen[start])[j].sum()
                n_tokens.append(len(ids))
                n_known.append(known)
                bases.append(float(base))
                scores.append(float(score))
                raw.append(b"\0" + cls.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(bases, pa.float64()), pa.array(scores, pa.float64()), pa.array(raw, pa.binary())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "classes"],
            )

    asked = texts.select("row", F.posexplode("rare").alias("at", "h"))
    found = asked.join(rare, "h").groupBy("row").agg(F.collect_list(F.struct("at", "c", "of")).alias("found"))
    both = texts.select("row", "doc_id", "held_out", "ids", "endings").join(found, "row", "left").select("doc_id", "held_out", "ids", "endings", "found")
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, emitted double, classes binary")


def score(model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row: what its words emit, and its transitions."""
    step = model.step

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            cs = [np.frombuffer(raw, np.uint8) for raw in batch.column(6).to_pylist()]
            total = [e + float(step[c[:-1], c[1:]].sum()) for e, c in zip(batch.column(5).to_pylist(), cs, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(total, pa.float64())], names=[*batch.schema.names[:5], "score"])

    out = model.texts.select("doc_id", "held_out", "n_tokens", "n_known", "base_score", "emitted", "classes").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )


def brown_scores(docs: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the rows that aren't held out and scores all.

    A null or empty text is its end alone. Rows that repeat are scored each. Other
    columns aren't read. Without rows there are none; without training rows every
    word is unknown.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("text"))
    model, _ = train(own, Scratch(docs.sparkSession, "brown"), shape)
    return score(model)


def op1_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of every row of ``documents`` under the class-based model."""
    return brown_scores(table(spark, sf_dir, "documents"))
