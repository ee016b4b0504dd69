"""Token-id files: fixed-size blocks, transposed into bit or byte planes, each plane compressed.

File layout (all integers little-endian): magic ``SKPL``, format byte, plane kind
byte (0 bytes, 1 bits), id width in bytes (2 or 4), a zero byte; the compressed
planes of every block, plane after plane; then the footer, compressed: number of
documents, ids and blocks, per document its id and length, per block its offset,
number of ids and the sizes of its planes; last, a trailer of fixed size: number of
ids (8 bytes), the file's part and place in it (4 each), the footer's offset (8), and
``SKPL`` with a newline. A document never spans two files; blocks ignore document
bounds. Files are written by Spark's text writer, a row a file, so any store that
Spark reaches will do; a reader needs the trailer, the footer and the blocks that it
wants, not the file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, partition_id, shuffle_partitions, slices, table
from .tokens import WordEncoder

MAGIC, END = b"SKPL", b"SKPL\n"
TRAILER = "<QIIQ5s"
TRAILER_SIZE = struct.calcsize(TRAILER)
BLOCK = 1 << 16
#: Files up to which their numbers are broadcast to where they are read.
BROADCAST_FILES = 100_000


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of one block, most significant first; a bit plane's last byte is filled with zeros."""
    raw = ids.astype(ids.dtype.newbyteorder(">")).view(np.uint8).reshape(len(ids), ids.itemsize)
    if bits:
        return [np.packbits(p).tobytes() for p in np.unpackbits(raw, axis=1).T]
    return [np.ascontiguousarray(p).tobytes() for p in raw.T]


def from_planes(planes: list[bytes], n: int, width: int, bits: bool) -> np.ndarray:
    if bits:
        m = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes])
        raw = np.packbits(np.ascontiguousarray(m.T), axis=1)
    else:
        raw = np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in planes]).T)
    return raw.view(f">u{width}").reshape(n).astype(f"<u{width}")


def write_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: bool = False, level: int = 3, part: int = 0, seq: int = 0) -> bytes:
    z = zstandard.ZstdCompressor(level=level)
    width, n_planes = ids.itemsize, ids.itemsize * (8 if bits else 1)
    out = [MAGIC, bytes([1, bits, width, 0])]
    at, index = 8, []
    for lo in range(0, len(ids), BLOCK):
        block = ids[lo : lo + BLOCK]
        planes = [z.compress(p) for p in to_planes(block, bits)]
        index.append(struct.pack(f"<QI{n_planes}I", at, len(block), *map(len, planes)))
        out += planes
        at += sum(map(len, planes))
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    footer = struct.pack("<QQQ", len(doc_ids), len(ids), len(index)) + nulls.tobytes() + keys.tobytes() + np.array(lengths, "<i8").tobytes() + b"".join(index)
    return b"".join([*out, z.compress(footer), struct.pack(TRAILER, len(ids), part, seq, at, END)])


class PlaneFile:
    """Reads a file's trailer and index at once and its blocks on demand, by a function of an offset and a number of bytes."""

    def __init__(self, read: Callable[[int, int], bytes], size: int) -> None:
        if size < 8 + TRAILER_SIZE:
            raise ValueError("not a plane file")
        head, (self.n_ids, self.part, self.seq, at, end) = read(0, 8), struct.unpack(TRAILER, read(size - TRAILER_SIZE, TRAILER_SIZE))
        if head[:4] != MAGIC or end != END or head[4] != 1:
            raise ValueError("not a plane file")
        self.read, self.bits, self.width = read, bool(head[5]), head[6]
        self.z = zstandard.ZstdDecompressor()
        footer = self.z.decompress(read(at, size - TRAILER_SIZE - at))
        docs, _, blocks = struct.unpack_from("<QQQ", footer)
        nulls = np.frombuffer(footer, np.uint8, docs, 24)
        keys = np.frombuffer(footer, "<i8", docs, 24 + docs).tolist()
        self.doc_ids = [None if x else k for x, k in zip(nulls, keys, strict=True)]
        self.lengths = np.frombuffer(footer, "<i8", docs, 24 + 9 * docs)
        n = self.width * (8 if self.bits else 1)
        form = struct.Struct(f"<QI{n}I")
        self.blocks = [form.unpack_from(footer, 24 + 17 * docs + k * form.size) for k in range(blocks)]

    @classmethod
    def of(cls, content: bytes) -> PlaneFile:
        return cls(lambda at, n: content[at : at + n], len(content))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PlaneFile:
        """A file in any store that Spark reaches, read in ranges (on the driver)."""
        jvm = spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        store = where.getFileSystem(spark._jsc.hadoopConfiguration())
        stream = store.open(where)

        def read(at: int, n: int) -> bytes:
            stream.seek(at)
            return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n))

        return cls(read, store.getFileStatus(where).getLen())

    def block(self, k: int) -> np.ndarray:
        at, n, *sizes = self.blocks[k]
        planes = []
        raw = self.read(at, sum(sizes))
        at = 0
        for size in sizes:
            planes.append(self.z.decompress(raw[at : at + size]))
            at += size
        return from_planes(planes, n, self.width, self.bits)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids from lo to hi, decoding only the blocks that hold them."""
        if hi <= lo:
            return np.empty(0, f"<u{self.width}")
        a, b = lo // BLOCK, (hi - 1) // BLOCK
        return np.concatenate([self.block(k) for k in range(a, b + 1)])[lo - a * BLOCK : hi - a * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids), a block at a time in memory beside the document."""
        rest, k, start = np.empty(0, f"<u{self.width}"), 0, 0
        for doc, n in zip(self.doc_ids, self.lengths.tolist(), strict=True):
            parts = [rest]
            have = len(rest)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            rest = np.concatenate(parts) if len(parts) > 1 else rest
            yield doc, start, rest[:n]
            rest, start = rest[n:], start + n


def write_planes(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text: str = "text",
    end_id: int = 1, bits: bool = False, file_ids: int = 1 << 21,
) -> None:
    """Encodes all texts and writes them in ascending id order, as files of at least ``file_ids`` ids but for each part's last.

    Ids are dealt by range, so files of ascending (part, place) hold ascending
    ids; null ids come first, equal ids next to each other. A task holds one
    file's ids. A null or empty text is ``end_id`` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        keys, lengths, parts, have, seq = [], [], [], 0, 0

        def out() -> pa.RecordBatch:
            content = write_file(keys, lengths, np.concatenate(parts), bits, part=partition_id(), seq=seq)
            return pa.RecordBatch.from_arrays([pa.array([content[:-1]], pa.binary())], names=["value"])  # the writer adds the newline

        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                keys.append(key)
                lengths.append(len(ids) + 1)
                parts += [ids, end]
                have += len(ids) + 1
                if have >= file_ids:
                    yield out()
                    keys, lengths, parts, have, seq = [], [], [], 0, seq + 1
        if keys:
            yield out()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    dealt = rows.repartitionByRange(shuffle_partitions(docs.sparkSession), "id").sortWithinPartitions("id")
    files = dealt.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    files.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_planes(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a folder.

    A file's base is the number of ids in the files before it, which their trailers
    say: parts' totals, as few as parts, are summed up in a small window, files
    within their part. An empty folder, and the empty file of an empty table, have no rows.
    """
    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)

    def trailers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [struct.unpack(TRAILER, x)[:3] for x in batch.column(1).to_pylist()]
            n, part, seq = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(part, pa.int32()), pa.array(seq, pa.int32()), pa.array(n, pa.int64())], names=["path", "part", "seq", "n_ids"])

    ends = files.select("path", F.expr(f"substring(content, -{TRAILER_SIZE}, {TRAILER_SIZE})"))
    sizes = Scratch(spark, "sizes").write(ends.mapInArrow(trailers, "path string, part int, seq int, n_ids long"), "sizes")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    based = sizes.join(parts, "part").select("path", (F.col("part_base") + F.coalesce(F.sum("n_ids").over(within), F.lit(0))).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            base, content = batch.column(0)[0].as_py(), batch.column(1)[0].as_py()
            rows = [(d, base + s, len(x), zlib.crc32(x.astype("<u4").tobytes())) for d, s, x in PlaneFile.of(content).documents()]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # a row a file: names and numbers, which go to where the files are read
    both = files.select("path", "content").join(F.broadcast(based) if sizes.count() <= BROADCAST_FILES else based, "path").select("base", "content")
    return both.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_plane_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` written as plane files and read back."""
    path = Scratch(spark, "planes").path("files")
    write_planes(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_planes(spark, path)
