"""Reversible line dedup: exact reference-count tables, with sharded cuckoo filters in front.

The index is a set of Parquet tables that insertions and deletions add to:
references (line key, document), counts of documents a line key (as additions and
subtractions), and documents taken away. Over the keys that are frequent enough, each
shard has a cuckoo filter of bounded size, stored as a row; a change inserts the keys
that become frequent into the stored filters and deletes those that no longer are. So a
change costs what it brings, and a reading of counts; every few changes the tables are
summed up. Lines are probed where they are, as long as the filters, measured, are small
enough to be sent there, else where their shard's rows meet. Only lines that pass are
joined with the exact counts, so false positives never change a result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import Scratch, shuffle_partitions, slices, table

BLANK = " \t\n\x0b\x0c\r"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
FOLD = bytes.maketrans(UPPER, LOWER)
#: Lines of a shard that are probed in one place, about; filters up to this size are sent to where lines are.
PROBED = 1_000_000
SENT_BYTES = 32 << 20
#: Frequent lines up to which each one's largest document is sent to where references are, 24 bytes each.
SENT_KEYS = 500_000
#: Changes after which the tables are summed up.
DELTAS = 8


def line_keys(text: str, min_chars: int) -> list[int | None]:
    """For each line the 128-bit hash of its stripped, ASCII-lower-cased form; None where it's too short."""
    out = []
    for line in text.split("\n"):
        s = line.strip(BLANK)
        out.append(xxhash.xxh3_128_intdigest(s.encode("utf-8", "surrogatepass").translate(FOLD)) if len(s) >= min_chars else None)
    return out


class CuckooFilter:
    """Buckets of four 16-bit fingerprints; a key's second bucket follows from its first and its fingerprint.

    Keys are 64-bit hashes. Insertion, deletion and probe are of whole arrays; only keys
    that meet two full buckets go one by one. ``build`` starts half empty and doubles
    until every key finds a place, so no key is ever missing. Buckets are filled
    from their left.
    """

    SLOTS = 4
    KICKS = 500

    def __init__(self, buckets: int) -> None:
        n = 1
        while n < buckets:
            n *= 2
        self.table = np.zeros((n, self.SLOTS), np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> CuckooFilter:
        size = max(1, int(len(keys) / cls.SLOTS / 0.5) + 1)
        while True:
            f = cls(size)
            if f.insert(keys):
                return f
            size = len(f.table) * 2

    def _place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        keys = keys.astype(np.uint64)
        mask = np.uint64(len(self.table) - 1)
        prints = ((keys >> np.uint64(48)) | np.uint64(1)).astype(np.uint64)
        first = keys & mask
        return prints.astype(np.uint16), first.astype(np.int64), (first ^ (prints * np.uint64(0x5BD1E995) & mask)).astype(np.int64)

    def probe(self, keys: np.ndarray) -> np.ndarray:
        prints, a, b = self._place(keys)
        p = prints[:, None]
        return (self.table[a] == p).any(1) | (self.table[b] == p).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """False if a key found no place; the filter is of no use then."""
        prints, a, b = self._place(keys)
        for side in (0, 1):
            order = np.argsort((a, b)[side], kind="stable")
            prints, a, b = prints[order], a[order], b[order]
            bucket = (a, b)[side]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            rank = np.arange(len(bucket)) - np.repeat(first, np.diff(np.append(first, len(bucket))))
            slot = (self.table[bucket] > 0).sum(1) + rank
            fits = slot < self.SLOTS
            self.table[bucket[fits], slot[fits]] = prints[fits]
            prints, a, b = prints[~fits], a[~fits], b[~fits]
        return all(self._kick(int(p), int(at)) for p, at in zip(prints, b, strict=True))

    def _kick(self, p: int, at: int) -> bool:
        mask = len(self.table) - 1
        for kick in range(self.KICKS):  # evict in turn; the walk is deterministic
            slot = (kick * 7 + p) % self.SLOTS
            p, self.table[at, slot] = int(self.table[at, slot]), p
            at ^= (p * 0x5BD1E995) & mask
            free = int((self.table[at] > 0).sum())
            if free < self.SLOTS:
                self.table[at, free] = p
                return True
        return False

    def delete(self, keys: np.ndarray) -> bool:
        """Removes one copy of each key that was inserted; False if one wasn't there."""
        prints, a, b = self._place(keys)
        for p, *buckets in zip(prints.tolist(), a.tolist(), b.tolist(), strict=True):
            for bucket in buckets:
                row = self.table[bucket].tolist()
                if p in row:
                    row.remove(p)
                    self.table[bucket] = [*row, 0]
                    break
            else:
                return False
        return True

    def entries(self) -> list[tuple[int, int]]:
        """What is in the filter whatever the order of changes: fingerprints with the smaller of their buckets."""
        at, slot = np.nonzero(self.table)
        prints = self.table[at, slot].astype(np.uint64)
        other = at.astype(np.uint64) ^ (prints * np.uint64(0x5BD1E995) & np.uint64(len(self.table) - 1))
        return sorted(zip(np.minimum(at, other.astype(np.int64)).tolist(), prints.tolist(), strict=True))

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CuckooFilter:
        f = cls(1)
        f.table = np.frombuffer(raw, np.uint16).reshape(-1, cls.SLOTS).copy()
        return f


def line_refs(docs: DataFrame, min_chars: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(hi, lo, doc): each line key of a document once. Documents with a null id hold no references."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            his, los, ids = [], [], []
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k in {k for k in line_keys(t or "", min_chars) if k is not None} if doc is not None else ():
                    his.append(k >> 64)
                    los.append(k & 0xFFFFFFFFFFFFFFFF)
                    ids.append(doc)
            arrays = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (his, los)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(ids, pa.int64())], names=["hi", "lo", "doc"])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, "hi long, lo long, doc long")


FILTERS = "shard int, filter binary"
KEYS = "hi long, lo long"


class LineIndex:
    """Reference counts of line keys in tables that grow and shrink with their documents.

    Inserting a document whose id is in the index changes nothing. Deleting takes
    its references away again: counts and filters are then as if it had never been
    there, and a line below the threshold comes back.
    """

    def __init__(self, spark: SparkSession, min_chars: int = 20, min_docs: int = 3, shard_keys: int = 200_000) -> None:
        self.spark, self.min_chars, self.min_docs, self.shard_keys = spark, min_chars, min_docs, shard_keys
        self.scratch = Scratch(spark, "lines")
        self.version = 0
        self.refs: list[tuple[int, DataFrame]] = []  # (version, table of hi, lo, doc)
        self.sums: list[DataFrame] = []  # (hi, lo, n): documents that came and went
        self.gone: list[tuple[int, DataFrame]] = []  # (version, documents taken away)
        self.written: list[str] = []  # the tables that go when they are summed up
        self.shards, self.filters = 1, spark.createDataFrame([], FILTERS)

    # tables

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        self.written.append(name)
        return self.scratch.write(df, name, "snappy")

    def references(self) -> DataFrame:
        """(hi, lo, doc) of the documents that are in the index."""
        rows = self.spark.createDataFrame([], f"{KEYS}, doc long, v int")
        for v, t in self.refs:
            rows = rows.union(t.withColumn("v", F.lit(v)))
        if self.gone:
            gone = [t.withColumn("until", F.lit(v)) for v, t in self.gone]
            gone = reduce(DataFrame.union, gone).groupBy("doc").agg(F.max("until").alias("until"))
            rows = rows.join(gone, "doc", "left").where(F.col("until").isNull() | (F.col("v") > F.col("until")))
        return rows.select("hi", "lo", "doc")

    def all_counts(self) -> DataFrame:
        """(hi, lo, n_docs) of all keys."""
        rows = reduce(DataFrame.union, self.sums, self.spark.createDataFrame([], f"{KEYS}, n long"))
        return rows.groupBy("hi", "lo").agg(F.sum("n").alias("n_docs")).where("n_docs > 0")

    def counts(self) -> DataFrame:
        """(hi, lo, n_docs) of the keys that are frequent enough."""
        return self.all_counts().where(F.col("n_docs") >= self.min_docs)

    # changes

    def insert(self, docs: DataFrame) -> None:
        new = line_refs(docs, self.min_chars)
        if self.refs:
            new = new.join(self.references().select("doc").distinct(), "doc", "left_anti").select("hi", "lo", "doc")
        self.version += 1
        new = self._write(new.distinct(), f"refs{self.version}")
        self.refs.append((self.version, new))
        self._count(new, 1)

    def delete(self, docs: DataFrame) -> None:
        """Takes the references of the documents with these ids (column doc_id) away."""
        self.version += 1
        gone = self._write(docs.select(F.col("doc_id").cast("long").alias("doc")).where("doc is not null").distinct(), f"gone{self.version}")
        lost = self._write(self.references().join(gone, "doc", "left_semi").select("hi", "lo", "doc"), f"lost{self.version}")
        self.gone.append((self.version, gone))
        self._count(lost, -1)

    def _count(self, refs: DataFrame, sign: int) -> None:
        """Adds a change to the counts, and its keys that cross the threshold to the filters, or takes them out."""
        change = self._write(refs.groupBy("hi", "lo").agg((F.count("*") * sign).alias("n")), f"sums{self.version}")
        first = not self.sums
        if first:
            crossed = change.where(F.col("n") >= self.min_docs)
        else:
            before = change.join(self.all_counts(), ["hi", "lo"], "left").select("hi", "lo", "n", F.coalesce("n_docs", F.lit(0)).alias("was"))
            now = F.col("was") + F.col("n")
            crossed = before.where((F.col("was") < self.min_docs) & (now >= self.min_docs) if sign > 0 else (F.col("was") >= self.min_docs) & (now < self.min_docs))
        crossed = self._write(crossed.select("hi", "lo"), f"crossed{self.version}")
        self.sums.append(change)
        keys = crossed.count()
        have = self.counts().count() if keys and not first else keys
        if have > self.shards * self.shard_keys:
            while have > self.shards * self.shard_keys:
                self.shards *= 2
            self._rebuild()
        elif keys:
            self._change_filters(crossed, sign)
        if max(len(self.refs), len(self.sums)) > DELTAS:
            self._sum_up()

    def _sum_up(self) -> None:
        v, old = self.version, self.written
        self.written = []
        self.refs, self.sums = [(v, self._write(self.references(), f"refs{v}s"))], [self._write(self.all_counts().withColumnRenamed("n_docs", "n"), f"sums{v}s")]
        self.gone = []
        for name in old:
            self.scratch.drop(name)

    # filters

    def _shard(self) -> Column:
        return F.pmod("hi", F.lit(self.shards)).cast("int").alias("shard")

    def _write_filters(self, df: DataFrame) -> None:
        self.filters = self.scratch.write(df, f"filters{self.version}-{self.shards}", "none")

    def _rebuild(self) -> None:
        """Filters anew from the exact counts: a shard's keys, of bounded number, meet in one task."""

        def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, keys = None, []

            def out() -> pa.RecordBatch:
                raw = CuckooFilter.build(np.concatenate(keys).view(np.uint64)).to_bytes()
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([raw], pa.binary())], names=["shard", "filter"])

            for batch in batches:
                shard, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                for s in np.unique(shard).tolist():
                    if s != now:
                        if keys:
                            yield out()
                        now, keys = s, []
                    keys.append(lo[shard == s])
            if keys:
                yield out()

        keys = self.counts().select(self._shard(), "lo").repartition(shuffle_partitions(self.spark), "shard").sortWithinPartitions("shard")
        self._write_filters(keys.mapInArrow(build, FILTERS))

    def _change_filters(self, keys: DataFrame, sign: int) -> None:
        """Each shard's stored filter meets the keys that are new to it or leave it; one that has no room left is an error row, and all are built anew."""

        def change(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, stored, keys = None, None, []

            def out() -> pa.RecordBatch:
                lo = np.concatenate([*keys, np.empty(0, np.int64)]).view(np.uint64)
                f = CuckooFilter.build(lo) if stored is None else CuckooFilter.from_bytes(stored)
                fine = stored is None or not len(lo) or (f.insert(lo) if sign > 0 else f.delete(lo))
                return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([f.to_bytes() if fine else None], pa.binary())], names=["shard", "filter"])

            for batch in batches:  # sorted: a shard's filter comes before its keys
                for shard, raw, lo in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if shard != now:
                        if now is not None:
                            yield out()
                        now, stored, keys = shard, raw, []
                    if raw is None:
                        keys.append(np.array([lo], np.int64))
            if now is not None:
                yield out()

        both = self.filters.select("shard", "filter", F.lit(None).cast("long").alias("lo")).union(keys.select(self._shard(), F.lit(None).cast("binary"), "lo"))
        both = both.repartition(shuffle_partitions(self.spark), "shard").sortWithinPartitions("shard", F.col("filter").isNull())
        self._write_filters(both.mapInArrow(change, FILTERS))
        if not self.filters.where("filter is null").isEmpty():
            self._rebuild()

    def passed(self) -> DataFrame:
        """(hi, lo, doc) of the references that pass their shard's filter."""
        size = self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
        return self._probe_sent() if size <= SENT_BYTES else self._probe_met()

    def _probe_sent(self) -> DataFrame:
        raw, shards = {r["shard"]: bytes(r["filter"]) for r in self.filters.collect()}, self.shards

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            filters = {s: CuckooFilter.from_bytes(x) for s, x in raw.items()}
            for batch in batches:
                hi, lo = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
                hit, of = np.zeros(len(hi), bool), np.mod(hi, shards)
                for s in np.unique(of).tolist():
                    if s in filters:
                        at = np.flatnonzero(of == s)
                        hit[at] = filters[s].probe(lo[at])
                yield batch.filter(pa.array(hit))

        return self.references().mapInArrow(probe, f"{KEYS}, doc long")

    def _probe_met(self) -> DataFrame:
        """For filters that are too large to send: a shard's lines are dealt over as many places as their number asks for, each with a copy of its filter."""
        spark = self.spark
        lines = self.references().withColumn("shard", self._shard())
        places = self.scratch.write(lines.groupBy("shard").agg(F.ceil(F.count("*") / PROBED).cast("int").alias("places")), f"places{self.version}")
        none = lambda kind: F.lit(None).cast(kind)
        heads = self.filters.join(places, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("places") - 1)).alias("place"), "filter", none("long").alias("hi"), none("long").alias("lo"), none("long").alias("doc"))
        lines = lines.join(F.broadcast(places), "shard").select("shard", F.pmod(F.xxhash64("doc"), F.col("places")).cast("int").alias("place"), none("binary").alias("filter"), "hi", "lo", "doc")

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, now = None, None
            for batch in batches:  # sorted: each place's copy of the filter comes before its lines
                place = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(place)]
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo == hi:
                        continue
                    part = batch.slice(lo, hi - lo)
                    if place[lo] != at:
                        at, now = place[lo], None
                    raw = part.column(2)
                    if heads := len(raw) - raw.null_count:
                        now = CuckooFilter.from_bytes(raw[0].as_py())
                        part = part.slice(heads)
                    if now is not None and part.num_rows:
                        yield part.select([3, 4, 5]).filter(pa.array(now.probe(part.column(4).to_numpy().view(np.uint64))))

        both = heads.union(lines).repartition(shuffle_partitions(spark), "shard", "place").sortWithinPartitions("shard", "place", F.col("filter").isNull())
        return both.mapInArrow(probe, f"{KEYS}, doc long")

    def doomed(self) -> DataFrame:
        """(doc, keys): for each document that loses lines, the keys of those lines: frequent ones, but where it is the largest document that holds them."""
        passed = self.scratch.write(self.passed(), f"passed{self.version}", "snappy")
        keeper = passed.groupBy("hi", "lo").agg(F.max("doc").alias("keeper")).join(self.counts(), ["hi", "lo"]).select("hi", "lo", "keeper")
        keeper = self.scratch.write(keeper, f"keepers{self.version}", "snappy")
        if keeper.count() <= SENT_KEYS:  # else a line that very many documents hold is a key that the join splits
            keeper = F.broadcast(keeper)
        sure = passed.join(keeper, ["hi", "lo"]).where(F.col("doc") < F.col("keeper"))
        return sure.groupBy("doc").agg(F.collect_list(F.struct("hi", "lo")).alias("keys"))


def drop_lines(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds n_lines (before), n_dropped and kept_text, which replace columns of these names; other columns stay as they are.

    A document loses every line whose key is doomed for it; other lines stay,
    joined by newlines. Null and empty texts are one empty line, which stays; rows
    that repeat a document's id are one document, each row losing the same lines.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    gone = index.doomed().select(F.col("doc").alias("_doc"), F.transform("keys", lambda k: k["hi"]).alias("_hi"), F.transform("keys", lambda k: k["lo"]).alias("_lo"))
    joined = docs.join(gone, docs[id_col].cast("long") == gone["_doc"], "left").drop(gone["_doc"])
    min_chars = index.min_chars
    at = docs.columns.index(text)
    added = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            hi, lo = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            ns, ds, ts = [], [], []
            for t, h, l in zip(batch.column(at).to_pylist(), hi, lo, strict=True):  # noqa: E741
                lines = (t or "").split("\n")
                ns.append(len(lines))
                if h:
                    doomed = {((a & 0xFFFFFFFFFFFFFFFF) << 64) | (b & 0xFFFFFFFFFFFFFFFF) for a, b in zip(h, l, strict=True)}
                    kept = [x for x, k in zip(lines, line_keys(t or "", min_chars), strict=True) if k not in doomed]
                    ds.append(len(lines) - len(kept))
                    ts.append("\n".join(kept))
                else:
                    ds.append(0)
                    ts.append(t or "")
            cols = [*batch.columns[:-2], pa.array(ns, pa.int64()), pa.array(ds, pa.int64()), pa.array(ts, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:-2], *added.names])

    schema = StructType([*docs.schema.fields, *(StructField(n, LongType()) for n in added.names[:2]), StructField("kept_text", StringType())])
    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with repeated lines taken out of their texts; null texts stay null."""
    index = LineIndex(docs.sparkSession)
    index.insert(docs)
    own = {"doc_id": "doc_id", "text": "text"}
    names = {c: own.get(c, f"_c{i}") for i, c in enumerate(docs.columns)}  # other columns may clash with ours
    out = drop_lines(docs.toDF(*names.values()), index)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(text)}
    return out.select([(new[c].cast(t) if c in new else F.col(names[c])).alias(c) for c, t in docs.dtypes])


def op8_reversible_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = LineIndex(spark)
    index.insert(docs)
    out = drop_lines(docs, index)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, list_extract(l, i) AS line FROM (
    SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE keeper IS NOT NULL AND doc_id < keeper) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR doc_id >= keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""
