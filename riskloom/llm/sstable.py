"""Token-ID output: sorted-string-table shards, and how to read and search them.

Documents are range-partitioned by identifier, so that each task writes one shard, in order; how many there are follows from
the bytes of text. A shard is a text-sink file whose lines are the parts of the format, each ended by the line feed that the sink
adds: blocks of about `block_bytes`, a sparse index, a Bloom filter and a footer. All of Spark's commit protocol and file
systems apply to it. Readers take ranges of a shard through Arrow's file systems: a scan reads blocks in stretches of some
megabytes, a lookup reads the footer, the filter and, if that lets it, the index and the blocks it points to. Where Arrow does not know
the file system, Spark hands over whole files.

    block   records: shared key bytes u8, own key bytes u8, value bytes u32, own key bytes, value
            key: 8 bytes of doc_id with the sign bit flipped, big-endian (a null doc_id: no bytes, so first), then a 0 and
            the row's number among equal identifiers as 4 bytes; shared bytes are those of the record before it
            value: ids, 2 bytes each if the vocabulary allows, else 4, little-endian
    index   per block: first key's bytes u8, position u64, bytes u32, first key
    filter  probes u8, then the bits
    footer  index position u64, filter position u64, block count u32, documents u64, ids u64, shard u32, bytes per id u8, b"SSTTOK1"

Cases: a null text is an empty one and keeps its end id; very long texts are read whole and make a block of their own; rows of
one identifier all stay (ordered by their text's hash); only doc_id and the text are read, so extra columns may have any name;
an empty table gives no shards with blocks and an empty result. An id that does not fit `id_bytes` raises, as does a damaged
file (`BadShard`).
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_right
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.llm.common import hash64, slices
from riskloom.llm.tokenizing import ID_TYPE, word_encoder

MAGIC = b"SSTTOK1"
FOOTER = struct.Struct("<QQIQQIB7s")
ENTRY = struct.Struct("<BQI")
RECORD = struct.Struct("<BBI")


class BadShard(ValueError):
    pass


def key_of(doc_id: int | None, number: int = 0) -> bytes:
    head = b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) & (2**64 - 1))
    return head + b"\0" + struct.pack(">I", number)


def doc_id_of(key: bytes) -> int | None:
    return None if len(key) == 5 else struct.unpack(">Q", key[:8])[0] - 2**63


def _places(doc_id: int | None, probes: int, bits: int) -> list[int]:
    h = hash64(key_of(doc_id)) & (2**64 - 1)
    a, b = h >> 32, h & 0xFFFFFFFF | 1
    return [(a + i * b) % bits for i in range(probes)]


class ShardWriter:
    """Parts of a shard, in order. Holds one block, the index and the identifiers' hashes."""

    def __init__(self, shard: int, id_bytes: int, block_bytes: int, bits_per_key: int = 10, probes: int = 7):
        self.shard, self.id_bytes, self.block_bytes, self.bits_per_key, self.probes = shard, id_bytes, block_bytes, bits_per_key, probes
        self.block, self.first, self.last, self.at = bytearray(), b"", b"", 0
        self.index, self.seen, self.docs, self.ids = bytearray(), set(), 0, 0
        self.blocks, self.number = 0, 0
        self.doc_id: object = ()

    def add(self, doc_id: int | None, ids: np.ndarray):
        self.number = self.number + 1 if doc_id == self.doc_id else 0
        self.doc_id = doc_id
        self.seen.add(doc_id)
        key, shared = key_of(doc_id, self.number), 0
        if not self.block:
            self.first = key
        else:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        if len(ids) and int(ids.max()) >> (8 * self.id_bytes):
            raise ValueError(f"an id does not fit {self.id_bytes} bytes; take id_bytes=4")
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        self.block += RECORD.pack(shared, len(key) - shared, len(value)) + key[shared:] + value
        self.last, self.docs, self.ids = key, self.docs + 1, self.ids + len(ids)
        if len(self.block) >= self.block_bytes:
            yield self._end_block()

    def _end_block(self) -> bytes:
        part = bytes(self.block)
        self.index += ENTRY.pack(len(self.first), self.at, len(part)) + self.first
        self.at += len(part) + 1
        self.blocks += 1
        self.block = bytearray()
        return part

    def finish(self):
        if self.block:
            yield self._end_block()
        index_at = self.at
        filter_at = index_at + len(self.index) + 1
        bits = max(64, self.bits_per_key * len(self.seen))
        bloom = bytearray(-(-bits // 8))
        for doc_id in self.seen:
            for p in _places(doc_id, self.probes, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        yield bytes(self.index)
        yield bytes([self.probes]) + bytes(bloom)
        yield FOOTER.pack(index_at, filter_at, self.blocks, self.docs, self.ids, self.shard, self.id_bytes, MAGIC)


class Shard:
    """A shard, read by its footer. `read(at, n)` gives n bytes from a place on; parts are read when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], size: int):
        if size < FOOTER.size + 1:
            raise BadShard("cut short")
        self.read, self.size = read, size
        self.index_at, self.filter_at, self.blocks, self.docs, self.ids, self.number, self.id_bytes, magic = FOOTER.unpack(read(size - FOOTER.size - 1, FOOTER.size))
        if magic != MAGIC:
            raise BadShard("no footer")

    @classmethod
    def of_bytes(cls, data: bytes) -> Shard:
        return cls(lambda at, n: data[at : at + n], len(data))

    @cached_property
    def starts(self) -> list[tuple[bytes, int, int]]:
        """First key, place and size of each block: the sparse index."""
        index, found, at = self.read(self.index_at, self.filter_at - 1 - self.index_at), [], 0
        for _ in range(self.blocks):
            n, place, size = ENTRY.unpack_from(index, at)
            at += ENTRY.size + n
            found.append((index[at - n : at], place, size))
        return found

    @cached_property
    def bloom(self) -> bytes:
        return self.read(self.filter_at, self.size - FOOTER.size - 2 - self.filter_at)

    def may_hold(self, doc_id: int | None) -> bool:
        probes, bits = self.bloom[0], self.bloom[1:]
        return all(bits[p >> 3] >> (p & 7) & 1 for p in _places(doc_id, probes, len(bits) * 8))

    def _records_of(self, data: bytes):
        at, key = 0, b""
        while at < len(data):
            shared, own, n = RECORD.unpack_from(data, at)
            at += RECORD.size + own + n
            key = key[:shared] + data[at - own - n : at - n]
            yield key, np.frombuffer(data[at - n : at], f"<u{self.id_bytes}")

    def block(self, k: int):
        _, at, size = self.starts[k]
        return self._records_of(self.read(at, size))

    def records(self, stretch: int = 1 << 22):
        """All records in order, read in stretches of blocks of about so many bytes (one block, if that is larger)."""
        k = 0
        while k < self.blocks:
            first = self.starts[k][1]
            stop = k + 1
            while stop < self.blocks and self.starts[stop][1] + self.starts[stop][2] - first <= stretch:
                stop += 1
            data = memoryview(self.read(first, self.starts[stop - 1][1] + self.starts[stop - 1][2] - first))
            for _, at, size in self.starts[k:stop]:
                for key, ids in self._records_of(bytes(data[at - first : at - first + size])):
                    yield doc_id_of(key), ids
            k = stop

    def find(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of all rows of that identifier, by Bloom filter and binary search over the sparse index."""
        found: list[np.ndarray] = []
        if not self.blocks or not self.may_hold(doc_id):
            return found
        k = max(0, bisect_right(self.starts, key_of(doc_id), key=lambda x: x[0]) - 1)
        while k < len(self.starts) and self.starts[k][0] <= key_of(doc_id, 2**32 - 1):
            found += [ids for key, ids in self.block(k) if key[:-5] == key_of(doc_id)[:-5]]
            k += 1
        return found


def shards_for(sizes: DataFrame, shard_bytes: int) -> int:
    """How many shards texts of those bytes make: as many as their sum asks for, or, for small tables, enough to give all cores work."""
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return max(1, -(-total // shard_bytes), min(sizes.sparkSession.sparkContext.defaultParallelism, total >> 20))


def write_shards(
    df: DataFrame, path: str, tokenizer_file: str, end_id: int, text: str = "text", shards: int | None = None, block_bytes: int = 32_768, id_bytes: int = 2, shard_bytes: int = 1 << 27
) -> None:
    """Tokenizes every text and writes the shards below `path`, one for about each shard_bytes of text unless a number is given. id_bytes is 2 for vocabularies of up to
    65,536 ids, else 4. Texts are shuffled, not ids: these take as many bytes (two for each 2 to 3 letters, which compress less), and range bounds are sampled
    from what is shuffled, so texts encoded before would be encoded twice."""

    def work(batches):
        encoder, end = word_encoder(tokenizer_file), np.array([end_id], ID_TYPE)
        writer = ShardWriter(TaskContext.get().partitionId(), id_bytes, block_bytes)
        for batch in slices(batches):
            parts: list[bytes] = []
            for doc_id, data in zip(batch.column("doc_id").to_pylist(), batch.column("_text").to_pylist()):
                parts += writer.add(doc_id, np.concatenate([encoder.encode(data or b""), end]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], names=["part"])
        if writer.docs:
            yield pa.RecordBatch.from_arrays([pa.array(writer.finish(), pa.binary())], names=["part"])

    keyed = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("binary").alias("_text"))
    keyed = keyed.withColumn("_tie", F.xxhash64("_text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    shards = shards or shards_for(keyed.select(F.length("_text").cast("long").alias("size")), shard_bytes)
    parts = keyed.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "_text").mapInArrow(work, "part binary")
    parts.select(F.col("part").cast("string").alias("value")).write.text(path)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file:///" + path.removeprefix("file:/")
    return fs.FileSystem.from_uri(path)


def _shards(spark: SparkSession, path: str, ranges: bool = True) -> DataFrame:
    """path, size of every shard; with `content` only where ranges cannot be read."""
    files = spark.read.format("binaryFile").load(path).where("length > 0")
    if ranges:
        try:
            _opened(path)
            return files.select("path", F.col("length").alias("size"))
        except (pa.ArrowInvalid, OSError, NotImplementedError, ImportError):
            pass
    return files.select("path", F.col("length").alias("size"), "content")


def _each_shard(batch: pa.RecordBatch):
    if "content" in batch.schema.names:
        for content in batch.column("content"):
            yield Shard.of_bytes(content.as_py())
        return
    for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
        system, name = _opened(path)
        with system.open_input_file(name) as file:
            yield Shard(lambda at, n, file=file: file.read_at(n, at), size)


def read_shards(spark: SparkSession, path: str, with_ids: bool = False, ranges: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 of every document, read from the shards; with_ids adds `ids array<int>`."""

    def totals(batches):
        for batch in batches:
            found = [(x.number, x.ids) for x in _each_shard(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int32()), pa.array([x for _, x in found], pa.int64())], names=["shard", "ids"])

    def documents(batches):
        for batch in batches:
            for shard in _each_shard(batch):
                before = 0
                rows: list[tuple] = []
                for doc_id, ids in shard.records():
                    rows.append((doc_id, before, len(ids), zlib.crc32(ids.astype(ID_TYPE).tobytes()), shard.number, ids))
                    before += len(ids)
                    if len(rows) == 5000:
                        yield rows_of(rows)
                        rows = []
                if rows:
                    yield rows_of(rows)

    def rows_of(rows):
        columns = list(zip(*rows))
        arrays = [pa.array(x, kind) for x, kind in zip(columns, [*[pa.int64()] * 4, pa.int32()])]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in columns[5]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "within", "n_tokens", "ids_crc32", "shard", *["ids"] * with_ids])

    files = _shards(spark, path, ranges)
    # one row a shard
    in_order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.mapInArrow(totals, "shard int, ids long").select("shard", F.coalesce(F.sum("ids").over(in_order), F.lit(0)).alias("before"))
    rows = files.mapInArrow(documents, "doc_id long, within long, n_tokens long, ids_crc32 long, shard int" + ", ids array<int>" * with_ids)
    return rows.join(offsets, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def lookup(spark: SparkSession, path: str, doc_ids: list[int | None]) -> DataFrame:
    """doc_id, ids of the named documents (a short list): each shard answers from its filter, its index and the blocks these point to."""

    def work(batches):
        for batch in batches:
            for shard in _each_shard(batch):
                hits = [(x, ids.astype(np.int32)) for x in dict.fromkeys(doc_ids) for ids in shard.find(x)]
                if hits:
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in hits], pa.int64()), pa.array([x for _, x in hits], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _shards(spark, path).mapInArrow(work, "doc_id long, ids array<int>")
