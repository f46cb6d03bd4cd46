"""Token-id output: sorted-string-table shards that are searched by document identifier.

A shard holds documents in ascending identifier order. Its entries lie in prefix-compressed, zstd-packed blocks; a sparse
index has each block's first key, a Bloom filter answers most misses without a read, and a footer of fixed size says where
all of it lies. A shard is written by one task over one range of identifiers; the manifest, a table that Spark commits, names
the shards of the attempts that count, so a retried task leaves no trace in what is read.

Defined results: a null identifier sorts before all others; a null text is an empty one (its entry has the end id only);
repeated identifiers keep one entry each, next to each other, ordered by text; an empty input gives no shards; further input
columns play no part.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.llm.encoding import encoder
from claimloom.llm.shared import filesystem, materialize, scratch, slices, text_column

MAGIC = b"CLMSST01"
FOOTER = struct.Struct("<QQQQQQB7x8s")  # index at, index bytes, filter at, filter bytes, entries, tokens, id width, magic
BITS_A_KEY, PROBES = 10, 7
BLOCK_BYTES = 64 << 10
#: Entries of a shard at most, whatever its size.
MOST_ENTRIES = 1 << 21
MANIFEST = "shard int, part int, path string, n_docs long, n_tokens long, n_bytes long, first_key binary, last_key binary"
MANIFEST_NAMES = [f.split()[0] for f in MANIFEST.split(", ")]


def encode_key(doc_id: int | None) -> bytes:
    """Bytes that sort as the identifier does, null first."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def decode_key(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class ShardWriter:
    """Appends entries in key order to a binary stream and closes it with index, filter and footer."""

    def __init__(self, out, width: int, block_bytes: int = BLOCK_BYTES):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.block, self.size, self.first, self.last, self.at, self.tokens = [], 0, b"", b"", 0, 0
        self.raw = self.entries = 0  # bytes before they are compressed, entries

    def add(self, key: bytes, ids: bytes) -> None:
        if not self.block:
            self.first, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + key[shared:] + _varint(self.tokens) + _varint(len(ids))
        self.block += [entry, ids]
        self.size += len(entry) + len(ids)
        self.raw += len(entry) + len(ids)
        self.entries += 1
        self.tokens += len(ids) // self.width
        if key != (self.keys[-1] if self.keys else None):
            self.keys.append(key)
        self.last = key
        if self.size >= self.block_bytes:
            self.flush()

    def flush(self) -> None:
        if self.block:
            data = self.pack(b"".join(self.block))
            self.out.write(data)
            self.index.append((self.first, self.at, len(data)))
            self.at += len(data)
            self.block, self.size = [], 0

    def close(self) -> int:
        """Write what closes the file; the file's size."""
        self.flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, len(self.keys) * BITS_A_KEY)
        field = np.zeros(bits, bool)
        for key in self.keys:
            field[_probes(key, bits)] = True
        filt = struct.pack("<Q", bits) + np.packbits(field, bitorder="little").tobytes()
        self.out.write(index + filt + FOOTER.pack(self.at, len(index), self.at + len(index), len(filt), self.entries, self.tokens, self.width, MAGIC))
        return self.at + len(index) + len(filt) + FOOTER.size


class Shard:
    """Reads a shard: all entries in order, or those of one key by binary search in the index."""

    def __init__(self, uri: str):
        filesys, path = filesystem(uri)
        self.file = filesys.open_input_file(path)
        size = self.file.size()
        index_at, index_n, filt_at, filt_n, self.entries, self.tokens, self.width, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        data, at = self._at(index_at, index_n), 0
        self.firsts: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        while at < len(data):
            n, at = _read_varint(data, at)
            self.firsts.append(data[at : at + n])
            self.places.append(struct.unpack_from("<QQ", data, at + n))
            at += n + 16
        filt = self._at(filt_at, filt_n)
        self.bits, self.filter = struct.unpack_from("<Q", filt)[0], filt[8:]
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")

    def _at(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, int, bytes]]:
        data, at, key = zstandard.ZstdDecompressor().decompress(self._at(*self.places[i])), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            key, at = key[:shared] + data[at : at + n], at + n
            start, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            yield key, start, data[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, ids of the shard before this entry, and id bytes, of each entry."""
        for i in range(len(self.places)):
            yield from self._block(i)

    def find(self, keys: Iterator[bytes]) -> Iterator[tuple[bytes, np.ndarray]]:
        """Key and ids of each entry of the keys, which must ascend. A block that several keys lie in is read once."""
        held, rows = -1, []
        for key in keys:
            if not all(self.filter[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits)):
                continue
            i = max(0, bisect_right(self.firsts, key) - 1)
            while i > 0 and self.firsts[i] == key:  # entries of one key may begin in an earlier block
                i -= 1
            while i < len(self.places) and self.firsts[i] <= key:
                if i != held:
                    held, rows = i, list(self._block(i))
                at = bisect_left(rows, key, key=lambda r: r[0])
                while at < len(rows) and rows[at][0] == key:
                    yield key, np.frombuffer(rows[at][2], self.dtype)
                    at += 1
                i += 1

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each entry of an identifier."""
        return [ids for _, ids in self.find(iter([encode_key(doc_id)]))]


def write_shards(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, shard_bytes: int = 256 << 20) -> DataFrame:
    """Encode every text of ``docs`` (doc_id, text) and write it; returns the manifest, in shard order.

    The identifiers are dealt to tasks by range, each task sorts its range (spilling if need be) and writes it as it reads,
    so no more than a slice of texts is in memory. A task begins another part at ``shard_bytes``, before compression, or
    ``MOST_ENTRIES``.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "sstable")
    ranged = docs.select(F.col("doc_id").cast("long"), text_column().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        shard, part, writer = TaskContext.get().partitionId(), 0, None
        filesys, root = filesystem(folder)
        filesys.create_dir(root, recursive=True)
        coder = encoder(vocabulary)
        end = np.array([end_id], coder.dtype).tobytes()
        rows = []

        def close():
            rows.append((shard, part, f"{folder}/{name}", writer.entries, writer.tokens, writer.close(), writer.keys[0], writer.keys[-1]))
            writer.out.close()

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text"))):
                if writer is None:
                    name = f"{shard:06d}-{part:04d}-{uuid.uuid4().hex}.sst"
                    writer = ShardWriter(filesys.open_output_stream(f"{root}/{name}"), coder.dtype.itemsize)
                writer.add(encode_key(doc_id), ids.tobytes() + end)
                if writer.raw >= shard_bytes or writer.entries >= MOST_ENTRIES:
                    close()
                    writer, part = None, part + 1
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=MANIFEST_NAMES)

    return materialize(ranged.mapInArrow(write, MANIFEST), "sstable-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """Every entry read back: doc_id, start, n_tokens, ids_crc32. A shard is read by one task, a slice of entries at a time."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)  # of the manifest, a row per shard
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).select("path", "base")

    def read(batches):
        for batch in batches:
            for path, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base"))):
                shard = Shard(path)
                entries = shard.scan()
                while some := list(islice(entries, 4096)):
                    rows = []
                    for key, start, ids in some:
                        wide = np.frombuffer(ids, shard.dtype).astype("<u4")
                        rows.append((decode_key(key), base + start, len(wide), zlib.crc32(wide.tobytes())))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(_tasks(manifest)).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _tasks(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lookup(manifest: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ids of the wanted identifiers (column doc_id): doc_id and ids, a row per entry.

    The manifest says where each shard begins and ends; these bounds, some bytes for every 256 MB of entries, go to all
    tasks, which send each identifier to the shards whose range it lies in, by binary search. A shard's identifiers come in
    order, so that each of its blocks is read once at most.
    """
    shards = sorted((bytes(r["first_key"]), bytes(r["last_key"]), r["path"]) for r in manifest.select("first_key", "last_key", "path").collect())
    spark = manifest.sparkSession
    bounds = spark.sparkContext.broadcast(([s[0] for s in shards], [s[1] for s in shards], [s[2] for s in shards]))
    keys = wanted.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()

    def route(batches):
        firsts, lasts, paths = bounds.value
        for batch in batches:
            rows = []
            for doc_id in batch.column("doc_id").to_pylist():
                key = encode_key(doc_id)
                rows += [(paths[i], key) for i in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["path", "key"])

    def find(batches):
        path = shard = None

        def rows_of(batch):
            nonlocal path, shard
            paths, keys = batch.column("path").to_pylist(), batch.column("key").to_pylist()
            for at, group in groupby(range(len(paths)), key=paths.__getitem__):
                if at != path:
                    path, shard = at, Shard(at)
                yield from shard.find(keys[i] for i in group)

        for batch in batches:
            found = rows_of(batch)
            while some := list(islice(found, 256)):
                yield pa.RecordBatch.from_arrays([pa.array([decode_key(k) for k, _ in some], pa.int64()), pa.array([ids for _, ids in some], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    routed = keys.mapInArrow(route, "path string, key binary").repartition(_tasks(manifest), "path").sortWithinPartitions("path", "key")
    return routed.mapInArrow(find, "doc_id long, ids array<long>")
