"""Sorted-string-table shards of token ids.

A shard holds documents in ascending key order. File layout, integers little-endian:

    block*   zstd(entries) + crc32 (4 bytes) of the compressed bytes
             entry: varint shared, varint unshared, varint value bytes, key suffix, value
    index    per block: 2-byte key length, first key, 8-byte offset, 4-byte length
    bloom    bits, `HASHES` probes a key by double hashing of XXH64
    footer   64 bytes: index offset, index length, bloom offset, bloom length, entries, ids, version, magic (8 bytes each)

Keys are order-preserving: one byte 0 (null) or 1, then the 64-bit integer with its sign bit flipped, big-endian. Ids
are 16 bits wide where all of them fit, else 32 (first byte of the value: the width).

Shards are cut by range partitioning on (key, checksum of the text), so many rows of one key still spread over tasks.
A task writes under a name of its own attempt and renames it when whole; a rerun of a lost task replaces the file by
an equal one. Only shards named in the manifest are read. Blocks, and the rows of a batch, bound the memory.

Edge cases: null text is empty and holds only the end id; a null key sorts first; repeated rows and equal keys are all
kept (ties by text checksum); an empty table writes no shard and reads back as no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from plumbline.llm.common import as_string, scratch_path, slices, written
from plumbline.llm.tokens import BYTE_BPE, END, encode, tokenizer_path

MAGIC, VERSION, FOOTER = b"PLSSTBL1", 1, struct.Struct("<7Q8s")
BLOCK_BYTES, BITS_PER_KEY, HASHES, SHARD_BYTES = 64 << 10, 10, 7, 256 << 20
MANIFEST = "shard long, roll long, path string, entries long, ids long, bytes long, first_key binary, last_key binary"


def pack_key(key: int | None) -> bytes:
    return b"\0" + bytes(8) if key is None else b"\1" + struct.pack(">Q", (key + (1 << 63)) & (1 << 64) - 1)


def unpack_key(data: bytes) -> int | None:
    return struct.unpack(">Q", data[1:])[0] - (1 << 63) if data[0] else None


def pack_ids(ids: np.ndarray) -> bytes:
    return b"\2" + ids.astype("<u2").tobytes() if not len(ids) or ids.max() < 65536 else b"\4" + ids.astype("<u4").tobytes()


def unpack_ids(value: bytes) -> np.ndarray:
    return np.frombuffer(value, "<u2" if value[0] == 2 else "<u4", offset=1)


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def _probes(key: bytes, n_bits: int) -> list[int]:
    from xxhash import xxh64_intdigest

    a, b = xxh64_intdigest(key, 1), xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % n_bits for i in range(HASHES)]


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


class ShardWriter:
    def __init__(self, out):
        import zstandard

        self.out, self.zstd = out, zstandard.ZstdCompressor(level=3)
        self.block, self.last, self.first_in_block, self.index, self.keys = bytearray(), b"", b"", [], []
        self.at = self.entries = self.ids = 0
        self.first_key = self.last_key = None

    def add(self, key: bytes, value: bytes, n_ids: int) -> None:
        if not self.block:
            self.first_in_block, self.last = key, b""
        shared = 0
        while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
            shared += 1
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last = self.last_key = key
        self.first_key = key if self.first_key is None else self.first_key
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.entries += 1
        self.ids += n_ids
        if len(self.block) >= BLOCK_BYTES:
            self.flush()

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def flush(self) -> None:
        if self.block:
            data = self.zstd.compress(bytes(self.block))
            self.index.append((self.first_in_block, self._put(data + struct.pack("<I", zlib.crc32(data))), len(data)))
            self.block = bytearray()

    def finish(self) -> None:
        self.flush()
        bits = np.zeros((len(self.keys) * BITS_PER_KEY // 8 + 8) * 8, np.uint8)
        for k in self.keys:
            bits[_probes(k, len(bits))] = 1
        index = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", o, n) for k, o, n in self.index)
        i, b = self._put(index), self._put(bloom := np.packbits(bits).tobytes())
        self._put(FOOTER.pack(i, len(index), b, len(bloom), self.entries, self.ids, VERSION, MAGIC))


class ShardReader:
    def __init__(self, uri: str):
        store, path = _store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        i, n_i, b, n_b, self.entries, self.ids, version, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError(f"{uri} is no shard of version {VERSION}")
        data, at, self.index = self.file.read_at(n_i, i), 0, []
        while at < len(data):
            n = struct.unpack_from("<H", data, at)[0]
            self.index.append((data[at + 2 : at + 2 + n], *struct.unpack_from("<QI", data, at + 2 + n)))
            at += 14 + n
        self.firsts = [k for k, _, _ in self.index]
        self.bloom = np.unpackbits(np.frombuffer(self.file.read_at(n_b, b), np.uint8))

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        _, at, n = self.index[i]
        raw = self.file.read_at(n + 4, at)
        if zlib.crc32(raw[:n]) != struct.unpack("<I", raw[n:])[0]:
            raise ValueError(f"block {i} is damaged")
        data, pos, key = zstandard.ZstdDecompressor().decompress(raw[:n]), 0, b""
        while pos < len(data):
            shared, pos = read_varint(data, pos)
            rest, pos = read_varint(data, pos)
            size, pos = read_varint(data, pos)
            key = key[:shared] + data[pos : pos + rest]
            yield key, data[pos + rest : pos + rest + size]
            pos += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[bytes]:
        """The values of a key: Bloom filter, binary search of the block index, then one block (or more, for repeated keys)."""
        if not self.bloom[_probes(key, len(self.bloom))].all():
            return []
        out, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.index) and self.firsts[i] <= key:
            out += [v for k, v in self.block(i) if k == key]
            i += 1
        return out

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str | None = None, by_word: bool = False, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes and writes the documents under `path`, which must be new; returns the manifest, also kept at path/manifest."""
    spark, vocabulary = docs.sparkSession, tokenizer or tokenizer_path(BYTE_BPE)

    def run(batches: Iterable[pa.RecordBatch]):
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        rows, roll, writer, name = [], 0, None, ""

        def close():
            writer.finish()
            writer.out.close()
            store.move(name, final := f"{folder}/shard-{shard:06d}-{roll:04d}.sst")
            rows.append((shard, roll, path.rstrip("/") + final[len(folder) :], writer.entries, writer.ids, writer.at, writer.first_key, writer.last_key))

        for batch in batches:
            for part in slices(batch, "_text"):
                ids, at = encode(as_string(part.column("_text")), vocabulary, by_word)
                for i, k in enumerate(part.column("_key").to_pylist()):
                    if writer is None:
                        name = f"{folder}/.writing-{shard}-{roll}-{attempt}"
                        writer = ShardWriter(store.open_output_stream(name))
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END))
                    writer.add(pack_key(k), pack_ids(own), len(own))
                    if writer.at >= shard_bytes:
                        close()
                        writer, roll = None, roll + 1
        if writer is not None:
            close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], [f.split()[0] for f in MANIFEST.split(", ")])

    slim = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).cast("string").alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text").asc()]
    slim.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MANIFEST).write.parquet(f"{path}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest")


def read_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """key, start (ids of all documents before it), n_ids, crc32 of the ids as 32-bit integers, and the ids if asked for.

    The running total is over one row a shard; each shard is then read by one task, a block at a time."""
    before = F.sum("ids").over(Window.orderBy("shard", "roll").rowsBetween(Window.unboundedPreceding, -1))
    todo = written(manifest.select("path", F.coalesce(before, F.lit(0)).alias("base")), "todo")
    n = max(1, todo.count())
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        for batch in batches:
            for uri, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader, rows = ShardReader(uri), []
                for i in range(len(reader.index)):
                    for k, v in reader.block(i):
                        ids = unpack_ids(v).astype("<u4")
                        rows.append((unpack_key(k), start, len(ids), zlib.crc32(ids.tobytes()), ids.astype(np.int32))[: 4 + with_ids])
                        start += len(ids)
                    if len(rows) >= (64 if with_ids else 4096) or i + 1 == len(reader.index):
                        cols = list(zip(*rows, strict=True))
                        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(list(c), pa.list_(pa.int32())) for c in cols[4:])], [f.split()[0] for f in schema.split(", ")])
                        rows = []
                reader.close()

    return todo.repartition(n).mapInArrow(run, schema)


def lookup(keys: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids) of each wanted key found, by the shards' ranges, Bloom filters and block indexes. Null keys find the null key."""
    spark: SparkSession = keys.sparkSession
    shards = [(bytes(r[0]), bytes(r[1]), r[2]) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").orderBy("shard", "roll").select("first_key", "last_key", "path").collect()]  # a row a shard

    def run(batches):
        lasts, readers = [x[1] for x in shards], {}
        for batch in batches:
            found, values = [], []
            for k in batch.column(0).to_pylist():
                p = pack_key(k)
                i = bisect.bisect_left(lasts, p)
                while i < len(shards) and shards[i][0] <= p:
                    if i not in readers:
                        if len(readers) >= 8:
                            readers.pop(next(iter(readers))).close()
                        readers[i] = ShardReader(shards[i][2])
                    for v in readers[i].get(p):
                        found.append(k)
                        values.append(unpack_ids(v).astype(np.int32))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(values, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return keys.select(F.col(key).cast("long").alias("doc_id")).mapInArrow(run, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str | None = None) -> DataFrame:
    """Writes shards to the shared folder and reads them back: doc_id, start, n_tokens, ids_crc32."""
    return read_shards(write_shards(docs, scratch_path(docs.sparkSession, "sst"), key, text, tokenizer), with_ids=False)
