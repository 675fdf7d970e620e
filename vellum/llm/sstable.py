"""Sorted-string-table shards of token ids, keyed by document.

A file holds data blocks, a sparse index, a Bloom filter and a footer:
  block   zstd of entries: varint shared, varint own, varint value bytes, own key bytes, value; then crc32 of the raw block
  index   for each block: last key, offset, size, documents, tokens
  filter  `k` probes over a bit array; keys are 8 bytes, big-endian, sign bit flipped, so bytes sort as the numbers do
  footer  offsets and sizes of index and filter, documents, tokens, id width, magic
Values are little-endian ids of the file's width (2 bytes where the vocabulary allows it, else 4).
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, file_system, range_shards, saved, shard_of, work_path
from .tokens import VOCABULARY, encoder

MAGIC = b"VSST0001"
INDEX, FOOTER = struct.Struct("<8sQIII"), struct.Struct("<QQQQQQHH8s")
BLOCK, SHARD = 64 << 10, 32 << 20
END = 1


def key_of(doc_id: int | None) -> bytes:
    return ((NULL_ID if doc_id is None else doc_id) + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    n = int.from_bytes(key, "big") - (1 << 63)
    return None if n == NULL_ID else n


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while raw[at] > 127:
        n |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
    return n | raw[at] << shift, at + 1


class Bloom:
    def __init__(self, bits: bytearray, probes: int):
        self.bits, self.probes = bits, probes

    @classmethod
    def of(cls, keys: list[bytes], bits_a_key: int = 10) -> Bloom:
        b = cls(bytearray(max(8, -(-len(keys) * bits_a_key // 8))), 7)
        for k in keys:
            for p in b._places(k):
                b.bits[p >> 3] |= 1 << (p & 7)
        return b

    def _places(self, key: bytes) -> Iterator[int]:
        h = xxhash.xxh3_128_intdigest(key)
        a, b, n = h & (1 << 64) - 1, h >> 64 | 1, len(self.bits) * 8
        return ((a + i * b) % n for i in range(self.probes))

    def __contains__(self, key: bytes) -> bool:
        return all(self.bits[p >> 3] >> (p & 7) & 1 for p in self._places(key))


class Writer:
    """Appends (key, value) in ascending key order to an open binary stream; equal keys may repeat."""

    def __init__(self, stream, width: int, block: int = BLOCK):
        self.stream, self.width, self.block, self.at = stream, width, block, 0
        self.raw, self.last, self.docs, self.tokens = bytearray(), b"", 0, 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.total = [0, 0]

    def add(self, key: bytes, value: bytes) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.raw:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last, strict=True)) if a != b), len(key))
        self.raw += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.docs, self.tokens = key, self.docs + 1, self.tokens + len(value) // self.width
        self.keys.append(key)
        if len(self.raw) >= self.block:
            self._flush()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.raw:
            at = self.at
            self._put(zstandard.ZstdCompressor(level=1).compress(bytes(self.raw)) + struct.pack("<I", zlib.crc32(self.raw)))
            self.index.append(INDEX.pack(self.last, at, self.at - at, self.docs, self.tokens))
            self.total = [self.total[0] + self.docs, self.total[1] + self.tokens]
            self.raw, self.last, self.docs, self.tokens = bytearray(), b"", 0, 0

    def close(self) -> tuple[int, int, int]:
        """(documents, tokens, bytes)."""
        self._flush()
        bloom, at = Bloom.of(self.keys), self.at
        self._put(b"".join(self.index))
        middle = self.at
        self._put(bytes(bloom.bits))
        self._put(FOOTER.pack(at, middle - at, middle, self.at - middle, *self.total, self.width, bloom.probes, MAGIC))
        return *self.total, self.at


class Reader:
    """A table on a random-access binary file (read, seek): scan() all, or get() the values of one key by binary search."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - FOOTER.size)
        i, n, f, m, self.docs, self.tokens, self.width, probes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table file")
        file.seek(i)
        raw = file.read(n)
        self.blocks = list(INDEX.iter_unpack(raw))
        file.seek(f)
        self.bloom = Bloom(bytearray(file.read(m)), probes)

    def _entries(self, block: tuple) -> Iterator[tuple[bytes, bytes]]:
        self.file.seek(block[1])
        data = self.file.read(block[2])
        raw = zstandard.ZstdDecompressor().decompress(data[:-4])
        if zlib.crc32(raw) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < len(raw):
            shared, at = read_varint(raw, at)
            own, at = read_varint(raw, at)
            size, at = read_varint(raw, at)
            key = key[:shared] + raw[at : at + own]
            at += own
            yield key, raw[at : at + size]
            at += size

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for b in self.blocks:
            yield from self._entries(b)

    def get(self, key: bytes) -> list[bytes]:
        out: list[bytes] = []
        if key not in self.bloom:
            return out
        for b in self.blocks[bisect_left(self.blocks, key, key=lambda b: b[0]) :]:
            for k, v in self._entries(b):
                if k > key:
                    return out
                if k == key:
                    out.append(v)
        return out


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END, shard: int = SHARD, block: int = BLOCK) -> list[dict]:
    """Writes the table of docs (doc_id, text) under `path` and returns its manifest, one entry a file, in key order.

    Documents go to range shards of about `shard` bytes of text, whose bounds depend on the rows alone; where very many
    documents make shards larger, or one id has very many, a shard rolls over to its next file after `shard` bytes, so no
    file or index outgrows its task. A file is written under a name of the attempt and then moved, so a task that is run
    again leaves one whole file; readers go by manifest.json, which is moved into place last. Null text: the end id
    alone; null doc_id: before all others.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sizes = saved(rows.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).alias("n")))
    bounds = range_shards(sizes, "doc_id", F.col("n"), shard)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        enc, last = encoder(vocabulary), int(end)
        wide = max(enc.whole.get_vocab_size(), last + 1) > 1 << 16
        now, out, writer, seq, taken = None, None, None, 0, 0

        def done() -> pa.RecordBatch:
            n, tokens, size = writer.close()
            out.close()
            fs.move(f"{root}/{name}.tmp-{tag}", f"{root}/{name}")
            return pa.RecordBatch.from_pylist([{"shard": now, "name": name, "docs": n, "tokens": tokens, "bytes": size}], schema=pa.schema([("shard", pa.int32()), ("name", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

        for b in batches:
            for s, doc, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if s != now or taken >= shard:
                    if writer:
                        yield done()
                    seq = seq + 1 if s == now else 0
                    now, name, tag, taken = s, f"shard-{s:06d}-{seq:04d}.sst", uuid.uuid4().hex, 0
                    out = fs.open_output_stream(f"{root}/{name}.tmp-{tag}")
                    writer = Writer(out, 4 if wide else 2, block)
                text = t.as_py() or ""
                ids = enc.ids(text) + last.to_bytes(4, "little")
                if not wide:
                    ids = np.frombuffer(ids, "<u4").astype("<u2").tobytes()
                writer.add(key_of(doc), ids)
                taken += len(text) + 8
        if writer:
            yield done()

    fs, root = file_system(path)
    fs.create_dir(root, recursive=True)
    placed = rows.withColumn("shard", shard_of(F.col("doc_id"), bounds))
    dealt = placed.repartitionById(len(bounds), F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    files = sorted((r.asDict() for r in dealt.select("shard", "doc_id", "text").mapInArrow(run, "shard int, name string, docs long, tokens long, bytes long").collect()), key=lambda r: (r["shard"], len(r["name"]), r["name"]))
    tmp = f"{root}/manifest.tmp-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as f:
        f.write(json.dumps({"vocabulary": vocabulary, "end": end, "files": files}).encode())
    fs.move(tmp, f"{root}/manifest.json")
    return files


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a written table, read from its files.

    start: ids of all documents before it in key order; ids_crc32: of the ids as little-endian unsigned 32-bit integers.
    """
    fs, root = file_system(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    listed, base = [], 0
    for x in files:
        listed.append((x["name"], base))
        base += x["tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(path)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{name}") as f:
                    table, got = Reader(f), []
                    for key, value in table.scan():
                        n = len(value) // table.width
                        ids = value if table.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
                        got.append((id_of(key), start, n, zlib.crc32(ids)))
                        start += n
                cols = list(zip(*got, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not listed:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(listed, "name string, start long").repartition(len(listed)).mapInArrow(run, schema)


def lookup(path: str, doc_id: int | None) -> list[list[int]]:
    """The ids of the documents with one id, by binary search over the files' key order and each file's sparse index."""
    fs, root = file_system(path)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        files = json.loads(f.read())["files"]
    out, lo, hi, key = [], 0, len(files) - 1, key_of(doc_id)
    while lo < hi:
        mid = (lo + hi) // 2
        with fs.open_input_file(f"{root}/{files[mid]['name']}") as f:
            if Reader(f).blocks[-1][0] < key:
                lo = mid + 1
            else:
                hi = mid
    # one id's documents may go on in the next files
    for x in files[lo:]:
        with fs.open_input_file(f"{root}/{x['name']}") as f:
            table = Reader(f)
            out += [list(memoryview(v).cast("I" if table.width == 4 else "H")) for v in table.get(key)]
            if table.blocks[-1][0] > key:
                break
    return out


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END, shard: int = SHARD) -> DataFrame:
    """Writes docs into a new folder of the shared place and reads the files back. Empty input: no rows."""
    path = work_path(docs.sparkSession, "sst")
    write(docs, path, vocabulary, end, shard)
    return read(docs.sparkSession, path)
