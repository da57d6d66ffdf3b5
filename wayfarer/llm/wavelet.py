"""Token-id output as wavelet matrices: one compressed, searchable file per shard.

A shard holds the ids of consecutive documents. Its ids are stored bit by bit from the highest: each plane has one bit of
every id, in the order that comes of sorting stably by the bits above. Planes are compressed in blocks of BLOCK bits; a table in
the file has each block's place and the number of ones before it. So rank reads one block of a plane, and from ranks follow,
block by block and without inflating the rest, the id at a position, how often an id occurs before a position, and where it
occurs for the k-th time. open_shard() does that on a file in any store that pyarrow reaches, by reads of the blocks it needs.

Documents are dealt to tasks by ranges of doc_id. They are encoded first, where they are read, so that ids of two bytes and not
texts are shuffled. The number of ranges follows the size of the texts. A task writes a file whenever it has shard_ids ids, so
its memory is bounded by that and the longest text; a task that runs again writes the same files again.

Defined results: null and empty texts are the end id alone; null ids come first, repeated ids next to each other (in order of
their tokens, and if there are so many that they fill several ranges, in order of the range); an empty table gives no shard and
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.llm.bpe import encoder
from wayfarer.llm.common import scratch, slices

MAGIC = b"WAVM\x02"
BLOCK = 1 << 15  #: bits of a plane that are compressed together
RANGE_BYTES = 64 << 20  #: of text, about, in each range of doc_id
SLICE = 1_000_000  #: bytes of text that a task encodes at once


class WaveletMatrix:
    """n ids of a number of bits. block(level, k) gives the bytes of a plane's k-th block; ones has the ones before each block."""

    def __init__(self, n: int, zeros: list[int], ones: np.ndarray, block: Callable[[int, int], np.ndarray]):
        self.n, self.zeros, self.ones, self.block = n, zeros, ones, block

    @property
    def bits(self) -> int:
        return len(self.zeros)

    def _rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        k, rest = divmod(i, BLOCK)
        got = int(self.ones[level, k])
        if rest:
            p = self.block(level, k)
            got += int(np.bitwise_count(p[: rest // 8]).sum(dtype=np.int64))
            if rest % 8:
                got += (int(p[rest // 8]) & ((1 << rest % 8) - 1)).bit_count()
        return got

    def _select(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) bit of that value in a plane."""
        ones = self.ones[level]
        counts = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        at = int(np.searchsorted(counts, k, "right")) - 1
        raw = np.unpackbits(self.block(level, at), count=min(BLOCK, self.n - at * BLOCK), bitorder="little")
        return at * BLOCK + int(np.flatnonzero(raw == bit)[k - int(counts[at])])

    def access(self, i: int) -> int:
        value = 0
        for level in range(self.bits):
            bit = int(self.block(level, i // BLOCK)[i % BLOCK // 8]) >> (i % 8) & 1
            ones = self._rank1(level, i)
            value, i = value * 2 + bit, self.zeros[level] + ones if bit else i - ones
        return value

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        lo, hi = 0, stop
        for level in range(self.bits):
            a, b = self._rank1(level, lo), self._rank1(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, stop: int) -> int:
        """How often the token occurs before a position."""
        lo, hi = self._range(token, stop) if token >> self.bits == 0 else (0, 0)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the token's k-th occurrence, from 0."""
        lo, hi = self._range(token, self.n) if token >> self.bits == 0 else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        at = lo + k
        for level in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - level) & 1
            at = self._select(level, bit, at - self.zeros[level] if bit else at)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self, dtype=np.uint32) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.dtype(dtype).type
        cur = np.zeros(self.n, dtype)
        for level in range(self.bits - 1, -1, -1):
            plane = np.concatenate([self.block(level, k) for k in range(self.ones.shape[1] - 1)]) if self.n else np.empty(0, np.uint8)
            one = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, dtype)
            up[~one] = cur[: self.zeros[level]]
            up[one] = cur[self.zeros[level] :] | kind(1 << (self.bits - 1 - level))
            cur = up
        return cur


_HEAD = "<BQQQQ"  #: bits, ids, documents, and the compressed sizes of the directory and of the documents' part


def to_bytes(doc_ids: np.ndarray, null: np.ndarray, count: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    """A shard: the head; the directory (zeros of each plane, ones before each block, each block's end); the documents (ids, which
    of them are null, lengths); then the blocks, each compressed, plane by plane."""
    pack = zstandard.ZstdCompressor(level=1).compress
    cur, n = np.ascontiguousarray(ids), len(ids)
    blocks = -(-n // BLOCK)
    zeros, ones, sizes, body = [], np.zeros((bits, blocks + 1), "<u8"), np.zeros((bits, blocks), "<u8"), []
    for level in range(bits):
        one = (cur & cur.dtype.type(1 << (bits - 1 - level))).astype(bool)
        plane = np.packbits(one, bitorder="little")
        per = np.bitwise_count(np.pad(plane, (0, -len(plane) % (BLOCK // 8))).reshape(blocks, BLOCK // 8)).sum(1, dtype=np.int64)
        ones[level, 1:] = np.cumsum(per)
        zeros.append(n - int(per.sum()))
        parts = [pack(plane[k * BLOCK // 8 : (k + 1) * BLOCK // 8].tobytes()) for k in range(blocks)]
        sizes[level] = [len(p) for p in parts]
        body += parts
        if level < bits - 1:
            cur = np.concatenate([cur[~one], cur[one]])
    directory = pack(np.array(zeros, "<u8").tobytes() + ones.tobytes() + np.cumsum(sizes.ravel(), dtype="<u8").tobytes())
    docs = pack(doc_ids.astype("<i8").tobytes() + null.astype(np.uint8).tobytes() + count.astype("<u8").tobytes())
    return b"".join([MAGIC, struct.pack(_HEAD, bits, n, len(doc_ids), len(directory), len(docs)), directory, docs, *body])


class Shard:
    """A shard that is read through read(offset, size): the directory at once, the documents and blocks when they are asked for."""

    def __init__(self, read: Callable[[int, int], bytes], held: int = 256):
        self._read = read
        size = len(MAGIC) + struct.calcsize(_HEAD)
        head = read(0, size)
        if head[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        bits, n, self.n_docs, directory, self._docs_size = struct.unpack_from(_HEAD, head, len(MAGIC))
        self._unpack = zstandard.ZstdDecompressor().decompress
        table, blocks = np.frombuffer(self._unpack(read(size, directory)), "<u8").astype(np.int64), -(-n // BLOCK)
        ones = table[bits : bits + bits * (blocks + 1)].reshape(bits, blocks + 1)
        ends = np.concatenate([[0], table[bits + bits * (blocks + 1) :]])
        self._docs_at = size + directory
        body = self._docs_at + self._docs_size

        def block(level: int, k: int) -> np.ndarray:
            j = level * blocks + k
            return np.frombuffer(self._unpack(read(body + int(ends[j]), int(ends[j + 1] - ends[j]))), np.uint8)

        self.ids = WaveletMatrix(n, table[:bits].tolist(), ones, lru_cache(held)(block) if held else block)

    def documents(self) -> tuple[list[int | None], np.ndarray]:
        """The ids of the documents, and the number of each one's tokens."""
        raw, n = self._unpack(self._read(self._docs_at, self._docs_size)), self.n_docs
        names, null = np.frombuffer(raw, "<i8", n).tolist(), np.frombuffer(raw, np.uint8, n, 8 * n).tolist()
        return [None if x else d for d, x in zip(names, null, strict=True)], np.frombuffer(raw, "<u8", n, 9 * n).astype(np.int64)


def from_bytes(blob: bytes) -> Shard:
    return Shard(lambda at, size: blob[at : at + size], held=0)


def open_shard(uri: str) -> Shard:
    """A shard's file, for single look-ups: only the blocks that are needed are read."""
    store, path = fs.FileSystem.from_uri(uri)
    file = store.open_input_file(path)

    def read(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    return Shard(read)


_MANIFEST = "part int, seq int, before bigint, n_ids bigint, n_docs bigint, file string"


def _ranges(docs: DataFrame, at_least: int) -> tuple[int, list[int]]:
    """The number of ranges, and the largest doc_id of all but the last."""
    n = F.sum(F.octet_length("text") + F.lit(1))
    size = docs.agg(n.alias("n")).first()["n"] or 0
    parts = int(max(1, at_least, -(-size // RANGE_BYTES)))
    shares = [k / parts for k in range(1, parts)]
    return parts, (docs.agg(F.percentile_approx("doc_id", F.lit(shares), max(1000, 10 * parts)).alias("b")).first()["b"] or []) if shares else []


def write_shards(docs: DataFrame, path: str, out: str, end_id: int = 2, shard_ids: int = 1 << 20) -> DataFrame:
    """Encodes documents in ascending doc_id order and writes their shards' files below out, and a table of them, which it returns."""
    spark = docs.sparkSession
    parts, bounds = _ranges(docs, int(spark.conf.get("spark.sql.shuffle.partitions")))
    edges = np.array(bounds, np.int64)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in slices(batches, SLICE):
            flat, count = enc.encode_arrow(b.column("text"))
            total = count + 1
            ids = np.full(int(total.sum()), end_id, enc.dtype if end_id < enc.size else "<u4")
            keep = np.ones(len(ids), bool)
            ends = np.cumsum(total)
            keep[ends - 1] = False
            ids[keep] = flat
            doc = b.column("doc_id").cast(pa.int64())
            known = doc.is_valid().to_numpy(zero_copy_only=False)
            value = doc.fill_null(0).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(edges, value, "left"), np.searchsorted(edges, value, "right")
            some = ends * 2654435761 % 4294967296 % (last - first + 1)  # an id that fills several ranges is dealt out over them
            data = pa.py_buffer(ids)
            col = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(total), [None, pa.py_buffer(np.concatenate([[0], ends]) * ids.dtype.itemsize), data])
            yield pa.RecordBatch.from_arrays([pa.array(np.where(known, first + some, 0).astype(np.int32)), doc, col.cast(pa.binary())], names=["range", "doc_id", "ids"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(path), TaskContext.get().partitionId()
        bits, kind = max(enc.size - 1, end_id).bit_length(), enc.dtype if end_id < enc.size else np.dtype("<u4")
        store, root = fs.FileSystem.from_uri(out)
        seq = before = held = 0
        names: list[pa.Array] = []
        counts, flats = [], []

        def flush() -> pa.RecordBatch:
            ids, doc = np.concatenate(flats), pa.concat_arrays(names)
            blob = to_bytes(doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_null().to_numpy(zero_copy_only=False), np.concatenate(counts), ids, bits)
            file = f"ids-{part:07d}-{seq:05d}.wavm"
            store.create_dir(root, recursive=True)
            with store.open_output_stream(f"{root}/.{file}-{TaskContext.get().taskAttemptId()}") as f:
                f.write(blob)
            store.move(f"{root}/.{file}-{TaskContext.get().taskAttemptId()}", f"{root}/{file}")
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (len(doc), pa.int64()), (file, pa.string()))], names=["part", "seq", "before", "n_ids", "n_docs", "file"])

        for b in slices(batches, 2_000_000, "ids"):
            col = b.column("ids").cast(pa.large_binary())
            _, offs, data = col.buffers()
            offs = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
            flats.append(np.frombuffer(data, np.uint8)[offs[0] : offs[-1]].view(kind).copy())
            counts.append(np.diff(offs) // kind.itemsize), names.append(b.column("doc_id"))
            held += len(flats[-1])
            if held >= shard_ids:
                yield flush()
                seq, before, held, names, counts, flats = seq + 1, before + held, 0, [], [], []
        if names:
            yield flush()

    encoded = docs.select("doc_id", "text").mapInArrow(encode, "range int, doc_id bigint, ids binary")
    dealt = encoded.repartitionById(parts, "range").sortWithinPartitions("doc_id", "ids").select("doc_id", "ids")
    dealt.mapInArrow(build, _MANIFEST).write.parquet(f"{out}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{out}/manifest")


def read_shards(spark: SparkSession, out: str) -> DataFrame:
    """One row per document, decoded from the shards: doc_id, start, n_tokens and ids_crc32."""
    shards = spark.read.schema(_MANIFEST).parquet(f"{out}/manifest")
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each writing task
    ahead = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = shards.join(totals.select("part", ahead.alias("ahead")), "part").select("file", (F.col("ahead") + F.col("before")).alias("begin"))  # a row for each file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(out)
        for b in batches:
            for file, begin in zip(b.column("file").to_pylist(), b.column("begin").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{file}") as f:
                    shard = from_bytes(f.read())
                (names, count), ids = shard.documents(), shard.ids.decode(np.uint32)
                ends, raw = np.cumsum(count), memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for n, e in zip(count.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(ends - count + begin), pa.array(count), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    several = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return starts.repartition(several, "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_store(docs: DataFrame, path: str, end_id: int = 2, out: str | None = None) -> DataFrame:
    """Writes the shards and reads them back."""
    spark = docs.sparkSession
    out = out or f"{scratch(spark)}/shards"
    write_shards(docs, path, out, end_id)
    return read_shards(spark, out)
