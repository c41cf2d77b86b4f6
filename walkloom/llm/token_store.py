"""Token-id files: Elias-Fano document boundaries over one concatenated id array per shard.

Documents are range-partitioned by id and each partition writes one shard file, so shards and the documents in them ascend. A shard holds
the boundaries of its documents as an Elias-Fano sequence: the low bits of each offset packed, the high bits as a unary-coded bit vector,
and a select directory of the place of every 256th one in 32 bits. An offset is read by one select, without a table of 64-bit offsets.

Layout (little-endian): magic "WLT1", u8 id bytes, u8 low bits, u16 0, u64 documents, u64 ids, u64 high-vector bytes, u64 low bytes,
u32 directory entries, u32 0; then i64 document ids, directory, low, high, ids.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written
from .textkit import slices
from .tokens import SLICE, encode, with_ends

_HEAD = "<4sBBHQQQQII"
_EVERY = 256
#: Stands for a null document id in a shard.
NO_ID = -(1 << 63)
#: A shard is closed at so many ids (64 MB of two bytes each); numbers that one range of ids has for its shards.
SHARD_IDS, SHARDS = 1 << 25, 1 << 24
_MANIFEST = "shard long, path string, docs long, ids long"


class EliasFano:
    """A non-decreasing sequence of n values below a bound, with select in near-minimal space."""

    def __init__(self, low_bits: int, n: int, low: np.ndarray, high: np.ndarray, directory: np.ndarray):
        self.low_bits, self.n, self.low, self.high, self.directory = low_bits, n, low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        n, bound = len(values), int(values[-1]) + 1 if len(values) else 1
        bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        ones = (values >> bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return cls(bits, n, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::_EVERY].astype(np.uint32))

    def get(self, k: int) -> int:
        """The k-th value: select on the high bits from the nearest directory entry, then the low bits."""
        place, rest = int(self.directory[k // _EVERY]), k % _EVERY
        byte = place // 8
        seen = -int(np.unpackbits(self.high[byte : byte + 1], bitorder="little")[: place % 8].sum())
        width = 64
        while True:
            part = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            sums = np.cumsum(part)
            if seen + int(sums[-1]) > rest:
                one = byte * 8 + int(np.searchsorted(sums, rest - seen + 1))
                break
            seen += int(sums[-1])
            byte += width
        at = k * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at // 8] >> (at % 8).astype(np.uint8)) & 1
        return ((one - k) << self.low_bits) | int((bits.astype(np.int64) << np.arange(self.low_bits)).sum())

    def some(self, first: int, last: int) -> np.ndarray:
        """The values from the first-th to before the last-th, by selects on the high bits of that stretch alone."""
        if first >= last:
            return np.zeros(0, np.int64)
        head = first // _EVERY
        byte, rest = int(self.directory[head]) // 8, first - head * _EVERY
        stop = min(len(self.high), int(self.directory[-(-last // _EVERY)]) // 8 + 1) if -(-last // _EVERY) < len(self.directory) else len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[byte:stop], bitorder="little")) + byte * 8
        rest += int(np.searchsorted(ones, int(self.directory[head])))
        k = np.arange(first, last)
        at = k[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = ((self.low[at // 8] >> (at % 8).astype(np.uint8)) & 1).astype(np.int64)
        return ((ones[rest : rest + last - first] - k) << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1)

    def below(self, value: int) -> int:
        """How many values are at most `value`: a binary search by select."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.get(mid) <= value else (lo, mid)
        return lo


def _write(root: str, tokenizer: str, kind: str, end_id: int, id_bytes: int, most: int) -> Callable:
    """Shards of one range of ids: a task closes one when it holds `most` ids, so memory doesn't grow with the range."""
    def closed(shard: int, docs: list[np.ndarray], sizes: list[np.ndarray], parts: list[bytes]) -> pa.RecordBatch:
        names, ends = np.concatenate(docs), np.cumsum(np.concatenate(sizes))
        ef, total = EliasFano.of(ends), int(ends[-1])
        store, base = fs.FileSystem.from_uri(root)
        path = f"{base}/shard-{shard:012d}-{uuid.uuid4().hex}.wlt"  # a retried task writes files of its own; the manifest names one
        store.create_dir(base, recursive=True)
        with store.open_output_stream(path) as out:
            out.write(struct.pack(_HEAD, b"WLT1", id_bytes, ef.low_bits, 0, len(names), total, len(ef.high), len(ef.low), len(ef.directory), 0))
            for x in (names.astype("<i8"), ef.directory.astype("<u4"), ef.low, ef.high):
                out.write(x.tobytes())
            for x in parts:
                out.write(x)
        return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path], "docs": [len(names)], "ids": [total]})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, sizes, parts, held, shard = [], [], [], 0, None
        for some in (x for batch in batches for x in slices(batch, "text", SLICE)):
            shard = some.column("part")[0].as_py() * SHARDS if shard is None else shard
            ids, at = with_ends(*encode(tokenizer, kind, some.column("text")), end_id)
            docs.append(some.column("doc_id").fill_null(NO_ID).to_numpy())
            sizes.append(np.diff(at))
            parts.append(ids.astype(f"<u{id_bytes}").tobytes())
            held += len(ids)
            if held >= most:
                yield closed(shard, docs, sizes, parts)
                docs, sizes, parts, held, shard = [], [], [], 0, shard + 1
        if docs:
            yield closed(shard, docs, sizes, parts)

    return task


class Shard:
    """One shard file: boundaries in memory, ids read by range."""

    def __init__(self, root: str, path: str):
        self.file = fs.FileSystem.from_uri(root)[0].open_input_file(path)
        magic, self.id_bytes, bits, _, self.n, self.ids, high, low, entries, _ = struct.unpack(_HEAD, self.file.read(struct.calcsize(_HEAD)))
        if magic != b"WLT1":
            raise ValueError(f"{path} is not a token shard")
        take = lambda kind, n: np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind)
        self.docs, directory, lows, highs = take("<i8", self.n), take("<u4", entries), take("u1", low), take("u1", high)
        self.ends = EliasFano(bits, self.n, lows, highs, directory)
        self.body = self.file.tell()

    def span(self, k: int) -> tuple[int, int]:
        return self.ends.get(k - 1) if k else 0, self.ends.get(k)

    def read(self, begin: int, end: int) -> np.ndarray:
        self.file.seek(self.body + begin * self.id_bytes)
        return np.frombuffer(self.file.read((end - begin) * self.id_bytes), f"<u{self.id_bytes}").astype("<u4")


def write_store(docs: DataFrame, root: str, tokenizer: str, kind: str, end_id: int, id_bytes: int = 2, id_col: str = "doc_id", text_col: str = "text", most: int = SHARD_IDS) -> DataFrame:
    """Write shards of about `most` ids at most under root; the manifest: shard, path, docs, ids, base (ids of all earlier shards), as a table.

    Texts are encoded whole, a null text as an empty one, and each is followed by end_id. Rows with a null id come first, under the
    smallest 64-bit number, and are read back with a null id. Rows that repeat an id are all written, the shorter text first. Columns besides
    id and text are not read. An empty table writes no shard.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.length("text"), "text")
    found = ranged.withColumn("part", F.spark_partition_id()).mapInArrow(_write(root, tokenizer, kind, end_id, id_bytes, most), _MANIFEST)
    found = written(found, "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # over one row per shard
    return found.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_store(manifest: DataFrame, root: str) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, binary) of every document, read back from the shards."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = Shard(root, path)
                at, begin = 0, 0
                while at < shard.n:  # about a million ids at a time, one document at least
                    to = max(at + 1, shard.ends.below(begin + (1 << 20)))
                    ends = shard.ends.some(at, to)
                    begins = np.concatenate(([begin], ends[:-1]))
                    ids = shard.read(begin, int(ends[-1]))
                    cuts = (np.concatenate((begins, ends[-1:])) - begin) * 4
                    docs = pa.array(shard.docs[at:to], mask=shard.docs[at:to] == NO_ID)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(begins + base), pa.array(ends - begins), pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(ids)])], names=["doc_id", "start", "n_tokens", "ids"])
                    at, begin = to, int(ends[-1])

    shards = manifest.select("shard", "path", "base").repartitionByRange(max(1, min(manifest.count(), 4096)), "shard")
    return shards.mapInArrow(task, "doc_id long, start long, n_tokens long, ids binary")
