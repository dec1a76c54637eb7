"""Token files: one compressed wavelet matrix per shard of consecutive documents.

A shard's ids are stored as bit planes, most significant bit first; after each plane the ids are
stably parted by its bit (zeros first). Each plane is cut into blocks that are compressed on
their own, with the number of ones before each block. That is enough for the id at
a position (access), how often an id occurs before a position (rank) and where it occurs for the
k-th time (select), reading only the blocks that are touched.

Layout of a file, little-endian: magic, length of the header, header (JSON), ends of the documents
(64-bit, compressed), then the blocks of all planes. Files are written by the tasks that encode the
documents, under names of their own; a table of file names is written last, and only files that
it lists count, so repeated tasks do no harm.

Defined results: a null text is empty and has the end id only; rows with a null doc_id come first;
rows with equal ids are all kept, ordered by a hash of their text; an empty table has no
files and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroflow.llm.common import SharedFolder, scratch_path, write_and_read
from hydroflow.llm.tokens import in_slices, word_table

MAGIC = b"WMTOK1\n\0"
#: Bits of a plane that are compressed together; a multiple of 8.
BLOCK_BITS = 1 << 18
#: Ids after which a shard is closed.
SHARD_IDS = 1 << 20


def encode_shard(ids: np.ndarray, doc_ends: np.ndarray) -> bytes:
    """The file of one shard. ``doc_ends``: position after each document's last id."""
    n = len(ids)
    bits = max(1, int(ids.max()).bit_length()) if n else 1
    squeeze = zstandard.ZstdCompressor(level=1).compress
    blocks, ones_before, zeros = [], [], []
    cur = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for level in range(bits - 1, -1, -1):
        bit = ((cur >> level) & 1).astype(np.uint8).view(bool)
        plane, ones = np.packbits(bit, bitorder="little"), 0
        for start in range(0, n, BLOCK_BITS):
            part = plane[start // 8:(start + BLOCK_BITS) // 8]
            ones_before.append(ones)
            ones += int(np.bitwise_count(part).sum())
            blocks.append(squeeze(part.tobytes()))
        after, n0 = np.empty_like(cur), n - ones
        np.compress(~bit, cur, out=after[:n0])
        np.compress(bit, cur, out=after[n0:])
        zeros.append(n0)
        cur = after
    ends = squeeze(doc_ends.astype("<i8").tobytes())
    head = json.dumps({"n": n, "bits": bits, "docs": len(doc_ends), "zeros": zeros, "ones_before": ones_before,
                       "ends": len(ends), "blocks": [len(b) for b in blocks]}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, ends, *blocks])


class WaveletShard:
    """Reads one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        size = int.from_bytes(data[8:16], "little")
        head = json.loads(data[16:16 + size])
        self.n, self.bits, self.zeros = head["n"], head["bits"], head["zeros"]
        self.per_plane = -(-self.n // BLOCK_BITS)
        self.ones_before = head["ones_before"]
        at = 16 + size
        self.doc_ends = np.frombuffer(zstandard.decompress(data[at:at + head["ends"]]), "<i8")
        self._starts = at + head["ends"] + np.concatenate([[0], np.cumsum(head["blocks"])]).astype(int)
        self._data = data
        self._block = lru_cache(maxsize=64)(self._unpacked)

    def _unpacked(self, plane: int, block: int) -> np.ndarray:
        k = plane * self.per_plane + block
        raw = zstandard.decompress(self._data[self._starts[k]:self._starts[k + 1]])
        return np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little",
                             count=min(BLOCK_BITS, self.n - block * BLOCK_BITS))

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before position i."""
        if i >= self.n:
            return self.n - self.zeros[plane]
        block, rest = divmod(i, BLOCK_BITS)
        return self.ones_before[plane * self.per_plane + block] + int(np.count_nonzero(self._block(plane, block)[:rest]))

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) such bit of a plane."""
        low, high = 0, self.per_plane - 1
        first = plane * self.per_plane
        before = lambda b: self.ones_before[first + b] if bit else b * BLOCK_BITS - self.ones_before[first + b]
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if before(mid) <= k else (low, mid - 1)
        return low * BLOCK_BITS + int(np.flatnonzero(self._block(plane, low) == bit)[k - before(low)])

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.bits):
            bit = int(self._block(p, i // BLOCK_BITS)[i % BLOCK_BITS])
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            value = value * 2 + bit
        return value

    def _range(self, token: int, upto: int) -> tuple[int, int]:
        """Where an id's occurrences before ``upto`` lie after the last plane."""
        if token >> self.bits:
            return 0, 0
        low, high = 0, upto
        for p in range(self.bits):
            a, b = self._ones(p, low), self._ones(p, high)
            low, high = (self.zeros[p] + a, self.zeros[p] + b) if token >> (self.bits - 1 - p) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, upto: int | None = None) -> int:
        """How often an id occurs before a position (rank)."""
        low, high = self._range(token, self.n if upto is None else upto)
        return high - low

    def occurrence(self, token: int, k: int) -> int | None:
        """Position of an id's k-th occurrence, from 0 (select)."""
        low, high = self._range(token, self.n)
        if k >= high - low:
            return None
        at = low + k
        for p in range(self.bits - 1, -1, -1):
            bit = token >> (self.bits - 1 - p) & 1
            at = self._select(p, bit, at - self.zeros[p] if bit else at)
        return at

    def ids(self) -> np.ndarray:
        """All ids: the planes are undone from the last to the first."""
        out = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            blocks = [self._unpacked(p, b) for b in range(self.per_plane)]
            bit = (np.concatenate(blocks) if blocks else np.zeros(0, np.uint8)).view(bool)
            whole = np.empty_like(out)
            whole[np.flatnonzero(~bit)] = out[:self.zeros[p]]
            whole[np.flatnonzero(bit)] = out[self.zeros[p]:] | out.dtype.type(1 << (self.bits - 1 - p))
            out = whole
        return out


def _write_shards(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, files = word_table(vocabulary, "<u4", False), SharedFolder(folder)
        end = np.array([end_id], "<u4").tobytes()
        task, made, ids, doc_ids, size, start = TaskContext.get().partitionId(), 0, [], [], 0, 0

        def close():
            nonlocal made, ids, doc_ids, size, start
            ends = np.cumsum([len(x) // 4 for x in ids])
            path = files.write(f"shard-{task:06d}-{made:06d}", encode_shard(np.frombuffer(b"".join(ids), "<u4"), ends))
            row = pa.RecordBatch.from_pydict({"task": [task], "part": [made], "path": [path], "doc_ids": [doc_ids],
                                              "in_task": [start], "n_ids": [size]}, schema=MANIFEST)
            made, start = made + 1, start + size
            ids, doc_ids, size = [], [], 0
            return row

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("doc_id").to_pylist()
            for a, b in in_slices(texts):
                for key, found in zip(keys[a:b], table.encode_many(texts[a:b])):
                    ids.append(found + end)
                    doc_ids.append(key)
                    size += len(found) // 4 + 1
                    if size >= SHARD_IDS:
                        yield close()
        if ids:
            yield close()
    return run


MANIFEST = pa.schema([("task", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("doc_ids", pa.list_(pa.int64())),
                      ("in_task", pa.int64()), ("n_ids", pa.int64())])
MANIFEST_DDL = "task int, part int, path string, doc_ids array<bigint>, in_task bigint, n_ids bigint"


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str) -> DataFrame:
    """Write the shards of all documents in ascending doc_id order; the table of files.

    Documents are dealt out by ranges of doc_id. A file belongs to one task, its first position within
    the task is known there; the ids of earlier tasks are added from one row per task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    files = write_and_read(rows.select("doc_id", "text").mapInArrow(_write_shards(folder, vocabulary, end_id), MANIFEST_DDL), "token-files")
    totals = files.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = totals.select("task", (F.sum("n").over(Window.orderBy("task")) - F.col("n")).alias("before"))
    return files.join(before, "task").withColumn("start", F.col("before") + F.col("in_task"))


def read_documents(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and CRC of the ids of every document, from the files."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = SharedFolder(folder)
        for batch in batches:
            for r in batch.itertuples():
                shard = WaveletShard(store.read(r.path))
                ids, ends = shard.ids().astype("<u4"), shard.doc_ends
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                data = memoryview(ids.tobytes())
                yield pd.DataFrame({
                    "doc_id": pd.array(list(r.doc_ids), dtype="Int64"), "start": starts + r.start, "n_tokens": ends - starts,
                    "ids_crc32": [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(starts, ends)]})

    n = max(1, files.sparkSession.sparkContext.defaultParallelism * 4)
    return files.select("path", "doc_ids", "start").repartition(n).mapInPandas(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_occurrences(files: DataFrame, folder: str, token: int) -> DataFrame:
    """How often an id occurs in each file and where it does so first, without reading the ids."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = SharedFolder(folder)
        for batch in batches:
            for r in batch.itertuples():
                shard = WaveletShard(store.read(r.path))
                n = shard.count(token)
                yield pd.DataFrame({"path": [r.path], "n": [n], "first": [r.start + shard.occurrence(token, 0) if n else -1]})

    return files.select("path", "start").mapInPandas(run, "path string, n long, first long")


def token_table(spark: SparkSession, docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write all documents as token files in the shared folder and read them back."""
    folder = scratch_path(spark, "wavelet")
    return read_documents(write_token_files(docs, vocabulary, end_id, folder), folder)
