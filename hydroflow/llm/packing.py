"""Documents packed into sequences of a fixed length by first-fit decreasing.

Each document's ids are cut into whole sequences and one rest. The rests are dealt at random into groups of
about ``GROUP_RESTS`` pieces; each group is packed on its own, longest piece first, into the first
sequence with room. A tournament tree over the room that is left in each sequence finds it in
logarithmic time. Groups are of bounded size whatever the documents are, because pieces are
dealt by a number drawn per piece and not by any of their values.

Defined results: a null or empty text is one piece with the end id; rows with equal or null
ids are packed each on its own; an empty table gives no sequences; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.common import write_and_read
from hydroflow.llm.tokens import in_slices, word_table

#: Pieces in a group, about; a group has at most 2 ** SEQUENCE_BITS sequences.
GROUP_RESTS = 8192
SEQUENCE_BITS = 24

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, draw long"


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece: longest first, each into the first sequence that has room for it.

    ``tree`` is a tournament: leaf i is the room left in sequence i, an inner node the larger of its two
    children, so that the way down to the first leaf with enough room is found by looking left first.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [room] * (2 * leaves)
    where, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    sizes = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        size, node = sizes[i], 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        where[i], offset[i] = node - leaves, room - tree[node]
        tree[node] -= size
        node >>= 1
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node >>= 1
    return where, offset


def _cut(vocabulary: str, end_id: int, room: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table = word_table(vocabulary, "<u4", True)
        draw = np.random.default_rng([seed, TaskContext.get().partitionId()])
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("doc_id").to_pylist()
            rows = [[], [], [], [], []]
            for a, b in in_slices(texts):
                for key, found in zip(keys[a:b], table.encode_many(texts[a:b])):
                    data = found + end
                    n = len(data) // 4
                    for start in range(0, n, room):
                        part = data[4 * start:4 * (start + room)]
                        for column, value in zip(rows, (key, start, len(part) // 4, zlib.crc32(part), n)):
                            column.append(value)
            out = [pa.array(c, pa.int64()) for c in rows] + [pa.array(draw.integers(0, 1 << 62, len(rows[0])), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"])
    return run


def cut_documents(docs: DataFrame, vocabulary: str, end_id: int, room: int, seed: int) -> DataFrame:
    """A row per piece with the number drawn for it, in a written table: a task that runs again draws the same."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return write_and_read(rows.mapInArrow(_cut(vocabulary, end_id, room, seed), PIECES), "pieces")


def pack(pieces: DataFrame, room: int) -> DataFrame:
    """Add sequence_id and offset to the pieces."""
    n = pieces.count()
    groups = max(1, -(-n // GROUP_RESTS))

    def one_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "start", "ids_crc32"], kind="stable")
        sequence, offset = first_fit_decreasing(rows["length"].to_numpy(np.int64), room)
        rows["sequence_id"] = (rows["bunch"].to_numpy(np.int64) << SEQUENCE_BITS) + sequence
        rows["offset"] = offset
        return rows.drop(columns=["bunch", "draw"])

    names = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return pieces.withColumn("bunch", F.col("draw") % groups).groupBy("bunch").applyInPandas(one_group, names)


def sequences(docs: DataFrame, packed: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """sequence_id and its ids in a row, for documents with ids of their own; the padding is left to the reader."""
    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = word_table(vocabulary, "<u4", True)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            batch["ids"] = [np.append(np.frombuffer(x, "<u4"), end_id).astype(np.int32) for x in table.encode_many(texts)]
            yield batch[["doc_id", "ids"]]

    ids = docs.select("doc_id", "text").mapInPandas(encode, "doc_id long, ids array<int>")
    parts = packed.join(ids, "doc_id").select("sequence_id", "offset", F.slice("ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int")).alias("ids"))
    whole = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"]))
    return parts.groupBy("sequence_id").agg(whole.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 2, room: int = 4096, seed: int = 11) -> DataFrame:
    """All documents in sequences of at most ``room`` ids, one row per piece."""
    return pack(cut_documents(docs, vocabulary, end_id, room, seed), room)
