"""Ranked lexical search: a set of items against all documents, term at a time with limited accumulators.

Documents are cut into blocks. A block keeps, for the terms of the items, posting lists (document, occurrences); they
are written once, and Spark sums the block's counts to the corpus statistics. An item is then answered in each block
on its own: its terms are taken rarest first, each adds to the accumulators of its postings, and once the largest
sum that the remaining terms can give lies below the k-th best partial score, no accumulator is created any more.
Those that exist go on to be updated exactly. A document without one cannot be among the block's k best, so the union
of the blocks' k best holds the k best of all.

Items are taken ``ITEM_BYTES`` of text at a time; that is what the driver and each task hold of them.

Defined results: a null or empty text has no terms; each row of documents is a document, repeated rows and ids
included; a null doc_id comes after the others among equal scores; equal rows of items are one item, and rows of one
item_id with different texts are ranked apart; items without terms or matches have no rows; without documents there
are no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.llm.common import small, unsmall, write_and_read

#: Text of items that is searched in one pass over the documents.
ITEM_BYTES = 4_000_000
#: A block ends with the document that brings it to so many documents or postings before they are merged.
BLOCK_DOCS = 16_384
BLOCK_HITS = 4_000_000
#: Parts in which an item's candidates are ranked before they meet.
PARTS = 64

#: Bytes to the bytes of terms: A-Z to a-z, 0-9, a-z and all of non-ASCII stay, others end a term.
_TO_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

_BLOCK = ("doc_ids array<{id}>, n_with_terms long, n_terms long, lengths binary, terms array<int>, counts array<int>, "
          "docs binary, tfs binary")


def terms_of(text: str | bytes | None) -> list[bytes]:
    """Terms of a text, in order: maximal runs of ASCII letters and digits and of other scripts, A-Z in lower case."""
    if not text:
        return []
    return (text if isinstance(text, bytes) else text.encode()).translate(_TO_TERMS).split()


def _merged(doc_ids: list, hits: list[np.ndarray], lengths: list[int], id_type: pa.DataType) -> pa.RecordBatch:
    """One block: posting lists of each term, documents in order, with their occurrences."""
    n = len(doc_ids)
    terms = np.concatenate(hits) if hits else np.empty(0, np.int64)
    key, tf = np.unique(terms * n + np.repeat(np.arange(n), [len(h) for h in hits]), return_counts=True)
    found, counts = np.unique(key // max(n, 1), return_counts=True)
    cells = [doc_ids, sum(x > 0 for x in lengths), sum(lengths), small(np.array(lengths, np.int64)), found.tolist(),
             counts.tolist(), small(key % max(n, 1)), small(tf)]
    kinds = [pa.list_(id_type), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
    names = ["doc_ids", "n_with_terms", "n_terms", "lengths", "terms", "counts", "docs", "tfs"]
    return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names)


def _indexer(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.value.get
        doc_ids, hits, lengths, n_hits, id_type = [], [], [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = terms_of(text.as_py())
                ids = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
                doc_ids.append(doc_id)
                lengths.append(len(words))
                hits.append(ids[ids >= 0])
                n_hits += len(hits[-1])
                if len(doc_ids) >= BLOCK_DOCS or n_hits >= BLOCK_HITS:
                    yield _merged(doc_ids, hits, lengths, id_type)
                    doc_ids, hits, lengths, n_hits = [], [], [], 0
        if doc_ids:
            yield _merged(doc_ids, hits, lengths, id_type)
    return run


class Block:
    """Posting lists of some documents with what each posting adds for a weight of one."""

    def __init__(self, row: dict, n_docs: int, n_terms: int):
        self.doc_ids = row["doc_ids"]
        counts = np.array(row["counts"], np.int64)
        self.docs, tf = unsmall(row["docs"]), unsmall(row["tfs"])
        length = unsmall(row["lengths"])
        m = 25 + 75 * length * n_docs // max(n_terms, 1)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 8 * m[self.docs])
        ends = np.cumsum(counts)
        starts = ends - counts
        most = np.maximum.reduceat(self.impact, starts) if len(starts) else starts
        self.spans = {t: (s, e, b) for t, s, e, b in zip(row["terms"], starts.tolist(), ends.tolist(), most.tolist())}

    def best(self, terms: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """The k best (position, score) for terms with their weights, given rarest first."""
        steps = [(w, *self.spans[t]) for t, w in terms if w > 0 and t in self.spans]
        rest = sum(w * bound for w, _, _, bound in steps)
        score = np.zeros(len(self.doc_ids), np.int64)
        open_, survivors = True, None
        for w, start, end, bound in steps:
            rest -= w * bound
            docs, impact = self.docs[start:end], self.impact[start:end]
            if open_:
                score[docs] += w * impact
                if len(score) > k and rest < score.max() and rest < np.partition(score, -k)[-k]:
                    open_, survivors = False, np.flatnonzero(score)
            elif len(survivors) * 8 < len(docs):  # look the survivors up in the list
                at = np.minimum(np.searchsorted(docs, survivors), len(docs) - 1)
                hit = docs[at] == survivors
                score[survivors[hit]] += w * impact[at[hit]]
            else:
                hit = score[docs] > 0
                score[docs[hit]] += w * impact[hit]
        found = np.flatnonzero(score)
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], -k)[-k]]
        ids = self.doc_ids
        ranked = sorted(found.tolist(), key=lambda i: (-score[i], ids[i] is None, ids[i]) if ids[i] is not None else (-score[i], True, 0))
        return [(i, int(score[i])) for i in ranked[:k]]


def _searcher(items, n_docs: int, n_terms: int, k: int, id_type: pa.DataType, item_type: pa.DataType):
    schema = pa.schema([("item", pa.int32()), ("item_id", item_type), ("doc_id", id_type), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block, out = Block(row, n_docs, n_terms), []
                for number, (item_id, terms) in enumerate(items.value):
                    out += [(number, item_id, block.doc_ids[i], score) for i, score in block.best(terms, k)]
                columns = zip(*out) if out else ([],) * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def _search_some(docs: DataFrame, rows: list, item_schema, k: int, number: int) -> DataFrame | None:
    """Candidates of a bounded list of items: at most k of each block and item."""
    spark = docs.sparkSession
    counted = [(item_id, Counter(terms_of(text))) for item_id, text in rows]
    names = sorted({t for _, c in counted for t in c})
    if not names:
        return None
    id_field = docs.schema["doc_id"]
    vocabulary = spark.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    index = write_and_read(docs.select("doc_id", "text").mapInArrow(
        _indexer(vocabulary), _BLOCK.format(id=id_field.dataType.simpleString())), "postings")
    totals = index.agg(F.sum("n_with_terms").alias("docs"), F.sum("n_terms").alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    cells = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("c"))
    df = {r["term"]: r["df"] for r in cells.groupBy(F.col("c.terms").alias("term")).agg(F.sum("c.counts").alias("df")).collect()}
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    at = {t: i for i, t in enumerate(names)}
    items = []
    for item_id, terms in counted:
        known = sorted((df[at[t]], at[t], n) for t, n in terms.items() if at[t] in df)
        items.append((item_id, [(t, n * weight[t]) for _, t, n in known]))
    from pyspark.sql.pandas.types import to_arrow_type
    id_type, item_type = to_arrow_type(id_field.dataType), to_arrow_type(item_schema["item_id"].dataType)
    out = f"item int, item_id {item_schema['item_id'].dataType.simpleString()}, doc_id {id_field.dataType.simpleString()}, score long"
    found = index.mapInArrow(_searcher(spark.sparkContext.broadcast(items), n_docs, n_terms, k, id_type, item_type), out)
    return found.withColumn("pass", F.lit(number))


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0 of each item."""
    items = items.select("item_id", "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = size // item_bytes + 1
    found = []
    for number in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number)
        found.append(_search_some(docs, [tuple(r) for r in part.collect()], items.schema, k, number))
    found = [f for f in found if f is not None]
    kinds = {f.name: f.dataType.simpleString() for f in [*items.schema, docs.schema["doc_id"]]}
    if not found:
        return docs.sparkSession.createDataFrame([], f"item_id {kinds['item_id']}, rank int, doc_id {kinds['doc_id']}, score long")
    best = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = reduce(DataFrame.unionByName, found).withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pass", "item", "part").orderBy(*best))).where(F.col("rank") <= k)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pass", "item").orderBy(*best))).where(F.col("rank") <= k)
    return rows.select("item_id", "rank", "doc_id", "score")
