"""Log-probabilities of texts from a weighted backoff automaton over smoothed bigrams.

Model. Words and one end per text; a state is the last word (or the begin of a text). Bigrams that
training texts hold at least ``LEAST_COUNT`` times are arcs with an absolutely discounted, interpolated probability; every
state has a failure arc to the empty state whose arcs are the words, with the discounts' mass as its weight. The empty state
gives what is discounted from words to all unknown words as one class. Each state's arcs sum to 1.

Work. Documents are cut into blocks. A block's words and bigrams are counted where it is read, its texts are
kept as word numbers in a file of the shared folder, and its counts go out in packed arrays, one per block and
bucket of hashes; a bucket adds up the counts of all blocks and answers each block with the totals of just the words and bigrams
that it holds. Of the blocks that hold a kept bigram, one is told that it owns it; a block sums up the bigrams that it owns by
their first words, and buckets of words add these sums up, so first words are not sent along with the bigrams. A block then builds its part of the automaton, weighs each of its bigrams once, as the step from the first word's
state on the second word, and adds up the steps of each text from left to right. What moves is one entry per block and
distinct bigram, so a word that makes up a third of all text is one entry per block, and counts cover all training text.

Defined results: a null or empty text is scored as its end alone; rows with a null id belong to training;
rows with equal ids are kept; without training texts all probabilities are 1; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.common import (SharedFolder, WordHashes, lower_words, mix64, scratch_path, small, squeezed, unsmall, unsqueezed,
                                  write_and_read)

#: Tokens in a block and entries in a bucket, about.
BLOCK_TOKENS, BUCKET_ENTRIES = 1_500_000, 1_500_000
#: Bytes of texts that a worker opens at a time, about.
OPEN_BYTES = 4_000_000
#: Bigrams with fewer training counts are left to the failure arc.
LEAST_COUNT = 2
END, BEGIN = np.uint64(1), np.uint64(2)

_WORDS = WordHashes(least=3)


def _pair_keys(words: np.ndarray, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
    """48 bits per bigram; with the bucket, which depends on both words too, they are as good as 54 and more."""
    return mix64(mix64(words[heads]) + words[tails]) >> np.uint64(16)


def _pair_bucket(words: np.ndarray, heads: np.ndarray, tails: np.ndarray, buckets: int) -> np.ndarray:
    """Bigrams of a first word go to an eighth of the buckets: few words are named in many buckets, and the most frequent one fills none."""
    spread = np.uint64(max(1, buckets // 8))
    return ((mix64(words) % np.uint64(buckets))[heads] + (mix64(words + np.uint64(1)) % spread)[tails]).astype(np.int64) % buckets


def _bucket_of(x: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64(x) % np.uint64(buckets)).astype(np.int64)


SEGMENT = "block string, bucket int, kind string, keys binary, counts binary"
SEGMENT_ARROW = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("counts", pa.binary())])


def _segments(block: str, kind: str, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray, buckets: int):
    """One row per bucket; keys rise within it."""
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for q in range(buckets):
        at = by[edges[q]:edges[q + 1]]
        if len(at):
            yield block, q, kind, squeezed(keys[at]), small(counts[at])


def _pairs(ids: np.ndarray, ends: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second words of the distinct bigrams of texts in a row, and the bigram at each place."""
    before = np.empty(len(ids), np.int64)
    before[1:] = ids[:-1]
    before[np.concatenate([[0], ends[:-1]])] = begin
    pairs, pair_of = np.unique(before * (begin + 1) + ids, return_inverse=True)
    return pairs // (begin + 1), pairs % (begin + 1), pair_of


class Block:
    """Texts of a block as numbers of its words, and its distinct bigrams with training counts."""

    def __init__(self, doc_ids: list, held_out: list[bool], hashes: list[np.ndarray]):
        ends = np.cumsum([len(h) + 1 for h in hashes])
        tokens = np.concatenate([x for h in hashes for x in (h, [END])]).astype(np.uint64)
        words, ids = np.unique(tokens, return_inverse=True)
        self.words = np.append(words, BEGIN)
        self.ids, self.heads, self.tails, pair_of = ids, *_pairs(ids, ends, len(words))
        trained = np.repeat(~np.array(held_out, bool), np.diff(ends, prepend=0))
        self.word_counts = np.bincount(ids[trained], minlength=len(self.words))
        self.word_counts[-1] = int((~np.array(held_out, bool)).sum())
        self.pair_counts = np.bincount(pair_of[trained], minlength=len(self.heads))
        self.doc_ids, self.held_out, self.ends = doc_ids, held_out, ends

    def segments(self, block: str, buckets: int) -> pd.DataFrame:
        by = np.argsort(self.words)
        rows = list(_segments(block, "word", _bucket_of(self.words[by], buckets), self.words[by], self.word_counts[by], buckets))
        keys = _pair_keys(self.words, self.heads, self.tails)
        by = np.argsort(keys)
        rows += _segments(block, "pair", _pair_bucket(self.words, self.heads, self.tails, buckets)[by], keys[by], self.pair_counts[by], buckets)
        return pd.DataFrame(rows, columns=["block", "bucket", "kind", "keys", "counts"])

    def file(self) -> bytes:
        """Words, and the texts as numbers of words."""
        out = io.BytesIO()
        np.savez(out, words=np.frombuffer(squeezed(self.words[:-1]), np.uint8), ids=np.frombuffer(small(self.ids), np.uint8), ends=self.ends, held_out=np.array(self.held_out, bool),
                 doc_ids=np.array([d or 0 for d in self.doc_ids], np.int64), no_id=np.array([d is None for d in self.doc_ids], bool))
        return zstandard.ZstdCompressor(level=1).compress(out.getvalue())

    @staticmethod
    def read(data: bytes) -> dict[str, np.ndarray]:
        found = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)))
        found = {k: found[k] for k in found.files}
        found["words"], found["ids"] = np.append(unsqueezed(found["words"].tobytes()), BEGIN), unsmall(found["ids"].tobytes())
        return found | dict(zip(("heads", "tails", "pair_of"), _pairs(found["ids"], found["ends"], len(found["words"]) - 1)))


def _opened(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Rows of a batch; about ``OPEN_BYTES`` of it stand as Python objects at a time."""
    step = max(1, batch.num_rows * OPEN_BYTES // max(1, batch.nbytes))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        yield from zip(*[part.column(c).to_pylist() for c in ("doc_id", "held_out", "text")])


def _count_blocks(folder: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, task, made = SharedFolder(folder), TaskContext.get().partitionId(), 0
        ids, held, hashes, size = [], [], [], 0

        def close():
            nonlocal made
            block, made = Block(ids, held, hashes), made + 1
            rows = block.segments(files.write(f"block-{task}-{made}", block.file(), fixed=True), buckets)
            return pa.RecordBatch.from_pandas(rows, schema=SEGMENT_ARROW, preserve_index=False)

        for batch in batches:
            for doc, out, text in _opened(batch):
                ids.append(doc)
                held.append(bool(out))
                hashes.append(_WORDS.of(lower_words(text)))
                size += len(hashes[-1]) + 1
                if size >= BLOCK_TOKENS:
                    yield close()
                    ids, held, hashes, size = [], [], [], 0
        if ids:
            yield close()
    return run


def _add_up(frame: pd.DataFrame) -> pd.DataFrame:
    """Totals of a bucket's words or bigrams: answers to the blocks, and sums that the model needs.

    Row kinds: ``word``/``pair`` answers a block with the totals of its own keys in their order, and with a bit for
    each kept bigram that it owns; ``sums`` holds counts of counts.
    """
    kind, bucket = frame["kind"].iloc[0], int(frame["bucket"].iloc[0])
    keys = [unsqueezed(b) for b in frame["keys"]]
    distinct, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = np.zeros(len(distinct), np.int64)
    np.add.at(totals, at, np.concatenate([unsmall(b) for b in frame["counts"]]))
    owns = np.zeros(len(at), bool)
    if kind == "pair":
        owns[first[totals >= LEAST_COUNT]] = True
    rows, start = [], 0
    for block, k in zip(frame["block"], keys):
        own = slice(start, start + len(k))
        rows.append((kind, block, bucket, small(totals[at[own]]), np.packbits(owns[own]).tobytes() if kind == "pair" else b"", 0, 0, 0, 0))
        start += len(k)
    words = totals[distinct != BEGIN] if kind == "word" else totals
    rows.append(("sums " + kind, "", bucket, b"", b"", int(words.sum()), int((words > 0).sum()), int((words == 1).sum()), int((words == 2).sum())))
    return pd.DataFrame(rows, columns=["kind", "block", "bucket", "counts", "sums", "total", "types", "ones", "twos"])


TOTALS = "kind string, block string, bucket int, counts binary, sums binary, total long, types long, ones long, twos long"


def _kept_parts(folder: str, buckets: int):
    """Per bucket of words: a block's words, and number and sum of the kept bigrams it owns that begin with each of them."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        name = frame["block"].iloc[0]
        block = Block.read(SharedFolder(folder).read(name))
        words, heads = block["words"], block["heads"]
        by_key, bucket = _pair_order(block, buckets)
        totals, owned = (_aligned(frame, bucket, column, "pair") for column in ("counts", "owns"))
        own = np.flatnonzero(owned)
        n = np.bincount(heads[by_key[own]], minlength=len(words))
        s = np.bincount(heads[by_key[own]], weights=totals[own], minlength=len(words)).astype("<i8")
        by = np.argsort(words)
        bucket = _bucket_of(words[by], buckets)
        at = np.argsort(bucket, kind="stable")
        edges, rows = np.searchsorted(bucket[at], np.arange(buckets + 1)), []
        for q in range(buckets):
            if edges[q] < edges[q + 1]:
                mine = by[at[edges[q]:edges[q + 1]]]
                rows.append((name, q, squeezed(words[mine]), small(n[mine]), s[mine].tobytes()))
        return pd.DataFrame(rows, columns=["block", "bucket", "keys", "counts", "sums"])
    return run


def _add_up_kept(frame: pd.DataFrame) -> pd.DataFrame:
    """Answers to the blocks of a bucket of words: number and sum of the kept bigrams that begin with each of a block's words."""
    keys = [unsqueezed(b) for b in frame["keys"]]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate([unsmall(b) for b in frame["counts"]])).astype(np.int64)
    s = np.bincount(at, weights=np.concatenate([np.frombuffer(b, "<i8") for b in frame["sums"]])).astype("<i8")
    rows, start = [], 0
    for block, k in zip(frame["block"], keys):
        mine = at[start:start + len(k)]
        rows.append(("kept", block, int(frame["bucket"].iloc[0]), small(n[mine]), s[mine].tobytes()))
        start += len(k)
    return pd.DataFrame(rows, columns=["kind", "block", "bucket", "counts", "sums"])


class Automaton:
    """A block's part of the automaton: log10 weights of word arcs, bigram arcs and failure arcs.

    ``counts``, ``kept_n``, ``kept_sum`` are per word of the block, ``pairs`` per bigram of the block.
    """

    def __init__(self, block, counts, kept_n, kept_sum, pairs, model: dict):
        n = model["tokens"]
        self.width = len(block["words"])
        d1, d2 = model["word_discount"], model["pair_discount"]
        if n:
            single = np.where(counts > 0, (counts - d1) / n, d1 * model["types"] / n)
            left = 1.0 - np.where(counts > 0, (kept_sum - d2 * kept_n) / np.maximum(counts, 1), 0.0)
            heads, tails = block["heads"], block["tails"]
            is_arc = pairs >= LEAST_COUNT
            h, t = heads[is_arc], tails[is_arc]
            weight = np.log10((pairs[is_arc] - d2) / counts[h] + left[h] * single[t])
        else:
            single, left = np.ones(self.width), np.ones(self.width)
            is_arc, weight = np.zeros(len(pairs), bool), np.zeros(0)
        #: log10 weight of each bigram of the block: its arc's, or that of failing to the empty state and taking the word's arc.
        self.steps = np.log10(np.maximum(left, 1e-300))[block["heads"]] + np.log10(single)[block["tails"]]
        self.steps[is_arc] = weight

    def score(self, pair_of: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sums over texts in a row, from left to right: the state is the word before, so a place's bigram names its step."""
        text_of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        return np.bincount(text_of, weights=self.steps[pair_of], minlength=len(ends))


def _aligned(rows: pd.DataFrame, bucket: np.ndarray, column: str, kind: str) -> np.ndarray:
    """Answers of all buckets, put at the places of the keys that a block sent (keys rise within a bucket)."""
    out = np.zeros(len(bucket), np.int64)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(int(bucket.max()) + 2)) if len(bucket) else np.zeros(1, int)
    for r in rows[rows["kind"] == kind].itertuples():
        at = by[edges[r.bucket]:edges[r.bucket + 1]]
        if column == "owns":
            out[at] = np.unpackbits(np.frombuffer(r.sums, np.uint8), count=len(at))
        else:
            out[at] = unsmall(r.counts) if column == "counts" else np.frombuffer(r.sums, "<i8")
    return out


def _pair_order(block: dict[str, np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order in which a block sent its bigrams, and their buckets in it."""
    by_key = np.argsort(_pair_keys(block["words"], block["heads"], block["tails"]))
    return by_key, _pair_bucket(block["words"], block["heads"], block["tails"], buckets)[by_key]


def _score_block(folder: str, buckets: int, model: dict):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block.read(SharedFolder(folder).read(frame["block"].iloc[0]))
        words = block["words"]
        by = np.argsort(words)
        bucket = _bucket_of(words[by], buckets)

        def in_order(by, values):
            out = np.empty(len(by), np.int64)
            out[by] = values
            return out

        def per_word(column, kind):
            return in_order(by, _aligned(frame, bucket, column, kind))

        counts, kept_n, kept_sum = per_word("counts", "word"), per_word("counts", "kept"), per_word("sums", "kept")
        by_key, pair_bucket = _pair_order(block, buckets)
        pairs = in_order(by_key, _aligned(frame, pair_bucket, "counts", "pair"))
        automaton = Automaton(block, counts, kept_n, kept_sum, pairs, model)
        ids, pair_of, ends = block["ids"], block["pair_of"], block["ends"]
        starts = np.concatenate([[0], ends[:-1]])
        n, v = model["tokens"], model["types"]
        base = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))[ids]
        known = (counts > 0)[ids]
        rows = pd.DataFrame({
            "doc_id": pd.array(block["doc_ids"], dtype="Int64"), "held_out": block["held_out"], "n_tokens": ends - starts,
            "n_known": np.add.reduceat(known.astype(np.int64), starts), "train_tokens": n, "base_score": np.add.reduceat(base, starts),
            "score": automaton.score(pair_of, ends)})
        rows.loc[block["no_id"], "doc_id"] = pd.NA
        return rows
    return run


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Token counts, base score and automaton score of every document; held-out ones are not counted."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About one distinct entry in five bytes of a block, whichever way blocks repeat each other.
    buckets = max(4, size // (5 * BUCKET_ENTRIES) + 1)
    folder = scratch_path(spark, "lm-blocks")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out)
    segments = rows.mapInArrow(_count_blocks(folder, buckets), SEGMENT)
    totals = write_and_read(segments.groupBy("kind", "bucket").applyInPandas(_add_up, TOTALS), "lm-totals")
    sums = {r["kind"]: r for r in totals.filter("kind LIKE 'sums%'").groupBy("kind").agg(
        *[F.sum(c).alias(c) for c in ("total", "types", "ones", "twos")]).collect()}
    if not sums:
        names = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        return spark.createDataFrame([], names)
    word, pair = sums["sums word"], sums["sums pair"]
    model = {"tokens": word["total"], "types": word["types"],
             "word_discount": min(0.9, max(0.1, word["ones"] / max(1, word["types"]))),
             "pair_discount": min(0.95, max(0.1, pair["ones"] / max(1, pair["ones"] + 2 * pair["twos"])))}
    told = totals.filter("kind IN ('word', 'pair')").select("kind", "block", "bucket", "counts", "sums")
    parts = told.filter("kind = 'pair'").groupBy("block").applyInPandas(
        _kept_parts(folder, buckets), "block string, bucket int, keys binary, counts binary, sums binary")
    kept = parts.groupBy("bucket").applyInPandas(_add_up_kept, "kind string, block string, bucket int, counts binary, sums binary")
    told = told.withColumn("sums", F.lit(None).cast("binary")).unionByName(kept)
    names = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return told.groupBy("block").applyInPandas(_score_block(folder, buckets, model), names)


def perplexity(scores: DataFrame) -> DataFrame:
    """Perplexity per token of the held-out documents: of the base and of the automaton."""
    value = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.filter("held_out").agg(value("base_score").alias("base"), value("score").alias("automaton"))

