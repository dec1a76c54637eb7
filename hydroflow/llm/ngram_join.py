"""Near copies by n-gram sets: a prefix-tree join with exact links, and their classes.

A document's set holds the hashes (64 bits) of its distinct five-word shingles. Documents with equal sets are one
class from the start; the rest of the work is on one set per class.

1. Quick links. A set gives ``QUICK_KEYS`` keys of ``KEY_HASHES`` min-hashes each. Sets with a common key meet in a chunk
   of bounded size, where a trie finds links; most near copies are joined here.
2. Complete search. A set that links to another class finds at least 80 % of its shingles there. Of the shingles
   in half of the hash space, every set is told how many are held by sets of other classes; sets for which that is too few
   to link with anything are done, which most are. The others are ordered, shingles that no other class holds and rare
   ones first: two sets that link share a shingle among the first ``n - ceil(0.8 n) + 1``. Groups of shingles with the same
   members are one group, and groups around the same set meet together if a chunk can hold them. Members of other groups meet
   in chunks, and chunks in pairs if there are several, so a group of any size is compared whole and no task holds more than two chunks.

In a chunk, sets are stored in a trie with the chunk's most frequent shingles first, so that near
copies share long paths. A set runs down the trie with the overlap that the path shares;
a subtree is left when the lengths that remain cannot reach the needed overlap, or when all its
sets already are in the class of the set that runs.

Defined results: null, empty or blank texts have size 0 and are linked with nothing; with fewer than five
words the whole sequence is the one shingle; rows with equal texts are one class, whatever
their ids; a null doc_id never is a class id unless the class has no other; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hydroflow.llm.common import SharedFolder, mix64, scratch_path, small, squeezed, unsmall, unsqueezed, write_and_read
from hydroflow.llm.components import components

#: Words of a shingle; links need 100 * common >= PERCENT * union.
SHINGLE, PERCENT = 5, 80
QUICK_KEYS, KEY_HASHES = 6, 3
#: Shingles that a task sends out together, and entries of a bucket, about.
BLOCK_SHINGLES, BUCKET_SHINGLES = 2_000_000, 4_000_000
#: Shingles of all sets in a chunk, about.
CHUNK_SHINGLES = 500_000
#: Spark's setting for shuffle files to be deleted at the end of the query that made them.
LET_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of the tables that let rows of interest through; fixed, so that what is sent to tasks is bounded.
FILTER_BITS = 1 << 23

#: Bytes of text that are hashed at a time, about; words longer than ``LONG_WORD`` bytes are hashed one by one.
PIECE_BYTES, LONG_WORD = 1 << 18, 256
#: A-Z in lower case, white space as blanks.
_PLAIN = bytes(range(256)).lower().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     "))
#: A number per byte (none for a blank), and powers of an odd base and of its inverse, modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix64(np.arange(1001, 1001 + 256, dtype=np.uint64)) * (np.arange(256) != 32).astype(np.uint64)
_POWERS, _INVERSE = (np.cumprod(np.append(np.ones(1, np.uint64), np.full(PIECE_BYTES, base, np.uint64)))
                     for base in (_BASE, pow(_BASE, -1, 1 << 64)))
#: Odd factors, one per place in a shingle.
FACTORS = mix64(np.arange(101, 101 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def _hashes_of_piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and end of each word between blanks in at most ``PIECE_BYTES`` bytes."""
    codes = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(codes != 32, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * _POWERS[:len(codes)], out=sums[1:])
    sizes = ends - starts
    out = mix64((sums[ends] - sums[starts]) * _INVERSE[starts] + sizes.astype(np.uint64))
    for i in np.flatnonzero(sizes > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]])
    return out, ends


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and end of each word ``[^\\x20\\x09-\\x0D]+`` of texts in a row, A-Z lower-cased."""
    data, at, found = data.translate(_PLAIN), 0, []
    while at < len(data):
        end = len(data) if len(data) - at <= PIECE_BYTES else data.rfind(b" ", at, at + PIECE_BYTES) + 1
        if end:
            hashes, ends = _hashes_of_piece(data[at:end])
        else:  # a word longer than a piece
            end = data.find(b" ", at)
            end = end if end > 0 else len(data)
            hashes, ends = np.array([xxhash.xxh3_64_intdigest(data[at:end])], np.uint64), np.array([end - at])
        found.append((hashes, ends + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; texts are hashed together, a piece's length at a time."""
    held, size = [], 0
    for text in texts:
        held.append((text or "").encode())
        size += len(held[-1]) + 1
        if size >= PIECE_BYTES:
            yield from _sets_of_texts(held)
            held, size = [], 0
    yield from _sets_of_texts(held)


def _sets_of_texts(texts: list[bytes]) -> Iterator[np.ndarray]:
    words, ends = word_hashes(b" ".join(texts))
    last = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1, side="right").tolist()
    full = np.full(max(0, len(words) - SHINGLE + 1), SHINGLE, np.uint64)
    for k, factor in enumerate(FACTORS):
        full += words[k:k + len(full)] * factor
    full, first = mix64(full), 0
    for end in last:
        if end - first >= SHINGLE:
            yield np.unique(full[first:end - SHINGLE + 1])
        elif end > first:  # the whole sequence
            yield mix64(np.array([end - first], np.uint64) + (words[first:end] * FACTORS[:end - first]).sum(dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        first = end


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return next(shingle_sets([text]))


def needed(x: int, y: int) -> int:
    """Smallest overlap with which sets of these sizes link."""
    return -(-PERCENT * (x + y) // (100 + PERCENT))


def describe(rows: DataFrame) -> DataFrame:
    """row_key, doc_id, size, signature of the set and min-hash keys of each document."""
    bins = np.arange(QUICK_KEYS * KEY_HASHES, dtype=np.uint64) * np.uint64((1 << 64) // (QUICK_KEYS * KEY_HASHES))

    def quick_keys(s: np.ndarray) -> list[int]:
        """The smallest hash from each bin's start on (the first of all after the last), ``KEY_HASHES`` to a key."""
        least = s[np.searchsorted(s, bins) % len(s)].reshape(QUICK_KEYS, KEY_HASHES)
        out = np.arange(QUICK_KEYS, dtype=np.uint64)
        for k in range(KEY_HASHES):
            out = mix64(out + least[:, k])
        return out.view(np.int64).tolist()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for s in shingle_sets(batch["text"]):
                keys = quick_keys(s) if len(s) else []
                out.append((len(s), int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64)), keys))
            frame = pd.DataFrame(out, columns=["n", "signature", "keys"])
            yield pd.concat([batch[["row_key", "doc_id"]].astype({"doc_id": "Int64"}).reset_index(drop=True), frame], axis=1)

    return rows.mapInPandas(run, "row_key long, doc_id long, n long, signature long, keys array<long>")


class Trie:
    """Sets on paths, most frequent shingle first; a node holds a run of shingles that all its sets share."""

    __slots__ = ("run", "children", "least", "most", "ends", "one")

    def __init__(self, run=()):
        self.run, self.children, self.least, self.most, self.ends = run, {}, 1 << 62, 0, []
        self.one = None  # a set of the subtree, while all its sets were of one class when last looked at

    def add(self, path: list[int], k: int) -> list["Trie"]:
        """Put set k on its path; the nodes on it."""
        node, at, size, met = self, 0, len(path), []
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            met.append(node)
            if at == size:
                node.ends.append(k)
                return met
            child = node.children.get(path[at])
            if child is None:
                child = node.children[path[at]] = Trie(tuple(path[at:]))
                child.one = k
                at = size
            else:
                run, common = child.run, 0
                most = min(len(run), size - at)
                if run[:most] == tuple(path[at:at + most]):
                    common = most
                else:
                    while run[common] == path[at + common]:
                        common += 1
                if common < len(run):
                    upper = Trie(run[:common])
                    upper.least, upper.most, upper.one = child.least, child.most, child.one
                    upper.children[run[common]] = child
                    child.run = run[common:]
                    node.children[path[at]] = child = upper
                at += common
            node = child


def links_in(sets: list[np.ndarray], classes: list[int], stored: list[bool], running: list[bool]) -> list[tuple[int, int]]:
    """Links between stored sets and sets that run down the trie, enough of them to join the classes that link.

    ``classes``: sets of the same class are joined already. Sets run in turn; each is stored after its run.
    """
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = {}
    for i, c in enumerate(classes):
        parent[i] = first.setdefault(c, i)
    # The most frequent first within the chunk; ties as in the common order, reversed.
    tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
    root, links = Trie(), []
    for k in sorted(range(len(sets)), key=lambda i: (running[i] and not stored[i], len(sets[i]))):
        own = sets[k]
        size = len(own)
        ranks = np.searchsorted(tokens, own)
        path = ranks[np.lexsort((ranks, -counts[ranks]))].tolist()
        if running[k]:
            has = frozenset(path)
            stack = [(root, 0, 0)]
            while stack:
                node, overlap, depth = stack.pop()
                if node.one is not None and find(node.one) == find(k):
                    continue
                least, most = max(node.least, -(-size * PERCENT // 100)), min(node.most, size * 100 // PERCENT)
                if least > most or overlap + min(size - overlap, most - depth) < needed(size, least):
                    continue
                if node.run:
                    overlap += len(has.intersection(node.run))
                    depth += len(node.run)
                    if overlap + min(size - overlap, most - depth) < needed(size, least):
                        continue
                for e in node.ends:
                    if 100 * overlap >= PERCENT * (size + depth - overlap) and find(e) != find(k):
                        links.append((k, e))
                        parent[find(k)] = find(e)
                        break
                stack += [(child, overlap, depth) for child in node.children.values()]
        if stored[k]:
            for node in root.add(path, k):
                if node.one is None and not node.ends and not node.children:
                    node.one = k
                elif node.one is not None and find(node.one) != find(k):
                    node.one = None
    return links


def _bits(values: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, set at the values' low bits; at most FILTER_BITS / 8 rows reach the driver."""
    low = values.toDF("x").select(F.col("x").bitwiseAND(FILTER_BITS - 1).alias("b")).distinct()
    parts = low.groupBy(F.expr("b div 8").alias("byte")).agg(F.expr("bit_or(shiftleft(1, cast(b % 8 as int)))").alias("v")).toPandas()
    table = np.zeros(FILTER_BITS // 8, np.uint8)
    table[parts["byte"].to_numpy(np.int64)] = parts["v"].to_numpy(np.uint8)
    return table


def _has(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    b = (values.astype(np.uint64) & np.uint64(FILTER_BITS - 1)).astype(np.int64)
    return (table[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def _sets_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """row_key and set of the wanted rows; equal rows once. Other texts are passed over, but for a few that the bit table lets by."""
    sent = rows.sparkSession.sparkContext.broadcast(_bits(wanted.select("row_key").distinct()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            chosen = batch[_has(sent.value, batch["row_key"].to_numpy(np.int64))]
            if len(chosen):
                yield pd.DataFrame({"row_key": chosen["row_key"], "set": [s.tobytes() for s in shingle_sets(chosen["text"])]})

    return rows.select("row_key", "text").mapInPandas(run, "row_key long, set binary").dropDuplicates(["row_key"])


def _meet(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) between the members of each bunch. members: bunch, row_key, vertex, class, stored, running."""
    def one_bunch(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row_key"], kind="stable")
        found = links_in([np.frombuffer(b, np.uint64) for b in frame["set"]], frame["class"].tolist(),
                         frame["stored"].tolist(), frame["running"].tolist())
        v = frame["vertex"].to_numpy(np.int64)
        return pd.DataFrame({"a": [v[i] for i, _ in found], "b": [v[j] for _, j in found]}, dtype="int64")

    return members.join(sets, "row_key").groupBy("bunch").applyInPandas(one_bunch, "a long, b long")


def _bunches(rows: DataFrame, in_pairs: bool) -> DataFrame:
    """Members of bunches in which all sets with a common token meet, if sets of other classes are among them.

    rows: token, row_key, vertex, class, n. Sets with a token are a group. Groups around the same set, that with the group's smallest
    hash, have most members in common: they are one bunch if it is no larger than a chunk. Other groups are dealt at random into
    chunks, each a bunch; ``in_pairs`` adds the chunks' pairs, so that the whole group meets.
    """
    groups = rows.groupBy("token").agg(F.sum(F.xxhash64("row_key").cast("decimal(38,0)")).alias("who"), F.count("*").alias("k"),
                                       F.sum("n").alias("total"), F.min("class").alias("c0"), F.max("class").alias("c1"),
                                       F.min(F.xxhash64("row_key")).alias("around")).filter("c0 <> c1")
    one = groups.groupBy("who", "k").agg(F.min("token").alias("token"), F.first("total").alias("total"), F.first("around").alias("around"))
    rows = write_and_read(rows.join(one, "token").select("token", "row_key", "vertex", "class", "n", "total", "around"), "groups")
    near = rows.select("around", "row_key", "vertex", "class", "n").distinct()
    fit = write_and_read(near.groupBy("around").agg(F.sum("n").alias("whole")).filter(F.col("whole") <= CHUNK_SHINGLES).select("around"), "bunches")
    yes = F.lit(True)
    whole = near.join(fit, "around").select(F.xxhash64("around").alias("bunch"), "row_key", "vertex", "class", yes.alias("stored"), yes.alias("running"))
    rows = rows.join(fit, "around", "left_anti").withColumn("chunks", F.expr(f"total div {CHUNK_SHINGLES} + 1"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row_key", "token"), "chunks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)) if in_pairs else F.col("chunk"))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    same = low == high
    return whole.unionByName(rows.select(F.xxhash64("token", low, high).alias("bunch"), "row_key", "vertex", "class",
                                         (same | (F.col("chunk") == low)).alias("stored"), (same | (F.col("chunk") == high)).alias("running")))


def _quick_members(vertices: DataFrame) -> DataFrame:
    """Sets with a common min-hash key, in bunches of bounded size."""
    return _bunches(vertices.select(F.explode("keys").alias("token"), "row_key", "vertex", F.col("vertex").alias("class"), "n"), in_pairs=False)


def _offer(folder: str, buckets: int):
    """Shingles of half of the hash space, in blocks of documents: one row per block and bucket of hashes.

    A block's documents stand in a file of the shared folder; the rows name them by their place in it. Rows come
    in a fixed order, so a task that runs again makes the same blocks.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        files, task, made = SharedFolder(folder), TaskContext.get().partitionId(), 0
        held, documents, size = [], [], 0

        def close():
            nonlocal made
            made += 1
            tokens = np.concatenate(held)
            place = np.repeat(np.arange(len(held)), [len(h) for h in held])
            keys, classes, needs = (np.array(c, np.int64) for c in zip(*documents))
            name = files.write(f"block-{task}-{made}", np.stack([keys, needs]).tobytes(), fixed=True)
            by = np.argsort(tokens)
            tokens, place = tokens[by], place[by]
            bucket = (mix64(tokens) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            edges, rows = np.searchsorted(bucket[by], np.arange(buckets + 1)), []
            for q in range(buckets):
                at = by[edges[q]:edges[q + 1]]
                if len(at):
                    own, index = np.unique(place[at], return_inverse=True)
                    rows.append((name, q, squeezed(tokens[at]), small(index), small(own), classes[own].tobytes()))
            return pd.DataFrame(rows, columns=["block", "bucket", "tokens", "index", "places", "classes"])

        for batch in batches:
            for key, kind, s in zip(batch["row_key"], batch["class"], shingle_sets(batch["text"])):
                half = s[s & np.uint64(1) == 0]
                held.append(half)
                documents.append((key, kind, len(half) - (len(s) - -(-PERCENT * len(s) // 100))))
                size += len(half)
                if size >= BLOCK_SHINGLES:
                    yield close()
                    held, documents, size = [], [], 0
        if held:
            yield close()
    return run


def _held_elsewhere(frame: pd.DataFrame) -> pd.DataFrame:
    """For one bucket: how many shingles of each document sets of other classes hold, packed per block."""
    tokens = [unsqueezed(b) for b in frame["tokens"]]
    index = [unsmall(b) for b in frame["index"]]
    classes = [np.frombuffer(b, np.int64)[i] for b, i in zip(frame["classes"], index)]
    everything, kinds = np.concatenate(tokens), np.concatenate(classes)
    by = np.argsort(everything, kind="stable")
    ordered = everything[by]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    kinds = kinds[by]
    many = np.minimum.reduceat(kinds, first) != np.maximum.reduceat(kinds, first)
    shared = np.empty(len(by), bool)
    shared[by] = np.repeat(many, np.diff(np.append(first, len(by))))
    rows, start = [], 0
    for block, places, i in zip(frame["block"], frame["places"], index):
        own = shared[start:start + len(i)]
        rows.append((block, places, small(np.bincount(i[own], minlength=len(places) // 4))))
        start += len(i)
    return pd.DataFrame(rows, columns=["block", "places", "counts"])


def _hopeful(folder: str):
    """Documents of a block with enough shingles held elsewhere to link with another class."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        keys, needs = np.frombuffer(SharedFolder(folder).read(frame["block"].iloc[0]), np.int64).reshape(2, -1)
        found = np.zeros(len(keys), np.int64)
        for places, counts in zip(frame["places"], frame["counts"]):
            found[unsmall(places)] += unsmall(counts)
        return pd.DataFrame({"row_key": keys[found >= needs]})
    return run


def _all_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row per shingle of each set."""
    for batch in batches:
        sets = [np.frombuffer(b, np.int64) for b in batch["set"]]
        yield pd.DataFrame({"token": np.concatenate(sets), "row_key": np.repeat(batch["row_key"].to_numpy(np.int64), [len(x) for x in sets])})


def _hopeful_sets(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """row_key and set of the documents that may link with another class."""
    folder, buckets = scratch_path(rows.sparkSession, "offers"), total // (2 * BUCKET_SHINGLES) + 4
    offered = rows.select("row_key", "text").join(classes.select("row_key", "class"), "row_key").sortWithinPartitions("row_key")
    packed = offered.mapInPandas(_offer(folder, buckets), "block string, bucket int, tokens binary, index binary, places binary, classes binary")
    counts = packed.groupBy("bucket").applyInPandas(_held_elsewhere, "block string, places binary, counts binary")
    hopeful = write_and_read(counts.groupBy("block").applyInPandas(_hopeful(folder), "row_key long"), "hopeful")
    return write_and_read(_sets_of(rows, hopeful).join(hopeful.distinct(), "row_key", "left_semi"), "hopeful-sets")


def _complete_members(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """Members of the groups that may hold a link between classes, in chunks, and chunks in pairs."""
    tokens = write_and_read(sets.mapInPandas(_all_shingles, "token long, row_key long").join(classes, "row_key").select(
        "token", "row_key", "vertex", "class", "n"), "hopeful-shingles")
    shared = tokens.groupBy("token").agg(F.count("*").alias("held"), F.min("class").alias("c0"), F.max("class").alias("c1")).filter("c0 <> c1")
    # Shingles that no other class holds come first in every order; of the rest, a prefix takes what is left of its length.
    rest = tokens.join(shared.select("token", "held"), "token")
    own = Window.partitionBy("row_key")
    left = F.expr(f"n - (({PERCENT} * n + 99) div 100) + 1") - (F.col("n") - F.count("*").over(own))
    tokens = rest.withColumn("left", left).withColumn("place", F.row_number().over(own.orderBy("held", "token"))).filter("place <= left")
    tokens = write_and_read(tokens.select("token", "row_key", "vertex", "class", "n"), "prefixes")
    return _bunches(tokens, in_pairs=True)


@contextmanager
def _shuffles_let_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go when the table that needs them is written, not when the driver next happens to collect its garbage."""
    before = spark.conf.get(LET_GO, None)
    spark.conf.set(LET_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(LET_GO)
        else:
            spark.conf.set(LET_GO, before)


def copy_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row_key, n and class (``root``) of every row with shingles; doc_id and n of the others)."""
    with _shuffles_let_go(docs.sparkSession):
        return _copy_classes(docs)


def _copy_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("doc_id", "text").alias("row_key"))
    described = write_and_read(describe(rows), "shingle-sets")
    vertices = described.filter("n > 0").groupBy(F.col("signature").alias("vertex")).agg(
        F.min("row_key").alias("row_key"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    vertices = write_and_read(vertices, "vertices")
    members = write_and_read(_quick_members(vertices), "quick")
    quick = components(_meet(_sets_of(rows, members), members))
    classes = write_and_read(vertices.join(quick, F.col("vertex") == F.col("v"), "left").select(
        "vertex", "row_key", "n", F.coalesce("root", "vertex").alias("class")), "classes")
    sets = _hopeful_sets(rows, classes, described.agg(F.sum("n")).first()[0] or 0)
    found = _meet(sets, write_and_read(_complete_members(sets, classes), "members"))
    ends = [classes.select(F.col("vertex").alias(c), F.col("class").alias("c" + c)) for c in ("a", "b")]
    late = components(found.join(ends[0], "a").join(ends[1], "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    final = classes.join(late, F.col("class") == F.col("v"), "left").select(
        F.col("vertex").alias("signature"), F.coalesce("root", "class").alias("root"))
    members = described.filter("n > 0").join(final, "signature").select("doc_id", "row_key", "n", "root")
    return write_and_read(members, "members-of-classes"), described.filter("n = 0").select("doc_id", "n")


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    members, others = copy_classes(docs)
    smallest = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = members.join(smallest, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = others.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies and all rows without shingles, all columns.

    The row with the smallest id stays, ids that are null last; of rows with that id, that with the smallest hash of
    (doc_id, text), and of rows equal in both, that with the smallest hash of all columns.
    """
    members, _ = copy_classes(docs)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")
    stay = members.groupBy("root").agg(F.min(order)["row_key"].alias("stays"), F.count("*").alias("k")).filter("k > 1")
    told = members.join(stay, "root").select(F.col("row_key").alias("_told"), (F.col("row_key") == F.col("stays")).alias("_stays")).distinct()
    # the row's own columns are held in one, where their names meet no other
    own = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("_key"), F.xxhash64(*own).alias("_tie"), F.struct(*own).alias("_row"))
    rows = rows.join(told.hint("merge"), F.col("_key") == F.col("_told"), "left").filter("_stays IS NULL OR _stays")
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy("_tie")))
    return rows.filter("_stays IS NULL OR _place = 1").select("_row.*")
