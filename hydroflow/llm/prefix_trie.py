"""The trie of conversation prefixes, built as a burst trie.

A conversation is a sequence of turn ids, 16 bytes of the digest of role and text. All sequences start in one container
below the root. A container with more than ``most`` members bursts: its head becomes a trie node, and its members go
into one container per next turn id. Counting is a grouped sum over ``LEVELS`` levels at a time, so a common
beginning is found by sums and moves no rows. What is left are containers of at most ``most`` suffixes. They are
dealt over the cluster by their head's path, sorted, and swept once: a stack of open nodes gives every node's members,
children, leaves and saved bytes. Heads then add up the containers and heads below them.

Turn texts are hashed where they are read. A row holds one conversation's turn ids; a container's nodes are held
while it is swept. Members that end at a head, however many, are joined by ranges of conv_id and hashed as a stream.

Defined results: a null role or text is empty; rows without conv_id are left out; turns are ordered by turn (null first),
then role, then the digest of role and text, repeated rows included; a conversation without turns is a member of the
root; an empty table has no nodes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.common import write_and_read
from hydroflow.operators.ranks import with_key_table

#: Members with which a container is not burst.
MOST = 512
#: Levels that are counted in one pass over the members of burst containers.
LEVELS = 8
#: Ends of a head that are joined to one string at a time, by the size of the range of conv_id.
END_RANGE = 4096
#: A head lends its first turns to the conversations of its group of five.
GROUP = 5
LENT = 9

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def _digest(data: Column) -> Column:
    """16 bytes of SHA-256."""
    return F.unhex(F.substring(F.sha2(data, 256), 1, 32))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, ids and sizes (bytes of text) of every conversation, its beginning taken from its group's first one."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"),
        _digest(F.encode(F.concat(F.octet_length(text("role")).cast("string"), F.lit(":"), text("role"), text("text")), "UTF-8")).alias("id"),
        F.octet_length(text("text")).alias("size"))
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "id", "size"))).alias("turns"))
    own = own.select("conv_id", F.transform("turns", lambda x: F.struct(x["id"].alias("id"), x["size"].alias("size"))).alias("turns"))
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    lent = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("group"), F.slice("turns", 1, LENT - 1).alias("lent"))
    both = own.withColumn("group", group).join(lent, "group", "left").withColumn("n", (F.crc32(F.col("conv_id").cast("string")) % LENT).cast("int"))
    first = F.slice(F.coalesce("lent", F.slice("turns", 1, 0)), F.lit(1), F.col("n"))
    rest = F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))
    both = both.select("conv_id", F.concat(first, rest).alias("turns"))
    return both.select("conv_id", F.transform("turns", lambda x: x["id"]).alias("ids"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


def _with_levels(state: DataFrame) -> DataFrame:
    """Add ``levels``: the next nodes on each member's way, each with the digest of its path as key."""
    found, above = [], F.col("key")
    for j in range(1, LEVELS + 1):
        there = F.size("ids") >= F.col("at") + j
        state = state.withColumn(f"_key{j}", F.when(there, _digest(F.concat(above, F.get("ids", F.col("at") + (j - 1))))))
        found.append(F.struct(F.lit(j).alias("level"), F.col(f"_key{j}").alias("key"), above.alias("above"),
                              F.get("sizes", F.col("at") + (j - 1)).alias("size")))
        above = F.col(f"_key{j}")
    state = state.withColumn("levels", F.filter(F.array(*found), lambda x: x["key"].isNotNull()))
    return state.drop(*[f"_key{j}" for j in range(1, LEVELS + 1)])


def _burst(state: DataFrame, most: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass: (members with the depth of their last head, new heads, children of each node)."""
    state = write_and_read(_with_levels(state), "trie-levels")
    steps = state.select("conv_id", "at", F.explode("levels").alias("l")).select("conv_id", "at", "l.*")
    counts = write_and_read(steps.groupBy("key").agg(
        F.count(F.lit(1)).alias("members"), F.min("conv_id").alias("least"), F.any_value("level").alias("level"),
        F.any_value("above").alias("above"), F.any_value("size").alias("size"), (F.any_value("at") + F.any_value("level")).alias("depth")), "trie-counts")
    large = counts.where(F.col("members") > most)
    deepest = with_key_table(steps.select("conv_id", "key", "level"), large.select("key", "members", "least"), ["key"], "members") \
        .groupBy("conv_id").agg(F.max(F.struct("level", "least")).alias("head"))
    members = state.join(deepest, "conv_id", "left").withColumn("deep", F.coalesce("head.level", F.lit(0))) \
        .withColumn("least", F.coalesce("head.least", "least")).drop("head")
    way = state.select(F.col("conv_id").alias("least"), "path", F.transform("levels", lambda x: x["key"]).alias("keys"))
    heads = large.join(way, "least").withColumn("path", F.concat("path", F.slice("keys", F.lit(1), F.col("level")))).drop("keys", "level")
    children = counts.groupBy(F.col("above").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    return write_and_read(members, "trie-members"), heads, children


def _head_at(level: Column) -> Column:
    """Key of the head so many levels below the pass's start."""
    return F.when(level == 0, F.col("key")).otherwise(F.get("levels", level - 1)["key"])


class _Node:
    __slots__ = ("depth", "size", "above", "least", "n", "children", "leaves", "saved", "ends")

    def __init__(self, depth: int, size: int, above: _Node | None):
        self.depth, self.size, self.above = depth, size, above
        self.least, self.n, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, None

    def end(self, conv_id: int) -> None:
        if self.ends is None:
            self.ends = hashlib.sha256(b"%d" % conv_id)
        else:
            self.ends.update(b",%d" % conv_id)
        self.n += 1
        self.least = conv_id if self.least is None else min(self.least, conv_id)

    def close(self) -> None:
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * self.size
        if up := self.above:
            up.n, up.children, up.leaves, up.saved = up.n + self.n, up.children + 1, up.leaves + self.leaves, up.saved + self.saved
            up.least = self.least if up.least is None else min(up.least, self.least)


SWEPT = NODE + ", head binary"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of sorted containers: rows (container, head, least, depth, conv_id, suffix, sizes)."""
    names = [f.split()[0] for f in SWEPT.split(", ")]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.binary()]
    current, nodes, open_, before, head, least = None, [], [], [], None, None

    def swept() -> pa.RecordBatch:
        while open_:
            open_.pop().close()
        rows = [(n.least, n.depth, n.above.least if n.above else least, n.n, n.children, n.leaves, n.saved,
                 n.ends.hexdigest() if n.ends else NO_ENDS, None if n.above else head) for n in nodes]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        for row in batch.to_pylist():
            suffix, sizes = row["suffix"], row["sizes"]
            if row["container"] != current:
                if nodes:
                    yield swept()
                current, head, least, before = row["container"], row["head"], row["least"], []
                nodes = [_Node(row["depth"], sizes[0], None)]
                open_[:] = nodes
            same = 0
            while same < len(before) and same < len(suffix) and before[same] == suffix[same]:
                same += 1
            while len(open_) > same + 1:
                open_.pop().close()
            for i in range(same, len(suffix)):
                nodes.append(_Node(open_[-1].depth + 1, sizes[i + 1], open_[-1]))
                open_.append(nodes[-1])
            open_[-1].end(row["conv_id"])
            before = suffix
    if nodes:
        yield swept()


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest per key of sorted rows (key, piece, ids)."""
    key, state = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ends_sha256"])

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if state is None or k != key:
                if state is not None:
                    yield row()
                key, state = k, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield row()


def _ends_of_heads(ends: DataFrame) -> DataFrame:
    """Digest of the members that end at each head: ranges of ids are joined on their own, then hashed in order."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("key", F.floor(F.col("conv_id") / END_RANGE).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(_hash_ends, "key binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, most: int = MOST) -> DataFrame:
    """One row per node of the trie of sequences (conv_id, ids, sizes; conv_id unique)."""
    spark = sequences.sparkSession
    sequences = write_and_read(sequences, "trie-sequences")
    root = sequences.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).first()
    if not root["n"]:
        return spark.createDataFrame([], NODE)
    nothing = F.lit("").cast("binary")
    state = sequences.select("*", F.lit(0).alias("at"), nothing.alias("key"), F.array(nothing).alias("path"), F.lit(root["least"]).alias("least"))
    heads = [spark.range(1).select(nothing.alias("key"), F.lit(root["n"]).alias("members"), F.lit(root["least"]).alias("least"),
                                   F.lit(None).cast("binary").alias("above"), F.lit(0).alias("size"), F.lit(0).alias("depth"),
                                   F.array(nothing).alias("path"))]
    children, containers, ends = [], [], []
    while True:
        members, more_heads, more_children = _burst(state, most)
        heads.append(more_heads)
        children.append(more_children)
        left = F.size("ids") - F.col("at")
        ends.append(members.where(F.col("deep") == left).select(_head_at(F.col("deep")).alias("key"), "conv_id"))
        depth = F.col("at") + F.col("deep") + 1
        containers.append(members.where((F.col("deep") < left) & (F.col("deep") < LEVELS)).select(
            F.get("levels", F.col("deep"))["key"].alias("container"), _head_at(F.col("deep")).alias("head"), "least",
            depth.cast("long").alias("depth"), "conv_id", F.slice("ids", depth + 1, F.size("ids")).alias("suffix"),
            F.slice("sizes", depth, F.size("ids")).alias("sizes")))
        state = members.where((F.col("deep") == LEVELS) & (left > LEVELS)).select(
            "conv_id", "ids", "sizes", (F.col("at") + LEVELS).alias("at"), _head_at(F.col("deep")).alias("key"),
            F.concat("path", F.transform("levels", lambda x: x["key"])).alias("path"), "least")
        if state.isEmpty():
            break
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    dealt = union(containers).repartition("container").sortWithinPartitions("container", "suffix", "conv_id")
    nodes = write_and_read(dealt.mapInArrow(_sweep, SWEPT), "trie-nodes")
    heads = write_and_read(union(heads), "trie-heads")
    return nodes.drop("head").unionByName(_head_nodes(heads, nodes, union(children), union(ends)))


def _head_nodes(heads: DataFrame, nodes: DataFrame, children: DataFrame, ends: DataFrame) -> DataFrame:
    """Nodes of the heads, with the sums of all containers and heads below them."""
    below = nodes.where(F.col("head").isNotNull()).groupBy(F.col("head").alias("key")).agg(
        F.sum("n_leaves").alias("leaves_below"), F.sum("saved_tokens").alias("saved_below"))
    counts = children.groupBy("key").agg(F.sum("n_children").alias("n_children"))
    heads = heads.join(below, "key", "left").join(counts, "key", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)),
        "own_saved": (F.col("members") - 1) * F.col("size") + F.coalesce("saved_below", F.lit(0))})
    own_leaves = F.coalesce("leaves_below", F.lit(0)) + (F.col("n_children") == 0).cast("long")
    sums = heads.select(F.explode("path").alias("key"), own_leaves.alias("leaves"), "own_saved").groupBy("key").agg(
        F.sum("leaves").alias("n_leaves"), F.sum("own_saved").alias("saved_tokens"))
    parents = heads.select(F.col("key").alias("above"), F.col("least").alias("parent_conv_id"))
    heads = heads.join(sums, "key").join(parents, "above", "left").join(_ends_of_heads(ends), "key", "left")
    return heads.select(
        F.col("least").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", F.col("members").alias("n_convs"),
        "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
