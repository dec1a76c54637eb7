"""Shards as leaves of a k-d tree over document metadata.

A node that still has to give k shards is cut in two along its widest dimension, at
the weighted median (the floor(k/2)/k quantile of its bytes), until each leaf is one
shard of the target size. All nodes of a level are cut at once: histograms of at most
``BINS`` cells per node are summed by Spark, the cell that holds the cut is divided
again, until the cut is exact. The driver sees cells' bounds only, never rows.

Rows that agree in the widest dimension are ordered by a hash of the row, and rows with the same hash, copies of one
row mostly, by a hash of their place in the written metadata. So a source, a language or a group of equal rows of any
size can be cut anywhere and byte counts stay near equal.

Defined results: a null text has size 16 and CRC 0; null metadata is a value of its own;
repeated rows are kept, each with a slot; an empty table has no rows; more shards than
rows leave the last ones empty; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydroflow.llm.common import write_and_read

#: Cells of a histogram per node and round.
BINS = 16_384
#: Rows that one window numbers at a time.
SLOT_ROWS = 20_000
#: Positions in a dimension and hashes of rows both have so many bits.
BITS = 30
SPAN = 1 << BITS
DIMENSIONS = ("lang_at", "source_at", "length_at", "id_at")


@dataclass
class Node:
    """A box that still has to give ``shards`` leaves, numbered from ``first``; ``weight`` is its bytes.

    The cut lies between the keys ``low`` and ``high``; once they are one key that several rows have, between the places
    ``place_low`` and ``place_high``. Rows up to the cut go left.
    """

    first: int
    shards: int
    weight: int = 0
    dim: str = ""
    low: int = 0
    high: int = 0
    before: int = 0
    place_low: int = 0
    place_high: int = SPAN - 1
    done: bool = False

    @property
    def left(self) -> int:
        return self.shards // 2

    @property
    def target(self) -> int:
        """Bytes that belong left of the cut."""
        return -(-self.weight * self.left // self.shards)


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, CRC and the positions of each document; no text."""
    h = lambda c: F.xxhash64(F.coalesce(F.col(c), F.lit(""))).bitwiseAND(SPAN - 1)
    rows = docs.select(
        "doc_id", "lang", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("text_crc32"))
    return rows.select(
        "doc_id", "size", "text_crc32", h("lang").alias("lang_at"), h("source").alias("source_at"),
        F.floor(F.log2(F.col("size").cast("double")) * (SPAN / 64)).cast("long").alias("length_at"),
        F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id_raw"),
        F.xxhash64("doc_id", "text_crc32", "lang", "source", "size").bitwiseAND(SPAN - 1).alias("tie"))


def _with_boxes(rows: DataFrame, nodes: list[Node]) -> DataFrame:
    """Rows of the nodes' boxes with the box's numbers and the row's sort key in its widest dimension.

    The table of boxes has one row per node, at most one per shard; its broadcast is bounded by the number of shards.
    """
    values = [(n.first, DIMENSIONS.index(n.dim), n.low, n.high, n.place_low, n.place_high, n.target - n.before, n.first + n.left) for n in nodes]
    boxes = rows.sparkSession.createDataFrame(
        values, "node int, dim int, lo long, hi long, place_lo long, place_hi long, wanted long, right int")
    rows = rows.join(F.broadcast(boxes), "node", "left")
    return rows.withColumn("key", F.array(*DIMENSIONS)[F.col("dim")] * SPAN + F.col("tie"))


def _measure(rows: DataFrame, nodes: list[Node]) -> None:
    """Fill each node's weight and widest dimension."""
    bounds = [f(d).alias(f"{d}_{k}") for d in DIMENSIONS for k, f in (("lo", F.min), ("hi", F.max))]
    open_nodes = rows.filter(F.col("node").isin([n.first for n in nodes]))
    found = {r["node"]: r for r in open_nodes.groupBy("node").agg(F.sum("size").alias("bytes"), *bounds).collect()}
    for n in nodes:
        if r := found.get(n.first):
            n.weight = r["bytes"]
            n.dim = max(DIMENSIONS, key=lambda d: r[f"{d}_hi"] - r[f"{d}_lo"])
            n.low, n.high, n.before = r[f"{n.dim}_lo"] * SPAN, r[f"{n.dim}_hi"] * SPAN + SPAN - 1, 0
            n.place_low, n.place_high, n.done = 0, SPAN - 1, False


def _narrow(rows: DataFrame, nodes: list[Node]) -> None:
    """One round: keep, of each node's range, the cell in which its cut lies."""
    at_key = F.col("lo") < F.col("hi")
    in_key = (F.col("key") >= F.col("lo")) & (F.col("key") <= F.col("hi"))
    inside = _with_boxes(rows, nodes).filter(in_key & (at_key | F.col("place").between(F.col("place_lo"), F.col("place_hi"))))
    inside = inside.withColumns({"at": F.when(at_key, F.col("key")).otherwise(F.col("place")),
                                 "from": F.when(at_key, F.col("lo")).otherwise(F.col("place_lo")),
                                 "to": F.when(at_key, F.col("hi")).otherwise(F.col("place_hi"))})
    cells = inside.withColumn("cell", F.expr(f"(at - from) div ((to - from) div {BINS} + 1)")).groupBy("node", "cell").agg(
        F.sum("size").alias("bytes"), F.min("at").alias("first"), F.max("at").alias("last"), F.min("wanted").alias("wanted"),
        F.count(F.lit(1)).alias("rows"))
    upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("cell"))
    cells = cells.withColumn("upto", upto).filter(F.col("upto") >= F.col("wanted"))
    found = cells.groupBy("node").agg(F.min(F.struct("cell", "first", "last", F.expr("upto - bytes").alias("before"), "upto", "rows")).alias("c"))
    by_first = {n.first: n for n in nodes}
    for r in found.collect():
        n, c = by_first[r["node"]], r["c"]
        short, over = n.target - n.before - c["before"], n.before + c["upto"] - n.target
        n.before += c["before"]
        whole = c["first"] == c["last"]
        nearer_without = short < over
        if n.low < n.high:
            n.low, n.high = c["first"], c["last"]
            if whole and c["rows"] == 1:  # the last row goes left or not
                n.low = n.high = n.low - nearer_without
                n.done = True
        else:
            n.place_low, n.place_high = c["first"], c["last"]
            if whole:
                n.place_high = n.place_low = n.place_low - nearer_without
                n.done = True


def kd_shards(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row, for a number of shards."""
    rows = metadata(docs)
    ids = rows.agg(F.min("id_raw").alias("lo"), F.max("id_raw").alias("hi")).first()
    low, width = (ids["lo"] or 0), max(1, (ids["hi"] or 0) - (ids["lo"] or 0))
    rows = rows.withColumn("id_at", F.floor((F.col("id_raw") - low) / F.lit(float(width)) * (SPAN - 1)).cast("long"))
    rows = write_and_read(rows.drop("id_raw").withColumn("node", F.lit(0)), "kd-metadata")
    place = F.xxhash64(F.regexp_extract("_metadata.file_name", "part-(\\d+)", 1), "_metadata.row_index")
    rows = rows.withColumn("place", place.bitwiseAND(SPAN - 1))
    leaves, nodes = [], [Node(0, shards)]
    while nodes:
        leaves += [n for n in nodes if n.shards == 1]
        nodes = [n for n in nodes if n.shards > 1]
        if nodes:
            _measure(rows, nodes)
        nodes = [n for n in nodes if n.weight]
        while wide := [n for n in nodes if not n.done]:
            _narrow(rows, wide)
        if nodes:
            past = (F.col("key") > F.col("lo")) | (F.col("key") == F.col("lo")) & (F.col("place") > F.col("place_hi"))
            right = F.when(past, F.col("right"))
            rows = write_and_read(_with_boxes(rows, nodes).withColumn("node", F.coalesce(right, F.col("node"))).drop(
                "dim", "lo", "hi", "place_lo", "place_hi", "wanted", "right", "key"), "kd-level")
        nodes = [m for n in nodes for m in (Node(n.first, n.left), Node(n.first + n.left, n.shards - n.left))]
    return with_slots(rows.withColumnRenamed("node", "shard"))


def with_slots(rows: DataFrame) -> DataFrame:
    """Number each shard's rows from 0 without a gap.

    A shard is cut into pieces of about ``SLOT_ROWS`` rows by the hash of the rows' place, which tells copies apart;
    pieces are numbered on their own, and the rows before each piece are added.
    """
    pieces = rows.groupBy("shard").agg(F.expr(f"count(*) div {SLOT_ROWS} + 1").alias("pieces"))
    rows = rows.join(F.broadcast(pieces), "shard").withColumn("piece", F.expr(f"(place * pieces) div {SPAN}"))
    counts = rows.groupBy("shard", "piece").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("piece")) - F.col("n")
    counts = counts.select("shard", "piece", before.alias("before"))
    inner = F.row_number().over(Window.partitionBy("shard", "piece").orderBy("place", "tie", "doc_id", "text_crc32", "size"))
    numbered = rows.withColumn("inner", inner).join(counts, ["shard", "piece"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("inner") - 1).cast("long").alias("slot"))
