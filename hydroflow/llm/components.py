"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydroflow.llm.common import write_and_read

#: Pointer doublings per round.
DOUBLINGS = 3


def _ancestors(parents: DataFrame) -> DataFrame:
    """(v, p) with p moved up the tree, 2 ** DOUBLINGS steps or to its root."""
    for _ in range(DOUBLINGS):
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("g"))
        parents = parents.join(up, "p", "left").select("v", F.coalesce("g", "p").alias("p"))
    return parents


def components(links: DataFrame) -> DataFrame:
    """(v, root) of every vertex of the links (a, b); the root is a vertex of the component, the same for all of it.

    Each round points a vertex at its smallest neighbour, climbs these trees and replaces every link's ends
    by where they lead; links that become loops fall away. Replacing vertices keeps a component connected, so
    when no link is left each component has one vertex. All rounds are joins and sums of written tables; nothing
    is collected. Few rounds are needed when vertices are numbered at random, as hashes are.
    """
    links = write_and_read(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    labels = None
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("a"), F.min("b")).alias("p"))
        parents = write_and_read(_ancestors(write_and_read(parents, "parents")), "ancestors")
        if labels is None:
            labels = parents.select("v", F.col("p").alias("root"))
        else:
            onward = parents.select(F.col("v").alias("root"), "p")
            labels = write_and_read(labels.join(onward, "root", "left").select("v", F.coalesce("p", "root").alias("root")), "labels")
        ends = [parents.select(F.col("v").alias(c), F.col("p").alias("p" + c)) for c in ("a", "b")]
        links = links.join(ends[0], "a").join(ends[1], "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        links = write_and_read(links.filter("a < b").distinct(), "links")
    return links.select(F.col("a").alias("v"), F.col("a").alias("root")) if labels is None else labels
