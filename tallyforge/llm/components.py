"""Connected components of a graph given by links, by alternating large-star and small-star steps.

Every round is two shuffles over the links and shrinks the components' diameters; the links of one round
are written to the shared folder, so a lost executor costs at most that round. Nodes with very many
neighbours meet their smallest one in a broadcast, so no task gathers their links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import dropped, split_join, written


def _star(links: DataFrame, large: bool, total: int) -> DataFrame:
    """Links (u, v), u > v. Joins the larger (or the smaller) neighbours of each node, and the node, to its smallest neighbour.

    The smallest neighbour comes from a grouped minimum with map-side combining and goes back to the links
    by a join that takes hubs apart, so a node with very many neighbours is never gathered into one row or task.
    """
    ways = links.select("u", "v").union(links.select(F.col("v"), F.col("u"))) if large else links.select("u", "v")
    least = ways.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
    least = written(least, "least")
    joined = split_join(ways, least, "u", "_n", total)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    out = written(out.where("u <> v").distinct(), "links")
    dropped(least)
    return out


def _settled(links: DataFrame) -> bool:
    """Whether the links are stars around the components' ends: each node has one link, and to a node that has none itself."""
    n, nodes = links.agg(F.count(F.lit(1)), F.count_distinct("u")).first()
    return n == nodes and links.select("u").join(links.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of long ids, in any direction, repeated or not -> (node, component), the smallest id reachable.

    Nodes without a link to another are not returned. Null ends are not links. An empty table gives no rows.
    """
    links = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    links = written(links, "links")
    while not _settled(links):
        total = 2 * links.count()
        middle = _star(links, True, total)
        found = _star(middle, False, total)
        for done in (links, middle):
            dropped(done)
        links = found
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
