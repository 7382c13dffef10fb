"""Connected components of links between numbered nodes, as Spark joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.batches import staged
from tideline.session import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs below one other, and none below a node that hangs itself."""
    if not edges.groupBy("a").count().where("count > 1").isEmpty():
        return False
    return edges.select(F.col("b").alias("a")).join(edges, "a", "left_semi").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node reachable, for every node of ``links`` (``a``, ``b``).

    Nodes are longs. Each round hangs every node and its larger neighbours below its smallest
    neighbour, first looking up, then down; links get fewer as trees get flat, and the rounds end
    when every node that is left hangs at a root. Minima are taken before any shuffle, and a node with very many
    links is only ever on the side of a join that can be split. Rounds are written in between.
    Self-links make a node its own component, repeated links count once, no links give no rows.
    """
    with Scratch(links.sparkSession) as scratch:
        ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        nodes = staged(ordered.distinct(), "links", scratch)
        edges = nodes.where("a > b")
        while not _stars(edges):
            # every node looks at its smallest neighbour; larger neighbours hang there
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            up = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            large = staged(up, "links", scratch)
            # every node and its smaller neighbours hang at the smallest of them
            down = large.groupBy("a").agg(F.min("b").alias("m"))
            small = large.join(down, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            edges = staged(small.unionByName(down.select("a", F.col("m").alias("b"))).distinct(), "links", scratch)
        roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        alone = nodes.select(F.col("a").alias("node")).unionByName(nodes.select(F.col("b").alias("node"))).distinct()
        return staged(
            alone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "components")
