"""Connected components of an undirected link table, by contraction: each round at least halves the nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, discard, join_groups, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link.

    Each round every node points to its smallest neighbour. Two pointers on never lead to a larger node, so
    chains of them end in two nodes that point to each other, of which the smaller becomes the root. Pointers
    are doubled until all name roots, and roots replace nodes in the links. Each root takes one other node at least,
    so rounds are at most the logarithm of the nodes, doublings that of a chain's length; none is capped. Hubs are counted
    with their smallest neighbour, and the nodes that point to one with the pointers; joins by a hub leave its rows where they
    are (``join_groups``). What a round needs is written, so lineage stays short and no row is lost with an executor. Null ends and loops count for nothing.
    """
    with Scratch(links.sparkSession) as scratch:
        return scratch.result(_components(links, a, b), "components")


def _components(links: DataFrame, a: str, b: str) -> DataFrame:
    spark = links.sparkSession
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    both = ends.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(ends.select(F.col(b).alias("u"), F.col(a).alias("v")))
    both = written(spark, both.distinct(), "links")
    rounds = []
    while both.limit(1).count():
        near = written(spark, both.groupBy("u").agg(F.min("v").alias("v"), F.count("*").alias("links")), "nearest")
        ends = both.count()
        root = (F.col("w") == F.col("u")) & (F.col("u") < F.col("v"))
        tree = _follow(near.select("u", "v")).select("u", F.when(root, F.col("u")).otherwise(F.col("v")).alias("v"))
        tree = written(spark, tree, "trees")
        moved = 1
        while moved:
            step = written(spark, _follow(tree).select("u", F.col("w").alias("v"), (F.col("v") != F.col("w")).alias("moved")), "trees")
            moved = step.where("moved").limit(1).count()
            discard(tree)
            tree = step.select("u", "v")
            tree.written_path = step.written_path
        rounds.append(tree)
        sized = written(spark, tree.join(near.select("u", "links"), "u"), "sized-trees")
        discard(near)
        left = join_groups(both, sized.select("u", F.col("v").alias("ru"), "links"), ["u"], "links", ends).drop("links")
        to = sized.select(F.col("u").alias("v"), F.col("v").alias("rv"), "links")
        left = join_groups(left, to, ["v"], "links", ends).where("ru <> rv")
        left = written(spark, left.select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct(), "links")
        discard(both, sized)
        both = left
    if not rounds:
        return both.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = rounds.pop()
    while rounds:  # the last round's roots stand for those of the round before that still had links
        tree = rounds.pop()
        last = written(spark, _follow(tree, roots).select("u", F.coalesce("w", "v").alias("v")), "roots")
        discard(tree, roots)
        roots = last
    least = roots.groupBy("v").agg(F.min("u").alias("component"), F.count("*").alias("nodes"))
    least = written(spark, least, "least")
    return join_groups(roots, least, ["v"], "nodes", roots.count()).select(F.col("u").alias("node"), "component")


def _follow(tree: DataFrame, to: DataFrame | None = None) -> DataFrame:
    """u, v, w: w is where v points to in the table to (tree itself if none is given), null if nowhere."""
    to = tree if to is None else to
    sizes = tree.groupBy("v").agg(F.count("*").alias("n"))
    above = written(tree.sparkSession, sizes.join(to.select(F.col("u").alias("v"), F.col("v").alias("w")), "v"), "above")
    return join_groups(tree, above, ["v"], "n", tree.count()).select("u", "v", "w")
