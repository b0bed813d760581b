"""Graphs in the tables: successions of parts in orders, a user's events, suppliers of parts, a hierarchy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _succession(df: DataFrame, by: str, order: list[str], key: str) -> DataFrame:
    after = F.lead(key).over(Window.partitionBy(by).orderBy(*order))
    return df.select(F.col(key).cast("long").alias("src"), after.cast("long").alias("dst")).where("dst is not null")


def successions(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts; an edge from each line of an order to its next line. Lines alike in number and part stand together, and give the same edges in any order."""
    lines = table(spark, sf_dir, "lineitem")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    return Graph(parts, _succession(lines, "l_orderkey", ["l_linenumber", "l_partkey"], "l_partkey"))


def chains(spark: SparkSession, sf_dir: str) -> Graph:
    """Events; an edge from each to the same user's next."""
    events = table(spark, sf_dir, "events")
    return Graph(events.select(F.col("event_id").cast("long").alias("id")), _succession(events, "user_id", ["ts", "event_id"], "event_id"))


def suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts, and suppliers numbered after them; an edge from a supplier to each part it delivered, once."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("id"))
    n = parts.count()
    nodes = parts.unionByName(table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + n).cast("long").alias("id")))
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") + n).cast("long").alias("src"), F.col("l_partkey").cast("long").alias("dst")).distinct()
    return Graph(nodes, edges)


def hierarchy(spark: SparkSession, sf_dir: str) -> Graph:
    """Regions, nations, customers and orders, numbered one kind after the other; edges downwards."""
    levels = [("region", "r_regionkey", None), ("nation", "n_nationkey", "n_regionkey"), ("customer", "c_custkey", "c_nationkey"), ("orders", "o_orderkey", "o_custkey")]
    nodes = edges = None
    offset = above = 0
    for name, key, parent in levels:
        rows = table(spark, sf_dir, name)
        ids = rows.select((F.col(key).cast("long") + offset).alias("id"))
        nodes = ids if nodes is None else nodes.unionByName(ids)
        if parent:
            down = rows.select((F.col(parent).cast("long") + above).alias("src"), (F.col(key).cast("long") + offset).alias("dst"))
            edges = down if edges is None else edges.unionByName(down)
        above, offset = offset, offset + rows.count()
    return Graph(nodes, edges)
