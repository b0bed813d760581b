"""Edges as text: source and destination on a line, separated by one space, no header."""

from pyspark.sql import DataFrame, SparkSession

from ..graph import EDGES, Graph


def read_edge_list(spark: SparkSession, path: str, n: int | None = None) -> Graph:
    return Graph.from_edges(spark.read.csv(path, sep=" ", schema=EDGES).where("src is not null and dst is not null"), n)


def write_edge_list(edges: DataFrame, path: str) -> None:
    edges.selectExpr("concat_ws(' ', src, dst) as value").write.text(path)
