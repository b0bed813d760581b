"""A directed, unweighted multigraph: vertices (id) and edges (src, dst), repeated edges and loops kept."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .plans import numbering

VERTICES, EDGES = "id long", "src long, dst long"


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @classmethod
    def empty(cls, spark: SparkSession) -> Graph:
        return cls(spark.createDataFrame([], VERTICES), spark.createDataFrame([], EDGES))

    @classmethod
    def from_edges(cls, edges: DataFrame, n: int | None = None) -> Graph:
        """Vertices 0..n-1; without n, up to the largest end of an edge."""
        edges = edges.select(F.col("src").cast("long"), F.col("dst").cast("long"))
        if n is None:
            top = edges.agg(F.max(F.greatest("src", "dst"))).first()[0]
            n = 0 if top is None else top + 1
        return cls(edges.sparkSession.range(n), edges)

    def degrees(self) -> DataFrame:
        """id, out_degree of every vertex, 0 for those without out-edges."""
        counted = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        return self.vertices.join(counted, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).alias("out_degree"))

    def numbered_edges(self) -> DataFrame:
        """eid, src, dst: the position in the order of (src, dst), from 0, without gathering in one task."""
        return numbering.positions(self.edges, ["src", "dst"], "eid")

    def row_starts(self) -> DataFrame:
        """id, row_start: how many edges have a smaller source."""
        return numbering.running_totals(self.degrees(), "id", "out_degree", "row_start")

    def neighbours(self, k: int | None = None) -> DataFrame:
        """src, dst, k: the k-th out-edge of each source, in the order of dst, from 0. With k given only that one: no
        task then sorts or sends more than k + 1 edges of a source."""
        at = F.row_number().over(Window.partitionBy("src").orderBy("dst"))
        out = self.edges.select("src", "dst", at.alias("_at"))
        out = out if k is None else out.where(F.col("_at") == k + 1)
        return out.select("src", "dst", (F.col("_at") - 1).alias("k"))


def node_data(result: DataFrame, node: int) -> DataFrame:
    """The row of one vertex of a result (id or node first): a filter that reaches the scan."""
    return result.where(F.col(result.columns[0]) == node)
