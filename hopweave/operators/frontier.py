"""Frontiers: sets of active vertices, their out-edges, degree classes and shares of work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import numbering
from ..plans.dealing import Dealt

#: Out-degrees from which a vertex counts as heavy and as medium. Fixed values.
HEAVY, MEDIUM = 256, 32
#: A frontier of at most this many ids is broadcast; a larger one is joined by shuffling it.
BROADCAST_IDS = 1_000_000


def expand(frontier: DataFrame, edges: DataFrame | Dealt, size: int | None = None) -> DataFrame:
    """src, dst of every out-edge of the frontier (id), repeated edges kept. size: its counted rows."""
    edges = edges if isinstance(edges, Dealt) else Dealt(edges, None)
    return edges.out_edges(frontier.select("id"), size is not None and size <= BROADCAST_IDS).select("src", "dst")


def dedupe(frontier: DataFrame) -> DataFrame:
    return frontier.select("id").distinct()


def not_visited(frontier: DataFrame, visited: DataFrame) -> DataFrame:
    return frontier.join(visited.select("id"), "id", "left_anti")


def degree_classes(graph: Graph, heavy: int = HEAVY, medium: int = MEDIUM) -> DataFrame:
    d = F.col("out_degree")
    kind = F.when(d >= heavy, "heavy").when(d >= medium, "medium").when(d > 0, "light").otherwise("none")
    return graph.degrees().select("id", "out_degree", kind.alias("degree_class"))


def heavy_members(frontier: DataFrame, graph: Graph, limit: int) -> DataFrame:
    """id, out_degree of the frontier's vertices of at least limit out-edges."""
    return graph.degrees().where(F.col("out_degree") >= limit).join(frontier, "id", "left_semi")


def work_offsets(frontier: DataFrame, graph: Graph) -> DataFrame:
    """id, out_degree, work_before: out-edges of the frontier's smaller ids, to cut its work evenly."""
    mine = graph.degrees().join(frontier, "id", "left_semi")
    return mine.join(numbering.running_totals(mine, "id", "out_degree", "work_before"), "id")


def aggregate_messages(state: DataFrame, edges: DataFrame | Dealt, message, reduce) -> DataFrame:
    """id, value: what the out-edges of state (id, ...) send, reduced at their ends.

    message is a Column over the state's and the edges' columns (null sends nothing), reduce an aggregate
    function of a Column. Dealt edges split what a hub sends over tasks; partial sums are made before the
    shuffle, so a hub as destination receives one row a task.
    """
    edges = edges if isinstance(edges, Dealt) else Dealt(edges, None)
    sent = edges.out_edges(state).select("dst", message.alias("_m")).where("_m is not null")
    return sent.groupBy(F.col("dst").alias("id")).agg(reduce(F.col("_m")).alias("value"))
