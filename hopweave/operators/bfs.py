"""Hop distances from one source. level is null where the source does not lead."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.dealing import Dealt, deal
from ..plans.fixpoint import Outcome, counted_cut, cut, iterate
from . import frontier as fr

#: What reports print for an unreachable vertex. Fixed value.
UNREACHABLE = 1073741823


def _checked(graph: Graph, source: int) -> None:
    if graph.vertices.where(F.col("id") == source).limit(1).count() == 0:
        raise ValueError(f"source {source} is not a vertex")


def initial(graph: Graph, source: int) -> DataFrame:
    return graph.vertices.select("id", F.when(F.col("id") == source, F.lit(0).cast("long")).alias("level"))


def one_hop(active: DataFrame, visited: DataFrame, edges: DataFrame | Dealt, level: int, size: int | None = None) -> DataFrame:
    """id, level of the vertices first reached from active."""
    reached = fr.expand(active, edges, size).select(F.col("dst").alias("id")).distinct()
    return fr.not_visited(reached, visited).withColumn("level", F.lit(level).cast("long"))


def data_driven(graph: Graph, source: int = 0, merge_every: int = 16) -> Outcome:
    """Only the frontier is expanded. Every level is cut and counted in one job. Older levels lie together, dealt by id in memory, so
    that a new level moves to them and not they to it; only the last few are joined as they are."""
    _checked(graph, source)
    edges = deal(graph.edges)
    first, _ = counted_cut(graph.vertices.where(F.col("id") == source).select("id", F.lit(0).cast("long").alias("level")))
    old, recent, size, level = None, [first], 1, 0
    while size:
        level += 1
        new = one_hop(recent[-1].select("id"), reduce(DataFrame.unionByName, recent), edges, level, size)
        new, size = counted_cut(new if old is None else fr.not_visited(new, old).select("id", "level"))
        if size:
            recent.append(new)
        if len(recent) > merge_every:
            merged = reduce(DataFrame.unionByName, recent[:-1] if old is None else [old, *recent[:-1]])
            merged = cut(merged).repartition("id").persist()
            if old is not None:
                old.unpersist()
            old, recent = merged, recent[-1:]
    edges.release()
    levels = reduce(DataFrame.unionByName, recent if old is None else [old, *recent])
    out = graph.vertices.join(levels, "id", "left").select("id", "level")
    return Outcome(out, level, True)


def relax(levels: DataFrame, edges: DataFrame | Dealt) -> DataFrame:
    """One pass over all edges: every vertex takes the least of its level and its sources' plus one."""
    reached = fr.aggregate_messages(levels, edges, F.col("level") + 1, F.min)
    out = levels.join(reached, "id", "left")
    return out.select("id", F.least("level", "value").alias("level"), (F.col("value") < F.coalesce("level", F.lit(1 << 62))).alias("changed"))


def topology(graph: Graph, source: int = 0, rounds_per_job: int = 8) -> Outcome:
    """All edges every round until no level falls. A vertex keeps its level through an edge to itself that
    adds nothing, so that a round is one join and one aggregate."""
    _checked(graph, source)
    own = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0).alias("hop"))
    moves = deal(graph.edges.select("src", "dst", F.lit(1).alias("hop")), own)

    def step(state: DataFrame, _: int) -> DataFrame:
        sent = moves.out_edges(state).select(
            "dst", (F.col("level") + F.col("hop")).alias("got"), F.when(F.col("hop") == 0, F.col("level")).alias("own")
        )
        new = sent.groupBy(F.col("dst").alias("id")).agg(F.min("got").alias("level"), F.min("own").alias("own"))
        return new.select("id", "level", (F.col("level").isNotNull() & ~F.col("level").eqNullSafe(F.col("own"))).alias("changed"))

    out = iterate(initial(graph, source), step, F.count_if("changed"), lambda n: not n, rounds_per_job=rounds_per_job)
    moves.release()
    return Outcome(out.state.select("id", "level"), out.rounds, out.converged)


def report(levels: DataFrame) -> DataFrame:
    return levels.select("id", F.coalesce("level", F.lit(UNREACHABLE).cast("long")).alias("level"))
