"""Residual-push PageRank, unnormalised: every vertex starts at 1 - alpha; what a vertex without out-edges
holds is passed to none.

Rounds run on blocks of vertices (plans/blocks.py), each block's ranks and edges as arrays; what a source passes on is sent
once to each block it has edges to. Graphs that have no such form take the joining path: a round is one join and one aggregate.
There edges weigh alpha / out-degree of their source; every vertex has an edge to itself of weight 0 that carries its rank and
what it holds back to the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans import blocks
from ..plans.dealing import Dealt, deal
from ..plans.fixpoint import Outcome, cut, iterate

#: Damping and the residual below which nothing is passed on. Fixed values.
ALPHA, EPSILON = 0.85, 1e-6
MODES = ("topology", "data_driven", "residual")
#: Bytes that the rounds of one job may write anyway; beyond, no more than the edges' own 16 bytes each.
SMALL_JOB = 64_000_000
#: From so many edges on the joining path runs one round a job.
MANY_EDGES = 2_000_000


def initial(graph: Graph, alpha: float = ALPHA) -> DataFrame:
    """id, p, r, out: start rank, no residual, and what each out-edge passes on first (null without any)."""
    out = F.when(F.col("out_degree") > 0, F.lit(alpha * (1 - alpha)) / F.col("out_degree"))
    return graph.degrees().select("id", F.lit(1 - alpha).alias("p"), F.lit(0.0).alias("r"), out.alias("out"))


def residual_start(graph: Graph, alpha: float = ALPHA) -> DataFrame:
    """id, residual: alpha (1 - alpha) times the sum over in-edges of one over the source's out-degree."""
    dealt = deal(graph.edges, weigh=lambda e: e.withColumn("share", F.lit(1.0) / F.col("degree")))
    got = dealt.edges.groupBy(F.col("dst").alias("id")).agg(F.sum("share").alias("s"))
    return graph.vertices.join(got, "id", "left").select("id", (F.coalesce("s", F.lit(0.0)) * alpha * (1 - alpha)).alias("residual"))


def weighted(graph: Graph, alpha: float = ALPHA) -> Dealt:
    own = graph.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"))
    hold = F.when(F.col("own"), F.lit(1.0)).otherwise(F.lit(0.0))
    w = F.when(F.col("own"), F.lit(0.0)).otherwise(F.lit(alpha) / F.col("degree"))
    return deal(graph.edges.select("src", "dst"), own, weigh=lambda e: e.withColumns({"w": w, "hold": hold}))


def start(graph: Graph, alpha: float = ALPHA) -> DataFrame:
    """id, p, passed (to be pushed on), held (kept below the threshold), total (the last round's)."""
    return graph.vertices.select("id", *[F.lit(x).alias(n) for n, x in (("p", 1 - alpha), ("passed", 1 - alpha), ("held", 0.0), ("total", 0.0))])


def push(state: DataFrame, moves: Dealt, mode: str = "topology", epsilon: float = EPSILON) -> DataFrame:
    total = F.sum(F.col("passed") * F.col("w") + F.col("held") * F.col("hold")).alias("total")
    sent = moves.out_edges(state.drop("total"))
    got = sent.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("p") * F.col("hold")).alias("p"), total)
    active = {"topology": F.lit(True), "data_driven": F.col("total") >= epsilon, "residual": F.col("total") > epsilon}[mode]
    passed, held = F.when(active, F.col("total")).otherwise(0.0), F.when(active, F.lit(0.0)).otherwise(F.col("total"))
    return got.select("id", (F.col("p") + passed).alias("p"), passed.alias("passed"), held.alias("held"), "total")


def pagerank(graph: Graph, mode: str = "topology", max_rounds: int | None = None, alpha: float = ALPHA, epsilon: float = EPSILON, rounds_per_job: int = 8) -> Outcome:
    """state has node, p. topology: every vertex passes on each round, ends once no residual is above
    epsilon, the last included. data_driven: vertices of at least epsilon, residual: above epsilon; ends once
    none is left, what is held stays out of the ranks. rounds_per_job: at most; fewer where a round ships much."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    done = (lambda m: m is None or m <= epsilon) if mode == "topology" else (lambda m: not m)
    laid = blocks.lay_out(graph, alpha)
    if laid is None:
        return _joining(graph, mode, max_rounds, alpha, epsilon, rounds_per_job, done)
    shipped = 8 * max(1, laid.sent)
    per_job = max(1, min(rounds_per_job, max(SMALL_JOB, 16 * laid.edges) // shipped))
    out = iterate(
        blocks.start(laid, 1 - alpha), lambda s, _: blocks.push(s, laid, mode, epsilon), F.max("measure"), done, max_rounds, per_job, True,
        lambda s: blocks.send(s, laid), lambda s, _: blocks.push(s, laid, mode, epsilon, last=True))
    state = out.state if out.rounds else cut(out.state)
    laid.release()
    return Outcome(blocks.ranks(state), out.rounds, out.converged)


def _joining(graph: Graph, mode: str, max_rounds: int | None, alpha: float, epsilon: float, rounds_per_job: int, done) -> Outcome:
    moves = weighted(graph, alpha)
    measure = F.max("total") if mode == "topology" else F.max("passed")
    many = moves.size > MANY_EDGES
    out = iterate(start(graph, alpha), lambda s, _: push(s, moves, mode, epsilon), measure, done, max_rounds, 1 if many else rounds_per_job, many)
    moves.release()
    return Outcome(out.state.select(F.col("id").alias("node"), "p"), out.rounds, out.converged)


def total(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.sum("p").alias("rank_sum"), F.count("*").alias("nodes"))


def top(ranks: DataFrame, k: int) -> DataFrame:
    return ranks.orderBy(F.desc("p"), "node").limit(k)


def normalised(ranks: DataFrame) -> DataFrame:
    """p over the sum of all, which is one row and joined by broadcast."""
    return ranks.join(F.broadcast(ranks.agg(F.sum("p").alias("rank_sum")))).select("node", (F.col("p") / F.col("rank_sum")).alias("p"))
