"""python -m hopweave.cli ALGORITHM GRAPH [-s SOURCE] [-x ROUNDS] [-t TOP] [-n] [-o OUT] [-q] [-b TASKS]

GRAPH is a .gr file or an edge list. Reading and the algorithm are timed apart. -t prints the highest ranks, highest first.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import SparkSession

from .graph import Graph
from .operators import bfs, pagerank
from .plans.registry import ALGORITHMS
from .sources.edge_list import read_edge_list
from .sources.gr import file_bytes, read_gr
from .sources.reports import level_lines, rank_lines, throughput_line, write_lines


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(prog="hopweave")
    p.add_argument("algorithm", choices=sorted(ALGORITHMS))
    p.add_argument("graph")
    p.add_argument("-s", "--source", type=int, default=0)
    p.add_argument("-x", "--max-rounds", type=int)
    p.add_argument("-t", "--top", type=int)
    p.add_argument("-n", "--nodes-only", action="store_true")
    p.add_argument("-o", "--out")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-b", "--tasks", type=int)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("hopweave").getOrCreate()
    if a.tasks:
        spark.conf.set("spark.sql.shuffle.partitions", a.tasks)
    began = time.perf_counter_ns()
    g = read_gr(spark, a.graph) if a.graph.endswith(".gr") else read_edge_list(spark, a.graph)
    g = Graph(g.vertices, g.edges.persist())
    edges, nodes = g.edges.count(), g.vertices.count()
    print(throughput_line(file_bytes(a.graph), time.perf_counter_ns() - began))
    print(f"read {edges} edges, {nodes} nodes")
    began = time.perf_counter_ns()
    out = ALGORITHMS[a.algorithm](g, source=a.source, max_rounds=a.max_rounds)
    state = out.state.persist()
    state.count()
    took = time.perf_counter_ns() - began
    print(f"{a.algorithm} took {took / 1e6:.0f} ms, {took} ns, {out.rounds} rounds, {spark.conf.get('spark.sql.shuffle.partitions')} partitions" + ("" if out.converged else ", stopped before its end"))
    if a.algorithm.startswith("bfs"):
        lines = level_lines(bfs.report(state))
    else:
        s = pagerank.total(state).first()
        print(f"sum: {s['rank_sum']:f} ({s['nodes']})")
        lines = rank_lines(pagerank.top(state, a.top) if a.top else state, a.nodes_only, bool(a.top))
    write_lines(lines, a.out, a.quiet)


if __name__ == "__main__":
    main()
