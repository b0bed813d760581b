"""Algorithms by name: (graph, **parameters) -> Outcome."""

from ..operators import bfs, pagerank

ALGORITHMS = {
    "bfs_data_driven": lambda g, source=0, **_: bfs.data_driven(g, source),
    "bfs_topology": lambda g, source=0, **_: bfs.topology(g, source),
    **{
        f"pagerank_{mode}": lambda g, max_rounds=None, mode=mode, **_: pagerank.pagerank(g, mode, max_rounds)
        for mode in pagerank.MODES
    },
}
