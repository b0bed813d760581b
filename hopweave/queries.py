"""Every operator as a query over the tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .functions import in_range
from .graph import Graph, node_data
from .operators import bfs, pagerank
from .operators import frontier as fr
from .plans.dealing import deal
from .plans.fixpoint import cut, shared_dir
from .sources import tables
from .sources.edge_list import read_edge_list, write_edge_list
from .sources.gr import invalid_edges, read_gr, write_gr

SUCC_SQL = """v AS (SELECT p_partkey::BIGINT AS node FROM part),
e AS (SELECT src, dst FROM (SELECT l_partkey::BIGINT AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey
  ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate)::BIGINT AS dst FROM lineitem) WHERE dst IS NOT NULL)"""
CHAIN_SQL = """v AS (SELECT event_id::BIGINT AS node FROM events),
e AS (SELECT src, dst FROM (SELECT event_id::BIGINT AS src, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS dst
  FROM events) WHERE dst IS NOT NULL)"""
PS_SQL = """n AS (SELECT count(*) AS n FROM part),
v AS (SELECT p_partkey::BIGINT AS node FROM part UNION ALL SELECT (s_suppkey + n)::BIGINT FROM supplier, n),
e AS (SELECT DISTINCT (l_suppkey + n)::BIGINT AS src, l_partkey::BIGINT AS dst FROM lineitem, n)"""
TREE_SQL = """a AS (SELECT (SELECT count(*) FROM region) AS r, (SELECT count(*) FROM nation) AS n, (SELECT count(*) FROM customer) AS c),
v AS (SELECT r_regionkey::BIGINT AS node FROM region UNION ALL SELECT (n_nationkey + r)::BIGINT FROM nation, a
  UNION ALL SELECT (c_custkey + r + n)::BIGINT FROM customer, a UNION ALL SELECT (o_orderkey + r + n + c)::BIGINT FROM orders, a),
e AS (SELECT n_regionkey::BIGINT AS src, (n_nationkey + r)::BIGINT AS dst FROM nation, a
  UNION ALL SELECT (c_nationkey + r)::BIGINT, (c_custkey + r + n)::BIGINT FROM customer, a
  UNION ALL SELECT (o_custkey + r + n)::BIGINT, (o_orderkey + r + n + c)::BIGINT FROM orders, a)"""
GRAPHS = {"succ": (tables.successions, SUCC_SQL), "chain": (tables.chains, CHAIN_SQL), "ps": (tables.suppliers, PS_SQL), "tree": (tables.hierarchy, TREE_SQL)}
#: Bounds of the hop counts in SQL, above the graphs' depths.
DEPTH = {"succ": 12, "chain": 110, "ps": 3, "tree": 4}
DEG_SQL = "deg AS (SELECT v.node AS id, count(e.src) AS out_degree FROM v LEFT JOIN e ON e.src = v.node GROUP BY 1)"
ROUNDS_SQL = 200


def _with(graph: str, body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{GRAPHS[graph][1]}, {body}"


def _on(graph: str, run):
    return lambda spark, sf_dir: run(GRAPHS[graph][0](spark, sf_dir))


def _bfs_sql(graph: str, source: int = 0, level: str = "level") -> str:
    return _with(graph, f"""b(id, lvl) AS (SELECT {source}::BIGINT, 0 UNION SELECT e.dst, b.lvl + 1 FROM b JOIN e ON e.src = b.id WHERE b.lvl < {DEPTH[graph]}),
best AS (SELECT id, min(lvl)::BIGINT AS level FROM b GROUP BY id)
SELECT v.node AS id, {level} AS level FROM v LEFT JOIN best ON best.id = v.node""", True)


def _ranks_sql(graph: str, mode: str, k: int = ROUNDS_SQL) -> str:
    """CTEs ending in ranks(node, p) and stop(k)."""
    weights = "d AS (SELECT src, count(*) AS d FROM e GROUP BY 1)"
    if mode == "topology":
        return _with(graph, f"""{weights}, w AS (SELECT e.src, e.dst, 0.85::DOUBLE / d AS w FROM e JOIN d USING (src)),
b(it, node, r) AS (SELECT 0, node, 0.15::DOUBLE FROM v UNION ALL
  SELECT b.it + 1, w.dst, sum(b.r * w.w) FROM b JOIN w ON w.src = b.node WHERE b.it < {k} GROUP BY b.it + 1, w.dst),
stop AS (SELECT coalesce(min(k), {k}) AS k FROM generate_series(1, {k}) g(k) LEFT JOIN (SELECT it, max(r) AS m FROM b GROUP BY it) x ON x.it = g.k WHERE coalesce(m, 0) <= 1e-6),
ranks AS (SELECT node, sum(r) AS p FROM b WHERE it <= (SELECT k FROM stop) GROUP BY node)""", True)
    on = {"data_driven": "t >= 1e-6", "residual": "t > 1e-6"}[mode]
    return _with(graph, f"""{weights}, w AS (SELECT e.src, e.dst, 0.85::DOUBLE / d AS w, 0.0::DOUBLE AS hold FROM e JOIN d USING (src) UNION ALL SELECT node, node, 0, 1 FROM v),
b(it, node, f, h) AS (SELECT 0, node, 0.15::DOUBLE, 0.0::DOUBLE FROM v UNION ALL
  SELECT it + 1, dst, CASE WHEN {on} THEN t ELSE 0 END, CASE WHEN {on} THEN 0 ELSE t END
  FROM (SELECT b.it, w.dst, sum(b.f * w.w + b.h * w.hold) AS t FROM b JOIN w ON w.src = b.node WHERE b.it < {k} GROUP BY b.it, w.dst)),
stop AS (SELECT coalesce(min(it), {k}) AS k FROM (SELECT it, max(f) AS m FROM b WHERE it > 0 GROUP BY it) WHERE m = 0),
ranks AS (SELECT node, sum(f) AS p FROM b GROUP BY node)""", True)


def p6():
    return F.round("p", 6).alias("p")


P6_SQL = "\nSELECT node, round(p, 6) AS p FROM ranks"


def _ranks(mode: str, k: int | None = None):
    return lambda g: pagerank.pagerank(g, mode, k).state.select("node", p6())


def _first_hop(g: Graph):
    start = g.vertices.where("id = 0").select("id")
    return bfs.one_hop(start, start, g.edges, 1, 1)


def _level(g: Graph):
    """The frontier of a search from 0 after one hop."""
    return _first_hop(g).select("id")


def _visited(g: Graph):
    return g.vertices.where("id = 0").select("id").unionByName(_level(g))


LEVEL_SQL = "f AS (SELECT DISTINCT dst AS id FROM e WHERE src = 0 AND dst <> 0)"


def _gr_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/succ-{uuid.uuid4().hex}.gr"
    write_gr(tables.successions(spark, sf_dir), path)
    return cut(read_gr(spark, path, strict=True, edges_per_task=10_000).edges)


def _edge_list(g: Graph):
    """The edges written as an edge list to the shared folder and read from it."""
    path = f"{shared_dir(g.spark)}/edges-{uuid.uuid4().hex}"
    write_edge_list(g.edges, path)
    return read_edge_list(g.spark, path, n=1).edges


def _dd_step(g: Graph, rounds: int = 30):
    state, moves = pagerank.start(g), pagerank.weighted(g)
    for k in range(rounds):
        state = pagerank.push(state, moves, "data_driven")
        if k % 10 == 9:
            state = cut(state)
    return state.select(F.col("id").alias("node"), p6(), (F.col("passed") > 0).alias("active"))


_QUERIES = {
    # Scans and access
    "edge_list_scan": ("succ", _edge_list, "x AS (SELECT 1)\nSELECT src, dst FROM e"),
    "node_scan": ("ps", lambda g: g.vertices, "x AS (SELECT 1)\nSELECT node AS id FROM v"),
    "valid_nodes": ("succ", lambda g: g.edges.select((F.col("src") * 2).alias("node"), in_range(F.col("src") * 2, g.vertices.count()).alias("valid")).distinct(),
        "x AS (SELECT count(*) AS n FROM v)\nSELECT DISTINCT src * 2 AS node, src * 2 < n AS valid FROM e, x"),
    "valid_edges": ("succ", lambda g: g.edges.select((F.col("dst") * 30).alias("eid"), in_range(F.col("dst") * 30, g.edges.count()).alias("valid")).distinct(),
        "x AS (SELECT count(*) AS n FROM e)\nSELECT DISTINCT dst * 30 AS eid, dst * 30 < n AS valid FROM e, x"),
    "invalid_edges": ("succ", lambda g: invalid_edges(g.edges.select("src", (F.col("dst") + 5).alias("dst")), g.vertices.count()),
        "x AS (SELECT count(*) AS n FROM v)\nSELECT src, dst + 5 AS dst FROM e, x WHERE dst + 5 >= n"),
    "out_degree": ("ps", lambda g: g.degrees(), f"{DEG_SQL}\nSELECT id, out_degree FROM deg"),
    "csr_row_start": ("succ", lambda g: g.row_starts(),
        f"{DEG_SQL}\nSELECT id, coalesce(sum(out_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS row_start FROM deg"),
    "kth_neighbor": ("succ", lambda g: g.neighbours(2).select("src", "dst"),
        "x AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k FROM e)\nSELECT src, dst FROM x WHERE k = 2"),
    # Frontiers and shares of work; the frontier is a level of a search
    "degree_class": ("tree", fr.degree_classes,
        f"{DEG_SQL}\nSELECT id, out_degree, CASE WHEN out_degree >= 256 THEN 'heavy' WHEN out_degree >= 32 THEN 'medium' WHEN out_degree > 0 THEN 'light' ELSE 'none' END AS degree_class FROM deg"),
    "edges_by_position": ("succ", lambda g: g.numbered_edges(), "x AS (SELECT 1)\nSELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst FROM e"),
    "level_heavy": ("succ", lambda g: fr.heavy_members(_level(g), g, 25), f"{DEG_SQL}, {LEVEL_SQL}\nSELECT id, out_degree FROM deg JOIN f USING (id) WHERE out_degree >= 25"),
    "level_work_prefix_sum": ("succ", lambda g: fr.work_offsets(_level(g), g),
        f"{DEG_SQL}, {LEVEL_SQL}\nSELECT id, out_degree, coalesce(sum(out_degree) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS work_before FROM deg JOIN f USING (id)"),
    "level_expand": ("succ", lambda g: fr.expand(_level(g), g.edges), f"{LEVEL_SQL}\nSELECT src, dst FROM e JOIN f ON f.id = e.src"),
    "level_dedupe": ("succ", lambda g: fr.dedupe(fr.expand(_level(g), g.edges).select(F.col("dst").alias("id"))), f"{LEVEL_SQL}\nSELECT DISTINCT dst AS id FROM e JOIN f ON f.id = e.src"),
    "level_compact": ("succ", lambda g: fr.not_visited(fr.dedupe(fr.expand(_level(g), g.edges).select(F.col("dst").alias("id"))), _visited(g)),
        f"{LEVEL_SQL}\nSELECT DISTINCT dst AS id FROM e JOIN f ON f.id = e.src WHERE dst <> 0 AND dst NOT IN (SELECT id FROM f)"),
    "level_size": ("succ", lambda g: fr.dedupe(fr.expand(_level(g), g.edges).select(F.col("dst").alias("id"))).agg(F.count("*").alias("size")),
        f"{LEVEL_SQL}\nSELECT count(DISTINCT dst) AS size FROM e JOIN f ON f.id = e.src"),
    "aggregate_messages": ("succ", lambda g: fr.aggregate_messages(g.degrees(), deal(g.edges), F.col("out_degree"), F.max),
        f"{DEG_SQL}\nSELECT dst AS id, max(out_degree) AS value FROM e JOIN deg ON deg.id = e.src GROUP BY 1"),
    # Hop distances
    "bfs_init": ("succ", lambda g: bfs.initial(g, 3), "x AS (SELECT 1)\nSELECT node AS id, CASE WHEN node = 3 THEN 0::BIGINT END AS level FROM v"),
    "bfs_one_hop": ("succ", _first_hop, "x AS (SELECT 1)\nSELECT DISTINCT dst AS id, 1::BIGINT AS level FROM e WHERE src = 0 AND dst <> 0"),
    "bfs_relax_once": ("succ", lambda g: bfs.relax(bfs.relax(bfs.initial(g, 0), g.edges).select("id", "level"), g.edges).select("id", "level"),
        "h AS (SELECT 0::BIGINT AS id, 0::BIGINT AS l UNION ALL SELECT dst, 1 FROM e WHERE src = 0 UNION ALL SELECT b.dst, 2 FROM e a JOIN e b ON b.src = a.dst WHERE a.src = 0)\n"
        "SELECT node AS id, min(l) AS level FROM v LEFT JOIN h ON h.id = v.node GROUP BY 1"),
    "bfs_data_driven": ("succ", lambda g: bfs.data_driven(g).state, _bfs_sql("succ")),
    "bfs_topology": ("succ", lambda g: bfs.topology(g).state, _bfs_sql("succ")),
    "bfs_source_n": ("succ", lambda g: bfs.data_driven(g, 17).state, _bfs_sql("succ", 17)),
    "bfs_chain": ("chain", lambda g: bfs.topology(g, rounds_per_job=16).state, _bfs_sql("chain")),
    "bfs_output": ("tree", lambda g: bfs.report(bfs.data_driven(g).state), _bfs_sql("tree", 0, "coalesce(level, 1073741823)")),
    "bfs_tree": ("tree", lambda g: bfs.topology(g, 1).state, _bfs_sql("tree", 1)),
    "bfs_ps": ("ps", lambda g: bfs.data_driven(g, g.vertices.agg(F.max("id")).first()[0]).state,
        _bfs_sql("ps").replace("SELECT 0::BIGINT, 0", "SELECT (SELECT max(node) FROM v), 0")),
    "node_data": ("succ", lambda g: node_data(bfs.data_driven(g).state, 17), _bfs_sql("succ") + " WHERE v.node = 17"),
    # Ranks
    "pr_init": ("ps", lambda g: pagerank.initial(g).select("id", F.round("p", 6).alias("p"), "r", F.round("out", 9).alias("out")),
        f"{DEG_SQL}\nSELECT id, 0.15::DOUBLE AS p, 0.0::DOUBLE AS r, round(CASE WHEN out_degree > 0 THEN 0.85::DOUBLE * (1 - 0.85::DOUBLE) / out_degree END, 9) AS out FROM deg"),
    "pr_push_once": ("succ", lambda g: fr.aggregate_messages(pagerank.initial(g), deal(g.edges), F.col("out"), F.sum).select("id", F.round("value", 6).alias("received")),
        f"{DEG_SQL}\nSELECT dst AS id, round(sum(0.85::DOUBLE * 0.15::DOUBLE / out_degree), 6) AS received FROM e JOIN deg ON deg.id = e.src GROUP BY 1"),
    "pr_step": ("succ", lambda g: pagerank.push(pagerank.start(g), pagerank.weighted(g)).select("id", p6(), F.round("passed", 6).alias("passed")),
        f"{DEG_SQL}, s AS (SELECT dst AS id, sum(0.85::DOUBLE * 0.15::DOUBLE / out_degree) AS t FROM e JOIN deg ON deg.id = e.src GROUP BY 1)\n"
        "SELECT node AS id, round(0.15 + coalesce(t, 0), 6) AS p, round(coalesce(t, 0), 6) AS passed FROM v LEFT JOIN s ON s.id = v.node"),
    "pr_topology_k10": ("succ", _ranks("topology", 10), _ranks_sql("succ", "topology", 10) + P6_SQL),
    "pr_topology": ("succ", _ranks("topology"), _ranks_sql("succ", "topology") + P6_SQL),
    "pr_dd_step": ("succ", _dd_step, _ranks_sql("succ", "data_driven", 30) + ", last AS (SELECT node, f > 0 AS active FROM b WHERE it = 30)\nSELECT node, round(p, 6) AS p, active FROM ranks JOIN last USING (node)"),
    "pr_data_driven_k10": ("succ", _ranks("data_driven", 10), _ranks_sql("succ", "data_driven", 10) + P6_SQL),
    "pr_data_driven": ("succ", _ranks("data_driven"), _ranks_sql("succ", "data_driven") + P6_SQL),
    "pr_residual_init": ("ps", lambda g: pagerank.residual_start(g).select("id", F.round("residual", 6).alias("residual")),
        f"{DEG_SQL}, s AS (SELECT dst AS id, sum(1.0::DOUBLE / out_degree) AS t FROM e JOIN deg ON deg.id = e.src GROUP BY 1)\n"
        "SELECT node AS id, round(coalesce(t, 0) * 0.85 * (1 - 0.85::DOUBLE), 6) AS residual FROM v LEFT JOIN s ON s.id = v.node"),
    "pr_residual": ("succ", _ranks("residual"), _ranks_sql("succ", "residual") + P6_SQL),
    "pr_ps": ("ps", _ranks("data_driven"), _ranks_sql("ps", "data_driven") + P6_SQL),
    "pr_iterations": ("succ", lambda g: g.spark.range(1).select(F.lit(pagerank.pagerank(g).rounds).cast("long").alias("iterations")), _ranks_sql("succ", "topology") + "\nSELECT k AS iterations FROM stop"),
    "pr_sum": ("succ", lambda g: pagerank.total(pagerank.pagerank(g, max_rounds=10).state).select(F.round("rank_sum", 4).alias("rank_sum"), "nodes"),
        _ranks_sql("succ", "topology", 10) + "\nSELECT round(sum(p), 4) AS rank_sum, count(*) AS nodes FROM ranks"),
    "pr_output": ("chain", _ranks("topology", 10), _ranks_sql("chain", "topology", 10) + P6_SQL),
    "pr_nodes_only": ("succ", lambda g: pagerank.pagerank(g, max_rounds=2).state.select("node"), _ranks_sql("succ", "topology", 2) + "\nSELECT node FROM ranks"),
    "pr_top_k": ("succ", lambda g: pagerank.top(pagerank.pagerank(g, max_rounds=10).state, 20).select("node", p6()), _ranks_sql("succ", "topology", 10) + "\nSELECT node, round(p, 6) AS p FROM (SELECT * FROM ranks ORDER BY p DESC, node LIMIT 20)"),
    "pr_normalized": ("succ", lambda g: pagerank.normalised(pagerank.pagerank(g, max_rounds=10).state).select("node", F.round("p", 9).alias("p")),
        _ranks_sql("succ", "topology", 10) + "\nSELECT node, round(p / sum(p) OVER (), 9) AS p FROM ranks"),
    # Reports of converged ranks
    "pr_sum_converged": ("succ", lambda g: pagerank.total(pagerank.pagerank(g).state).select(F.round("rank_sum", 4).alias("rank_sum"), "nodes"),
        _ranks_sql("succ", "topology") + "\nSELECT round(sum(p), 4) AS rank_sum, count(*) AS nodes FROM ranks"),
    "pr_output_converged": ("chain", _ranks("topology"), _ranks_sql("chain", "topology") + P6_SQL),
    "pr_top_k_converged": ("succ", lambda g: pagerank.top(pagerank.pagerank(g).state, 20).select("node", p6()),
        _ranks_sql("succ", "topology") + "\nSELECT node, round(p, 6) AS p FROM (SELECT * FROM ranks ORDER BY p DESC, node LIMIT 20)"),
    "pr_normalized_converged": ("succ", lambda g: pagerank.normalised(pagerank.pagerank(g).state).select("node", F.round("p", 9).alias("p")),
        _ranks_sql("succ", "topology") + "\nSELECT node, round(p / sum(p) OVER (), 9) AS p FROM ranks"),
}

#: Of each query the graph it runs on, by its name in GRAPHS, and what it runs there.
GRAPH_OF = {name: graph for name, (graph, _, _) in _QUERIES.items()}
ON_GRAPH = {name: run for name, (_, run, _) in _QUERIES.items()}
QUERIES = {name: _on(graph, run) for name, (graph, run, _) in _QUERIES.items()} | {"gr_roundtrip": _gr_roundtrip}
ORACLES = {name: sql if sql.startswith("WITH") else _with(graph, sql) for name, (graph, _, sql) in _QUERIES.items()}
ORACLES["gr_roundtrip"] = ORACLES["edge_list_scan"]
