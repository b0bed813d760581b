import random
import struct
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hopweave import cli
from hopweave.graph import Graph, node_data
from hopweave.operators import bfs, pagerank
from hopweave.operators import frontier as fr
from hopweave.plans import blocks, dealing
from hopweave.plans.fixpoint import cut, tidy_up
from hopweave.sources import tables
from hopweave.sources.edge_list import read_edge_list, write_edge_list
from hopweave.sources.gr import file_bytes, invalid_edges, read_gr, read_header, write_gr
from hopweave.sources.reports import throughput_line

TREE = [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6)]
CYCLE = [(0, 1), (1, 2), (2, 0)]


def graph(spark, edges, n=None):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), n)


def levels(out):
    return [r["level"] for r in out.state.orderBy("id").collect()]


def ranks(out):
    return [r["p"] for r in out.state.orderBy("node").collect()]


def test_tree(spark):
    g = graph(spark, TREE)
    assert levels(bfs.data_driven(g)) == levels(bfs.topology(g)) == [0, 1, 1, 2, 2, 2, 2]
    for mode in pagerank.MODES:
        out = pagerank.pagerank(g, mode)
        assert out.rounds == 3 and ranks(out) == pytest.approx([0.15, 0.21375, 0.21375] + [0.24084375] * 4)
    one = pagerank.pagerank(g, max_rounds=1)
    assert not one.converged and ranks(one) == pytest.approx([0.15] + [0.21375] * 6)


def test_cycle_tells_the_modes_apart(spark):
    g = graph(spark, CYCLE)
    topo, dd = pagerank.pagerank(g), pagerank.pagerank(g, "data_driven")
    assert (topo.rounds, dd.rounds) == (74, 74)
    assert ranks(topo) == pytest.approx([0.9999949135] * 3, abs=1e-9) and ranks(dd) == pytest.approx([0.9999940159] * 3, abs=1e-9)


def test_line(spark):
    g = graph(spark, [(i, i + 1) for i in range(40)], 42)
    assert levels(bfs.topology(g)) == [*range(41), None]
    assert ranks(pagerank.pagerank(g, rounds_per_job=16))[:41] == pytest.approx([1 - 0.85 ** (i + 1) for i in range(41)])


def test_bad_source(spark):
    for algorithm in (bfs.data_driven, bfs.topology):
        with pytest.raises(ValueError):
            algorithm(graph(spark, TREE), 7)
    with pytest.raises(ValueError):
        pagerank.pagerank(graph(spark, TREE), "none")


def test_empty_and_single(spark):
    assert Graph.empty(spark).degrees().count() == 0
    g = graph(spark, [], 1)
    assert levels(bfs.data_driven(g)) == [0] and ranks(pagerank.pagerank(g)) == pytest.approx([0.15])


def _plain_levels(n, edges, source):
    level, todo = {source: 0}, [source]
    while todo:
        new = {d for s, d in edges if s in todo and d not in level}
        level |= {d: level[todo[0]] + 1 for d in new}
        todo = sorted(new)
    return [level.get(i) for i in range(n)]


def _plain_ranks(n, edges, rounds):
    degree = [sum(s == i for s, _ in edges) for i in range(n)]
    p, r = [0.15] * n, [0.15] * n
    for _ in range(rounds):
        t = [0.0] * n
        for s, d in edges:
            t[d] += 0.85 * r[s] / degree[s]
        p, r = [a + b for a, b in zip(p, t, strict=True)], t
    return p


@pytest.mark.parametrize("seed", [1, 2])
def test_random_multigraphs(spark, seed):
    rnd = random.Random(seed)
    n = 60
    edges = [(rnd.randrange(40), rnd.randrange(50)) for _ in range(90)] + [(5, 5), (5, 6), (5, 6)] + [(7, rnd.randrange(n - 5)) for _ in range(260)]
    g = graph(spark, edges, n)
    expected = _plain_levels(n, edges, 7)
    assert levels(bfs.data_driven(g, 7)) == levels(bfs.topology(g, 7, rounds_per_job=3)) == expected
    assert ranks(pagerank.pagerank(g, max_rounds=6)) == pytest.approx(_plain_ranks(n, edges, 6))
    a, b = ranks(pagerank.pagerank(g)), ranks(pagerank.pagerank(g, "data_driven"))
    assert max(abs(x - y) for x, y in zip(a, b, strict=True)) < 1e-4
    degree = {i: sum(s == i for s, _ in edges) for i in range(n)}
    assert {r["id"]: r["out_degree"] for r in g.degrees().collect()} == degree
    assert {r["id"]: r["row_start"] for r in g.row_starts().collect()} == {i: sum(degree[k] for k in range(i)) for i in range(n)}
    assert [(r["eid"], r["src"], r["dst"]) for r in g.numbered_edges().orderBy("eid").collect()] == [(k, *e) for k, e in enumerate(sorted(edges))]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_hubs_are_split(spark, monkeypatch, broadcast):
    monkeypatch.setattr(dealing, "HUB_EDGES", 20)
    monkeypatch.setattr(fr, "BROADCAST_IDS", broadcast)
    rnd = random.Random(9)
    n = 80
    edges = [(7, rnd.randrange(n - 5)) for _ in range(150)] + [(rnd.randrange(40), rnd.randrange(50)) for _ in range(60)] + [(7, 3), (7, 3)]
    g = graph(spark, edges, n)
    dealt = dealing.deal(g.edges)
    parts = {r["_part"] for r in dealt.edges.where("src = 7").select("_part").distinct().collect()}
    assert len(parts) == -(-sum(s == 7 for s, _ in edges) // 20)
    assert levels(bfs.data_driven(g, 7)) == levels(bfs.topology(g, 7)) == _plain_levels(n, edges, 7)
    assert ranks(pagerank.pagerank(g, max_rounds=6)) == pytest.approx(_plain_ranks(n, edges, 6))
    weighed = pagerank.weighted(g)
    parts = {r["_part"]: r["n"] for r in weighed.edges.where("src = 7 and hold = 0").groupBy("_part").agg(F.count("*").alias("n")).collect()}
    assert len(parts) > 4 and max(parts.values()) < 80  # a hub's edges never meet, not even to be weighed
    degree = {i: sum(s == i for s, _ in edges) for i in range(n)}
    want = {i: sum(1 / degree[s] for s, d in edges if d == i) * 0.85 * 0.15 for i in range(n)}
    assert {r["id"]: r["residual"] for r in pagerank.residual_start(g).collect()} == pytest.approx(want)
    sent = fr.aggregate_messages(g.degrees(), dealt, F.col("out_degree"), F.sum)
    assert {r["id"]: r["value"] for r in sent.collect()} == {i: sum(degree[s] for s, d in edges if d == i) for i in {d for _, d in edges}}


def test_hubs_are_never_many(spark, monkeypatch):
    monkeypatch.setattr(dealing, "HUB_EDGES", 1)
    monkeypatch.setattr(dealing, "MAX_HUBS", 5)
    g = graph(spark, [(s, d) for s in range(30) for d in range(3 + (s == 4) * 40)], 50)
    assert [r["_hub"] for r in dealing.deal(g.edges).hubs.collect()] == [4]


def test_nothing_stays_in_storage(spark):
    spark.catalog.clearCache()
    g = graph(spark, TREE)
    bfs.data_driven(g, merge_every=1), bfs.topology(g), pagerank.pagerank(g), g.row_starts().collect(), g.numbered_edges().collect()
    kept = spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    assert kept <= 1  # the merged levels of the first, which its result reads


def test_levels_merged_early(spark):
    g = graph(spark, [(i, i + 1) for i in range(12)] + [(i, 0) for i in range(5)], 15)
    assert levels(bfs.data_driven(g, merge_every=1)) == levels(bfs.data_driven(g, merge_every=3)) == [*range(13), None, None]


def test_kth_neighbour_is_limited_before_the_shuffle(spark):
    g = graph(spark, [(0, d) for d in range(50)] + [(1, 3), (1, 2)])
    third = g.neighbours(1)
    assert sorted(map(tuple, third.collect())) == sorted(map(tuple, g.neighbours().where("k = 1").collect())) == [(0, 1, 1), (1, 3, 1)]
    assert "WindowGroupLimit" in third._jdf.queryExecution().executedPlan().toString()


def test_node_data(spark):
    out = bfs.data_driven(graph(spark, TREE)).state
    assert [tuple(r) for r in node_data(out, 5).collect()] == [(5, 2)] and node_data(out, 99).count() == 0


def test_degree_classes_at_their_edges(spark):
    edges = [(i, 9) for i, d in enumerate([31, 32, 255, 256]) for _ in range(d)]
    got = {r["id"]: r["degree_class"] for r in fr.degree_classes(graph(spark, edges)).collect()}
    assert [got[i] for i in range(5)] == ["light", "medium", "medium", "heavy", "none"]


def test_message_reduce(spark):
    state = spark.createDataFrame([(0, 3), (1, None), (2, 5)], "id long, x long")
    got = fr.aggregate_messages(state, graph(spark, TREE).edges, F.col("x"), F.sum)
    assert {(r["id"], r["value"]) for r in got.collect()} == {(1, 3), (2, 3), (5, 5), (6, 5)}


def test_gr_round_trip(spark, tmp_path):
    rnd = random.Random(3)
    edges = [(rnd.randrange(30), rnd.randrange(40)) for _ in range(333)]
    path = str(tmp_path / "g.gr")
    write_gr(graph(spark, edges, 40), path)
    assert read_header(path) == (40, 333)
    got = read_gr(spark, path, strict=True, edges_per_task=50)
    assert got.edges.rdd.getNumPartitions() == 7 if hasattr(got.edges, "rdd") else True
    assert sorted((r["src"], r["dst"]) for r in got.edges.collect()) == sorted(edges) and got.vertices.count() == 40


def test_gr_writer_checks_both_ends(spark, tmp_path):
    path = str(tmp_path / "g.gr")
    for edges, n in ([(7, 2)], 3), ([(0, 1 << 32)], 3), ([(0, -1)], 3), ([(-1, 0)], 3):
        with pytest.raises(ValueError, match="no vertex"):
            write_gr(graph(spark, edges, n), path)
    with pytest.raises(ValueError, match="vertices"):
        write_gr(Graph(spark.range(1, 4), spark.createDataFrame([], "src long, dst long")), path)
    for edges, n in ([], 0), ([], 3), ([(2, 0)], 3), ([(0, 0)] * 5, 1):
        write_gr(graph(spark, edges, n), path)
        assert read_header(path) == (n, len(edges)) and [tuple(r) for r in read_gr(spark, path).edges.collect()] == edges
        assert file_bytes(path) == 32 + 8 * n + 4 * (len(edges) + len(edges) % 2)
    assert [f.name for f in tmp_path.iterdir()] == ["g.gr"]  # no part is left


def test_gr_faults(spark, tmp_path):
    path = str(tmp_path / "bad.gr")
    with pytest.raises(OSError):
        read_header(path)
    with open(path, "wb") as f:
        f.write(struct.pack("<4Q", 2, 0, 1, 0) + struct.pack("<Q", 0))
    with pytest.raises(ValueError):
        read_header(path)
    with open(path, "wb") as f:
        f.write(struct.pack("<4Q", 1, 0, 2, 2) + struct.pack("<2Q", 1, 2) + struct.pack("<2I", 1, 9))
    assert invalid_edges(read_gr(spark, path).edges, 2).collect() == [(1, 9)]
    with pytest.raises(ValueError):
        read_gr(spark, path, strict=True)


def test_edge_list_and_command_line(spark, tmp_path, capsys):
    text = str(tmp_path / "edges")
    write_edge_list(graph(spark, TREE).edges, text)
    assert sorted(map(tuple, read_edge_list(spark, text).edges.collect())) == TREE
    cli.main(["bfs_topology", text, "-s", "1", "-o", "-"], spark)
    assert capsys.readouterr().out.splitlines()[-7:] == ["0 1073741823", "1 0", "2 1073741823", "3 1", "4 1", "5 1073741823", "6 1073741823"]
    cli.main(["pagerank_topology", text, "-t", "2", "-n", "-o", "-"], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[-2:] == ["3", "4"] and "sum: 1.540875 (7)" in out
    assert any(line.startswith("read 24 bytes in ") and line.endswith("MB/s)") for line in out) and any("3 rounds, 4 partitions" in line for line in out)
    cli.main(["pagerank_topology", text, "-t", "5", "-o", "-"], spark)
    assert capsys.readouterr().out.splitlines()[-5:] == ["3 0.240844", "4 0.240844", "5 0.240844", "6 0.240844", "1 0.213750"]
    assert throughput_line(5_000_000, 2_000_000_000) == "read 5000000 bytes in 2000 ms (2.50 MB/s)"
    cli.main(["pagerank_data_driven", text, "-q", "-o", "-"], spark)
    assert "0 0." not in capsys.readouterr().out


def _shuffled(spark):
    """Bytes of shuffle files that Spark holds."""
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(f.stat().st_size for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data") if f.exists())


@pytest.mark.parametrize("mode", ["topology", "data_driven"])
def test_rounds_hold_no_more_disk_than_the_edges(spark, monkeypatch, mode):
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 50_000)
    monkeypatch.setattr(pagerank, "SMALL_JOB", 1)
    n, m = 20_000, 200_000
    edges = spark.range(m).select((F.col("id") % n).alias("src"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("dst"))
    before = _shuffled(spark)
    out = pagerank.pagerank(Graph(spark.range(n), edges), mode, max_rounds=8)
    assert out.state.count() == n and _shuffled(spark) - before < 40 * m  # a round of the joining path alone writes about 24 bytes an edge


def _cut_bytes(spark):
    top = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    return sum(f.stat().st_size for f in top.rglob("part-*") if f.exists())


@pytest.mark.parametrize("mode", ["topology", "data_driven"])
def test_what_a_job_wrote_is_gone_when_the_next_begins(spark, monkeypatch, mode):
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 50_000)
    monkeypatch.setattr(pagerank, "SMALL_JOB", 1)
    n, m, held, push = 20_000, 200_000, [], blocks.push
    edges = spark.range(m).select((F.col("id") % n).alias("src"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("dst"))
    cut(spark.range(1))  # names the folder
    tidy_up(spark)
    before = _shuffled(spark) + _cut_bytes(spark)
    monkeypatch.setattr(blocks, "push", lambda *a, **b: held.append(_shuffled(spark) + _cut_bytes(spark) - before) or push(*a, **b))
    out = pagerank.pagerank(Graph(spark.range(n), edges), mode, max_rounds=12)
    assert out.rounds == 12 and max(held) < 15 * m, (max(held) / m, held)  # the edges' own are 16 bytes each
    assert _shuffled(spark) + _cut_bytes(spark) - before < 4 * m + 30 * n  # the blocks' own shuffle, ranks


def test_longs_in_few_bytes():
    top = 2**63 - 1
    for a in [], [7], [-3] * 5, [5, 1, 3], [10**15, 10**15 + 200], [-top - 1, top], [top, -top - 1, 0], [*range(300), 10**9], [0, 2**32, 2**31, -1]:
        stored = blocks._stored(np.array(a, np.int64))
        assert blocks._ints(pa.scalar(stored)).tolist() == a
    assert len(blocks._stored(np.arange(10**15, 10**15 + 1000))) == 1016  # a byte each


def test_ties_of_lines_give_the_same_edges(spark, tmp_path):
    """Lines alike in order, number and part, in any order of the rest."""
    spark.range(3).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    lines = [(1, 1, 0), (1, 1, 0), (1, 2, 2), (1, 1, 1), (2, 5, 1), (2, 5, 1), (3, 1, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = tables.successions(spark, str(tmp_path)).edges.collect()  # reads no further column
    assert sorted(map(tuple, got)) == [(0, 0), (0, 1), (1, 1), (1, 2)]


def test_blocks_and_what_has_none(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_EDGES", 40)
    rnd = random.Random(4)
    n = 60
    edges = [(rnd.randrange(40), rnd.randrange(50)) for _ in range(150)] + [(5, 5), (5, 6), (5, 6)]
    want = _plain_ranks(n, edges, 4)
    g = graph(spark, edges, n)
    assert blocks.lay_out(g, 0.85).count == 4
    assert ranks(pagerank.pagerank(g, max_rounds=4)) == pytest.approx(want)
    far = lambda c: (F.col(c) * 10**15 - 7).alias(c)  # noqa: E731  ids far apart, negative ones too
    spread = Graph(g.vertices.select(far("id")), g.edges.select(far("src"), far("dst")).unionByName(spark.createDataFrame([(3, -7), (None, -7)], "src long, dst long")))
    assert blocks.lay_out(spread, 0.85) is not None  # edges from no vertex pass on nothing
    assert ranks(pagerank.pagerank(spread, max_rounds=4)) == pytest.approx(want)
    assert blocks.lay_out(graph(spark, [*edges, (1, n)], n), 0.85) is None
    assert blocks.lay_out(Graph(g.vertices.union(g.vertices), g.edges), 0.85) is None
    monkeypatch.setattr(blocks, "MOST_EDGES", 20)
    assert blocks.lay_out(g, 0.85) is None
    assert ranks(pagerank.pagerank(g, max_rounds=4)) == pytest.approx(want)
