"""Binary CSR graph files, version 1, as a data source: ``spark.read.format("gr")``.

Layout, little-endian: u64 version (1), u64 bytes of edge data, u64 nodes, u64 edges, u64 end offset of each
node's edges, u32 destination of each edge, padding to 8 bytes, edge data (not read).

A reading task takes a range of edges: it finds its first source by bisection over the offsets in the file
and reads on from there, so files of any size are read in parallel. Writing sorts and encodes ranges of offsets and of
destinations in parallel, each as a part beside the file; the driver then joins the parts byte by byte, in blocks.
"""

from __future__ import annotations

import struct
import uuid
from bisect import bisect_right

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import in_range
from ..graph import EDGES, Graph

HEADER = struct.Struct("<4Q")
EDGES_PER_TASK, ROWS_PER_BATCH = 4_000_000, 65_536


def _at(path: str):
    """File system and path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _open(path: str):
    fs, inner = _at(path)
    return fs.open_input_file(inner)


def read_header(path: str) -> tuple[int, int]:
    """Nodes and edges; an unreadable file or another version raises."""
    with _open(path) as f:
        raw = f.read(HEADER.size)
        if len(raw) < HEADER.size:
            raise ValueError(f"{path} is shorter than a header")
        version, _, nodes, edges = HEADER.unpack(raw)
        if version != 1:
            raise ValueError(f"{path} has version {version}; only 1 is supported")
        if f.size() < HEADER.size + 8 * nodes + 4 * edges:
            raise ValueError(f"{path} ends before its last edge")
    return nodes, edges


class _Ends:
    """The offsets in a file, one at a time."""

    def __init__(self, f, nodes: int):
        self.f, self.nodes = f, nodes

    def __len__(self) -> int:
        return self.nodes

    def __getitem__(self, i: int) -> int:
        return struct.unpack("<Q", self.f.read_at(8, HEADER.size + 8 * i))[0]


class GrPartition(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class GrReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.per_task = int(options.get("edgesPerTask", EDGES_PER_TASK))

    def partitions(self):
        _, edges = read_header(self.path)
        return [GrPartition(a, min(edges, a + self.per_task)) for a in range(0, edges, self.per_task)] or [GrPartition(0, 0)]

    def read(self, partition):
        import numpy as np
        import pyarrow as pa

        nodes, _ = read_header(self.path)
        with _open(self.path) as f:
            node = bisect_right(_Ends(f, nodes), partition.start)
            for a in range(partition.start, partition.end, ROWS_PER_BATCH):
                b = min(partition.end, a + ROWS_PER_BATCH)
                dst = np.frombuffer(f.read_at(4 * (b - a), HEADER.size + 8 * nodes + 4 * a), "<u4").astype(np.int64)
                parts, first = [], node
                while True:  # offsets until one reaches the end of the batch
                    more = min(65_536, nodes - first - sum(map(len, parts)))
                    got = np.frombuffer(f.read_at(8 * more, HEADER.size + 8 * (first + sum(map(len, parts)))), "<u8").astype(np.int64)
                    parts.append(got)
                    if more == 0 or got[-1] >= b:
                        break
                src = first + np.searchsorted(np.concatenate(parts), np.arange(a, b), side="right")
                node = int(src[-1])
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])


class GrSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gr"

    def schema(self) -> str:
        return EDGES

    def reader(self, schema) -> GrReader:
        return GrReader(self.options)


def invalid_edges(edges: DataFrame, n: int) -> DataFrame:
    """Edges with an end outside 0..n-1."""
    inside = lambda c: (F.col(c) >= 0) & (F.col(c) < n)
    return edges.where(~(inside("src") & inside("dst")))


def read_gr(spark: SparkSession, path: str, strict: bool = False, edges_per_task: int = EDGES_PER_TASK) -> Graph:
    """strict: a destination that is no node raises; else such edges are kept."""
    spark.dataSource.register(GrSource)
    nodes, _ = read_header(path)
    edges = spark.read.format("gr").option("path", path).option("edgesPerTask", edges_per_task).load()
    if strict and (bad := invalid_edges(edges, nodes).limit(1).collect()):
        raise ValueError(f"{path} has an edge to no node: {bad[0]}")
    return Graph(spark.range(nodes), edges)


def file_bytes(path: str) -> int:
    """Size of a file, or of all data files of a folder."""
    fs, inner = _at(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return info.size
    files = (f for f in fs.get_file_info(pafs.FileSelector(inner, recursive=True)) if f.type == pafs.FileType.File)
    return sum(f.size for f in files if f.base_name[0] not in "._")


def _write_parts(df: DataFrame, col: str, kind: str, folder: str) -> list[str]:
    """The numbers of col, in the order of df's sorted ranges, as raw parts in folder; their names in order.

    A part is named by attempt, and only the names that tasks returned are read: a repeated or lost attempt does no harm."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, inner = _at(folder)
        at, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        with fs.open_output_stream(f"{inner}/{name}") as f:
            for batch in batches:
                f.write(batch.column(0).to_numpy().astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([name])], names=["at", "name"])

    return [r["name"] for r in df.select(col).mapInArrow(run, "at int, name string").orderBy("at").collect()]


def write_gr(graph: Graph, path: str) -> None:
    """One file. Vertices must be 0..n-1, below 2**32, and edges must begin and end at vertices; else it raises."""
    spark = graph.spark
    nodes, low, high, kinds = graph.vertices.agg(F.count("*"), F.min("id"), F.max("id"), F.count_distinct("id")).first()
    if nodes and (low, high, kinds) != (0, nodes - 1, nodes):
        raise ValueError(f"vertices are not 0..{nodes - 1}, each once")
    if nodes > 1 << 32:
        raise ValueError("a destination has 32 bits")
    edges, bad = graph.edges.agg(F.count("*"), F.coalesce(F.count_if(~(in_range("src", nodes) & in_range("dst", nodes))), F.lit(0))).first()
    if bad:
        raise ValueError(f"{bad} edges have an end that is no vertex")
    fs, inner = _at(path)
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    fs.create_dir(_at(folder)[1])
    try:
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ends = graph.row_starts().join(graph.degrees(), "id").select("id", (F.col("row_start") + F.col("out_degree")).alias("end"))
        parts = _write_parts(ends.repartitionByRange(tasks, "id").sortWithinPartitions("id"), "end", "<u8", folder)
        parts += _write_parts(graph.edges.repartitionByRange(tasks, "src", "dst").sortWithinPartitions("src", "dst"), "dst", "<u4", folder)
        with fs.open_output_stream(inner) as f:
            f.write(HEADER.pack(1, 0, nodes, edges))
            for name in parts:
                with _open(f"{folder}/{name}") as part:
                    while block := part.read(16 << 20):
                        f.write(block)
            f.write(b"\0" * (edges % 2 * 4))
    finally:
        fs.delete_dir(_at(folder)[1])
