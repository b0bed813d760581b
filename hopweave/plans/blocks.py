"""A graph laid out in blocks of vertices for rounds that sum along in-edges, one stage a round.

A block holds its vertices' ids, the weights of their out-edges, the edges that end in it (as positions, copies merged and
counted), and for every other block the vertices it has edges to. In a round it sends each block one array: of
every vertex with an edge there, once, what it passes on; so a round ships 8 bytes for each pair of a source and a
block, and the edges stay where they are. Longs are stored in as few bytes as hold them. What a job leaves is each block's own row,
without what it sends: the next job sends it first. Ids may be any longs. ``lay_out`` gives None where this form does not
hold: ids that are null or repeated, edges to no vertex, no vertices, or a block (of a hub) of more than ``MOST_EDGES``.
"""

from __future__ import annotations

import functools
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..graph import Graph
from .fixpoint import drop_cut, settled

#: Edges a block is meant for, the most blocks, the most edges of a block, and of a packed row.
BLOCK_EDGES, MAX_BLOCKS, MOST_EDGES, CHUNK = 1_000_000, 4096, 16_000_000, 500_000

WIDTHS = (np.uint8, np.uint16, np.uint32, np.uint64)

PACKED = "src binary, dst binary, n binary, edges long, bad boolean"
SPLIT = "b long, kind int, src binary, dst binary, n binary"
LAYOUT = "b long, ids binary, w binary, runs binary, dst binary, n binary, others binary, lengths binary, pos binary, edges long, sent long, bad boolean"
STATE = "b long, other long, data binary, ids binary, p binary, held binary, measure double"


@dataclass(frozen=True)
class Blocks:
    rows: DataFrame  # LAYOUT, kept in memory, dealt by b
    count: int
    edges: int
    sent: int  # values a round sends

    laid: DataFrame  # the cut that rows are read from

    def release(self) -> None:
        """What was computed from the blocks must have been cut before."""
        self.rows.unpersist()
        drop_cut(self.laid)


def _block(ids: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Index in labels of each id's block."""
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(len(labels))).astype(np.int64)


def _stored(a: np.ndarray) -> bytes:
    """Doubles as they are; longs as distances from the smallest, or ascending ones from the one before, in as few bytes as hold them,
    after a head of 16 bytes."""
    if a.dtype == np.float64 or not len(a):
        return a.tobytes()
    a = a.astype(np.int64, copy=False)
    ascending = bool((a[1:] >= a[:-1]).all())
    base = a[0] if ascending else a.min()
    far = (np.diff(a, prepend=base) if ascending else a - base).view(np.uint64)
    kind = next(i for i, k in enumerate(WIDTHS) if int(far.max()) <= np.iinfo(k).max)
    return np.array([base, kind + 4 * ascending], np.int64).tobytes() + far.astype(WIDTHS[kind]).tobytes()


def _doubles(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.float64)


def _ints(cell) -> np.ndarray:
    """The longs of _stored()."""
    buffer = cell.as_buffer()
    if not len(buffer):
        return np.zeros(0, np.int64)
    base, how = np.frombuffer(buffer, np.int64, 2)
    far = np.frombuffer(buffer, WIDTHS[how % 4], offset=16)
    return base + (np.cumsum(far, dtype=np.uint64) if how >= 4 else far.astype(np.uint64)).view(np.int64)


def _counts(n: np.ndarray) -> np.ndarray:
    """n as it is stored: without values if all are 1."""
    return n if (n != 1).any() else n[:0]


def _numbers(cell, size: int) -> np.ndarray:
    return _ints(cell) if len(cell.as_buffer()) else np.ones(size, np.int64)


def _longs(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _merged(*keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in ascending order, and the sums of n."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(first)
    return *(k[at] for k in keys), np.add.reduceat(n[order], at) if len(at) else n[:0]


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    cells = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array([_stored(x) if isinstance(x, np.ndarray) else x for x in c], kinds[k]) for c, (_, k) in zip(cells, fields)], names=[n for n, _ in fields])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges as arrays, copies within a row merged; edges from null pass on nothing, edges to null are bad."""
    def row():
        got = pa.Table.from_batches(held)
        bad = got.filter(pa.compute.is_valid(got["src"]))["dst"].null_count > 0
        got = got.drop_null()
        src, dst = _longs(got["src"]), _longs(got["dst"])
        src, dst, n = _merged(src, dst, n=np.ones(len(src), np.int64))
        return _batch(PACKED, [(src, dst, _counts(n), len(src), bad)])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield row()
            held, size = [], 0
    if size:
        yield row()


def _sizes(labels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, starts = np.zeros(len(labels), np.int64), np.zeros(len(labels), np.int64)
        for batch in batches:
            for src, dst in zip(batch["src"], batch["dst"]):
                ends += np.bincount(_block(_ints(dst), labels), minlength=len(labels))
                starts += np.bincount(_block(np.unique(_ints(src)), labels), minlength=len(labels))
        at = np.flatnonzero(ends + starts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(ends[at]), pa.array(starts[at])], names=["at", "ends", "starts"])
    return run


def _split(labels: np.ndarray):
    """Of each packed row, by block: the edges that end there (kind 0), and the sources that lie there with the block of their edges' ends (1)."""
    def by(at, kind, src, dst, n):
        order = np.argsort(at, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            if len(rows):
                yield int(labels[at[rows[0]]]), kind, src[rows], dst[rows], _counts(n[rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, dst, n in zip(batch["src"], batch["dst"], batch["n"]):
                src, dst = _ints(src), _ints(dst)
                n = _numbers(n, len(src))
                end = _block(dst, labels)
                yield _batch(SPLIT, list(by(end, 0, src, dst, n)))
                src, end, n = _merged(src, labels[end], n=n)
                yield _batch(SPLIT, list(by(_block(src, labels), 1, src, end, n)))
    return run


def _vertices(labels: np.ndarray):
    """Ids by block (kind 2); a null id is a row without ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _longs(batch["id"])
            at = _block(ids, labels)
            rows = [(int(labels[k]), 2, ids[at == k], None, None) for k in np.unique(at)]
            rows += [(int(labels[0]), 2, None, None, None)] * (batch["id"].null_count > 0)
            yield _batch(SPLIT, rows)
    return run


def _at(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Positions in ids, -1 for those that are not there."""
    if not len(ids):
        return np.full(len(of), -1, np.int32)
    at = np.minimum(np.searchsorted(ids, of), len(ids) - 1)
    return np.where(ids[at] == of, at, -1).astype(np.int32)


def _build(alpha: float, labels: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        def all_of(kind):
            got = table.filter(pa.compute.equal(table["kind"], kind))
            cells = [(_ints(a), _ints(b), n) for a, b, n in zip(got["src"], got["dst"], got["n"])]
            return [np.concatenate(x or [np.zeros(0, np.int64)]) for x in ([a for a, _, _ in cells], [b for _, b, _ in cells], [_numbers(n, len(a)) for a, _, n in cells])]

        own = table.filter(pa.compute.equal(table["kind"], 2))["src"]
        ids = np.sort(np.concatenate([_ints(x) for x in own.drop_null()] or [np.zeros(0, np.int64)]))
        bad = own.null_count > 0 or bool((ids[1:] == ids[:-1]).any())
        src, dst, n = all_of(0)
        begin, src, dst, n = _merged(labels[_block(src, labels)], src, dst, n=n)
        # what arrives is ordered by block and source, as the sender's positions are
        new = np.flatnonzero(np.append(True, (begin[1:] != begin[:-1]) | (src[1:] != src[:-1]))[: len(src)])
        runs = np.diff(new, append=len(src))
        end = _at(ids, dst)
        n = _counts(n)
        edges, bad = len(src), bad or bool((end < 0).any())
        src, to, out = all_of(1)
        to, src, out = _merged(to, src, n=out)
        pos = _at(ids, src)  # -1: no vertex, passes on nothing
        degree = np.bincount(pos[pos >= 0], out[pos >= 0], len(ids))
        w = np.divide(alpha, degree, out=np.zeros(len(ids)), where=degree > 0)
        others, lengths = np.unique(to, return_counts=True)
        row = (table["b"][0].as_py(), ids, w, runs, end, n, others, lengths, pos, edges, len(pos), bad)
        return pa.Table.from_batches([_batch(LAYOUT, [row])])
    return run


def lay_out(graph: Graph, alpha: float, block_edges: int | None = None) -> Blocks | None:
    seen = Observation()
    packed = graph.edges.select("src", "dst").mapInArrow(_pack, PACKED)
    packed = settled(packed.observe(seen, F.coalesce(F.sum("edges"), F.lit(0)).alias("edges"), F.coalesce(F.bool_or("bad"), F.lit(False)).alias("bad")))
    try:
        return None if seen.get["bad"] else _lay_out(graph, packed, seen.get["edges"], alpha, block_edges or BLOCK_EDGES)
    finally:
        drop_cut(packed)


def _lay_out(graph: Graph, packed: DataFrame, edges: int, alpha: float, block_edges: int) -> Blocks | None:
    count = max(1, min(MAX_BLOCKS, -(-edges // block_edges)))
    # names of blocks of which each goes to a partition of its own
    at = F.pmod(F.hash("id"), F.lit(count))
    names = [r[1] for r in graph.spark.range(40 * count + 100, numPartitions=1).groupBy(at.alias("at")).agg(F.min("id")).collect()]
    labels = np.array(sorted(names), np.int64)
    sizes = packed.mapInArrow(_sizes(labels), "at long, ends long, starts long").groupBy("at").agg(F.sum("ends").alias("e"), F.sum("starts").alias("s"))
    if (sizes.agg(F.max(F.greatest("e", "s"))).first()[0] or 0) > MOST_EDGES:
        return None
    rows = packed.mapInArrow(_split(labels), SPLIT).unionByName(graph.vertices.select(F.col("id").cast("long")).mapInArrow(_vertices(labels), SPLIT))
    laid = settled(rows.repartition(count, "b").groupBy("b").applyInArrow(_build(alpha, labels), LAYOUT))
    rows = laid.repartition(count, "b").persist()
    held, sent, bad = rows.agg(F.sum("edges"), F.sum("sent"), F.bool_or("bad")).first()
    out = Blocks(rows, count, held, sent, laid)
    if bad or held is None:
        out.release()
        return None
    return out


def _sent(b: int, passed: np.ndarray, layout: dict) -> list[tuple]:
    v = np.append(passed * _doubles(layout["w"]), 0.0)
    pos, rows, at = _ints(layout["pos"]), [], 0
    for j, n in zip(_ints(layout["others"]).tolist(), _ints(layout["lengths"]).tolist()):
        rows.append((j, b, v[pos[at : at + n]], None, None, None, None))
        at += n
    return rows


def _cells(table: pa.Table) -> dict:
    return {n: table[n][0] for n in table.column_names}


@functools.cache
def _keep_loaded() -> None:
    """Once a worker: what it has loaded is left out of the garbage collection that Spark runs after each of its tasks."""
    gc.freeze()


def start(blocks: Blocks, value: float) -> DataFrame:
    """STATE: a row for each block (other = -1) with ids, ranks, what is held back and, as data, what is to be passed on."""
    def run(table: pa.Table) -> pa.Table:
        layout = _cells(table)
        at = np.full(len(_ints(layout["ids"])), value)
        return pa.Table.from_batches([_batch(STATE, [(layout["b"].as_py(), -1, at, layout["ids"].as_py(), at, np.zeros(len(at)), None)])])
    return blocks.rows.select("b", "ids").groupBy("b").applyInArrow(run, STATE)


def send(state: DataFrame, blocks: Blocks) -> DataFrame:
    """state with what each block sends to each."""
    def run(got: pa.Table, table: pa.Table) -> pa.Table:
        _keep_loaded()
        own, layout = _cells(got), _cells(table)
        b = own["b"].as_py()
        row = (b, -1, None, *[own[n].as_py() for n in ("ids", "p", "held", "measure")])
        return pa.Table.from_batches([_batch(STATE, [row, *_sent(b, _doubles(own["data"]), layout)])])
    layouts = blocks.rows.select("b", "w", "others", "lengths", "pos")
    return state.repartition(blocks.count, "b").groupBy("b").cogroup(layouts.groupBy("b")).applyInArrow(run, STATE)


def push(state: DataFrame, blocks: Blocks, mode: str, epsilon: float, last: bool = False) -> DataFrame:
    """The next round of what send() gives, sent again unless last; measure: of a block the highest total (topology) or passed value."""
    def run(got: pa.Table, table: pa.Table) -> pa.Table:
        _keep_loaded()
        layout = _cells(table)
        order = np.argsort(got["other"].to_numpy())
        own, sent = int(order[0]), [_doubles(got["data"][int(i)]) for i in order[1:]]
        p, held = _doubles(got["p"][own]), _doubles(got["held"][own])
        value = np.repeat(np.concatenate(sent or [np.zeros(0)]), _ints(layout["runs"]))
        n = _ints(layout["n"])
        total = np.bincount(_ints(layout["dst"]), value * n if len(n) else value, len(p)) + held
        active = {"topology": np.True_, "data_driven": total >= epsilon, "residual": total > epsilon}[mode]
        passed, held = np.where(active, total, 0.0), np.where(active, 0.0, total)
        measure = float((total if mode == "topology" else passed).max(initial=0.0))
        b = layout["b"].as_py()
        row = (b, -1, passed if last else None, got["ids"][own].as_py(), p + passed, held, measure)
        return pa.Table.from_batches([_batch(STATE, [row, *([] if last else _sent(b, passed, layout))])])
    layouts = blocks.rows.select("b", "runs", "dst", "n", *([] if last else ["w", "others", "lengths", "pos"]))
    return state.repartition(blocks.count, "b").groupBy("b").cogroup(layouts.groupBy("b")).applyInArrow(run, STATE)


def ranks(state: DataFrame) -> DataFrame:
    """node, p."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, p in zip(batch["ids"], batch["p"]):
                ids, p = _ints(ids), _doubles(p)
                for k in range(0, len(ids), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[k : k + 100_000]), pa.array(p[k : k + 100_000])], names=["node", "p"])
    return state.where("other = -1").select("ids", "p").mapInArrow(run, "node long, p double")
