"""Operator 4, variable-capacity best-fit packing.

Documents are cut into pieces of at most the largest permitted sequence length and packed into sequences
(bins) of several permitted lengths, jointly: pieces go in from the longest, each into the open bin with
the least room that still takes it. If none does, the bin size with the least cost is opened: its price,
``capacity ** power + bin_cost``, less the worth of the room that pieces still to come can fill.
How much that room is worth is not known beforehand, so every shard is packed for each of ``worths`` and
the cheapest packing stays. At the end each bin shrinks to the smallest permitted length that holds it.

Shards of about ``shard_pieces`` pieces are packed independently, in parallel; a shard loses at most a few
part-filled bins. Rows go to shards by a hash of id, length and part, so no source or key gathers in
one task, and only numbers are shuffled, never texts.

Defined cases: null and empty texts have length ``extra`` (the end mark); rows that repeat an id are
packed each, told apart by ``copy``; ties in length are packed by id, part and copy, null ids last; a long text is several
pieces; an empty input gives no rows; only the id and what ``length`` names are looked at, so no other column clashes.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

CAPACITIES = (512, 1024, 2048, 4096, 8192)


def pack(lengths: list[int], capacities=CAPACITIES, power: float = 1.0, bin_cost: float = 32.0, worths=(0.0, 0.9, 0.97, 1.0, 2.0)) -> list[tuple[int, int, int]]:
    """(bin, start in the bin, capacity of the bin) of each length; lengths must fall or stay equal."""
    caps = sorted(capacities)
    price = {c: c**power + bin_cost for c in caps}
    unit = min(price[c] / c for c in caps)  # what a token costs in the best filled bin
    best = None
    for worth in worths:
        got = _pack_once(lengths, caps, price, worth * unit)
        fill: dict[int, int] = {}
        for n, (b, _) in zip(lengths, got, strict=True):
            fill[b] = fill.get(b, 0) + n
        size = {b: caps[bisect_left(caps, n)] for b, n in fill.items()}
        cost = sum(price[c] for c in size.values())
        if best is None or cost < best[0]:
            best = cost, [(b, at, size[b]) for b, at in got]
    return best[1] if best else []


def _pack_once(lengths, caps, price, value):
    left = sum(lengths)
    rooms: list[int] = []  # rooms of open bins, each value once, sorted
    open_: dict[int, list[int]] = {}
    used: list[int] = []
    out = []
    for n in lengths:
        left -= n
        at = bisect_left(rooms, n)
        if at < len(rooms):
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        else:
            room = min((c for c in caps if c >= n), key=lambda c: (price[c] - value * min(c - n, left), c))
            b = len(used)
            used.append(0)
        out.append((b, used[b]))
        used[b] += n
        room -= n
        if room:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append(b)
    return out


def word_length(text, extra: int = 1):
    """Words of a text, with end mark: the length that the queries pack by."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long") + F.lit(extra)


def best_fit_packing(
    df: DataFrame, length, id_col: str = "doc_id", capacities=CAPACITIES, power: float = 1.0, bin_cost: float = 32.0,
    worths=(0.0, 0.9, 0.97, 1.0, 2.0), shard_pieces: int = 20_000,
) -> DataFrame:
    """A row per piece: id, part, copy, piece_start, piece_length, shard, bin, bin_start, capacity.

    length: a Column. Lengths below one count as one.
    """
    spark, most = df.sparkSession, max(capacities)
    sized = df.select(F.col(id_col).alias("_id"), F.greatest(length.cast("long"), F.lit(1)).alias("_n")).groupBy("_id", "_n").agg(F.count("*").alias("_copies"))
    sized = written(spark, sized, "lengths")
    pieces = sized.select(
        "_id", "_n", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("copy")
    ).select("_id", "_n", "copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / most))).alias("part"))
    start = F.col("part") * most
    total = sized.agg(F.sum(F.col("_copies") * F.ceil(F.col("_n") / most))).first()[0] or 0
    shards = max(1, math.ceil(total / shard_pieces))
    pieces = pieces.select(
        F.pmod(F.xxhash64("_id", "_n", "copy", "part"), F.lit(shards)).alias("shard"), "_id", "part", "copy",
        start.alias("piece_start"), F.least(F.col("_n") - start, F.lit(most)).alias("piece_length"),
    )

    def run(table):
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = [("piece_length", "descending"), ("_id", "ascending"), ("part", "ascending"), ("copy", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_end"))
        got = pack(table.column("piece_length").to_pylist(), capacities, power, bin_cost, worths)
        for name, values in zip(("bin", "bin_start", "capacity"), zip(*got, strict=True), strict=True):
            table = table.append_column(name, pa.array(values, pa.int64()))
        return table

    kind = pieces.schema["_id"].dataType.simpleString()  # in Arrow from end to end: no id becomes a float beside a null
    return pieces.groupBy("shard").applyInArrow(
        run, f"shard long, _id {kind}, part long, copy long, piece_start long, piece_length long, bin long, bin_start long, capacity long"
    ).withColumnRenamed("_id", id_col)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), word_length(F.col("text")))
