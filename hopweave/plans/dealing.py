"""Edges kept in memory (spilling to disk), dealt by source for joins that repeat every round.

A hub, a source of more than ``HUB_EDGES`` edges, is dealt in parts of about that many, by a hash of the
destination; what joins it is repeated once a part. Copies of one edge stay together. On graphs of more than
``HUB_EDGES * MAX_HUBS`` edges a hub is a source of more than edges / ``MAX_HUBS``, so there are always fewer than
``MAX_HUBS`` hubs and their table is broadcast. Out-degrees are counted once, for hubs and weights alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HUB_EDGES = 1_000_000
MAX_HUBS = 100_000


@dataclass(frozen=True)
class Dealt:
    edges: DataFrame
    hubs: DataFrame | None
    degrees: DataFrame | None = None
    size: int = 0

    def out_edges(self, state: DataFrame, small: bool = False) -> DataFrame:
        """state (id, ...) with every out-edge of its ids. small: state is counted and can be broadcast."""
        if small:
            return self.edges.join(F.broadcast(state), F.col("id") == F.col("src"))
        if self.hubs is None:
            return state.join(self.edges, F.col("id") == F.col("src"))
        return _in_parts(state, "id", self.hubs, "_at").join(self.edges, (F.col("id") == F.col("src")) & (F.col("_at") == F.col("_part")))

    def release(self) -> None:
        """Gives the memory back; the edges can still be read, at the cost of dealing them again."""
        for df in (self.edges, self.hubs, self.degrees):
            if df is not None:
                df.unpersist()


def _in_parts(rows: DataFrame, key: str, hubs: DataFrame, name: str) -> DataFrame:
    """rows, those of a hub repeated once for each of its parts."""
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1)).alias(name)
    return rows.join(F.broadcast(hubs), F.col(key) == F.col("_hub"), "left").select(*rows.columns, each)


def deal(edges: DataFrame, own: DataFrame | None = None, hub_edges: int | None = None, weigh: Callable | None = None) -> Dealt:
    """own: further rows with the edges' columns, one a source.

    weigh: takes edges and own rows, told apart by a column own, with a column degree (the source's out-degree, null for
    none), and gives the rows to keep. They are dealt before they meet their degree, so a hub's edges are never in one task."""
    counted = edges.groupBy("src").agg(F.count("*").alias("degree")).persist()
    all_, top = counted.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
    most = max(hub_edges or HUB_EDGES, -(-all_ // MAX_HUBS))
    hubs = None
    if top > most:
        hubs = counted.where(F.col("degree") > most).select(F.col("src").alias("_hub"), F.ceil(F.col("degree") / most).alias("_parts")).persist()
    keys, rows = ["src"], edges
    if weigh:
        rows = rows.withColumn("own", F.lit(False))
        own = own if own is None else own.withColumn("own", F.lit(True))
    if hubs is not None:
        keys = ["src", "_part"]
        part = F.pmod(F.xxhash64("dst"), F.coalesce("_parts", F.lit(1))).alias("_part")
        rows = rows.join(F.broadcast(hubs), F.col("src") == F.col("_hub"), "left").select(*rows.columns, part)
        own = own if own is None else own.withColumn("_part", F.lit(0).cast("long"))
    rows = (rows if own is None else rows.unionByName(own)).repartition(*keys)
    if weigh:
        degrees = counted if hubs is None else _in_parts(counted, "src", hubs, "_part")
        rows = weigh(rows.join(degrees.hint("merge"), keys, "left")).drop("own", "degree")
    out = Dealt(rows.persist(), hubs, counted, all_)
    if not weigh:
        counted.unpersist()
    return out
