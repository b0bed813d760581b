"""Results as lines of text, and what a run reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def level_lines(levels: DataFrame) -> DataFrame:
    return levels.orderBy("id").select(F.concat_ws(" ", "id", "level").alias("value"))


def rank_lines(ranks: DataFrame, nodes_only: bool = False, ranked: bool = False) -> DataFrame:
    """ranked: from the highest rank, ties by node; else by node."""
    line = F.col("node").cast("string") if nodes_only else F.format_string("%d %f", "node", "p")
    return ranks.orderBy(*([F.desc("p"), "node"] if ranked else ["node"])).select(line.alias("value"))


def throughput_line(n_bytes: int, took_ns: int) -> str:
    """Bytes, milliseconds and MB (10**6 bytes) a second of a read."""
    ms = took_ns / 1e6
    return f"read {n_bytes} bytes in {ms:.0f} ms ({n_bytes / 1e6 / max(took_ns, 1) * 1e9:.2f} MB/s)"


def write_lines(lines: DataFrame, target: str | None, quiet: bool = False) -> None:
    """target: a folder, "-" for standard output, None for nowhere."""
    if quiet or target is None:
        return
    if target == "-":
        for r in lines.toLocalIterator():
            print(r["value"])
    else:
        lines.write.text(target)
