"""Column predicates of graphs."""

from pyspark.sql import functions as F


def in_range(col, n):
    """Whether an id is one of n: 0..n-1. Null is not."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce((col >= 0) & (col < n), F.lit(False))
