"""Frequent values of a column of arrays, found without shuffling the values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_GROUPS, LEAST_SHARE, give_back, small_batches, written

#: Counters a task keeps. A task's counts are too small by at most its values / COUNTERS.
COUNTERS = 4 * HOT_GROUPS


def merge(keys: np.ndarray, counts: np.ndarray, values: np.ndarray, most: int = COUNTERS) -> tuple[np.ndarray, np.ndarray]:
    """Counters with more values counted in: where more than ``most`` are left, all fall by the next largest (Misra and Gries)."""
    new, n = np.unique(values, return_counts=True)
    keys, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([counts, n]), len(keys)).astype(np.int64)
    if len(keys) > most:
        counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        keys, counts = keys[counts > 0], counts[counts > 0]
    return keys, counts


def heavy_values(arrays: DataFrame, col: str, total: int) -> DataFrame:
    """token, held: every value with more than a thousandth of all ``total`` values (and LEAST_SHARE), and perhaps some with
    three quarters of that; fewer than 1,400, whatever the input. held is at most the value's count, and over 700.

    Each task counts its own values in a bounded number of counters; only these are shuffled and summed."""
    small_batches(arrays.sparkSession)

    def run(batches):
        import pyarrow as pa

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys, counts = merge(keys, counts, batch.column(0).flatten().to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["token", "n"])
        give_back()

    share = max(LEAST_SHARE, total / HOT_GROUPS)
    summed = arrays.select(col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("held"))
    return written(arrays.sparkSession, summed.where(F.col("held") > share - total / COUNTERS), "heavy-values")
