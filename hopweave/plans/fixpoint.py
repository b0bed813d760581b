"""Iteration to a fixpoint: several rounds a job, lineage cut in the shared checkpoint folder after each job.

A round takes the state to the next state and names a measure of it. All rounds of a job are one lazy
plan; their measures are observed while it runs, so a job costs one action. If a round inside the block already
met the end, the block is run again up to that round, from the last cut.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Outcome:
    state: DataFrame
    rounds: int
    converged: bool


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder, which driver and executors share. Where none is named, a local one in local mode (tests); else it raises."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="hopweave-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def counted_cut(df: DataFrame) -> tuple[DataFrame, int]:
    """cut() and the number of rows, which is observed in the same job."""
    seen = Observation()
    out = cut(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return out, seen.get["n"]


def tidy_up(spark: SparkSession) -> None:
    """Spark gives back the shuffles and cuts that no plan holds any more; without this, only once the driver's heap happens to be collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settled(df: DataFrame) -> DataFrame:
    """cut(), and at once gives back the shuffles that df's own plan wrote. df itself is not to be read again; what is kept in memory below it stays."""
    out = cut(df)
    plan, cleaner = df._jdf.queryExecution().executedPlan(), df.sparkSession.sparkContext._jsc.sc().cleaner()
    if plan.getClass().getSimpleName() != "AdaptiveSparkPlanExec" or cleaner.isEmpty():
        tidy_up(df.sparkSession)
        return out
    ids = plan.context().shuffleIds().keySet().iterator()
    while ids.hasNext():
        cleaner.get().doCleanupShuffle(ids.next(), True)
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes the files of a cut that nothing reads any more; leaves a df that is no cut."""
    plan = df._jdf.queryExecution().analyzed()
    file = plan.rdd().getCheckpointFile() if plan.getClass().getSimpleName() == "LogicalRDD" else None
    if file is not None and file.isDefined():
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def iterate(
    state: DataFrame, step: Callable[[DataFrame, int], DataFrame], measure: Column, done: Callable[[object], bool],
    max_rounds: int | None = None, rounds_per_job: int = 8, tidy: bool = False,
    first: Callable[[DataFrame], DataFrame] | None = None, last: Callable[[DataFrame, int], DataFrame] | None = None,
) -> Outcome:
    """step(state, number of the round, from 1); done(value of the measure after a round) ends it. tidy: each job gives back its shuffles
    and the cut that it began from. first: of the state of each job before its rounds; last: in place of step in a job's last round."""
    save = settled if tidy else cut
    rounds = 0

    def job(n: int, seen: list[Observation] | None = None) -> DataFrame:
        after = first(state) if first else state
        for k in range(n):
            after = (last if last and k == n - 1 else step)(after, rounds + k + 1)
            if seen is not None:
                after = after.observe(seen[k], measure.alias("measure"))
        return save(after)

    while max_rounds is None or rounds < max_rounds:
        block = rounds_per_job if max_rounds is None else min(rounds_per_job, max_rounds - rounds)
        seen = [Observation() for _ in range(block)]
        after = job(block, seen)
        ends = [k for k, o in enumerate(seen) if done(o.get["measure"])]
        ran = ends[0] + 1 if ends else block
        if ran < block:
            if tidy:
                drop_cut(after)
            after = job(ran)
        if tidy:
            drop_cut(state)
        state, rounds = after, rounds + ran
        if ends:
            return Outcome(state, rounds, True)
    return Outcome(state, rounds, False)
