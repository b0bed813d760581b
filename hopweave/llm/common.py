"""What the operators share: reading tables, written intermediates, defined handling of ids."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local one in local mode (tests); else it raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="hopweave-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scopes: ContextVar[tuple] = ContextVar("scopes", default=())


class Scratch:
    """Tables written within the block are deleted at its end; result() writes the one that outlives it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        self.token = _scopes.set((*_scopes.get(), self))
        return self

    def __exit__(self, *_) -> None:
        _scopes.reset(self.token)
        for path in self.paths:
            delete(self.spark, path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        out = written(self.spark, df, name)
        self.paths.remove(out.written_path)
        if outer := [s for s in _scopes.get() if s is not self]:
            outer[-1].paths.append(out.written_path)
        return out


def written(spark: SparkSession, df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """df as a table in the shared folder: lineage ends here and lost executors cost no recomputation."""
    path = new_path(spark, name)
    if _scopes.get():
        _scopes.get()[-1].paths.append(path)
    # Row groups of 16 MB: what a task buffers stays small beside its sort and shuffle memory.
    df.write.option("compression", codec).option("parquet.block.size", 16 << 20).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by written(), once all that is computed from them has itself been written."""
    for df in frames:
        delete(df.sparkSession, df.written_path)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


HOT_GROUPS = 1000
#: A key with fewer rows is no burden to a task.
LEAST_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size_col: str, total: int) -> DataFrame:
    """rows left-joined with groups, which has one row per key and in size_col the key's number of rows.

    A key with more than total / HOT_GROUPS rows is hot. There are fewer than HOT_GROUPS such keys however
    large the input, so they are broadcast and their rows stay where they are; the rest is shuffled, and
    none of its keys gathers more than that share. groups is read three times: give a written table."""
    hot = F.col(size_col) * HOT_GROUPS > total
    few = groups.where(hot)
    many = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(groups.where(~hot), keys, "left")
    return rows.join(F.broadcast(few), keys).unionByName(many)


def join_split(rows: DataFrame, other: DataFrame, keys: list[str], salt: list[str], counted: DataFrame | None = None) -> DataFrame:
    """rows joined with other on keys; rows may hold any number of a key. counted: a written table with the keys of all
    rows, rows itself if none is given.

    The fewer than HOT_GROUPS keys with more than a thousandth of all rows (and LEAST_SHARE) are dealt in parts of about that many, by a
    hash of the salt columns, and what other has of them is repeated once a part: no task gathers a hot key's rows."""
    counted = rows if counted is None else counted
    share = max(LEAST_SHARE, -(-counted.count() // HOT_GROUPS))
    parts = F.ceil(F.col("_n") / share).cast("int").alias("_parts")
    sizes = counted.groupBy(*keys).agg(F.count("*").alias("_n"))
    hot = written(rows.sparkSession, sizes.where(F.col("_n") > share).select(*keys, parts), "hot-keys")
    if not hot.limit(1).count():
        return rows.join(other, keys)
    hot, most = F.broadcast(hot), F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*salt), most).cast("int")).drop("_parts")
    copies = other.join(hot, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), most - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"]).drop("_part")


def ascii_lower(col):
    return F.translate(col, ASCII_UPPER, ASCII_LOWER)


def id_bucket(col, buckets: int):
    """crc32 of the id as decimal text, modulo buckets: the fold rule of the labelled operators."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(buckets)


#: What a Python worker gets at once: rows, and bytes before the text that crosses the bound.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's batch bounds to BATCH for good; never raises one. The setting is the same for every
    operator and thread, changes no result, and holds when a lazy result runs later."""
    for key, most in BATCH.items():
        now = spark.conf.get(key)
        if not (now.isdecimal() and 0 < int(now) <= most):  # "256MB" and the like are large, too
            spark.conf.set(key, str(most))


def map_texts(df: DataFrame, id_col: str, value_cols: list[str], schema: str, make: Callable, rows: int = 256) -> DataFrame:
    """id and the columns of schema: make(), called in each task, gives a function from the values of a few rows (a
    list a column) to one list for each column of schema.

    The id is passed on as the Arrow column it came as: null or any type, no value changes."""
    small_batches(df.sparkSession)
    names = [f"_v{k}" for k in range(len(value_cols))]
    src = df.select(F.col(id_col).alias("_id"), *[F.col(c).alias(n) for c, n in zip(value_cols, names, strict=True)])
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = work(*[part.column(n).to_pylist() for n in names])
                cols = [pa.array(x, field.type, from_pandas=False) for x, field in zip(got, out, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *cols], names=["_id", *out.names])
        give_back()

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, {schema}").withColumnRenamed("_id", id_col)


def give_back() -> None:
    """Returns a Python worker's free memory to the system; idle workers then hold little."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no malloc_trim
        ctypes.CDLL("libc.so.6").malloc_trim(0)
