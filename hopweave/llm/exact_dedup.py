"""Operator 1, exact dedup by progressive refinement.

Rows are grouped by byte length; lengths that occur once are settled. The rest are grouped by length and
the hash of a short prefix, which only they have taken; groups of one are settled again. Only members of groups that survive both
have their full content hashed (SHA-256) and grouped by it. A caller that wants every row's SHA-256 (``digest_col``) gets
it from the same single computation.

``exact_dedup`` shuffles no text: each round scans the input and shuffles lengths and hashes alone. The repeated lengths and the keys of
surviving groups are broadcast only after their number was counted and found below
``max_broadcast_groups``. Above it the round settles nothing and the next one does its rows: a column of texts is read whole for its
prefix anyhow, so this costs hashing in the scan, where a join would shuffle the texts; the rows are the same. Groups that
hold more than a thousandth of all rows, fewer than 1,000, are joined by broadcast, so that no task gets all copies of a hot text.
``drop_exact_copies`` returns whole rows: the (id, hash) pairs that go are broadcast when counted to be at most
``max_broadcast_rows``; beyond that they are joined, which shuffles the rows with their texts once.

Defined cases: null text counts as the empty text; all empty texts form one group; rows that repeat both
id and text belong to one group like any others and share ``kept``; an empty input gives an empty
result; columns of the input other than id, text and ``carry`` are not looked at, and helper columns take
names that the input lacks, so clashing names are harmless. The row with the largest id of a group stays (null ids lose).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, join_groups, table, written

PREFIX_CHARS = 64


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: dict | None = None,
    prefix_chars: int = PREFIX_CHARS,
    max_broadcast_groups: int = 500_000,
    digest_col: str | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, the ``carry`` columns (name -> Column) and, named by
    digest_col, every row's SHA-256."""
    spark = docs.sparkSession
    carry = carry or {}
    src = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"),
        *[c.alias(f"_c_{k}") for k, c in carry.items()],
    )
    src = src.withColumn("_len", F.octet_length("_text"))

    def marked(rows, groups, keys, mark):
        """rows with a column that tells whether their keys are in groups (written, with column mark)."""
        if groups.count() <= max_broadcast_groups:
            return rows.join(F.broadcast(groups), keys, "left")
        return rows.withColumn(mark, F.lit(True))

    lengths = src.groupBy("_len").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", F.lit(True).alias("_again"))
    src = marked(src, written(spark, lengths, "dedup-lengths"), ["_len"], "_again")
    src = src.withColumn("_pre", F.when(F.col("_again"), F.xxhash64(F.substring("_text", 1, prefix_chars))))
    groups = src.where("_again").groupBy("_len", "_pre").agg(F.count("*").alias("_n")).where("_n > 1").select("_len", "_pre", F.lit(True).alias("_open"))
    src = marked(src, written(spark, groups, "dedup-groups"), ["_len", "_pre"], "_open")
    full = F.sha2(F.col("_text").cast("binary"), 256)
    if digest_col:
        src = src.withColumn("_sha", full)
        full = F.col("_sha")
    rows = written(
        spark,
        src.select(
            "_id", "_len", *[f"_c_{k}" for k in carry], *(["_sha"] if digest_col else []),
            F.when(F.col("_open") & F.col("_again"), full).alias("_full"),
        ),
        "dedup-marked",
    )
    sizes = (
        rows.where("_full is not null").groupBy("_len", "_full")
        .agg(F.max("_id").alias("_keep"), F.count("*").alias("_size")).where("_size > 1")
    )
    # Rows that were settled early meet no group: they pass without a shuffle.
    single = rows.where("_full is null").withColumns({"_keep": F.lit(None).cast(sizes.schema["_keep"].dataType), "_size": F.lit(None).cast("long")})
    out = join_groups(rows.where("_full is not null"), written(spark, sizes, "dedup-sizes"), ["_len", "_full"], "_size", rows.count()).unionByName(single)
    keep = F.coalesce("_keep", "_id")
    return out.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), F.coalesce("_size", F.lit(1)).alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), *[F.col(f"_c_{k}").alias(k) for k in carry],
        *([F.col("_sha").alias(digest_col)] if digest_col else []),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """docs with one row of each group of equal texts, that of the largest id; every column stays.

    Rows that go are anti-joined by id and a hash of the text (so that a null id drops no other row).
    Of rows that repeat both, one stays.
    """
    spark, key = docs.sparkSession, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    the_id, the_hash = fresh(docs, "_dedup_id"), fresh(docs, "_dedup_hash")
    marked = written(spark, exact_dedup(docs, id_col, text_col, carry={"_dedup_key": key}), "dedup")

    def pairs(df, name):
        out = written(spark, df.select(F.col(id_col).alias(the_id), F.col("_dedup_key").alias(the_hash)).distinct(), name)
        return F.broadcast(out) if out.count() <= max_broadcast_rows else out

    same = F.col(id_col).eqNullSafe(F.col(the_id)) & (key == F.col(the_hash))
    out = docs.join(pairs(marked.where("not kept"), "dedup-gone"), same, "left_anti")
    twice = pairs(marked.where("kept").groupBy(id_col, "_dedup_key").count().where("count > 1"), "dedup-repeats")
    if not twice.limit(1).count():
        return out
    again = out.join(twice, same, "left_semi").withColumn(the_hash, key).dropDuplicates([id_col, the_hash]).drop(the_hash)
    return out.join(twice, same, "left_anti").unionByName(again)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), digest_col="text_sha256")


ORACLE = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
