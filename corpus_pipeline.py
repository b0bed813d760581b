"""From raw documents to packed sequences: five stages, each applying one operator to all its predecessor kept.

Defined cases, the same in every stage: an empty table gives an empty result; columns besides doc_id, text, lang, source and
n_chars pass through untouched, and helper columns take names that the documents lack; null ids are kept (no stage drops a row for
its id alone); very long texts are read whole. What a stage does with null and empty texts, ties and repeated rows is in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm import exact_dedup, jaccard_join, langid, packing, secrets
from hopweave.llm.common import discard, fresh, id_bucket, table, written

#: A text this far from every profile (of 0 to 1) is in none of the languages.
LEAST_LANGUAGE_SCORE = 0.1
#: Ids that go are broadcast when counted to be at most so many, else joined.
MAX_BROADCAST_ROWS = 1_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (null and empty texts, too), or in no known language, go. Without profiles nothing
    is known and only documents without a letter go. Ties between languages do not matter, repeated rows are judged alike."""
    known = langid.profiles(docs.where(id_bucket(F.col("doc_id"), 4) != 2))
    if not known:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    name = fresh(docs, "_judged")
    judged = docs.withColumn(name, langid.judge_column(known)("text"))
    good = (F.col(name)["lang_pred"] != "und") & (F.col(name)["score"] >= LEAST_LANGUAGE_SCORE)
    return judged.where(good).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest doc_id stays, a null id only where no other is; null and empty texts are
    equal; of rows that repeat id and text one stays."""
    return exact_dedup.drop_exact_copies(docs, max_broadcast_rows=MAX_BROADCAST_ROWS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest doc_id stays. Null ids, texts without words and texts
    that nothing links stay. Texts that share an id are told apart by their SHA-256: none goes for its namesake's sake."""
    repeats = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    text_hash = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", text_hash)) if repeats else F.col("doc_id")
    found = jaccard_join.near_duplicates(docs.select(key.alias("doc_id"), "text"))
    name = fresh(docs, "_gone")
    gone = written(spark, found.where("doc_id <> component_id").select(F.col("doc_id").alias(name)).distinct(), "near-copies")
    discard(found)
    gone = F.broadcast(gone) if gone.count() <= MAX_BROADCAST_ROWS else gone
    return docs.join(gone, key == F.col(name), "left_anti")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Values found to be secrets are replaced in the text, and n_chars follows; no document goes. Null and empty texts
    stay as they are, repeated rows are changed alike."""
    out = secrets.redact(docs, secrets.train(spark, words=secrets.learn_words(docs)))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The plan of sequences: one row per piece of a document. Null and empty texts are an end mark alone, repeated ids are
    packed each, ties in length go by id."""
    return packing.best_fit_packing(docs, packing.word_length(F.col("text")))


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: Language profiles, the forest and packing are beyond SQL; tests/llm compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between the stages are deleted once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
