"""Operator 9, a content-addressed WARC archive.

An archive is a folder with two tables. ``payloads`` holds each distinct payload once under its SHA-256;
``headers`` holds one row per record with the exact bytes of its WARC header block and the digest. A
record is rebuilt by joining the two: header block, payload (for a response), two line ends.

Of records with equal payloads of at least ``min_revisit_bytes`` bytes the one with the smallest id is a
response and the others are revisits that name it; smaller payloads are always responses.

Writing: digests that repeat are counted from narrow rows; payloads are written by the scan that reads them, by the row
that holds the smallest id. Only payloads that repeat under that very id (repeated rows) meet in an aggregate. Where the repeated
digests are more than ``max_broadcast_groups`` they are joined by digest, hot ones apart.
Reading: ``read_records`` measures and verifies each payload once in the scan of the store and joins the narrow result with
the parsed headers, hot digests in parts; a payload that does not match its digest, or a length that is not the
header's, fails the job. ``read_archive`` joins whole payloads, to rebuild records; only there payloads are shuffled, those of one digest
in parts.

Defined cases: a null payload is empty; a null url leaves out WARC-Target-URI; control characters and line
separators (C0, DEL, U+0085, U+2028, U+2029) in a url are percent-encoded, so no url can end a header line; a null id is written
as an empty id, read back as null, and its record is a response; repeated rows give repeated records (those with the smallest id all are responses); a very long
payload is one row and is held by the one task that writes or reads it; an empty input gives an empty archive; only id, url and
payload are looked at, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, join_groups, join_split, new_path, table, written

VERSION, DATE = "WARC/1.1", "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
BREAKS = [*map(chr, range(32)), "\x7f", "\x85", "\u2028", "\u2029"]


def _header(kind, record_id, refers_to, url, digest, n_bytes, date: str):
    """The WARC header block as text; it ends with the empty line."""
    field = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda x: F.concat(F.lit("<urn:record:"), x, F.lit(">"))
    clean = url
    for c in BREAKS:
        clean = F.replace(clean, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode())))
    clean = F.when(F.regexp_like(url, F.lit("[\\x00-\\x1f\\x7f\\x{85}\\x{2028}\\x{2029}]")), clean).otherwise(url)
    return F.concat(
        F.lit(VERSION + CRLF), field("WARC-Type", kind),
        field("WARC-Record-ID", urn(F.coalesce(record_id.cast("string"), F.lit("")))),
        F.lit(f"WARC-Date: {date}{CRLF}"), F.coalesce(field("WARC-Target-URI", clean), F.lit("")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(kind == "revisit", F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}"), field("WARC-Refers-To", urn(refers_to.cast("string"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/octet-stream{CRLF}"),
        field("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(n_bytes.cast("string"))), F.lit(CRLF),
    )


def write_archive(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 100, date: str = DATE, max_broadcast_groups: int = 200_000,
) -> None:
    spark = df.sparkSession
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary"))
    src = df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), payload.alias("_payload"))
    keyed = src.select("_id", "_url", "_payload", F.sha2("_payload", 256).alias("_digest"), F.octet_length("_payload").cast("long").alias("_n"))
    # Of each repeated digest the smallest id (null last), how many rows have that id, and how many there are.
    same = keyed.groupBy("_digest", "_id").agg(F.count("*").alias("_n"))
    firsts = same.groupBy("_digest").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_n")).alias("_f"), F.sum("_n").alias("_copies")).where("_copies > 1")
    firsts = firsts.select("_digest", F.col("_f._id").alias("_first"), F.col("_f._n").alias("_same"), "_copies")
    firsts.write.parquet(f"{path}/repeated")
    firsts = spark.read.schema(firsts.schema).parquet(f"{path}/repeated")
    small = firsts.count() <= max_broadcast_groups
    total = 0 if small else df.count()

    def with_first(rows):
        return rows.join(F.broadcast(firsts), "_digest", "left") if small else join_groups(rows, firsts, ["_digest"], "_copies", total)

    heads = with_first(keyed.select("_id", "_url", "_digest", "_n"))
    again = (F.col("_n") >= min_revisit_bytes) & (F.col("_first") != F.col("_id"))
    kind = F.when(F.coalesce(again, F.lit(False)), F.lit("revisit")).otherwise(F.lit("response"))
    heads.select(
        _header(kind, F.col("_id"), F.col("_first"), F.col("_url"), F.col("_digest"), F.col("_n"), date).cast("binary").alias("header"),
        F.col("_digest").alias("digest"),
    ).write.option("compression", "zstd").parquet(f"{path}/headers")

    once = with_first(keyed.select("_id", "_digest", "_payload")).where("_copies is null or _first <=> _id")
    one = once.where("coalesce(_same, 1) = 1").select("_digest", "_payload")
    several = once.where("_same > 1").groupBy("_digest").agg(F.any_value("_payload").alias("_payload"))
    one.unionByName(several).select(
        F.col("_digest").alias("digest"), F.col("_payload").alias("payload"),
    ).write.option("compression", "zstd").parquet(f"{path}/payloads")


def _tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    heads = spark.read.schema("header binary, digest string").parquet(f"{path}/headers")
    store = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    return heads, store


def _verified(store: DataFrame, value):
    wrong = F.raise_error(F.lit("payload does not match its digest"))
    return F.when(F.sha2("payload", 256) == F.col("digest"), value).otherwise(wrong)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """header, digest, payload of every record; a payload that does not match its digest fails the job."""
    heads, store = _tables(spark, path)
    return join_split(heads, store.select("digest", _verified(store, F.col("payload")).alias("payload")), ["digest"], ["header"])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """record_id (null: none), record_type, refers_to, digest, payload_bytes of every record.

    The header's fields come from the exact header block, digest and size from the payload as it was read."""
    heads, store = _tables(spark, path)
    text = F.col("header").cast("string")
    urn = lambda name: F.regexp_extract(header_field(text, name), "^<urn:record:(.*)>$", 1)
    heads = heads.select(
        urn("WARC-Record-ID").alias("record_id"), header_field(text, "WARC-Type").alias("record_type"), urn("WARC-Refers-To").alias("refers_to"),
        F.unhex(F.regexp_replace(header_field(text, "WARC-Payload-Digest"), "^sha256:", "")).alias("named"),
        header_field(text, "Content-Length").cast("long").alias("block_bytes"), F.unhex("digest").alias("digest"),
    )
    heads = written(spark, heads, "warc-headers")
    facts = store.select(_verified(store, F.unhex(F.sha2("payload", 256))).alias("digest"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    got = join_split(heads, facts, ["digest"], ["record_id"])
    block = F.when(F.col("record_type") == "revisit", F.lit(0)).otherwise(F.col("payload_bytes"))
    fits = (F.col("named") == F.col("digest")) & (F.col("block_bytes") == block)
    wrong = F.raise_error(F.lit("a header does not fit its payload"))
    return got.select(
        F.nullif("record_id", F.lit("")).alias("record_id"), "record_type", "refers_to", F.lower(F.hex("digest")).alias("digest"),
        F.when(fits, F.col("payload_bytes")).otherwise(wrong.cast("long")).alias("payload_bytes"),
    )


def header_field(header, name: str):
    """A field's value: what stands between its name, at the start of a line, and the next CRLF; null without it."""
    got = F.regexp_extract(header, rf"(?s)\r\n{name}: (.*?)\r\n", 1)
    return F.when(got != "", got)


def records(archive: DataFrame) -> DataFrame:
    """Each record as the bytes a .warc file has: header block, block, two line ends."""
    revisit = header_field(F.col("header").cast("string"), "WARC-Type") == "revisit"
    block = F.when(revisit, F.lit("").cast("binary")).otherwise(F.col("payload"))
    return archive.select(F.concat("header", block, F.lit(CRLF * 2).cast("binary")).alias("record"))


def parse_records(df: DataFrame, col: str = "content") -> DataFrame:
    """Rows of whole .warc byte strings (as ``binaryFile`` reads them) to header and block of every record.

    Cut by Content-Length, so blocks may hold anything. Bytes after the last whole record raise.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            heads, blocks = [], []
            for data in batch[col].dropna():
                at = 0
                while at < len(data):
                    end = data.index(b"\r\n\r\n", at) + 4
                    head = data[at:end]
                    size = next(int(x.split(b":")[1]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                    if data[end + size : end + size + 4] != b"\r\n\r\n":
                        raise ValueError(f"the record at byte {at} does not end after its block")
                    heads.append(head)
                    blocks.append(data[end : end + size])
                    at = end + size + 4
            yield pd.DataFrame({"header": heads, "block": blocks})

    return df.select(col).mapInPandas(run, "header binary, block binary")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    got = read_records(spark, path).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"),
    )
    out = written(spark, got, "warc-read")
    delete(spark, path)
    return out


ORACLE = """
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN strlen(h) >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 100 AND page_id <> f THEN f END AS refers_to
FROM (SELECT page_id, h, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS f
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
"""
