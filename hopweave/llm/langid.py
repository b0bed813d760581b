"""Operator 8, language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three letters, word edges
included), most frequent first. A text's own list is compared with each profile: every n-gram adds the
distance between its two ranks, one that the profile lacks adds the profile's full length. The language
with the smallest sum wins; score is one minus its sum over the largest possible sum.

Profiles are counted over all training rows: workers count n-grams per language as sorted integers,
partial counts are summed by key, and only the top ``profile_size`` of each language, a bounded table,
reach the driver and the scoring tasks. Scoring reads each whole text once and shuffles nothing.

Defined cases: text that is null or has no letter is ``und`` with score 0; ties between languages go to
the alphabetically first, ties between n-grams to the smaller code; rows without a language are not
learned from; without training rows everything is ``und``; an empty table gives an empty result; repeated rows and
null ids are kept and judged alike; long texts are read whole, a few rows at a time (``common.BATCH``); only id, text
and lang are looked at, and the id never becomes a Python value, so no other column clashes and no id changes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_bucket, map_texts, small_batches, table

PROFILE, TEXT_TOP, FLUSH_GRAMS = 400, 300, 1_000_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code of each character: its own number for a letter, 0 for anything else."""
    letters = (i if not 0xD800 <= i < 0xE000 and chr(i).isalpha() else 0 for i in range(0x110000))
    return np.fromiter(letters, dtype=np.uint64, count=0x110000)  # no list of a million numbers in every worker


def codes(text: str) -> np.ndarray:
    """Letters in lower case, each run of anything else one 0, a 0 at both ends; empty without a letter."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    c = np.concatenate([[0], c, [0]]).astype(np.uint64)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = c[keep]
    return c if len(c) > 2 else c[:0]


def grams(c: np.ndarray, seen: int = 0) -> np.ndarray:
    """One number for each n-gram that ends after the first ``seen`` codes: letters of 21 bits each; one, two and three
    letters never collide, for the first letter of a longer one is shifted and a lone 0 is left out."""
    s = np.uint64(21)
    one = c[seen:][c[seen:] != 0]
    # A gram that starts with 0 (a word's start) is marked by a number that is no character.
    start = np.uint64(0x1FFFFF)
    first = np.where(c == 0, start, c)
    two = (first[:-1] << s) | c[1:]
    three = (first[:-2] << (s + s)) | (c[1:-1] << s) | c[2:]
    skip2, skip3 = max(0, seen - 1), max(0, seen - 2)
    return np.concatenate([one, two[skip2:], three[skip3:][c[1:-1][skip3:] != 0]])


SLICE = 1 << 20


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of a text, sorted, and how often each occurs; a long text is counted slice by slice."""
    if len(text) <= SLICE:
        return np.unique(grams(codes(text)), return_counts=True)
    text, letters = text.lower(), _letters()
    keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    last = np.zeros(1, np.uint64)  # the two codes before a slice: the n-grams that end in it begin there
    any_letter = False
    for at in range(0, len(text) + 1, SLICE):  # the last slice may be the closing 0 alone
        c = letters[np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        if at + SLICE > len(text):
            c = np.concatenate([c, np.zeros(1, np.uint64)])
        keep = (c != 0) | (np.concatenate([last[-1:], c[:-1]]) != 0)
        c = c[keep]
        any_letter = any_letter or bool((c != 0).any())
        if not len(c):
            continue
        both = np.concatenate([last, c])
        new, n = np.unique(grams(both, len(last)), return_counts=True)
        merged, back = np.unique(np.concatenate([keys, new]), return_inverse=True)
        keys, counts = merged, np.bincount(back, np.concatenate([counts, n]), len(merged)).astype(np.int64)
        last = both[-2:]
    return (keys, counts) if any_letter else (keys[:0], counts[:0])


def top(values: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent of distinct, sorted values, most frequent first, the smaller on ties."""
    if len(values) > k:
        # Everything above the k-th count, and of those equal to it the smallest keys (values is sorted).
        edge = np.partition(counts, len(counts) - k)[len(counts) - k]
        above = np.flatnonzero(counts > edge)
        at = np.concatenate([above, np.flatnonzero(counts == edge)[: k - len(above)]])
        values, counts = values[at], counts[at]
    return values[np.lexsort((values, -counts))]


def _count(batches):
    """lang, gram, n: sums over as many texts as FLUSH_CHARS allows, whatever the batches."""
    import pandas as pd

    held: dict[str, list] = {}
    size = 0

    def flush():
        for lang, parts in held.items():
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            n = np.bincount(back, np.concatenate([n for _, n in parts]), len(keys))
            yield pd.DataFrame({"lang": lang, "gram": keys.astype(np.int64), "n": n.astype(np.int64)})
        held.clear()

    for batch in batches:
        for lang, t in zip(batch["lang"], batch["_t"], strict=True):
            keys, n = gram_counts(t)
            held.setdefault(lang, []).append((keys, n))
            size += len(keys)
            if size >= FLUSH_GRAMS:
                yield from flush()
                size = 0
    yield from flush()


def profiles(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = PROFILE) -> dict[str, np.ndarray]:
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("_t"))
    summed = rows.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    got = summed.withColumn("rank", rank).where(F.col("rank") <= size).orderBy("lang", "rank").collect()
    out: dict[str, list[int]] = {}
    for r in got:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, dtype=np.uint64) for k, v in sorted(out.items())}


class Judge:
    def __init__(self, known: dict[str, np.ndarray], size: int):
        self.langs, self.size = sorted(known), size
        self.order = [np.argsort(known[k]) for k in self.langs]
        self.keys = [known[k][o] for k, o in zip(self.langs, self.order, strict=True)]

    def __call__(self, text: str | None) -> tuple[str, float]:
        values, counts = gram_counts(text or "")
        if not len(values) or not self.langs:
            return "und", 0.0
        mine = top(values, counts, TEXT_TOP)
        rank = np.arange(len(mine))
        best, least = 0, None
        for i, (keys, order) in enumerate(zip(self.keys, self.order, strict=True)):
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            far = np.where(keys[at] == mine, np.minimum(np.abs(order[at] - rank), self.size), self.size).sum()
            if least is None or far < least:
                best, least = i, far
        return self.langs[best], float(1 - least / (self.size * len(mine)))


def identify(docs: DataFrame, known: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text", size: int = PROFILE) -> DataFrame:
    """id, lang_pred, score."""

    def make():
        judge = Judge(known, size)
        return lambda texts: list(zip(*map(judge, texts), strict=True))

    return map_texts(docs, id_col, [text_col], "lang_pred string, score double", make)


def judge_column(known: dict[str, np.ndarray], size: int = PROFILE):
    """text -> struct(lang_pred, score), for filters that keep their rows as they are."""

    small_batches(SparkSession.active())

    @F.pandas_udf("lang_pred string, score double")
    def run(text):
        import pandas as pd

        judge = Judge(known, size)
        return pd.DataFrame([judge(t) for t in text], columns=["lang_pred", "score"])

    return run


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    known = profiles(docs.where(~held_out))
    return identify(docs, known).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


#: Runs of letters as code points, 0 between them; CRC-32 bit by bit; ranks and distances as joins.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, lang, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 4 = 2 AS held_out
  FROM documents),
s AS (SELECT doc_id, lang, held_out, '_' || trim(regexp_replace(lower(text), '[^\p{L}]+', '_', 'g'), '_') || '_' AS s FROM d WHERE regexp_matches(text, '\p{L}')),
c AS (SELECT doc_id, lang, held_out, i, CASE WHEN x = '_' THEN 0 ELSE ord(x)::BIGINT END AS a
  FROM (SELECT doc_id, lang, held_out, unnest(string_split(s, '')) AS x, generate_subscripts(string_split(s, ''), 1) AS i FROM s)),
w AS (SELECT *, lead(a, 1) OVER o AS b, lead(a, 2) OVER o AS c, CASE WHEN a = 0 THEN 2097151 ELSE a END AS f FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, lang, held_out, a AS gram FROM w WHERE a > 0 UNION ALL SELECT doc_id, lang, held_out, f * 2097152 + b FROM w WHERE b IS NOT NULL
  UNION ALL SELECT doc_id, lang, held_out, f * 4398046511104 + b * 2097152 + c FROM w WHERE b > 0 AND c IS NOT NULL),
n AS MATERIALIZED (SELECT doc_id, lang, held_out, gram, count(*) AS n FROM g GROUP BY ALL),
p AS MATERIALIZED (SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS r
  FROM (SELECT lang, gram, sum(n) AS n FROM n WHERE lang IS NOT NULL AND NOT held_out GROUP BY ALL) QUALIFY r <= 400),
t AS MATERIALIZED (SELECT doc_id, gram, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, gram) AS r FROM n QUALIFY r <= 300),
f AS (SELECT t.doc_id, l.lang, sum(coalesce(least(abs(p.r - t.r), 400), 400)) AS far, count(*) AS m
  FROM t CROSS JOIN (SELECT DISTINCT lang FROM p) l LEFT JOIN p ON p.lang = l.lang AND p.gram = t.gram GROUP BY ALL),
best AS (SELECT doc_id, lang, 1 - far / (400 * m) AS score FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY far, lang) = 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(best.score, 0)::DOUBLE AS score FROM d LEFT JOIN best USING (doc_id)
"""
