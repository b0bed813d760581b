"""Operator 6, quality by compression.

Two zstandard dictionaries are trained, one on text labelled good and one on text labelled bad. A text is
compressed with each, in blocks so that the dictionary counts over the whole of a long text too; the
difference of the two sizes over the text's own size is its raw score, and a rising curve fitted on
labelled rows turns it into a probability of label 1: nine parts the isotonic fit (pooled neighbours, joined by
lines), one part the logistic, which keeps texts apart where the isotonic fit is level.

Fitting uses a bounded sample of the labelled rows: at most ``sample_docs`` of each class, those with the
smallest hash of the id, and of these in that order as many as fit into ``sample_bytes`` a class (whole texts of at most
``max_doc_bytes``); every second one trains the dictionaries, the others the curve. So the driver holds at most 2 x
``sample_bytes`` of text. A dictionary sees no more text than the other class has, nor more than ``dict_text_bytes``.
Only the two dictionaries (``dict_bytes`` each) and two numbers travel to the executors. Scoring reads every whole
text once, a few rows at a time (``common.BATCH``), and shuffles nothing.

Defined cases: null text counts as empty; an empty text has raw score 0, which the curve maps like any
other; without labelled rows of both classes every score is 0.5 (with one class: 0.98 for label 1, 0.02 for label 0);
labels that are null, doubled or of unknown ids are skipped, counted twice in the class shares, skipped; of rows that repeat
a labelled id one is learned from; repeated rows and null ids are scored alike and kept; an empty table gives an empty
result; only id and text are looked at, so no other column clashes.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_bucket, map_texts, table, written

BLOCK = 2048
LEVEL = 3


def _raw(data: bytes, good, bad, block: int = BLOCK) -> float:
    """(size with the bad dictionary - size with the good one) / size."""
    if not data:
        return 0.0
    g = b = 0
    for i in range(0, len(data), block):
        part = data[i : i + block]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (len(data) + 64)


def _compressor(dictionary: bytes):
    import zstandard as z

    kw = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    return z.ZstdCompressor(level=LEVEL, dict_data=z.ZstdCompressionDict(dictionary), **kw) if dictionary else z.ZstdCompressor(level=LEVEL, **kw)


def train_dictionary(texts: list[bytes], size: int) -> bytes:
    """A dictionary of at most size bytes; where there is too little text to train one, the text itself."""
    import zstandard as z

    parts = [t[i : i + BLOCK] for t in texts for i in range(0, len(t), BLOCK)]
    try:
        return z.train_dictionary(size, parts, k=512, d=8).as_bytes()
    except z.ZstdError:
        return b"".join(parts)[-size:]


def _logistic(x: list[float], y: list[int], prior: float) -> tuple[float, float]:
    """Slope and offset, by Newton steps with a small ridge; rows are weighted to the class shares."""
    scale = max(1e-9, (sum(v * v for v in x) / len(x)) ** 0.5)
    n1, a, b = sum(y), 0.0, 0.0
    w = [prior / n1 if t else (1 - prior) / (len(y) - n1) for t in y]
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for v, t, k in zip(x, y, w, strict=True):
            v /= scale
            p = 1 / (1 + math.exp(-max(-30, min(30, a * v + b))))
            ga, gb = ga + k * (t - p) * v, gb + k * (t - p)
            h = k * p * (1 - p)
            haa, hab, hbb = haa + h * v * v, hab + h * v, hbb + h
        ga, haa, hbb = ga - 1e-4 * a, haa + 1e-4, hbb + 1e-6
        det = haa * hbb - hab * hab
        da, db = (ga * hbb - gb * hab) / det, (gb * haa - ga * hab) / det
        step = min(1.0, 5 / max(1e-9, abs(da), abs(db)))
        a, b = a + step * da, b + step * db
        if abs(da) + abs(db) < 1e-7:
            break
    return a / scale, b


def _isotonic(x: list[float], y: list[int], prior: float) -> list[tuple[float, float]]:
    """(raw score, probability) of pooled neighbours, both rising; rows are weighted to the class shares."""
    n1 = sum(y)
    w = [prior / (1 - prior) * (len(y) - n1) / n1 if t else 1.0 for t in y]
    blocks: list[list[float]] = []  # weight, weight of label 1, weighted sum of scores
    for v, t, k in sorted(zip(x, y, w, strict=True)):
        blocks.append([k, k * t, k * v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return [(s / n, min(0.995, max(0.005, g / n))) for n, g, s in blocks]


def probability(model: dict, raw: float) -> float:
    """The curve at a raw score."""
    p = 1 / (1 + math.exp(-max(-50, min(50, model["a"] * raw + model["b"]))))
    points = model.get("points")
    if not points:
        return p
    at = bisect_left(points, (raw,))
    if at in (0, len(points)):
        level = points[min(at, len(points) - 1)][1]
    else:
        (x0, p0), (x1, p1) = points[at - 1 : at + 1]
        level = p0 + (p1 - p0) * (raw - x0) / (x1 - x0)
    return 0.9 * level + 0.1 * p


def fit(
    docs: DataFrame, labelled: DataFrame, id_col: str, text_col: str, sample_docs: int = 1500, dict_bytes: int = 65536,
    max_doc_bytes: int = 1 << 20, sample_bytes: int = 16 << 20, dict_text_bytes: int = 4 << 20,
) -> dict:
    """labelled: id, label (0 or 1), held-out rows left out already."""
    labelled = labelled.where("label in (0, 1)")
    share = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(share) < 2:
        return {"good": b"", "bad": b"", "a": 0.0, "b": 0.0 if not share else (4.0 if 1 in share else -4.0)}
    order = [F.xxhash64("id"), F.col("id")]
    chosen = [r for k in (0, 1) for r in labelled.where((F.col("label") == k) & F.col("id").isNotNull()).groupBy("id").agg(F.lit(k).alias("label")).orderBy(*order).limit(sample_docs).collect()]
    spark = docs.sparkSession
    kind = docs.select(F.col(id_col).alias("_id")).schema["_id"].dataType.simpleString()
    known = spark.createDataFrame([(r["id"], r["label"], n) for n, r in enumerate(chosen)], f"_id {kind}, _label int, _rank int")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where(F.octet_length("_t") <= max_doc_bytes)
    # One row of each id, of at most 2 x sample_docs, in the shared folder; the driver first sees lengths only.
    sample = written(spark, texts.join(F.broadcast(known), "_id").groupBy("_rank", "_label").agg(F.min("_t").alias("_t")), "quality-sample")
    room, picked = {0: sample_bytes, 1: sample_bytes}, []
    for r in sample.select("_rank", "_label", F.octet_length("_t").alias("n")).orderBy("_rank").collect():
        if r["n"] <= room[r["_label"]]:
            room[r["_label"]] -= r["n"]
            picked.append(r["_rank"])
    rows = sample.where(F.col("_rank").isin(picked)).orderBy("_rank").collect() if picked else []
    discard(sample)
    half, rest = {0: [], 1: []}, []
    for n, r in enumerate(rows):
        if n % 2:
            rest.append((r["_label"], r["_t"].encode()))
        else:
            half[r["_label"]].append(r["_t"].encode())
    # Both dictionaries come from equally much text, or the larger class would compress all better.
    room = min(sum(map(len, half[0])), sum(map(len, half[1])), dict_text_bytes)
    cut = {}
    for k, texts in half.items():
        cut[k], left = [], room
        for t in texts:
            if left > 0:
                cut[k].append(t)
                left -= len(t)
    good, bad = train_dictionary(cut[1], dict_bytes), train_dictionary(cut[0], dict_bytes)
    g, b = _compressor(good), _compressor(bad)
    x, y = [_raw(t, g, b) for _, t in rest], [k for k, _ in rest]
    prior = share[1] / (share[0] + share[1])
    slope, offset = _logistic(x, y, prior) if 0 < sum(y) < len(y) else (0.0, math.log(prior / (1 - prior)))
    points = _isotonic(x, y, prior) if slope > 0 else []
    return {"good": good, "bad": bad, "a": slope, "b": offset, "points": points}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (probability of label 1), raw."""

    def make():
        g, b = _compressor(model["good"]), _compressor(model["bad"])

        def work(texts):
            raw = [_raw((t or "").encode(), g, b) for t in texts]
            return [probability(model, v) for v in raw], raw

        return work

    return map_texts(docs, id_col, [text_col], "score double, raw double", make)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labels.where(id_bucket(F.col("doc_id"), 5) != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    out = score(docs, fit(docs, known, "doc_id", "text"))
    return out.select(
        "doc_id", (id_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
