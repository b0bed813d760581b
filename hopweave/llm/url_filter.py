"""Operator 5, url filters: host and path rules, else a character language-model ratio. SQL only.

Two variable-order Markov models over url characters, one of accepted and one of rejected urls, are
smoothed by interpolation: the probability of a character after a context mixes its count with the
probability after the next shorter context, weighted by how many different characters the context was
seen with (Witten-Bell), down to a uniform distribution. A url's score is the mean over its characters
of the difference of the two log probabilities.
Calibration: a logistic curve fitted to the scores of labelled urls on hosts that the models were not trained on (hosts
are dealt to folds by hash); ``allow`` at a probability of 0.5 or more. ``reliability`` measures it on hosts of a further
fold that neither the models nor the curve saw.

Counts cover every labelled url; the n-gram table grows with the input and is joined, never broadcast or collected, hot
n-grams (those of ``http``) apart. To the driver come only counts of scores in steps of 0.001 between -50 and 50.

Defined cases: a null url or one without ``://`` has an empty host and path and fits no rule; the
models then score its whole string (null: the empty string), a very long url by all its characters. Without urls of one of
the two classes in the curve's fold, or where accepted urls do not score higher, the method allows. Repeated rows and null
ids are kept and judged alike, one by one; an empty table gives an empty result; only id and url are looked at, so no other
column clashes.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, join_groups, table, written

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Rule:
    text: str  # host, then the start of the path, such as "example.org/es/"
    verdict: str  # "allow" or "block"


RULES = (
    Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("example.org/en/1", "block"),
    Rule("com/fr/", "allow"), Rule("com/de/", "block"),
)


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumn("host", ascii_lower(F.regexp_extract(url, URL, 1))).withColumn("path", F.regexp_extract(url, URL, 2))


def rule_column(rules=RULES):
    """The longest rule that fits, or null: one CASE over the rules, longest first."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        at = r.text.index("/")
        host, path = r.text[:at], r.text[at:]
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        out = F.when(fits, F.lit(r.text)) if out is None else out.when(fits, F.lit(r.text))
    return out if out is not None else F.lit(None).cast("string")


def verdict_of(rules=RULES):
    out = F.lit(None).cast("string")
    for r in rules:
        out = F.when(F.col("rule") == r.text, F.lit(r.verdict)).otherwise(out)
    return out


def grams(df: DataFrame, url_col: str, order: int, keep: list[str]) -> DataFrame:
    """A row for each character of a url and its end: the character with the ``order`` ones before it."""
    padded = F.concat(F.lit("\x02" * order), F.coalesce(F.col(url_col), F.lit("")), F.lit("\x03"))
    at = F.explode(F.sequence(F.lit(1), F.length("_padded") - F.lit(order)))
    rows = df.select(*keep, padded.alias("_padded")).select(*keep, "_padded", at.alias("_at"))
    return rows.select(*keep, F.substr("_padded", F.col("_at"), F.lit(order + 1)).alias("gram"))


def model(counted: DataFrame, order: int, alphabet: int) -> DataFrame:
    """gram -> llr, n, from gram, good, bad, n (counts): the smoothed log ratio of its last character."""
    out = counted.select("gram", "n", F.lit(1.0 / alphabet).alias("p_good"), F.lit(1.0 / alphabet).alias("p_bad"))
    for k in range(order + 1):
        cut = F.substr(F.col("gram"), F.lit(order + 1 - k), F.lit(k + 1))
        short = counted.groupBy(cut.alias("_g")).agg(F.sum("good").alias("_good"), F.sum("bad").alias("_bad"))
        ctx = F.substring("_g", 1, k)
        seen = lambda c: F.count_if(F.col(c) > 0)
        totals = short.groupBy(ctx.alias("_x")).agg(
            F.sum("_good").alias("_ng"), F.sum("_bad").alias("_nb"), seen("_good").alias("_tg"), seen("_bad").alias("_tb")
        )
        stats = short.join(totals, ctx == F.col("_x")).drop("_x")
        out = out.withColumn("_k", cut).join(stats, F.col("_k") == F.col("_g"), "left")

        def mix(n, total, kinds, p):
            return F.when(F.col(total) > 0, (F.col(n) + F.col(kinds) * F.col(p)) / (F.col(total) + F.col(kinds))).otherwise(F.col(p))

        out = out.select("gram", "n", mix("_good", "_ng", "_tg", "p_good").alias("p_good"), mix("_bad", "_nb", "_tb", "p_bad").alias("p_bad"))
    return out.select("gram", "n", (F.log("p_good") - F.log("p_bad")).alias("llr"))


def _curve(bins: list[tuple[float, int, int]]) -> tuple[float, float] | None:
    """Slope and offset of the logistic curve through (score, accepted, rejected); None where there is none that rises.

    The targets are drawn in from 0 and 1 as Platt does, so that separable scores give a finite slope."""
    n1, n0 = sum(g for _, g, _ in bins), sum(b for _, _, b in bins)
    if not n1 or not n0:
        return None
    hi, lo = (n1 + 1) / (n1 + 2), 1 / (n0 + 2)
    rows = [(x, g + b, (g * hi + b * lo) / (g + b)) for x, g, b in bins if g + b]

    def loss(a, c):
        z = [(a * x + c, n, t) for x, n, t in rows]
        return sum(n * (max(v, 0) - t * v + math.log1p(math.exp(-abs(v)))) for v, n, t in z)

    a, c = 0.0, math.log(n1 / n0)
    now = loss(a, c)
    for _ in range(100):
        ga = gc = haa = hac = hcc = 0.0
        for x, n, t in rows:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * x + c))))
            h = n * p * (1 - p)
            ga, gc, haa, hac, hcc = ga + n * (t - p) * x, gc + n * (t - p), haa + h * x * x, hac + h * x, hcc + h
        haa, hcc = haa + 1e-9, hcc + 1e-9
        det = haa * hcc - hac * hac
        if det <= 0:
            break
        da, dc, step = (ga * hcc - gc * hac) / det, (gc * haa - ga * hac) / det, 1.0
        while step > 1e-6 and (then := loss(a + step * da, c + step * dc)) > now:
            step /= 2
        if step <= 1e-6 or now - then < 1e-9 * (1 + now):
            break
        a, c, now = a + step * da, c + step * dc, then
    return (a, c) if a > 0 else None


def _scores(df: DataFrame, url_col: str, rules, order: int, alphabet: int, folds: int, held: bool) -> DataFrame:
    """Written: _u (each distinct url), raw, and how often it is accepted and rejected by rule in the curve's fold (good_out,
    bad_out) and, with held, in the fold that is left for measuring (good_held, bad_held)."""
    spark = df.sparkSession
    judged = with_parts(df.select(F.coalesce(F.col(url_col), F.lit("")).alias("_u")), "_u").withColumn("rule", rule_column(rules))
    fold = F.pmod(F.xxhash64("host"), F.lit(folds))
    use = F.when(fold == 0, F.lit("out")).when((fold == 1) & F.lit(held), F.lit("held")).otherwise(F.lit("fit"))
    judged = judged.withColumn("_by_rule", verdict_of(rules)).withColumn("_use", use)
    # Equal urls have equal scores: they are scored once and joined back.
    tally = [
        F.count_if((F.col("_by_rule") == verdict) & (F.col("_use") == use)).alias(f"{name}_{use}")
        for use in ("fit", "out", "held") for name, verdict in (("good", "allow"), ("bad", "block"))
    ]
    urls = written(spark, judged.groupBy("_u").agg(*tally), "urls")
    rows = grams(urls, "_u", order, ["good_fit", "bad_fit"])
    counted = written(spark, rows.groupBy("gram").agg(F.sum("good_fit").alias("good"), F.sum("bad_fit").alias("bad"), F.count("*").alias("n")), "url-grams")
    llr = written(spark, model(counted, order, alphabet), "url-model")
    total = counted.agg(F.sum("n")).first()[0] or 0
    # Urls are told apart by two independent hashes; the joined rows stay narrow.
    key = F.struct(F.xxhash64("_u").alias("a"), F.hash("_u").alias("b"))
    hits = grams(urls.withColumn("_key", key), "_u", order, ["_key"])
    scored = join_groups(hits, llr, ["gram"], "n", total).groupBy("_key").agg((F.sum(F.round("llr", 9).cast("decimal(20,9)")) / F.count("*")).cast("double").alias("raw"))
    out = written(spark, urls.withColumn("_key", key).join(scored, "_key").drop("_key"), "url-scores")
    discard(urls, counted, llr)
    return out


def _bins(scores: DataFrame, use: str) -> list[tuple[float, int, int]]:
    """(score in steps of 0.001, accepted, rejected): at most 100,001 rows."""
    at = F.round(F.greatest(F.lit(-50.0), F.least(F.lit(50.0), F.col("raw"))), 3).alias("at")
    got = scores.where(F.col(f"good_{use}") + F.col(f"bad_{use}") > 0).groupBy(at).agg(F.sum(f"good_{use}").alias("g"), F.sum(f"bad_{use}").alias("b"))
    return [(r["at"], r["g"], r["b"]) for r in got.orderBy("at").collect()]


def _probability(curve: tuple[float, float] | None):
    if curve is None:
        return F.lit(1.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-curve[0]) * F.col("raw") - F.lit(curve[1])))


def url_filter(
    df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = 4,
    alphabet: int = 256, calibration_folds: int = 5,
) -> DataFrame:
    """One row per row: id, host, path, rule, verdict, score (probability of accept by the method)."""
    scores = _scores(df, url_col, rules, order, alphabet, calibration_folds, False)
    prob = _probability(_curve(_bins(scores, "out")))
    judged = with_parts(df.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")), "_url").withColumn("rule", rule_column(rules))
    judged = judged.withColumns({"_by_rule": verdict_of(rules), "_u": F.coalesce("_url", F.lit(""))})
    out = judged.join(scores.select("_u", "raw"), "_u", "left")
    by_method = F.when(prob >= 0.5, F.lit("allow")).otherwise(F.lit("block"))
    return out.select(
        F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_by_rule", by_method).alias("verdict"),
        F.round(prob, 6).alias("score"),
    )


def reliability(df: DataFrame, url_col: str = "url", rules=RULES, order: int = 4, alphabet: int = 256, folds: int = 5) -> tuple[float, list[tuple]]:
    """Brier score, and (urls, mean probability, share accepted by rule) by tenths of the probability, on the labelled urls of
    a fold of hosts that neither the models nor the curve saw."""
    scores = _scores(df, url_col, rules, order, alphabet, folds, True)
    curve = _curve(_bins(scores, "out"))
    tenths, n, loss = [[0, 0.0, 0] for _ in range(10)], 0, 0.0
    for x, g, b in _bins(scores, "held"):
        p = 1.0 if curve is None else 1 / (1 + math.exp(-max(-40.0, min(40.0, curve[0] * x + curve[1]))))
        row = tenths[min(9, int(p * 10))]
        row[:] = row[0] + g + b, row[1] + p * (g + b), row[2] + g
        n, loss = n + g + b, loss + g * (1 - p) ** 2 + b * p * p
    discard(scores)
    return (loss / n if n else float("nan")), [(k, s / k if k else None, g / k if k else None) for k, s, g in tenths]


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))
