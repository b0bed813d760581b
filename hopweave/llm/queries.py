"""The operators' queries and the SQL of those that SQL can express."""

from __future__ import annotations

from . import exact_dedup, gif, jaccard_join, langid, packing, pieces, quality, secrets, url_filter, warc

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_gif": gif.op3_gif,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_quality": quality.op6_quality,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_language_id": langid.op8_language_id,
    "op9_warc": warc.op9_warc,
    "op10_secret_scan": secrets.op10_secret_scan,
}

ORACLES = {"op1_exact_dedup": exact_dedup.ORACLE, "op2_jaccard_join": jaccard_join.ORACLE, "op8_language_id": langid.ORACLE, "op9_warc": warc.ORACLE}
