import random

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import docs, families, plain_components, plain_sets

KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def test_stages_against_a_plain_version(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(i, t) for i, t in families(3, 80)]
    rows += [(500 + i, t) for i, t in enumerate(rnd.sample([t for _, t in rows], 20))] + [(800, "1234 !!"), (801, None), (802, ""), (803, f'see token = "{KEY}" here and there')]
    docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept = {i: t for i, t in rows if any(c.isalpha() for c in t or "")}
    last = {t: i for i, t in kept.items()}
    for i, t in kept.items():
        last[t] = max(last[t], i)
    kept = {i: t for i, t in kept.items() if last[t] == i}
    heads = plain_components(plain_sets(kept.items()))
    kept = {i: t for i, t in kept.items() if heads[i] == i}
    assert {r["doc_id"] for r in out} == set(kept)
    assert {r["doc_id"]: r["piece_length"] for r in out} == {i: len(t.split()) + 1 for i, t in kept.items()}


def test_stages_keep_columns_and_redact(spark, tmp_path):
    rows = [(1, f'see token = "{KEY}" here'), (2, "no secret in this text at all"), (None, "a text without an id is kept"), (3, None)]
    state = docs(spark, rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == docs(spark, []).columns
    got = {r["doc_id"]: r for r in state.collect()}
    assert set(got) == {1, 2, None} and KEY not in got[1]["text"] and got[1]["n_chars"] == len(got[1]["text"])
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
    assert empty.count() == 0


def test_stages_with_clashing_columns(spark, tmp_path):
    names = ["_judged", "_gone", "_key", "_values", "_dedup_id", "_dedup_hash", "_dedup_key", "text_key", "value", "start", "_VALUES2", "_row", "features", "_t"]
    rows = [(1, f'see token = "{KEY}" here'), (2, "no secret in this text at all"), (2, "no secret in this text at all"), (3, "no secret in this text at all"), (4, None)]
    state = docs(spark, rows)
    for n in names:
        state = state.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    columns = state.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, str(tmp_path))
        assert state.columns == columns
    got = state.collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3] and all(r[n] == f"{n}{r['doc_id']}" for r in got for n in names)
    assert all(KEY not in r["text"] for r in got)


def test_namesakes_of_near_copies_stay(spark, tmp_path):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(1, base), (2, base + " more"), (2, "another text that only shares its id with a near copy"), (None, base + " and"), (3, base.upper() + " x"), (4, None), (4, "")]
    state = corpus_pipeline.near_copies(spark, docs(spark, rows), str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in state.collect() if r["doc_id"] and r["text"]) == [(1, base), (2, rows[2][1])]
    assert state.count() == 5 and state.columns == docs(spark, []).columns
    big = 2**53 + 1
    state = corpus_pipeline.near_copies(spark, docs(spark, [(big, base), (big + 2, base + " more"), (None, "x")]), str(tmp_path))
    assert sorted(str(r["doc_id"]) for r in state.collect()) == [str(big), "None"]
