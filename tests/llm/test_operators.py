import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from hopweave.llm import components, exact_dedup, gif, jaccard_join, langid, packing, pieces, quality, secrets, shingles, url_filter, warc
from hopweave.llm.common import join_groups

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, n string, score string, token string"
WORDS = [f"w{i}" for i in range(400)]


def docs(spark, rows):
    """Rows of (doc_id, text), with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "x", "x", "x") for i, t in rows], DOCS)


def awkward():
    return [(1, "same text"), (2, "same text"), (2, "same text"), (None, "same text"), (3, None), (4, ""), (None, None), (5, "x" * 200_000), (6, "Same text"), (7, " \t\n")]


# 1 Exact dedup


def test_exact_dedup_awkward(spark):
    got = exact_dedup.exact_dedup(docs(spark, awkward())).collect()
    assert len(got) == len(awkward())
    seen = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in got)
    assert seen[(2, 2, 4, True)] == 2 and seen[(1, 2, 4, False)] == 1 and seen[(None, 2, 4, False)] == 1
    assert seen[(4, 4, 3, True)] == 1 and seen[(3, 4, 3, False)] == 1 and seen[(5, 5, 1, True)] == 1 and seen[(6, 6, 1, True)] == 1
    kept = exact_dedup.drop_exact_copies(docs(spark, awkward()))
    assert kept.columns == docs(spark, []).columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 5, 6, 7]


@pytest.mark.parametrize("limit", [0, 500_000])
def test_exact_dedup_against_groups(spark, limit):
    rnd = random.Random(1)
    rows = [(i, rnd.choice(["a" * 70 + x + y for x in "abc" for y in "de"] + [f"only {i}"])) for i in range(300)]
    want = defaultdict(list)
    for i, t in rows:
        want[t].append(i)
    got = {r["doc_id"]: r for r in exact_dedup.exact_dedup(docs(spark, rows), max_broadcast_groups=limit).collect()}
    assert all(got[i]["keep_id"] == max(want[t]) and got[i]["group_size"] == len(want[t]) for i, t in rows)


def test_hot_and_other_groups_join_alike(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") < 500, 0).when(F.col("id") < 700, F.floor(F.col("id") / 2)).alias("k"))
    groups = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("size"), F.max("id").alias("last"))
    plain = {(r["id"], r["size"], r["last"]) for r in rows.join(groups, "k", "left").collect()}
    assert {r["size"] for r in groups.collect()} == {500, 2}  # 5 rows of 5,000 make a key hot
    for total in (5000, 0, 10**9):  # some hot, all hot, none hot
        got = join_groups(rows, groups, ["k"], "size", total).collect()
        assert len(got) == 5000 and {(r["id"], r["size"], r["last"]) for r in got} == plain


# 2 Jaccard join


def plain_sets(rows):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def plain_components(sets):
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def families(seed, n=160):
    rnd = random.Random(seed)
    passage = [rnd.choice(WORDS) for _ in range(60)]
    bases = [[rnd.choice(WORDS) for _ in range(rnd.choice([3, 8, 30, 90, 200]))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(rnd.choice(bases)) if rnd.random() < 0.8 else [rnd.choice(WORDS) for _ in range(rnd.randrange(0, 80))]
        for _ in range(rnd.choice([0, 0, 1, 2, 3, 5, 9])):
            if w:
                w[rnd.randrange(len(w))] = rnd.choice(WORDS[:20])
        if rnd.random() < 0.3:
            w += passage
        if rnd.random() < 0.2:
            w = w[: -rnd.randrange(1, 12)] or w
        rows.append((i, rnd.choice([" ", "\n", "  "]).join(w).replace("w1", rnd.choice(["W1", "w1"]))))
    return rows


@pytest.mark.parametrize(("seed", "union", "limit"), [(1, 200_000, 1_000_000), (2, 1, 0)])
def test_jaccard_join_against_all_pairs(spark, monkeypatch, seed, union, limit):
    monkeypatch.setattr(jaccard_join, "UNION_TOKENS", union)
    rows = [*families(seed), (900, None), (901, ""), (902, " \n "), (903, "one two"), (904, "One TWO"), (905, "é É a b")]
    sets = plain_sets(rows)
    want = plain_components(sets)
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(docs(spark, rows), max_broadcast_rows=limit).collect()}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == want and len(set(want.values())) < len(want) - 20


@pytest.mark.parametrize(("seed", "union", "limit"), [(1, 200_000, 1_000_000), (4, 1, 0)])
def test_jaccard_join_lists_every_link(spark, monkeypatch, seed, union, limit):
    monkeypatch.setattr(jaccard_join, "UNION_TOKENS", union)
    rnd = random.Random(seed)
    base = [f"v{i}" for i in range(200)]
    family = [(1000 + i, " ".join(w if p != at else "new" for p, w in enumerate(base))) for i, at in enumerate(rnd.sample(range(200), 12))]
    rows = [*families(seed), *family, (2000, family[0][1])]
    sets = {i: s for i, s in plain_sets(rows).items() if s}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    got = jaccard_join.near_links(docs(spark, rows), max_broadcast_rows=limit).collect()
    assert sorted((r["a"], r["b"]) for r in got) == sorted({(a, b) for a, b in want if rep[a] == a and rep[b] == b and sets[a] != sets[b]})
    if limit:
        count = Counter(i for pair in want for i in pair)
        out = jaccard_join.near_duplicates(docs(spark, rows), count_links=True).collect()
        assert {r["doc_id"]: r["n_links"] for r in out} == {i: count[i] for i, _ in rows}


def test_jaccard_join_awkward(spark):
    got = jaccard_join.near_duplicates(docs(spark, [*awkward(), (2, "another text of the same id here")])).collect()
    assert len(got) == len(awkward()) + 1
    assert all(r["component_id"] is None for r in got if r["doc_id"] is None)
    assert {r["component_id"] for r in got if r["doc_id"] in (1, 2, 6)} == {1}
    assert jaccard_join.near_duplicates(docs(spark, [])).count() == 0


def test_bounds_hold_for_every_size():
    for n in range(1, 400):
        p, s = jaccard_join.prefix_size(n), jaccard_join.probe_size(n)
        assert 1 <= s <= p <= n
        for m in range(jaccard_join.needed(n), n + 1):
            least = min(jaccard_join.slack(n), jaccard_join.slack(m))
            common = min(jaccard_join.common_probes(n), jaccard_join.common_probes(m))
            assert common <= least and (s == p or s >= p - least + common)
            assert max(jaccard_join.least_shared(n), jaccard_join.least_shared(m)) <= max(1, least)


def test_shingles_do_not_run_over_texts():
    one, two = list(shingles.shingle_sets(["a b c d e f", "g h"]))
    assert len(one) == 2 and len(two) == 1 and one.tolist() == list(shingles.shingle_sets(["A\tB c\nd e f"]))[0].tolist()


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 9), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 4)]
    got = components.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {1: 1, 2: 1, 3: 1, 7: 1, 8: 1, 9: 1, 10: 1, 20: 20, 21: 20}
    assert components.components(spark.createDataFrame([(5, 5), (None, 4)], "a long, b long")).count() == 0


def test_components_of_long_shuffled_chain(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(10_000), 2000)
    star = [(20_000 - 1, 20_000 + i) for i in range(50)] + [(20_000 + i, 30_000 + i) for i in range(50)]
    got = components.components(spark.createDataFrame(list(zip(ids, ids[1:])) + star, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == dict.fromkeys(ids, min(ids)) | {i: 19_999 for pair in star for i in pair}


# 3 GIF


def test_gif_round_trip_and_rules(spark):
    rnd = random.Random(5)
    for n in (192, 192 * 257, 192 * 600):
        data = bytes(rnd.choice(b"abcde \xff\x00") for _ in range(n))
        shown = b"".join(c[y : y + h, x : x + w, 0].tobytes() for c, x, y, w, h, _, _ in gif.frames_of(gif.encode_gif(data)))
        assert shown == data
    for size in (2, 3, 7):  # narrower codes, written plainly: each sample after a clear code
        clear, bits = 1 << size, []
        for v in (1, 0, 3):
            for code in (clear, v):
                bits += [code >> k & 1 for k in range(size + 1)]
        bits += [clear + 1 >> k & 1 for k in range(size + 1)]
        raw = bytes(sum(b << k for k, b in enumerate(bits[i : i + 8])) for i in range(0, len(bits), 8))
        assert gif.lzw_decode(raw, size, 3) == bytes([1, 0, 3])
    assert gif.lzw_decode(gif.lzw_encode(b"abcabcabc")[:3], 8, 9) in (b"a", b"ab")  # ends early


def test_gif_disposal_transparency_interlace():
    def image(x, y, w, h, samples, flags=0, control=b""):
        return control + b"\x2c" + b"".join(v.to_bytes(2, "little") for v in (x, y, w, h)) + bytes([flags]) + b"\x08" + gif._sub_blocks(gif.lzw_encode(bytes(samples)))

    gce = lambda disposal, delay=5, clear=None: b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0]) + b"\0"
    head = b"GIF89a\x02\0\x08\0\xf7\0\0" + gif.GREY
    base = list(range(1, 17))
    parts = [image(0, 0, 2, 8, base, 0x40, gce(1)), image(0, 0, 1, 1, [99], 0, gce(3)), image(1, 0, 1, 1, [7], 0, gce(2, 9, 7)), image(0, 1, 1, 1, [50])]
    frames = list(gif.frames_of(head + b"".join(parts) + b"\x3b"))
    rows = {k: base[2 * i : 2 * i + 2] for i, k in enumerate([0, 4, 2, 6, 1, 3, 5, 7])}
    assert frames[0][0][..., 0].tolist() == [rows[k] for k in range(8)] and [f[5] for f in frames] == [50, 50, 90, 0]
    assert frames[1][0][0, 0, 0] == 99 and frames[2][0][0, 0, 0] == rows[0][0] and frames[2][0][0, 1, 0] == rows[0][1]
    assert frames[3][0][0, 1].tolist() == [0, 0, 0, 0] and frames[3][0][1, 0, 0] == 50


def test_gif_columns(spark):
    rows = spark.createDataFrame([(1, bytearray(gif.encode_gif(b"x" * 192))), (2, None), (3, bytearray(b"")), (4, bytearray(b"GIF89a broken and short"))], "i long, media binary")
    got = {r["i"]: r for r in gif.decode_column(rows, "media").collect()}
    assert got[1]["frames"][0]["delay_ms"] == 100 and sum(got[1]["frames"][0]["histogram"]) == 192
    assert got[2]["frames"] is None and got[3]["frames"] == [] and got[3]["frames_error"] and got[4]["frames_error"]
    out = {r["doc_id"]: r for r in gif.describe(gif.encode_bytes(docs(spark, [(1, "é"), (2, None), (3, "y" * 50_000)]), "doc_id", "text"), "doc_id").collect()}
    for i, t in ((1, "é"), (2, ""), (3, "y" * 50_000)):
        pad = t.encode() + b" " * (max(1, -(-len(t.encode()) // 192)) * 192 - len(t.encode()))
        assert out[i]["payload_sha256"] == hashlib.sha256(pad).hexdigest() and out[i]["tail_crc32"] == zlib.crc32(pad[-16:]) and out[i]["n_bytes"] == len(t.encode())


# 4 Packing


def test_packing(spark):
    rnd = random.Random(2)
    rows = [(i, "w " * rnd.choice([0, 1, 5, 30, 31, 99, 150])) for i in range(300)] + [(None, "a"), (None, "a"), (7, None)]
    got = packing.best_fit_packing(docs(spark, rows), packing.word_length(F.col("text")), capacities=(16, 32, 64), shard_pieces=100).collect()
    want = Counter((i, len((t or "").split()) + 1) for i, t in rows)
    total = Counter()
    for r in got:
        total[r["doc_id"]] += r["piece_length"]
        assert 0 < r["piece_length"] <= 64
    assert total == Counter({i: sum(n * c for (k, n), c in want.items() if k == i) for i, _ in rows})
    bins = defaultdict(list)
    for r in got:
        bins[r["shard"], r["bin"]].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["bin_start"])
        at = 0
        for r in b:
            assert r["bin_start"] == at
            at += r["piece_length"]
        assert {r["capacity"] for r in b} == {min(c for c in (16, 32, 64) if c >= at)}
    assert len({r["shard"] for r in got}) > 1
    assert packing.best_fit_packing(docs(spark, []), packing.word_length(F.col("text"))).count() == 0


def test_pack_is_near_the_best():
    assert len({b for b, _, _ in packing.pack([6, 5, 4, 3, 2], (10,))}) == 2
    assert packing.pack([], (10,)) == [] and packing.pack([3], (4, 10))[0][2] == 4


# 5 Urls


def test_url_parts_rules_and_method(spark):
    urls = ["http://A.Example.ORG/es/x?q", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/", "https://com/de/#", "ftp://badorg/", "no scheme", None, "", "http://org", "http://q.net/a?b://c"]
    urls += [f"http://h{i}.org/good/page{i}" for i in range(60)] + [f"http://h{i}.com/de/casino{i}" for i in range(60)] + ["http://z.net/casino77", "http://z.net/good/page9"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.url_filter(df.withColumn("host", F.lit(1))).collect()}
    assert [got[i]["rule"] for i in range(11)] == ["example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None]
    assert [(got[i]["host"], got[i]["path"]) for i in (0, 6, 7, 9, 10)] == [("a.example.org", "/es/x"), ("", ""), ("", ""), ("org", ""), ("q.net", "/a")]
    assert got[0]["verdict"] == "block" and got[2]["verdict"] == "allow"
    assert got[len(urls) - 2]["verdict"] == "block" and got[len(urls) - 1]["verdict"] == "allow"
    assert [r["verdict"] for r in url_filter.url_filter(df.where("page_id in (6, 7)")).collect()] == ["allow"] * 2
    assert url_filter.url_filter(df.where("false")).count() == 0


# 6 Quality


def test_quality(spark):
    rnd = random.Random(4)
    good = [" ".join(rnd.choice(["the", "river", "runs", "slowly", "past", "old", "houses"]) for _ in range(80)) for _ in range(120)]
    bad = ["".join(rnd.choice("#$%&*!?") * 3 + rnd.choice("qzx") for _ in range(80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(900, None), (901, "")]
    df = docs(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(0, 180, 2)] + [(None, 1), (5000, 1), (2, None)], "id long, label int")
    got = {r["doc_id"]: r["score"] for r in quality.score(df, quality.fit(df, labels, "doc_id", "text")).collect()}
    assert sum((got[i] >= 0.3) == (i < 120) for i in range(1, 180, 2)) >= 88 and 0 <= got[900] == got[901] <= 1
    none = quality.fit(df, labels.where("false"), "doc_id", "text")
    assert {r["score"] for r in quality.score(df, none).collect()} == {0.5}


# 7 SentencePiece


@pytest.mark.parametrize(
    "texts, labels, want",
    [
        ([(1, None), (2, None), (9, "abc")], [(1, 0), (2, 1)], 0.5),
        ([(9, "abc")], [(1, 0), (2, 1)], 0.5),
        ([(1, ""), (2, ""), (3, ""), (4, "")], [(1, 0), (2, 1), (3, 0), (4, 1)], 0.5),
        ([(None, "good text"), (2, "bad text"), (3, "x")], [(None, 0), (2, 1), (3, 0), (3, None)], 1 / 3),
        ([], [], None),
    ],
)
def test_quality_with_little_to_learn_from(spark, texts, labels, want):
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame(labels, "id long, label int"), "doc_id", "text")
    got = quality.score(frame, model).collect()
    assert len(got) == len(texts) and all(abs(r["score"] - want) < 1e-9 for r in got)



def test_sentencepiece(spark):
    P, sp = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    path = P.path("piece_bpe_32k.model")
    lib, own = sp.SentencePieceProcessor(model_file=path), pieces.load(path)
    rnd = random.Random(6)
    texts = ["", " ", "▁ a", "\n\n x", "<s>", "<0x41>", "q" * 500, "naïve 漢字 😀\0"] + ["".join(rnd.choice("ab the é字 \n▁😀") for _ in range(rnd.randrange(60))) for _ in range(150)]
    rows = [*enumerate(texts), (900, None)]
    got = {r["doc_id"]: r for r in pieces.digests(docs(spark, rows), path).collect()}
    spans = {r["doc_id"]: r for r in pieces.decode(pieces.encode(docs(spark, rows), path), path, out_col="back").collect()}
    for i, t in rows:
        ids = lib.encode(t or "")
        assert spans[i]["ids"] == ids and spans[i]["back"] == lib.decode(ids)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        ends = spans[i]["ends"]
        assert got[i]["last_end"] == len((t or "").encode()) and ends == sorted(ends)
        assert got[i]["spans_crc32"] == zlib.crc32(b"".join(e.to_bytes(4, "little") for e in ends))
    for _ in range(300):
        ids = [rnd.randrange(rnd.choice([300, 32000])) for _ in range(9)]
        assert own.decode(ids) == lib.decode(ids)


def test_compiled_character_map():
    sp = pytest.importorskip("sentencepiece")
    lib = sp.SentencePieceNormalizer(rule_name="nmt_nfkc")
    blob = next(v for k, v in pieces._fields(lib.serialized_model_proto()) if k == 3)
    own = pieces.Model.__new__(pieces.Model)
    own.charmap = pieces.CharMap(next(v for k, v in pieces._fields(blob) if k == 2))
    own.remove_extra = own.add_dummy = True
    for t in ("ｆｕｌｌ　①  ﬁx", "㌀ é ½ ™", "ａ゙ ガ", "  a  b ", "", "한글 ﷺ"):
        norm, source = own.normalise(t)
        assert norm == lib.normalize(t) and len(source) == len(norm) + 1 and source.tolist() == sorted(source)


# 8 Language ID


def test_language_id(spark):
    de, en = "der die und nicht ist das ein schlecht", "the of and to that this with which"
    rnd = random.Random(7)
    mk = lambda s: " ".join(rnd.choice(s.split()) for _ in range(30))
    rows = [(i, mk(de if i % 2 else en), "de" if i % 2 else "en") for i in range(80)]
    train = spark.createDataFrame(rows + [(None, None, "en"), (1, "x", None)], "doc_id long, text string, lang string")
    known = langid.profiles(train)
    test = docs(spark, [(1, mk(de)), (2, mk(en)), (3, None), (4, " 12 !"), (5, ""), (6, "É")])
    got = {r["doc_id"]: r for r in langid.identify(test, known).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5)] == ["de", "en", "und", "und", "und"] and got[6]["lang_pred"] in ("de", "en")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.identify(test, langid.profiles(train.where("false"))).collect()} == {"und"}
    c = Counter()  # the same n-grams, counted plainly
    w = "_" + "_".join(de.split()) + "_"
    for n in (1, 2, 3):
        for k in range(len(w) - n + 1):
            g = w[k : k + n]
            if g != "_" and not (n == 3 and g[1] == "_"):
                c[g] += 1
    keys = langid.grams(langid.codes(de))
    assert sorted(Counter(keys.tolist()).values()) == sorted(c.values())


# 9 WARC


@pytest.mark.parametrize("limit", [0, 200_000])
def test_warc(spark, tmp_path, limit):
    big, odd = "b" * 150, "line\r\n\r\nWARC/1.1\r\nContent-Length: 3"
    rows = [(5, "http://a/", big), (3, "http://b/\r\nX: y", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (7, "u", None), (8, "u", ""), (3, "again", big), (6, "u", odd), (None, "n", "z" * 200), (None, "n", "z" * 200)]
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path, max_broadcast_groups=limit)
    back = warc.read_archive(spark, path)
    got = Counter((re.search(r'<urn:record:(.*?)>', bytes(r['header']).decode())[1], r["kind"], bytes(r["payload"]).decode()) for r in back.select("*", warc.header_field(F.col("header").cast("string"), "WARC-Type").alias("kind")).collect())
    assert got == Counter([("5", "revisit", big), ("3", "response", big), ("3", "response", big), ("9", "revisit", big), ("1", "response", "small"), ("2", "response", "small"), ("7", "response", ""), ("8", "response", ""), ("6", "response", odd), ("", "response", "z" * 200), ("", "response", "z" * 200)])
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    joined = b"".join(bytes(r["record"]) for r in warc.records(back).collect())
    parsed = warc.parse_records(spark.createDataFrame([(bytearray(joined),)], "content binary")).collect()
    assert len(parsed) == len(rows) and sum(bytes(r["block"]) == odd.encode() for r in parsed) == 1


def test_warc_finds_damage(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), path)
    spark.createDataFrame([(hashlib.sha256(b"x").hexdigest(), bytearray(b"y"))], "digest string, payload binary").write.mode("overwrite").parquet(f"{path}/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, path).collect()


# 10 Secrets


def test_secrets(spark):
    key, digest = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "b5bb9d8014a0f9b1d61e21e796d78dccdf1352f2"
    text = f'one two token = "{key}" three; commit {digest} and ann.12345@mail7.example.com, 4111111111111111 end. password: hunter2XyZ99'
    rows = [(1, text), (2, None), (3, ""), (4, "plain words only"), (1, text), (5, f"x{' y' * 50_000} token={key}")]
    forest = secrets.train(spark)
    assert not forest.forest.hasSummary
    seen = Observation()  # a session that has observed anything can't be sent to executors
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    got = secrets.scan_secrets(docs(spark, rows), forest).collect()
    found = {(r["doc_id"], r["value"]): r["is_secret"] for r in got}
    assert found[1, key] and found[5, key] and not found[1, digest] and not found[1, "4111111111111111"] and found[1, "hunter2XyZ99"]
    by_id = dict(rows)
    assert all(by_id[r["doc_id"]][r["start"] : r["end"]] == r["value"] for r in got)
    clean = secrets.redact(docs(spark, rows), forest).collect()
    assert len(clean) == len(rows) and all(key not in (r["text"] or "") for r in clean) and any(digest in (r["text"] or "") for r in clean)
    assert {r["doc_id"]: r["text"] for r in clean}[4] == "plain words only"
    assert secrets.scan_secrets(docs(spark, []), forest).count() == 0


def test_forest_on_held_out_examples(spark):
    part = F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(4))
    rows = secrets.example_findings(spark, 4_000).withColumn("doc_id", F.xxhash64("text")).cache()
    forest = secrets.train(spark, rows.where(part != 2))
    held = rows.where(part == 2)
    got = secrets.scan_secrets(held, forest, path_col="path").join(held.select("doc_id", "label").distinct(), "doc_id")
    wrong, n = got.agg(F.count_if(F.col("is_secret") != (F.col("label") == 1)), F.count("*")).first()
    assert n > 700 and wrong <= n * 0.02
