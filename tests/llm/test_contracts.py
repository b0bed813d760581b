"""The opN_ queries on a small written table, against SQL or a plain version of each."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hopweave.llm import gif, langid, packing, quality, queries, secrets, url_filter, warc
from tests.llm.test_operators import families, plain_components, plain_sets

LANGS = {
    "en": "the of and to in that was his with as her for had you not be is at on by this have from which she all were or we one",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou être été",
}
KEY = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source) of all kinds: languages, families, copies, nulls, empty and wordless texts, secrets."""
    rnd = random.Random(12)
    out = [(i, " ".join(rnd.choice(LANGS[k].split()) for _ in range(rnd.randrange(5, 60))), k, f"src{i % 3}") for i in range(90) for k in [rnd.choice(sorted(LANGS))]]
    out += [(100 + i, t, "en", "src0") for i, t in families(5, 60)]
    out += [(200 + i, t, k, s) for i, (_, t, k, s) in enumerate(rnd.sample(out, 30))]
    out += [(300, None, None, None), (301, "", "en", ""), (302, " \n\t ", None, "x"), (303, "１２３ !!", None, "x"), (304, f'see token = "{KEY}" here; password: p@ss!w0rd#9x, and commit {KEY[::-1]}', "en", "src1")]
    return out


@pytest.fixture(scope="module")
def sf(spark, rows, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] % 4 > 0), 0) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    rnd = random.Random(3)
    hosts = [f"{rnd.choice(['news', 'shop', 'blog'])}{k}.{rnd.choice(['example.org', 'site.org', 'mail.com', 'odd.net'])}" for k in range(80)]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'es', 'fr', 'de'])}/{rnd.choice(['good', 'casino'])}{rnd.randrange(9)}" for _ in range(300)]
    urls += ["http://A.Example.ORG/es/x?q", "no scheme", None, "", "http://a/\u2028WARC-Payload-Digest: sha256:dead\x85WARC-Refers-To: <urn:record:7>\u2029\r\nWARC-Type: revisit"]
    big = "<p>" + "same page " * 30
    html = [rnd.choice([big, big + "x", f"only {k}" * 20, "tiny", "", None]) for k in range(len(urls))]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string")
    pages.write.parquet(f"{folder}/pages.parquet")
    return folder


def run(spark, sf, name):
    return queries.QUERIES[name](spark, sf)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet/*.parquet'")
    got, want = run(spark, sf, name), con.sql(queries.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.project(", ".join(names)).fetchall())


def test_op2(spark, sf, rows):
    sets = plain_sets([(r[0], r[1]) for r in rows])
    want = plain_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, sf, "op2_jaccard_join").collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()} and len(set(want.values())) < len(want)


def textbook_lzw(data, size):
    """One code after the other, as the format's description has it."""
    clear, end = 1 << size, (1 << size) + 1
    bits, at, width, out, prev = int.from_bytes(data, "little"), 0, size + 1, b"", None
    table = [bytes([i]) for i in range(clear)] + [b"", b""]
    while True:
        code = bits >> at & ((1 << width) - 1)
        at += width
        if code == clear:
            table, width, prev = table[: clear + 2], size + 1, None
            continue
        if code == end:
            return out
        entry = table[code] if code < len(table) else prev + prev[:1]
        if prev is not None and len(table) < 4096:
            table.append(prev + entry[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, prev = out + entry, entry


def test_op3(spark, sf, rows):
    got = {r["doc_id"]: r for r in run(spark, sf, "op3_gif").collect()}
    media = {r["doc_id"]: bytes(r["media"]) for r in gif.encode_bytes(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id", "text").collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        raw = (t or "").encode()
        want = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media[i]), hashlib.sha256(media[i]).hexdigest())
        body, blocks = media[i][13 + 768 :], b""
        assert body[:4] == b"\x21\xf9\x04\x04" and len(raw) < 192 * 256  # one frame: control, image, code size, blocks
        at = 8 + 10 + 1
        while body[at]:
            blocks += body[at + 1 : at + 1 + body[at]]
            at += 1 + body[at]
        assert textbook_lzw(blocks, 8) == want and r["feature"].startswith("frames=1;ms=100;")


def best_cost(lengths, caps, bin_cost=32):
    """The least cost of all ways to put the pieces into bins."""
    def split(k, bins):
        if k == len(lengths):
            yield sum(min(c for c in caps if c >= b) + bin_cost for b in bins)
            return
        for at in range(len(bins) + 1):
            grown = [*bins, 0][: max(len(bins), at + 1)]
            grown[at] += lengths[k]
            if grown[at] <= max(caps):
                yield from split(k + 1, grown)

    return min(split(0, []))


def test_op4_packs_near_the_optimum():
    rnd, worst, sums = random.Random(1), 1.0, [0, 0]
    for _ in range(120):
        lengths = sorted((rnd.randrange(1, 65) for _ in range(rnd.randrange(1, 9))), reverse=True)
        got = packing.pack(lengths, (16, 32, 64))
        cost, best = sum({b: c + 32 for b, _, c in got}.values()), best_cost(lengths, (16, 32, 64))
        assert cost >= best
        worst, sums = max(worst, cost / best), [sums[0] + cost, sums[1] + best]
    assert worst <= 1.5 and sums[0] <= 1.005 * sums[1]
    ties = packing.pack([8, 8, 8, 8], (16, 32), bin_cost=1)
    assert sorted((b, at) for b, at, _ in ties) in ([(0, 0), (0, 8), (0, 16), (0, 24)], [(0, 0), (0, 8), (1, 0), (1, 8)])


def test_op4(spark, sf, rows):
    got = run(spark, sf, "op4_best_fit_packing").collect()
    length, bins = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["piece_start"] == length[r["doc_id"], r["copy"]] or r["part"] > 0
        length[r["doc_id"], r["copy"]] += r["piece_length"]
        bins[r["shard"], r["bin"]].append((r["bin_start"], r["piece_length"], r["capacity"]))
    assert dict(length) == {(i, 0): len(re.findall(r"\S+", t or "", re.ASCII)) + 1 for i, t, *_ in rows}
    for b in bins.values():
        b.sort()
        assert [x[0] for x in b] == list(itertools.accumulate([0, *[x[1] for x in b[:-1]]]))
        assert {x[2] for x in b} == {min(c for c in packing.CAPACITIES if c >= sum(x[1] for x in b))}


def test_op5(spark, sf):
    pages = [(r["page_id"], r["url"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = {r["page_id"]: r for r in run(spark, sf, "op5_url_filter").collect()}
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = url.split("://", 1)[1]
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        return host.translate({c: c + 32 for c in range(65, 91)}), re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]

    def rule(host, path):
        fits = [r for r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
        return max(fits, key=len, default=None)

    hosts = {parts(u)[0] for _, u in pages}
    folds = {r["h"]: r["f"] for r in spark.createDataFrame([(h,) for h in hosts], "h string").select("h", F.pmod(F.xxhash64("h"), F.lit(5)).alias("f")).collect()}
    counts = {v: defaultdict(Counter) for v in ("allow", "block")}  # what follows a context, of each length
    for _, u in pages:
        host, path = parts(u)
        if (r := rule(host, path)) and folds[host]:
            padded = "\x02" * 4 + (u or "") + "\x03"
            for at in range(4, len(padded)):
                for k in range(5):
                    counts[rules[r]][padded[at - k : at]][padded[at]] += 1

    def probability(verdict, gram):
        p = 1 / 256
        for k in range(5):
            if after := counts[verdict].get(gram[4 - k : 4]):
                p = (after[gram[4]] + len(after) * p) / (sum(after.values()) + len(after))
        return p

    def raw(url):
        padded = "\x02" * 4 + (url or "") + "\x03"
        return sum(math.log(probability("allow", padded[a - 4 : a + 1]) / probability("block", padded[a - 4 : a + 1])) for a in range(4, len(padded))) / (len(padded) - 4)

    plain = {u or "": raw(u) for _, u in pages}
    scores = url_filter._scores(spark.read.parquet(f"{sf}/pages.parquet"), "url", url_filter.RULES, 4, 256, 5, False)
    own = {r["_u"]: r["raw"] for r in scores.collect()}
    assert own.keys() == plain.keys() and all(abs(own[u] - plain[u]) < 1e-6 for u in own)
    bins = defaultdict(lambda: [0, 0])
    for _, u in pages:
        host, path = parts(u)
        if (r := rule(host, path)) and not folds[host]:
            bins[round(own[u or ""], 3)][rules[r] == "block"] += 1
    a, c = url_filter._curve([(x, g, b) for x, (g, b) in sorted(bins.items())])
    assert a > 0
    for i, u in pages:
        host, path = parts(u)
        r, p = rule(host, path), 1 / (1 + math.exp(-a * own[u or ""] - c))
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, r)
        assert got[i]["verdict"] == (rules[r] if r else "allow" if p >= 0.5 else "block")


def test_curve_fits_and_reliability():
    rnd = random.Random(2)
    bins = Counter()
    for _ in range(20_000):
        x = round(rnd.uniform(-3, 3), 3)
        bins[x, rnd.random() < 1 / (1 + math.exp(-(1.7 * x + 0.4)))] += 1
    a, c = url_filter._curve([(x, bins[x, True], bins[x, False]) for x in sorted({x for x, _ in bins})])
    assert abs(a - 1.7) < 0.1 and abs(c - 0.4) < 0.1
    a, c = url_filter._curve([(-1.0, 0, 50), (1.0, 50, 0)])  # separable, yet finite
    assert 0 < a < 20 and abs(c) < 1
    assert url_filter._curve([(1.0, 5, 0)]) is None and url_filter._curve([(-1.0, 9, 0), (1.0, 0, 9)]) is None


def test_reliability(spark, sf):
    brier, tenths = url_filter.reliability(spark.read.parquet(f"{sf}/pages.parquet"))
    assert 0 <= brier < 0.25 and sum(t[0] for t in tenths) > 0


def test_op6(spark, sf, rows, tmp_path):
    got = {r["doc_id"]: r for r in run(spark, sf, "op6_quality").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    known = [(r["doc_id"], r["quality"]) for r in labels.collect() if fold(r["doc_id"], 5)]
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.createDataFrame(known, "id long, label int"), "doc_id", "text")
    good, bad = quality._compressor(model["good"]), quality._compressor(model["bad"])
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        data = (t or "").encode()
        blocks = [data[k : k + 2048] for k in range(0, len(data), 2048)]
        raw = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks) / (len(data) + 64)
        p = 1 / (1 + math.exp(-model["a"] * raw - model["b"]))
        if model["points"]:
            p = 0.1 * p + 0.9 * np.interp(raw, *zip(*model["points"], strict=True))
        assert got[i]["held_out"] == (fold(i, 5) == 0) and abs(got[i]["score"] - p) < 1e-9 and got[i]["predicted"] == int(p >= 0.3)
    # Labels of held-out rows change nothing.
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{tmp_path}/labels.parquet")
    assert {r["doc_id"]: r["score"] for r in run(spark, str(tmp_path), "op6_quality").collect()} == {i: r["score"] for i, r in got.items()}


def test_isotonic_curve():
    rnd = random.Random(3)
    x = [rnd.uniform(-1, 1) for _ in range(4000)]
    y = [int(rnd.random() < (0.1 if v < 0 else 0.8)) for v in x]
    share = sum(y) / len(y)
    points = quality._isotonic(x, y, share)
    assert points == sorted(points) and [p for _, p in points] == sorted(p for _, p in points)
    at = lambda v, **kw: quality.probability({"points": points, "a": 0.0, "b": 0.0, **kw}, v)
    assert abs(at(-0.5) - 0.1 * 0.9 - 0.05) < 0.05 and abs(at(0.5) - 0.8 * 0.9 - 0.05) < 0.05
    assert at(-9, a=1.0) < at(-5, a=1.0) < at(5, a=1.0) < at(9, a=1.0)
    half = quality._isotonic(x, y, share / 2)  # fewer of label 1 than in the sample
    assert half[len(half) // 4][1] <= points[-1][1] and min(p for _, p in half) < 0.08


def test_op7(spark, sf, rows):
    tokenizers, sp = pytest.importorskip("public_tokenizers"), pytest.importorskip("sentencepiece")
    lib = sp.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in run(spark, sf, "op7_sentencepiece").collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        proto = lib.encode(t or "", return_type="proto")
        ids = [p.id for p in proto.pieces]
        ends = [p.end for p in proto.pieces]  # bytes of the text as given
        r = got[i]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert r["last_end"] == (ends[-1] if ends else 0) and r["spans_crc32"] == zlib.crc32(b"".join(e.to_bytes(4, "little") for e in ends))


def plain_grams(text):
    """n-grams of one to three letters, a mark at each end of a word; a lone mark and one between two letters are none."""
    s = "_" + "".join(c if c.isalpha() else "_" for c in text.lower()) + "_"
    s = re.sub("_+", "_", s)
    found = [s[k : k + n] for n in (1, 2, 3) for k in range(len(s) - n + 1)]
    return Counter(g for g in found if g != "_" and not (len(g) == 3 and g[1] == "_")) if any(c != "_" for c in s) else Counter()


def plain_order(counts, k):
    """Most frequent first; ties in the order of the packed numbers."""
    def number(g):
        codes = [0 if c == "_" else ord(c) for c in g]
        if codes[0] == 0:
            codes[0] = 0x1FFFFF
        out = 0
        for c in codes:
            out = out << 21 | c
        return out

    return sorted(counts, key=lambda g: (-counts[g], number(g)))[:k]


def test_op8(spark, sf, rows, tmp_path):
    profiles = defaultdict(Counter)
    for i, t, lang, _ in rows:
        if fold(i, 4) != 2 and lang and t:
            profiles[lang] += plain_grams(t)
    ranks = {k: {g: n for n, g in enumerate(plain_order(c, langid.PROFILE))} for k, c in profiles.items()}
    got = {r["doc_id"]: r for r in run(spark, sf, "op8_language_id").collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        mine = plain_order(plain_grams(t or ""), langid.TEXT_TOP)
        far = {k: sum(min(abs(r[g] - n), langid.PROFILE) if g in r else langid.PROFILE for n, g in enumerate(mine)) for k, r in ranks.items()}
        best = min(sorted(far), key=far.get) if mine else "und"
        assert got[i]["held_out"] == (fold(i, 4) == 2) and got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - (1 - far[best] / (langid.PROFILE * len(mine)) if mine else 0)) < 1e-9
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang"))).write.parquet(f"{tmp_path}/documents.parquet")
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in run(spark, str(tmp_path), "op8_language_id").collect()}
    assert again == {i: (r["lang_pred"], r["score"]) for i, r in got.items()}


def test_op9_rebuilds_records(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    warc.write_archive(pages, f"{tmp_path}/w")
    facts = {r["record_id"]: r for r in warc.read_records(spark, f"{tmp_path}/w").collect()}
    blocks = b"".join(bytes(r["record"]) for r in warc.records(warc.read_archive(spark, f"{tmp_path}/w")).collect())
    parsed = warc.parse_records(spark.createDataFrame([(bytearray(blocks),)], "content binary")).collect()
    assert len(parsed) == pages.count() == len(facts)
    html = {str(r["page_id"]): (r["html"] or "").encode() for r in pages.collect()}
    for r in parsed:
        head = bytes(r["header"]).decode().split("\r\n")
        assert head[0] == "WARC/1.1" and all(": " in line for line in head[1:-2])
        fields = dict(line.split(": ", 1) for line in head[1:-2])
        i = fields["WARC-Record-ID"][len("<urn:record:") : -1]
        f = facts[i]
        assert f["digest"] == hashlib.sha256(html[i]).hexdigest() and fields["WARC-Payload-Digest"] == "sha256:" + f["digest"]
        assert f["record_type"] == fields["WARC-Type"] and f["payload_bytes"] == len(html[i])
        assert bytes(r["block"]) == (html[i] if f["record_type"] == "response" else b"")
    stored = spark.read.parquet(f"{tmp_path}/w/payloads")
    assert stored.count() == len(set(html.values())) == stored.select("digest").distinct().count()


def plain_features(v, before, after, path, vocabulary):
    share = lambda rx: len(re.findall(rx, v)) / len(v)
    has = lambda rx, s: float(bool(re.search(rx, s)))
    runs = re.findall("[a-z]{3,20}", re.sub("([a-z])([A-Z])", r"\1 \2", v).lower())
    return {
        "length": len(v), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "symbols": share("[^A-Za-z0-9]"), "spaces": share(r"(?a:\s)"),
        "hex": has(r"\A([0-9a-f]+|[0-9A-F]+)\Z", v), "turns": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "distinct": len(set(v)) / min(len(v), 64), "bigrams": sum(v.lower()[k : k + 2] in vocabulary.pairs for k in range(len(v))) / len(v),
        "words": sum(len(w) for w in runs if w in vocabulary.words) / len(v), "runs": share(r"(.)\1\1"), "dots": share(r"\."), "slashes": share("/"), "dashes": share("[-_]"),
        "known": has(secrets.KNOWN, v), "key_word": has(secrets.KEY_WORD, before), "assigned": has("[:=]\\s*[\"']?$", before), "quoted": has("[\"']$", before),
        "plain_word": has(secrets.PLAIN_WORD, before), "fake": has(secrets.FAKE, v), "test_path": has(secrets.TEST_PATH, path),
        "address": float(bool(re.search(r"(@|//|\w)$", before) or re.search("^@", after))), "next_fake": has(r"(?i)^\W{0,4}\s*(\(|#|//)?\s*(example|sample|placeholder|dummy)", after),
    }


def test_op10(spark, sf, rows):
    """Candidates, offsets and features found by Python's re; the forest's verdicts on the query's rows."""
    words = secrets.learn_words(spark.read.parquet(f"{sf}/documents.parquet"))
    plain = Counter(w for _, t, *_ in rows for w in set(re.split("[^a-z]+", (t or "").lower())) if 3 <= len(w) <= 20)
    assert set(words.words) == set(plain) | set(secrets.WORDS)
    texts = [(r[0], r[1], r[3] or "") for r in rows]
    texts += [(1000 + i, r["text"], r["path"] or "") for i, r in enumerate(secrets.example_findings(spark, 1500).collect())]
    found = secrets.candidates(spark.createDataFrame(texts, "doc_id long, text string, path string"), "text", F.col("path"), {"_id": F.col("doc_id")})
    got = {(r["_id"], r["start"], r["end"]): r for r in secrets.with_features(found, words).collect()}
    want = {}
    for i, t, path in texts:
        last, hits = 0, list(re.finditer(secrets.CANDIDATE, t or ""))
        for k, m in enumerate(hits):
            value = re.match(secrets.VALUE, m[0])[1]
            start = m.end() - len(value)
            nxt = hits[k + 1].start() if k + 1 < len(hits) else len(t)
            before = t[last : m.start()][-secrets.BEFORE :] + t[m.start() : start]
            want[i, start, m.end()] = (value, plain_features(value, before, t[m.end() : nxt][: secrets.AFTER], path, words))
            last = m.end()
    assert got.keys() == want.keys() and len(want) > 1400
    for at, (value, features) in want.items():
        assert got[at]["value"] == value and list(features) == secrets.FEATURES
        for k, x in features.items():
            assert abs(got[at][f"f_{k}"] - x) < 1e-9, (k, value)
    out = {(r["doc_id"], r["start"], r["end"]): r for r in run(spark, sf, "op10_secret_scan").collect()}
    mine = {at: v for at, (v, _) in want.items() if at[0] < 1000}
    assert out.keys() == mine.keys() and all(out[at]["value_sha256"] == hashlib.sha256(v.encode()).hexdigest() for at, v in mine.items())
    marked = {v for at, v in mine.items() if out[at]["is_secret"]}
    assert {KEY, "p@ss!w0rd#9x"} <= marked and KEY[::-1] not in marked
