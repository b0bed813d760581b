"""Operator 10, secret scans with a random forest. DataFrame and SQL functions only.

One pattern finds candidates: long runs of key characters with a digit or a known key's first letters, whole private key blocks (to their END line;
without one, the lines of base64 after BEGIN), any value assigned to a key word (password, token, secret, api key and
the like, of any characters), and passwords in the user part of a url. A random forest (pyspark.ml) then removes
false positives. It looks at the candidate's length, its character classes and the transitions between them (with the
commonest letter pairs), how much of it words of a dictionary cover, the path it was found under, and the neighbouring words.

The dictionary, ``dictionary_words`` words in most documents of the table that is scanned, and the letter pairs of these words are counted
over all its texts (``learn_words``); common words of identifiers are added. The forest is trained on labelled findings: ``labelled`` is a
table of text, path and label (1: its
candidates are secrets). Without one, ``example_findings`` makes such a table by rule, of
``n`` rows, a documented bound. Texts are matched whole. Texts
without a candidate leave the plan in the scan; of the rest only candidates with a few words around
them are shuffled, to add up their offsets within one text.

Defined cases: null and empty texts have no candidates; overlapping candidates cannot occur, the leftmost
is taken; repeated rows and null ids are kept and give repeated findings; an empty table gives none (the dictionary is then
the identifiers' words). Extra columns of the input are not looked at; helper columns take names that it lacks.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, join_groups, table, written

KEY_CHARS = r"A-Za-z0-9+/_.\-"
PEM_KIND = "[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
PEM = (
    rf"-----BEGIN {PEM_KIND}(?:[^\-]{{0,20000}}+(?:-(?!----)[^\-]{{0,20000}}+){{0,100}}+-----END {PEM_KIND}"
    r"|(?:\s{0,4}[A-Za-z0-9+/]{16,}={0,2}){0,1000})"
)
#: What a value is assigned to, up to the value or its quote.
LEAD = (
    r"(?=[PpSsTtAaCc])(?i:passw(?:or)?d|passphrase|pwd|secret|token|(?:api|access|private|signing)[_\-. ]?key|credentials?|auth(?:orization)?(?![A-Za-z]))"
    r"[A-Za-z0-9_\-]{0,24}+[\"']?[ \t]{0,3}(?::=|=>|[:=])[ \t]{0,3}(?:(?i:bearer|basic|token)[ \t]{1,3})?"
)
#: The start of a url up to the password in it.
USER = r"://[^\s/:@\"']{1,128}:"
CANDIDATE = (
    rf"{PEM}|{LEAD}(?:\"[^\"\n]{{6,512}}(?=\")|'[^'\n]{{6,512}}(?=')|[\"']?[^\s\"']{{5,}}[^\s\"';,.)\]}}>])|{USER}[^\s/@\"']{{3,128}}(?=@)"
    rf"|(?<![{KEY_CHARS}])(?=(?:A[KS]IA|gh[pousr]_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|npm_)|[A-Za-z+/_.\-]*[0-9])[{KEY_CHARS}]{{16,}}={{0,2}}"
)
VALUE = rf"(?s)^(?:{LEAD}[\"']?|{USER})?(.*)$"
BEFORE, AFTER = 80, 40

KNOWN = r"^(AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk-|AIza|eyJ|SG\.|npm_|-----BEGIN)"
KEY_WORD = r"(?i)(token|secret|passw|pwd|passphrase|://[^ ]{1,128}:$|api.?key|access.?key|auth|bearer|credential|private|signing)[^\n]{0,24}$"
PLAIN_WORD = r"(?i)(sha-?[0-9]|md5|checksum|commit|digest|hash|etag|version|uuid|guid|revision|build|order|invoice|card|base64,|integrity|mail|phone|isbn|session id|trace)[^\n]{0,24}$"
FAKE = r"(?i)(example|sample|dummy|placeholder|changeme|your|insert|replace|xxxx|test|fake|todo|1234)"
TEST_PATH = r"(?i)(test|spec|example|fixture|sample|mock|docs?/|readme)"
#: Words of paths, identifiers and hosts that texts seldom have; they are added to the dictionary.
WORDS = (
    "usr lib local share home src main test tests build dist site packages python java node modules index "
    "html page post news image images static assets media user users name file files path data value config "
    "service server client handler manager helper util utils function method class object string number list "
    "map set get put add remove update delete create read write open close start stop init load save format "
    "parse render view model controller request response http https www com org net example mail web api "
    "version release alpha beta stable final draft report summary total order item product price date time "
    "year month day week the and for with from this that your key token secret here default first last"
).split()


@dataclass(frozen=True)
class Vocabulary:
    words: tuple[str, ...]
    pairs: tuple[str, ...]


def vocabulary(counts: dict[str, int], n_pairs: int = 60) -> Vocabulary:
    """The words with WORDS, and the letter pairs that are commonest in them (each word as often as it was counted)."""
    counts = {w: 1 for w in WORDS} | counts
    pairs = Counter()
    for w, n in counts.items():
        for k in range(len(w) - 1):
            pairs[w[k : k + 2]] += n
    return Vocabulary(tuple(sorted(counts)), tuple(p for p, _ in sorted(pairs.items(), key=lambda x: (-x[1], x[0]))[:n_pairs]))


def learn_words(docs: DataFrame, text_col: str = "text", dictionary_words: int = 2000) -> Vocabulary:
    """The words of 3 to 20 letters a-z that most texts have; ties go to the alphabetically first. The driver gets no more rows
    than that: the best of 16 parts are found in tasks, and the best of these in one."""
    words = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), "[^a-z]+"))).alias("w"))
    counted = words.where(F.length("w").between(3, 20)).groupBy("w").agg(F.count("*").alias("n"))
    best = Window.partitionBy("part").orderBy(F.desc("n"), "w")
    few = counted.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(16))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= dictionary_words)
    few = few.select("w", "n").repartition(1).orderBy(F.desc("n"), "w").limit(dictionary_words)
    return vocabulary({r["w"]: r["n"] for r in few.collect()})


FEATURES = [
    "length", "digits", "upper", "lower", "symbols", "spaces", "hex", "turns", "distinct", "bigrams", "words", "runs", "dots",
    "slashes", "dashes", "known", "key_word", "assigned", "quoted", "plain_word", "fake", "test_path", "address", "next_fake",
]


def _left(x, n):
    return F.left(x, F.lit(n) if isinstance(n, int) else n)


def candidates(docs: DataFrame, text_col: str, path, keep: dict) -> DataFrame:
    """keep columns, value, start, end, before, after, path: a row per candidate, offsets in characters; nth counts them
    from 0 within a row."""
    text = F.col(text_col)
    hit = docs.where(F.regexp_like(text, F.lit(CANDIDATE))).select(
        *[c.alias(k) for k, c in keep.items()], F.coalesce(path, F.lit("")).alias("path"), text.alias("_t"),
        F.monotonically_increasing_id().alias("_row"),
    )
    hit = hit.select(
        *keep, "path", "_row", F.split("_t", CANDIDATE, -1).alias("_parts"),
        F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0)).alias("_found"),
    )
    cut = F.transform(
        F.sequence(F.lit(0), F.size("_found") - 1),
        lambda i: F.struct(
            F.length(F.get("_parts", i)).alias("gap"), F.right(F.get("_parts", i), F.lit(BEFORE)).alias("before"),
            F.get("_found", i).alias("match"), _left(F.get("_parts", i + 1), F.lit(AFTER)).alias("after"),
        ),
    )
    rows = hit.select(*keep, "path", "_row", F.posexplode(cut).alias("_k", "_c")).select(*keep, "path", "_row", "_k", "_c.*")
    upto = F.sum(F.col("gap") + F.length("match")).over(Window.partitionBy("_row").orderBy("_k"))
    rows = rows.withColumn("end", upto).withColumn("value", F.regexp_extract("match", VALUE, 1))
    lead = _left("match", F.length("match") - F.length("value"))
    return rows.select(
        *keep, "path", "value", (F.col("end") - F.length("value")).alias("start"), "end",
        F.concat("before", lead).alias("before"), "after", F.col("_k").alias("nth"),
    )


def with_features(found: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda rx: F.regexp_count(v, F.lit(rx)) / n
    flag = lambda x: x.cast("double")
    like = lambda c, rx: flag(F.regexp_like(c, F.lit(rx)))
    before, after = F.col("before"), F.col("after")
    known_words = F.split(F.lit(" ".join(vocabulary.words)), " ")  # one literal after constant folding
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(v, "([a-z])([A-Z])", "$1 $2")), F.lit("[a-z]{3,20}"), F.lit(0))
    covered = F.aggregate(F.filter(runs, lambda w: F.array_contains(known_words, w)), F.lit(0), lambda a, w: a + F.length(w))
    cols = {
        "length": n, "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "symbols": share("[^A-Za-z0-9]"), "spaces": share(r"\s"),
        "hex": like(v, "^([0-9a-f]+|[0-9A-F]+)$"),
        "turns": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0)),
        "bigrams": F.regexp_count(F.lower(v), F.lit(f"(?=(?:{'|'.join(vocabulary.pairs)}))")) / n, "words": covered / n, "runs": share(r"(.)\1\1"),
        "dots": share(r"\."), "slashes": share("/"), "dashes": share("[-_]"), "known": like(v, KNOWN),
        "key_word": like(before, KEY_WORD), "assigned": like(before, "[:=]\\s*[\"']?$"), "quoted": like(before, "[\"']$"),
        "plain_word": like(before, PLAIN_WORD), "fake": like(v, FAKE), "test_path": like(F.col("path"), TEST_PATH),
        "address": flag(F.regexp_like(before, F.lit(r"(@|//|\w)$")) | F.regexp_like(after, F.lit(r"^@"))),
        "next_fake": like(after, r"(?i)^\W{0,4}\s*(\(|#|//)?\s*(example|sample|placeholder|dummy)"),
    }
    return found.withColumns({f"f_{k}": F.coalesce(c, F.lit(0.0)) for k, c in cols.items()})


def example_findings(spark: SparkSession, n: int = 12_000) -> DataFrame:
    """Labelled findings made by rule: text, path, label, shape (its number). Real key shapes in key contexts are secrets;
    digests, ids, versions, paths, hosts, card numbers, plain words, code and placeholders are not. A few are ambiguous."""
    cat, lit, left = F.concat, F.lit, _left
    pick = lambda salt, xs: F.element_at(F.array(*[lit(x) for x in xs]), (F.pmod(F.xxhash64(lit(salt), F.col("id")), lit(len(xs))) + 1).cast("int"))
    size = lambda salt, lo, hi: (F.pmod(F.xxhash64(lit(salt), F.col("id")), lit(hi - lo + 1)) + lo).cast("int")
    words = [*WORDS[:60], "ther", "onatin", "unge", "ment", "ciones", "leaux", "shering", "blent"]
    raw = F.sha2(cat(lit("finding "), F.col("id").cast("string")), 512)
    # Drawn once a row and written, so that each shape below is a few slices of plain columns.
    drawn = written(spark, spark.range(0, n, 1, 4).select(
        "id", raw.alias("hex"), F.translate(F.base64(F.unhex(raw)), "=\r\n", "").alias("b64"), F.translate(raw, "abcdef", "493817").alias("dig"),
        *[pick(f"w{k}", words).alias(f"w{k}") for k in range(8)],
        pick("key", ["token", "secret", "api_key", "apikey", "auth_token", "access_token", "client_secret", "SECRET_KEY", "API-Key", "credential"]).alias("key"),
        pick("eq", [' = "', '="', ": ", "=", " = ", ": '", ':"']).alias("eq"), F.pmod(F.xxhash64(lit("lead"), F.col("id")), lit(4)).cast("int").alias("lead"),
        size("short", 8, 20).alias("short"), size("long", 20, 64).alias("long"), pick("hexlen", [32, 40, 40, 40, 48, 64]).alias("hexlen"),
        pick("path", ["src/app/main.py", "src0", "config/settings.yml", "web/page.html", "", "deploy/values.yaml", "notes/2024.md", "src17"]).alias("path"),
    ), "drawn-findings")
    c = F.col
    hx, dg = lambda a, k: F.substring("hex", a, k), lambda a, k: F.substring("dig", a, k)
    lead = lambda *xs: F.get(F.array(*[lit(x) for x in xs]), c("lead"))
    tame = F.translate(c("b64"), "+/", "Q7")
    secret = cat(c("key"), c("eq"), left(c("hex"), c("hexlen")))
    kind = lead("RSA ", "EC ", "OPENSSH ", "")
    lines = cat(left(c("b64"), 64), lit("\n"), F.reverse(left(c("b64"), 64)), lit("\n"), F.upper(left(c("hex"), c("long"))), lit("=="))
    signs = cat(left(tame, 4), lit("$"), dg(1, 2), lit("!"), F.substring("b64", 9, 4), lit("#"), hx(5, 3), lit("^"), F.substring("b64", 20, 5), lit("%"))
    good = [
        secret, secret, cat(c("key"), c("eq"), left(c("b64"), c("long"))),
        cat(lead("", "aws_access_key_id = ", "key: ", "id "), lit("AKIA"), F.upper(left(tame, 16))),
        cat(lead("", "token ", "GITHUB_TOKEN=", "use "), lit("ghp_"), left(tame, 36)),
        cat(lead("password", "passwd", "Password", "pwd"), c("eq"), left(c("b64"), c("short"))),
        cat(lead("Bearer ", "Authorization: ", "jwt ", ""), lit("eyJhbGciOiJIUzI1NiJ9.eyJ"), left(F.translate(c("b64"), "+/", "-_"), 60)),
        cat(lit("Authorization: Bearer "), left(c("b64"), c("long"))),
        cat(lead("", "slack ", "SLACK_TOKEN: ", "bot "), lit("xoxb-"), dg(1, 12), lit("-"), left(tame, 24)),
        cat(lit("-----BEGIN "), kind, lit("PRIVATE KEY-----\n"), lines, lit("\n-----END "), kind, lit("PRIVATE KEY-----")),
        cat(lit("-----BEGIN "), kind, lit("PRIVATE KEY-----\n"), lines),
        cat(c("key"), c("eq"), F.translate(left(c("b64"), c("long")), "0123456789+/", "gKtRwBnPzqXe")),
        cat(c("key"), c("eq"), F.when(c("id") % 2 == 0, F.translate(F.lower(left(c("b64"), c("long"))), "0123456789+/", "gktrwbnpzqxe")).otherwise(
            F.substr(lit("abcdefghijklmnopqrstuvwxyz" * 4), F.pmod(c("id"), lit(26)) + 1, c("long")))),
        cat(c("key"), c("eq"), signs),
        cat(lead("password", "passwd", "DB_PASSWORD", "pwd"), c("eq"), left(signs, c("short"))),
        cat(lead("postgres", "mysql", "amqp", "https"), lit("://"), c("w0"), lit(":"), left(tame, c("short")), lit("@"), c("w1"), lit(".internal/"), c("w2")),
    ]
    bad = [
        cat(lead("commit ", "commit: ", "revision = ", "hash "), hx(1, 40)),
        cat(lead("sha256:", "sha256 = ", "SHA-256 digest ", "checksum: "), hx(1, 64)),
        cat(lead("md5 ", "md5sum: ", 'ETag: "', "hash="), hx(1, 32)),
        cat(lead("uuid ", "id=", "trace ", ""), hx(1, 8), lit("-"), hx(9, 4), lit("-"), hx(13, 4), lit("-"), hx(17, 4), lit("-"), hx(21, 12)),
        cat(lead("version ", "v", "release ", "build "), dg(1, 2), lit("."), dg(3, 2), lit("."), dg(5, 1), lit("-beta."), dg(6, 8)),
        cat(lit("/"), c("w0"), lit("/"), c("w1"), lit("/"), c("w2"), dg(1, 2), lit("/"), c("w3"), lead(".py", ".html", "", ".tar.gz")),
        cat(c("w0"), lit("."), dg(1, 2), lit("@mail"), dg(3, 1), lit("."), c("w1"), lit(".example.com")),
        cat(lead("card ", "order ", "", "invoice "), dg(1, 16)),
        cat(c("w0"), lit("_"), c("w1"), lit("_"), c("w2"), lit("_v"), dg(1, 1), lit("_"), c("w3")),
        cat(c("key"), c("eq"), lead("your-api-key-0123-here", "xxxxxxxx1234xxxxxxxx", "insert_token_here_1234", "changeme-changeme-1")),
        cat(lit("data:image/png;base64,"), left(c("b64"), 64)),
        cat(lit("https://"), c("w0"), lit("."), c("w1"), lit(".com/"), c("w2"), lit("/"), dg(1, 8), lit("/"), c("w3")),
        cat(dg(1, 4), lit("-"), dg(5, 2), lit("-"), dg(7, 2), lit("T"), dg(9, 6), lit("."), dg(15, 6)),
        cat(c("w0"), lit("-"), c("w1"), lit("-"), dg(1, 3), lit("-"), c("w2"), lit("-"), c("w3")),
        cat(c("key"), c("eq"), c("w0"), c("w1"), lead("", " ", "_", "-"), c("w2"), c("w3")),
        cat(c("key"), lead(": ", ": ", " = ", "="), c("w0"), lit("."), c("w1"), lit("("), c("w2"), lit(")"), lit("_"), c("w3")),
        cat(c("key"), c("eq"), lead("${SECRET_KEY}", "<your-token>", "os.environ.get", "{{ vault_token }}")),
        cat(lead("tokens", "Tokens", "max_tokens", "token count"), lead(": ", "=", " = ", ": "), dg(1, 7)),
        cat(lead("password", "passwd", "Password", "pwd"), lead(": ", " = ", ": ", "="), lead("please", "required", "changeme", "********"), lit(" "), c("w0")),
        cat(lit("-----BEGIN "), kind, lit("PRIVATE KEY----- "), c("w0"), lit(" "), c("w1")),
        cat(lead("https", "http", "ftp", "postgres"), lit("://"), lead("user:password@", "user:pass@", "name:secret@", "admin:example@"), lit("example.com/"), c("w0")),
    ]
    shapes = [(x, 1.0) for x in good] + [(x, 0.0) for x in bad]
    snippet, label = lit(None).cast("string"), lit(None).cast("double")
    turn = F.pmod(c("id"), lit(len(shapes)))
    for k, (x, y) in enumerate(shapes):
        snippet, label = F.when(turn == k, x).otherwise(snippet), F.when(turn == k, lit(y)).otherwise(label)
    rows = written(spark, drawn.select("w4", "w5", "w6", "w7", "path", snippet.alias("s"), label.alias("label"), turn.alias("shape")), "findings")
    close = F.when(F.regexp_like("s", lit('"[^"]*$')), lit('"')).when(F.regexp_like("s", lit("'[^']*$")), lit("'")).otherwise(lit(""))
    return rows.select(F.concat_ws(" ", "w4", "w5", cat("s", close), "w6", cat("w7", lit("."))).alias("text"), "path", "label", "shape")


@dataclass(frozen=True)
class Scanner:
    forest: object
    vocabulary: Vocabulary


def train(spark: SparkSession, labelled: DataFrame | None = None, words: Vocabulary | None = None, trees: int = 24, depth: int = 8, seed: int = 7) -> Scanner:
    """A fitted pyspark.ml forest over FEATURES, with the vocabulary it looks at."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    words = words or vocabulary({})
    with Scratch(spark):
        labelled = example_findings(spark) if labelled is None else labelled
        found = candidates(labelled.where("label is not null"), "text", F.col("path"), {"label": F.col("label").cast("double")})
        rows = written(spark, with_features(found, words).select("label", *[f"f_{k}" for k in FEATURES]).coalesce(4), "labelled-findings")
        rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows)
        forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(rows)
    return Scanner(forest.copy(), words)  # without the training summary, which holds the session and cannot go to executors


def scan_secrets(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", threshold: float = 0.5) -> DataFrame:
    """A row per candidate: id, text_key (SHA-256 of its text), nth, start, end, value, score, is_secret."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    path = F.col(path_col).cast("string") if path_col else F.lit("")
    keep = {"_id": F.col(id_col), "text_key": F.sha2(F.col(text_col).cast("binary"), 256)}
    rows = with_features(candidates(docs, text_col, path, keep), scanner.vocabulary)
    rows = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features").transform(rows)
    out = scanner.forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return out.select(F.col("_id").alias(id_col), "text_key", "nth", "start", "end", "value", "score", (F.col("score") >= threshold).alias("is_secret"))


def redact(docs: DataFrame, scanner: Scanner, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """docs with every value found to be a secret replaced by mark, wherever its text has it; other rows pass through unmoved.

    Only texts with a candidate are joined with their secrets, texts that many rows share by broadcast."""
    spark = docs.sparkSession
    has = F.coalesce(F.regexp_like(F.col(text_col), F.lit(CANDIDATE)), F.lit(False))
    key, values, size = fresh(docs, "_key"), fresh(docs, "_values"), fresh(docs, "_size")
    found = scan_secrets(docs, scanner, id_col, text_col, path_col, threshold).groupBy(F.col("text_key").alias(key)).agg(
        F.array_sort(F.collect_set(F.when(F.col("is_secret"), F.col("value"))), lambda a, b: F.length(b) - F.length(a)).alias(values), F.count_if(F.col("nth") == 0).alias(size)
    )
    found = written(spark, found, "secrets-of-texts")
    total = found.agg(F.sum(size)).first()[0] or 0
    hit = join_groups(docs.where(has).withColumn(key, F.sha2(F.col(text_col).cast("binary"), 256)), found.where(F.size(values) > 0), [key], size, total)
    clean = F.aggregate(values, F.col(text_col), lambda t, v: F.replace(t, v, F.lit(mark)))
    hit = hit.withColumn(text_col, F.when(F.col(values).isNull(), F.col(text_col)).otherwise(clean))
    return docs.where(~has).unionByName(hit.select(*docs.columns))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, train(spark, words=learn_words(docs)))
    masked = F.concat(_left("value", F.lit(4)), F.lit("..."), F.length("value").cast("string"))
    return found.select("doc_id", "start", "end", masked.alias("masked"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
