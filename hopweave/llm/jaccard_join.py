"""Operator 2, n-gram Jaccard join with a token-group matrix: exact links at a similarity of 0.8 or more.

Equal sets are one class, of which the smallest id stands for all. Then, with o the overlap that a link needs:

1. Prefix. In the order of their hashes a class emits its first ``n - o + slack`` tokens. Any two linked
   classes share at least ``slack`` of these. Tokens that no other class emits are counted and left; of
   the rest, the rarest that still must contain ``common_probes`` shared ones are kept (the probe
   tokens). Classes with fewer than ``least_shared`` tokens that others emit, too, have no link. Rare-first probing keeps passages that many texts
   share out of it.
2. Groups. For each probe token the class most of whose tokens occur elsewhere too is the token's leader; a
   class belongs to the leader named by most of its tokens. Classes linked to their leader, checked
   exactly, form its linked group; the others of a leader are grouped by size.
3. Matrix. Each group stores the union of its members' tokens with counts, smallest size and largest
   reach. A class queries the groups with which it shares enough probe tokens, except its own linked group. A
   group is passed over if sizes forbid a link, first by how many of the query's tokens occur anywhere
   else, then by how many occur in the group (its own left out).
4. Only groups that qualify are opened: a member that links holds at least one of the few tokens of the
   query that are rarest in the group; the query meets the members that do, and whole sets decide.

So members of a large group of near copies meet its leader and the group, not each other. No component changes by
that, for every pair of linked classes either shares a linked group or passes all bounds; but links between two
members that both link to their leader are not listed. ``near_links`` and ``count_links`` list and count every link: with
them a class also queries its own linked group, which costs the square of a family's size, as its links do. The query
op2, which asks for components, does without. Nothing is capped.
Side tables of ids are broadcast only when counted to be at most ``max_broadcast_rows``. Tokens, groups, leaders and
classes with more than a thousandth of a join's rows are dealt in parts or joined by broadcast (there are fewer than 1,000).

Sets are compared by 64-bit hashes of shingles over BLAKE2b word digests; ``shingles`` states the chance of a wrong decision.
Defined cases: null ids get n_shingles but a null component and no links; null or empty texts and texts
without words have no shingles and are alone; very long texts are read whole, a slice at a time; of rows that repeat an id with
different texts the one with the smallest set signature takes part in links, and the component goes to all of them; empty input,
empty result; only id and text are looked at, and the id passes through workers untouched, so no other column clashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, discard, join_groups, join_split, map_texts, table, written
from .components import components
from .heavy import heavy_values
from .shingles import WORDS_PER_SHINGLE, shingle_sets, signature

SLACK = 0.06  # of n
UNION_TOKENS = 200_000  # a group's union up to this size is one row


def needed(n: int, percent: int = 80) -> int:
    """The overlap with any linked set is at least this: percent of the set itself."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    return max(1, int(SLACK * n))


def prefix_size(n: int, percent: int = 80) -> int:
    return min(n, n - needed(n, percent) + slack(n))


def least_shared(n: int, percent: int = 80) -> int:
    """A class that links has at least so many prefix tokens that other classes have in theirs: the slack of the smallest
    partner possible."""
    return slack(needed(n, percent))


def common_probes(n: int) -> int:
    """Linked sets share at least this many probe tokens, n being the smaller one's size."""
    return max(1, slack(n) // 2)


def probe_size(n: int, percent: int = 80) -> int:
    """A partner has at least needed(n) tokens, so the two prefixes share at least slack(needed(n))."""
    p = prefix_size(n, percent)
    return min(p, p - slack(needed(n, percent)) + common_probes(n))


def _maybe_broadcast(df: DataFrame, limit: int) -> DataFrame:
    return F.broadcast(df) if df.count() <= limit else df


def _sets(docs: DataFrame, k: int, percent: int, what: str) -> DataFrame:
    """what: "prefix" (its tokens, with its size and the probe size) or "whole". Needs _id, _t."""
    import numpy as np

    def prefix(texts):
        sets = list(shingle_sets(texts, k))
        a, b = zip(*map(signature, sets), strict=True)
        p = [prefix_size(len(s), percent) for s in sets]
        least = [least_shared(len(s), percent) for s in sets]
        return [len(s) for s in sets], a, b, p, [probe_size(len(s), percent) for s in sets], least, [s[:m].view(np.int64) for s, m in zip(sets, p, strict=True)]

    def whole(texts):
        sets = list(shingle_sets(texts, k))
        a, b = zip(*map(signature, sets), strict=True)
        return [len(s) for s in sets], a, b, [s.view(np.int64) for s in sets]

    cols = {"prefix": "p int, probe int, least int, tokens array<long>", "whole": "tokens array<long>"}[what]
    return map_texts(docs, "_id", ["_t"], f"n long, s1 long, s2 long, {cols}", lambda: {"prefix": prefix, "whole": whole}[what])


def jaccard_links(pre: DataFrame, src: DataFrame, k: int, percent: int, max_broadcast_rows: int, after_prefix=lambda: None, size_step: float = 1.03, every: bool = False) -> DataFrame:
    """Links a, b between classes. pre: _id, n, s1, s2, p, probe, least, tokens of one row of each; src: _id, _t.

    every: all links, once each with a < b; else links with the same components, without those between two
    members of a linked group. after_prefix is called once pre is no longer read."""
    spark = src.sparkSession
    rows = pre.select("_id", F.explode("tokens").alias("token"))
    shared = written(spark, _held_by_several(pre, rows), "shared-prefix")

    # Probe tokens: of a class's prefix tokens the rarest `probe`, those held once counting first.
    w = Window.partitionBy("_id")
    several = F.count("*").over(w)
    rank = F.row_number().over(w.orderBy("held", "token"))
    probes = shared.join(pre.select("_id", "n", "p", "probe", "least"), "_id").withColumns({"several": several, "rank": rank})
    probes = written(spark, probes.where("several >= least and rank <= probe - (p - several)").select("_id", "n", "token"), "probes")

    # Whole sets of the classes that are left, and how many of their tokens others of these hold too.
    left = _maybe_broadcast(written(spark, probes.select("_id").distinct().join(pre.select("_id", "s1", "s2"), "_id"), "left"), max_broadcast_rows)
    discard(shared)
    after_prefix()
    again = _sets(src.join(left.select("_id"), "_id", "left_semi"), k, percent, "whole").join(left, ["_id", "s1", "s2"], "left_semi")
    whole = written(spark, again.select("_id", "n", "tokens"), "whole-sets", "snappy")
    flat = whole.select("_id", F.explode("tokens").alias("token"))
    sets = _held_by_several(whole, flat).groupBy("_id").agg(F.collect_list("token").alias("tokens")).join(whole.select("_id", "n"), "_id")
    # With i shared tokens at most, a partner has at most i * (100 + percent) / percent - n.
    reach = F.floor(F.size("tokens") * F.lit(100 + percent) / F.lit(percent) - F.col("n") + F.lit(1e-6))
    sets = sets.withColumn("reach", reach).where(F.col("reach") * 100 >= F.col("n") * percent)
    sets = written(spark, sets.select("_id", "n", "tokens", "reach"), "sets", "snappy")
    discard(whole)
    facts = sets.select("_id", "reach", (F.size("tokens") / F.col("n")).alias("centre"))
    live = written(spark, probes.join(facts, "_id"), "live-probes")

    # Leaders and groups.
    led = live.groupBy("token").agg(F.min_by("_id", F.struct(-F.col("centre"), "_id")).alias("leader"), F.count("*").alias("holders")).where("holders > 1")
    votes = live.join(led, "token").groupBy("_id", "n", "leader").agg(F.count("*").alias("votes"))
    chosen = votes.groupBy("_id", "n").agg(F.max_by("leader", F.struct("votes", -F.col("n"), "leader")).alias("leader"))
    chosen = written(spark, chosen, "chosen")

    to_leader = written(spark, chosen.where("_id <> leader").select(F.col("_id").alias("a"), F.col("leader").alias("b")), "to-leader")
    star = written(spark, verified(to_leader, sets, percent), "star-links")
    linked = star.select(F.col("a").alias("_id"), F.col("b").alias("in_star"))
    heads = star.select(F.col("b").alias("_id")).distinct().withColumn("heads", F.lit(True))
    size_class = F.floor(F.log("n") / F.log(F.lit(size_step)))
    home = (
        chosen.join(linked, "_id", "left").join(heads, "_id", "left")
        .withColumn("lead", F.when(F.col("heads"), F.col("_id")).otherwise(F.coalesce("in_star", "leader")))
        .withColumn("size_class", F.when(F.coalesce("heads", F.col("in_star").isNotNull()), F.lit(-1)).otherwise(size_class))
        .select("_id", F.struct("lead", "size_class").alias("group"))
    )
    home = written(spark, home, "home")
    live = written(spark, live.join(home, "_id"), "grouped-probes")
    about = live.select("_id", "n", "reach", "group").distinct().groupBy("group").agg(
        F.count("*").alias("members"), F.min("n").alias("least"), F.max("reach").alias("farthest")
    )
    about = written(spark, about, "groups")

    # Which group a class has to query, from the smaller group to the larger.
    holders = live.select("token", "group").distinct().join(about, "group").select("token", F.col("group").alias("g"), "members", "least", "farthest")
    own = written(spark, live.join(about.select("group", F.col("members").alias("own_members")), "group"), "own-probes")
    larger = F.struct(F.col("members"), F.col("g")) > F.struct(F.col("own_members"), F.col("group"))
    meets_own = F.lit(True) if every else F.col("g.size_class") >= 0
    apart = ((F.col("g") == F.col("group")) & meets_own & (F.col("members") > 1)) | ((F.col("g") != F.col("group")) & larger)
    ask = join_split(own, holders, ["token"], ["_id"]).where(apart & (F.col("least") <= F.col("reach")) & (F.col("n") <= F.col("farthest")))
    least_n = F.ceil(F.col("n") * percent / 100)
    fewest = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.floor(least_n * F.lit(SLACK) - F.lit(1e-9))) / 2))
    ask = ask.groupBy("_id", "n", "g", "least", (F.col("g") == F.col("group")).alias("inside")).agg(F.count("*").alias("met")).where(F.col("met") >= fewest)
    ask = written(spark, ask.drop("met"), "queries")

    # The matrix: the token unions of the groups that are asked for. Members of large groups lie together by
    # group; before their tokens are spread out they are dealt evenly.
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = ask.select("g").distinct()
    inside = home.join(asked, F.col("group") == F.col("g"), "left_semi").join(sets, "_id").repartition(tasks)
    matrix = inside.select(F.col("group").alias("g"), F.explode("tokens").alias("token")).groupBy("g", "token").agg(F.count("*").alias("held"))
    matrix = written(spark, matrix, "matrix")
    large = matrix.groupBy("g").count().where(F.col("count") > UNION_TOKENS).select("g")
    any_large = large.limit(1).count() > 0

    # Any member that links misses at most upto - need of the query's tokens in the union, so it holds one of
    # the upto - need + 1 that the fewest members hold.
    need = F.ceil((F.col("n") + F.greatest("least", least_n)) * percent / (100 + percent))
    unions = (matrix.join(large, "g", "left_anti") if any_large else matrix).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("held", "token"))).alias("union"))
    others = F.filter("union", lambda x: ~F.col("inside") | (x["held"] > 1))
    hits = F.array_intersect(F.transform(others, lambda x: x["token"]), F.col("tokens"))  # in the order of the union
    asking = ask.join(sets.select("_id", "tokens"), "_id")  # the query moves to the union, not the union to each query
    met = join_split(asking, unions, ["g"], ["_id"], ask).withColumn("hits", hits).withColumns({"upto": F.size("hits"), "need": need})
    bound = met.where("upto >= need").select("_id", "n", "g", "upto", F.explode(F.slice("hits", F.lit(1), (F.col("upto") - F.col("need") + 1).cast("int"))).alias("token"))
    if any_large:  # unions too large for one row: the same, token by token
        pair = Window.partitionBy("_id", "g")
        asking = ask.join(large, "g", "left_semi").join(sets.select("_id", "tokens"), "_id").select("_id", "n", "g", "least", "inside", F.explode("tokens").alias("token"))
        rows = asking.join(matrix, ["g", "token"]).where("not inside or held > 1").withColumns(
            {"upto": F.count("*").over(pair).cast("int"), "rank": F.row_number().over(pair.orderBy("held", "token")), "need": need}
        )
        bound = bound.unionByName(rows.where("rank <= upto - need + 1").select("_id", "n", "g", "upto", "token"))
    bound = written(spark, bound, "qualified")

    # Opened groups: members that hold one of these, of a size within reach.
    opened = bound.select("g").distinct()
    inside = home.join(opened, F.col("group") == F.col("g"), "left_semi").join(sets, "_id").repartition(tasks)
    theirs = inside.select(F.col("_id").alias("m"), F.col("n").alias("mn"), F.col("reach").alias("mreach"), F.col("group").alias("g"), F.explode("tokens").alias("token"))
    fits = (F.col("mn") * percent <= F.col("n") * 100) & (F.col("n") * percent <= F.col("mn") * 100) & (F.col("n") <= F.col("mreach"))
    fits = fits & (F.col("upto") * (100 + percent) >= (F.col("n") + F.col("mn")) * percent) & (F.col("_id") != F.col("m"))
    open_ = join_split(bound, theirs, ["g", "token"], ["_id"]).where(fits).select(F.least("_id", "m").alias("a"), F.greatest("_id", "m").alias("b")).distinct()
    if every:  # a star's links are met again within its group
        star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        open_ = open_.join(star, ["a", "b"], "left_anti")
    return star.select("a", "b").unionByName(verified(written(spark, open_, "open-pairs"), sets, percent))


def _held_by_several(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """_id, token, held of the rows (the tokens of sets, exploded) whose token several rows have. One shuffle of the rows:
    those of a token meet in a window, but for the few heavy tokens, which are known before and whose held is a lower bound."""
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    heavy = F.broadcast(heavy_values(sets, "tokens", total))
    held = F.count("*").over(Window.partitionBy("token")).alias("held")
    light = rows.join(heavy.select("token"), "token", "left_anti").select("_id", "token", held).where("held > 1")
    return rows.join(heavy, "token").select("_id", "token", "held").unionByName(light)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b (a written table) whose sets overlap enough. Tokens held by one class alone cannot be shared. The pairs of a
    class that is in very many are dealt in parts, from either side."""
    one = sets.select(F.col("_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    two = sets.select(F.col("_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    both = F.size(F.array_intersect("ta", "tb"))
    found = join_split(join_split(pairs, one, ["a"], ["b"]), two, ["b"], ["a"], pairs).select("a", "b", "na", "nb", both.alias("i"))
    return found.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b")


def _classes_and_links(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, max_broadcast_rows: int, every: bool):
    """Signatures of all rows, the class of each id, classes with their sizes, links between classes."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    prefixes = written(spark, _sets(src, k, percent, "prefix"), "prefixes", "snappy")
    base = written(spark, prefixes.select("_id", "n", "s1", "s2"), "signatures")
    taking_part = base.where("_id is not null and n > 0")
    one = taking_part.groupBy("_id").agg(F.min(F.struct("n", "s1", "s2")).alias("s"), F.count("*").alias("rows")).select("_id", "s.*", "rows")
    one = written(spark, one, "ids")
    reps = written(spark, one.groupBy("n", "s1", "s2").agg(F.min("_id").alias("rep"), F.count("*").alias("size")), "class-sizes")
    member = join_groups(one, reps, ["n", "s1", "s2"], "size", one.count())  # a hot class is not gathered in one task
    member = written(spark, member.select("_id", "n", "s1", "s2", "rep", "rows"), "classes")
    copies = member.where("_id <> rep").select("_id")
    pre = prefixes.where("_id is not null and n > 0").join(_maybe_broadcast(copies, max_broadcast_rows), "_id", "left_anti")
    repeated = member.where("_id = rep and rows > 1").select("_id", "s1", "s2")
    part = src.where("_id is not null")
    if repeated.limit(1).count():  # ids of several rows: one row of the chosen signature
        chosen = pre.join(repeated, ["_id", "s1", "s2"], "left_semi").dropDuplicates(["_id"])
        pre = pre.join(repeated.select("_id"), "_id", "left_anti").unionByName(chosen.select(pre.columns))
        part = part.dropDuplicates(["_id", "_t"])
    links = jaccard_links(pre, part, k, percent, max_broadcast_rows, lambda: discard(prefixes), every=every)
    return base, member, reps, written(spark, links, "jaccard-links")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS_PER_SHINGLE, percent: int = 80, max_broadcast_rows: int = 1_000_000) -> DataFrame:
    """a, b (a < b): every link between classes, each named by its class_id."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_classes_and_links(docs, id_col, text_col, k, percent, max_broadcast_rows, True)[3], "near-links")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS_PER_SHINGLE, percent: int = 80, max_broadcast_rows: int = 1_000_000, count_links: bool = False
) -> DataFrame:
    """id, n_shingles, class_id (smallest id with an equal set), component_id of every row; with count_links
    also n_links, the number of other ids whose sets are equal or linked."""
    with Scratch(docs.sparkSession) as scratch:
        return scratch.result(_near_duplicates(docs, id_col, text_col, k, percent, max_broadcast_rows, count_links), "near-duplicates")


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int, max_broadcast_rows: int, count_links: bool) -> DataFrame:
    base, member, reps, links = _classes_and_links(docs, id_col, text_col, k, percent, max_broadcast_rows, count_links)
    found = components(links)
    named = member.select("_id", "rep").join(found, F.col("rep") == F.col("node"), "left").select("_id", "rep", F.coalesce("component", "rep").alias("component"))
    out = [
        F.col("_id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("rep", "_id").alias("class_id"), F.coalesce("component", "_id").alias("component_id")
    ]
    if count_links:
        sizes = reps.select("rep", "size")
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        others = both.join(sizes, F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("size").alias("others"))
        counts = sizes.join(others, F.col("rep") == F.col("a"), "left").select("rep", (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
        named = named.join(counts, "rep")
        out.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return base.join(named, "_id", "left").select(*out)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


#: All pairs that share a shingle: for small tables.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, sha256(array_to_string(list_sort(s), chr(10))) AS k, s FROM s),
c AS (SELECT k, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k WHERE n > 0 GROUP BY k),
t AS MATERIALIZED (SELECT id, n, md5_number(x) AS x FROM (SELECT id, n, unnest(s) AS x FROM c)),
o AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.x = b.x AND a.id < b.id AND 100 * b.n >= 80 * a.n AND 100 * a.n >= 80 * b.n
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a, b FROM o UNION ALL SELECT b, a FROM o),
r(id, reach) AS (SELECT id, id FROM c UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reach),
m AS (SELECT id, min(reach) AS component FROM r GROUP BY id)
SELECT doc_id, k.n AS n_shingles, coalesce(m.component, doc_id) AS component_id FROM k LEFT JOIN c ON c.k = k.k AND k.n > 0 LEFT JOIN m ON m.id = c.id
"""
