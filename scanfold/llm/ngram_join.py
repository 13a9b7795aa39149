"""N-gram Jaccard join with token-combination prefixes (operator 7).

A document is the set of 64-bit hashes of its word shingles; documents with
equal sets are one node. Two nodes can only reach the Jaccard threshold if they
share a token among the first p = n - ceil(t * n) + 1 of each, in any order of
tokens that holds for all; the order here is that of the hash. Prefixes are
extended by k - 1 tokens, so that a pair must share k of them:

1. The extended prefixes are indexed; tokens of one node only are left out, and
   sets too small to be like any other set (under 9 tokens for 0.9).
2. Star rounds: a node is compared with the node that leads most of its prefix,
   each token being led by one of its nodes: in turn the most central one (whose
   tokens the most nodes have, such as the text that copies were made from) and
   any. Verified pairs are links, and their
   components are found. Large groups of near copies collapse here at a cost in
   proportion to their size. Nodes of one leader that aren't both like it are
   paired by what their sets differ in from the leader's; later steps compare
   nodes of different leaders only. Rounds go on, with other leaders, while
   leaders link a quarter of the nodes that are open.
3. What is left: tokens whose nodes lie in several components and have several
   leaders, and nodes that have k such tokens; no other node can have a link that is missing. The first
   of k tokens that a pair shares, in order of their number of nodes, is among
   the first l - k + 1 of each node's l. A rare token pairs its nodes at once.
4. Nodes that meet at a frequent token are taken with their whole sets, in
   order of the tokens' number of nodes, so that what copies of one text have
   in common comes last. The larger set of a pair shows its prefix under the
   size classes that partners may have, the smaller one under its own: a set
   with too many tokens of its own has no common token in its prefix. Tokens
   that still are frequent are joined with each later one to combinations of two,
   of which the frequent ones take a third, and on up to k. A key pairs nodes of
   different components whose sizes and positions leave room for the common
   tokens they need. All pairs are verified on whole sets.

So no link is lost, while pairs within a group are never listed. Nothing is
capped: FREQUENT, CLASSES and GAIN only choose how tokens are indexed. Tables
that a step has made use of are deleted once their successor is written.

Null and empty texts and texts without words have the empty set and link with
nothing; a text of fewer words than a shingle is one token. Rows with equal
doc_id count as one document where one is to stay; a null doc_id takes part,
but doesn't name a component. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.components import components
from scanfold.sources.tables import discard, staged, table

#: Prefix tokens of more nodes than this are frequent. A key of whole sets is, if it makes more than the square of
#: this in pairs and more than GAIN times the longer keys that it would become.
FREQUENT, GAIN = 30, 16
#: Size classes for each factor e of the size.
CLASSES = 50
#: Star rounds at most; what they leave is found in step 3 whatever their number.
STAR_ROUNDS = 8
#: So many ids, 24 bytes each, are broadcast at most to fetch texts; more are joined by shuffle.
BROADCAST_IDS = 200_000


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z in lower case."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    x = np.zeros(n, np.uint64)
    for j in range(size):
        x = (x ^ h[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(32)))


def prefix(n: int, percent: int) -> int:
    """Tokens of a set of n that must hold one of any partner's."""
    return n - least_size(n, percent) + 1


def least_size(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def extension(n: int, percent: int) -> int:
    """k: tokens that the extended prefixes of two sets of n share at least."""
    return min(4 + prefix(n, percent) // 5, least_size(n, percent))


def shared_least(n: int, percent: int) -> int:
    """k for the smallest partner that a set of n can have: what it shares with any partner at least."""
    return extension(least_size(n, percent), percent)


def smallest(percent: int) -> int:
    """Least size of a set that can be like a different one: n / (n + 1) must reach the threshold."""
    return -(-percent // (100 - percent)) if percent < 100 else 1 << 62


SET_SCHEMA = "doc_id long, th long, n long, node long, k long, tokens array<long>"


def _sets(size: int, percent: int, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(doc_id, th, text) to set sizes, node ids and either the extended prefix or the whole set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, node, k, tokens, ends = [], [], [], [], [0]
                for text in part.column(2):
                    s = shingle_set(text.as_py(), size)
                    m = len(s)
                    n.append(m)
                    node.append(xxhash.xxh64_intdigest(s.tobytes(), m) if m else 0)
                    k.append(shared_least(m, percent) if m else 0)
                    tokens.append(s if whole else s[:prefix(m, percent) + extension(m, percent) - 1] if m else s)
                    ends.append(ends[-1] + len(tokens[-1]))
                values = pa.array(np.concatenate(tokens).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(n, pa.int64()),
                     pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(k, pa.int64()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)],
                    ["doc_id", "th", "n", "node", "k", "tokens"])
    return run


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"),
                       F.col("text").cast("binary").alias("text"))


def _whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(node, n, tokens): the whole sets of ``wanted`` nodes, from one text each."""
    ids = staged(wanted.select("node").distinct().join(nodes, "node").select(
        F.col("label").alias("id"), F.col("th").alias("hash")))
    known = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = _keyed(docs)
    texts = rows.join(known, (rows["th"] == known["hash"]) & rows["doc_id"].eqNullSafe(known["id"])).select(
        "doc_id", "th", "text")
    sets = staged(texts.mapInArrow(_sets(size, percent, True), SET_SCHEMA).select("node", "n", "tokens").dropDuplicates(["node"]))
    discard(ids)
    return sets


def _like(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets reach the threshold."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("tokens").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("t_a", "t_b"))
    return staged(both.where(common * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))).select("a", "b"))


def _compared(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(a, b, n, m, like, diff): nodes a and their leaders b, the sizes of their sets, whether these reach the threshold, and
    the tokens that one of the two alone has, null where these are more than either's own; ``pairs`` is discarded."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = _whole_sets(ends, nodes, docs, size, percent)
    both = pairs.join(sets.select(F.col("node").alias("a"), "n", F.col("tokens").alias("t")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("u")), "b")
    diff = F.concat(F.array_except("t", "u"), F.array_except("u", "t"))
    common = (F.col("n") + F.col("m") - F.size("diff")) / 2
    out = staged(both.withColumn("diff", diff).select(
        "a", "b", "n", "m", (common * (100 + percent) >= percent * (F.col("n") + F.col("m"))).alias("like"),
        F.when(F.size("diff") <= F.least("n", "m"), F.col("diff")).alias("diff")))
    for done in (pairs, sets):
        discard(done)
    return out


def _diff_pairs(near: DataFrame, percent: int) -> DataFrame:
    """(a, b): the pairs of nodes of one leader that reach the threshold, but for those where both do so with the leader.

    The sets x and y of two nodes differ in what their differences d and e from the leader's set differ in, so they
    have (|d| + |e| - h) / 2 tokens of d and e in common or more, if x and y may differ in h = r * (|x| + |y|) tokens,
    r = (100 - percent) / (100 + percent). That is |d| - h at least, and if y isn't like the leader's set z, so that
    |e| > r * (|y| + |z|), more than (|d| + r * (|z| - |x|)) / 2. Differences that nobody shares can't make that up:
    copies that differ from their original each in its own way are told apart without listing their pairs.
    """
    held = near.select("a", "b", F.explode("diff").alias("token"))
    counts = held.groupBy("b", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    d, r = F.size("diff"), (100 - percent) / (100 + percent)
    most = F.floor((F.col("n") + F.floor(F.col("n") * 100 / percent)) * r + 1e-9)
    far = F.greatest(d - most, F.lit(1))
    half = F.greatest(F.floor((d + (F.col("m") - F.col("n")) * r) / 2 - 1e-9) + 1, far)
    ranked = held.join(counts, ["b", "token"]).groupBy("a").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts"))
    sets = staged(near.select("a", "b", "n", "like", "diff", far.alias("far"), half.alias("half")).join(ranked, "a").select(
        "a", "b", "n", "like", F.size("diff").alias("d"), "far", "half", F.transform("ts", lambda t: t["token"]).alias("ts")).where(
        F.size("ts") >= F.when(F.col("like"), F.col("half")).otherwise(F.col("far"))))

    def view(rows: DataFrame, least: str, x: str) -> DataFrame:
        first = F.slice("ts", F.lit(1), F.greatest(F.size("ts") - F.col(least) + 1, F.lit(0)).cast("int"))
        return rows.select("b", F.posexplode(first).alias(f"at_{x}", "token"), F.size("ts").alias(f"c_{x}"),
                           *[F.col(c).alias(f"{c}_{x}") for c in ("a", "n", "d")])

    room = F.least(F.col("c_x") - F.col("at_x"), F.col("c_y") - F.col("at_y"))
    fits = ((F.least("n_x", "n_y") * 100 >= F.greatest("n_x", "n_y") * percent)
            & (2 * room >= F.col("d_x") + F.col("d_y") - (F.col("n_x") + F.col("n_y") - 2 * _needed("n_x", "n_y", percent))))
    pair = lambda x, y: x.join(y, ["b", "token"]).where(fits).select(F.col("a_x").alias("x"), F.col("a_y").alias("y"))
    unlike, like = sets.where("not like"), sets.where("like")
    pairs = staged(pair(view(unlike, "half", "x"), view(unlike, "half", "y")).where("x < y").union(
        pair(view(like, "half", "x"), view(unlike, "far", "y"))).distinct())
    side = lambda x: sets.select(F.col("a").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "d", "ts")])
    total = F.col("n_x") + F.col("n_y")
    common = (total - F.col("d_x") - F.col("d_y")) / 2 + F.size(F.array_intersect("ts_x", "ts_y"))
    out = staged(pairs.join(side("x"), "x").join(side("y"), "y").where(common * (100 + percent) >= percent * total).select(
        F.col("x").alias("a"), F.col("y").alias("b")))
    for done in (sets, pairs):
        discard(done)
    return out


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b), a written table, of nodes whose whole sets reach the threshold; ``pairs`` is discarded."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    sets = _whole_sets(ends, nodes, docs, size, percent)
    like = _like(pairs, sets, percent)
    for done in (pairs, sets):
        discard(done)
    return like


def _live(hits: DataFrame, comps: DataFrame | None, homes: DataFrame) -> DataFrame:
    """hits of tokens whose nodes lie in several components and parts, for nodes with k such tokens.

    No two nodes of a part need comparing: those of one leader (node, home), else those of a component."""
    if comps is None:
        return hits
    comps = comps.select("node", F.col("comp").alias("joined"))
    now = hits.drop("comp", "part").join(comps.join(homes, "node", "full"), "node", "left").withColumn(
        "comp", F.coalesce("joined", "node")).withColumn("part", F.coalesce("home", "comp")).drop("joined", "home")
    split = now.groupBy("token").agg(*[g(c).alias(g.__name__ + c) for c in ("comp", "part") for g in (F.min, F.max)]).where(
        "mincomp <> maxcomp and minpart <> maxpart").select("token")
    open_ = now.join(split, "token")
    enough = open_.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("k").alias("k")).where("c >= k").select("node")
    return staged(open_.join(enough, "node"))


def _star_pairs(live: DataFrame, turn: int) -> DataFrame:
    """(a, b): nodes and their tokens' leaders of another component, where one leads most of a node's prefix.

    That is three quarters; for the leaders of more than FREQUENT nodes over half, so that few of a large group stay out.
    """
    counts = live.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    central = live.join(counts, "token").groupBy("node").agg((F.sum("df") / F.first("e")).alias("score"))
    order = F.col("score") if turn % 2 == 0 else F.xxhash64(F.lit(turn), "node")
    lead = F.max(F.struct(order.alias("o"), F.col("node").alias("b"), F.col("comp").alias("bc")))
    leaders = live.join(central, "node").groupBy("token").agg(lead.alias("lead")).select("token", "lead.b", "lead.bc")
    led = live.join(leaders, "token").where("comp <> bc").groupBy(F.col("node").alias("a"), "b").agg(
        F.count(F.lit(1)).alias("c"), F.first("e").alias("e")).where("2 * c > e")
    great = led.where("4 * c >= 3 * e").groupBy("b").agg(F.count(F.lit(1)).alias("led")).where(F.col("led") > FREQUENT)
    return led.join(great, "b", "left").where("4 * c >= 3 * e or led is not null").select("a", "b")


def always_shared(percent: int) -> int:
    """Tokens that the extended prefixes of any two sets that are like each other share."""
    first = smallest(percent)
    return min(shared_least(n, percent) for n in range(first, first + 200)) if percent < 100 else 1


def _rare_pairs(live: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(a, b): pairs by the rare tokens of the extended prefixes; (node, comp, part): the nodes that meet at frequent ones.

    The first of k tokens that a pair shares is among the first l - k + 1 of each node's l.
    """
    counts = live.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    ranked = live.join(counts, "token").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("comp", "part", "n", "k", "e")],
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts")).withColumn("all", F.size("ts"))
    kept = ["node", "comp", "part", "n", "e", "all"]
    first = F.slice(F.transform("ts", lambda t: t["token"]), F.lit(1), (F.col("all") - F.col("k") + 1).cast("int"))
    entries = staged(ranked.select(*kept, F.posexplode(first).alias("at", "key")))
    keys = entries.groupBy("key", "part").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    keys = keys.groupBy("key").agg(F.sum("c").alias("g"), F.max("c").alias("most"), F.max_by("part", "c").alias("main"),
                                   F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("g > most and lo <> hi")
    keys = staged(keys.select("key", "main", (F.least(F.col("g"), F.col("g") - F.col("most") + 1) > FREQUENT).alias("frequent")))
    met = entries.join(keys.where("not frequent").select("key", "main"), "key")
    a = met.where("part <> main").select("key", *[F.col(c).alias(f"a_{c}") for c in (*kept, "at")])
    b = met.select("key", "main", *[F.col(c).alias(f"b_{c}") for c in (*kept, "at")])
    least = _needed("a_n", "b_n", percent) - F.greatest(F.col("a_n") - F.col("a_e"), F.col("b_n") - F.col("b_e"))
    fits = ((F.col("a_comp") != F.col("b_comp")) & (F.col("a_part") != F.col("b_part"))
            & ((F.col("a_node") < F.col("b_node")) | (F.col("b_part") == F.col("main")))
            & (F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
            & (F.least(F.col("a_all") - F.col("a_at"), F.col("b_all") - F.col("b_at")) >= least))
    pairs = staged(a.join(b, "key").where(fits).select(
        F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct())
    crowded = staged(entries.join(keys.where("frequent").select("key"), "key").select("node", "comp", "part").distinct())
    for done in (entries, keys):
        discard(done)
    return pairs, crowded


def _needed(x: str, y: str, percent: int) -> Column:
    """Tokens that sets of x and y tokens must share to be like each other."""
    return F.ceil((F.col(x) + F.col(y)) * percent / (100 + percent))


def _frequent_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): all pairs of whole sets (node, comp, n, tokens) of different components that can be like each other.
    With a column ``part``, those of different parts alone.

    Tokens are in order of their number of nodes, those of one component alone in front. The smaller set of a pair
    (``probe`` false) shows itself under its size class, the larger one under each class that its partner may have,
    with just the tokens that can be the first shared ones for that class. Keys that would make too many pairs take
    one more token, up to k.
    """
    if "part" not in sets.columns:
        sets = sets.withColumn("part", F.col("comp"))
    held = sets.select("node", "comp", "part", "n", F.explode("tokens").alias("token"))
    counts = held.groupBy("token").agg(F.count(F.lit(1)).alias("df"), *[g(c).alias(g.__name__ + c) for c in ("comp", "part") for g in (F.min, F.max)]).where(
        "mincomp <> maxcomp and minpart <> maxpart").select("token", "df")
    k = always_shared(percent)
    least = F.ceil(F.col("n") * percent / 100)
    ranked = staged(held.join(counts, "token").groupBy("node").agg(
        *[F.first(c).alias(c) for c in ("comp", "part", "n")],
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ts")).where(F.size("ts") >= least).select(
        "node", "comp", "part", "n", (F.col("n") - F.size("ts")).alias("alone"), F.slice(
            F.transform("ts", lambda t: t["token"]), F.lit(1), (F.size("ts") - least + k).cast("int")).alias("tokens")))
    grade = lambda m: F.floor(F.log(m.cast("double")) * CLASSES).cast("int")
    own = ranked.select("*", F.lit(False).alias("probe"), grade(F.col("n")).alias("grade"), F.col("n").alias("m"))
    other = ranked.select("*", F.lit(True).alias("probe"), F.explode(F.sequence(grade(least), grade(F.col("n")))).alias("grade"))
    other = other.withColumn("m", F.least(F.greatest(least, F.floor(F.exp(F.col("grade") / CLASSES))), F.col("n")))
    views = staged(own.unionByName(other).withColumn(
        "room", (F.col("n") - F.col("alone") - _needed("n", "m", percent)).cast("int")).where("room >= 0").drop("m"))
    seen = ["node", "comp", "part", "n", "alone", "probe", "grade", "room"]
    entries = views.select(*seen, F.posexplode(F.slice("tokens", F.lit(1), F.col("room") + 1)).alias("at", "token")).select(
        *seen, "at", F.xxhash64("grade", "token").alias("key"))
    found, spent = [], [ranked, views]
    for size in range(1, k + 1):
        keys = entries.groupBy("key", "part").agg(
            F.count_if(~F.col("probe")).alias("i"), F.count_if("probe").alias("p"),
            F.sum(F.col("room") + size - F.col("at")).alias("more")).groupBy("key").agg(
            (F.sum("i") * F.sum("p") - F.sum(F.col("i") * F.col("p"))).alias("made"),
            F.max_by("part", F.col("i") + F.col("p")).alias("main"), F.sum("more").alias("more")).where("made > 0")
        grows = (F.col("made") > FREQUENT * FREQUENT) & (F.col("made") > GAIN * F.col("more")) & F.lit(size < k)
        keys = staged(keys.select("key", "main", grows.alias("grows")))
        spent.append(keys)
        met = entries.join(keys.where("not grows").select("key", "main"), "key")
        side = lambda x: met.where(F.col("probe") == (x == "b")).select(
            "key", "main", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "comp", "part", "n", "alone", "at")])
        a, b = side("a"), side("b").drop("main")
        ends = F.least(F.col("a_n") - F.col("a_alone") - F.col("a_at"), F.col("b_n") - F.col("b_alone") - F.col("b_at"))
        fits = ((F.col("a_comp") != F.col("b_comp")) & (F.col("a_part") != F.col("b_part")) & (F.col("a_n") * 100 >= F.col("b_n") * percent)
                & ((F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a_node") < F.col("b_node"))))
                & (size - 1 + ends >= _needed("a_n", "b_n", percent)))
        rest = side("b").where("b_part <> main").drop("main")
        both = a.where("a_part <> main").join(b, "key").unionByName(a.where("a_part = main").join(rest, "key"))
        found.append(staged(both.where(fits).select(
            F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()))
        open_ = keys.where("grows")
        if size == k or open_.isEmpty():
            break
        more = entries.join(open_.select("key"), "key").select("node", "probe", "grade", "key", "at").join(
            views, ["node", "probe", "grade"])
        grown = more.select(*seen, "key", "at", F.posexplode(F.slice(
            "tokens", F.col("at") + 2, F.col("room") + size - F.col("at"))).alias("step", "token"))
        entries = staged(grown.select(*seen, (F.col("at") + F.col("step") + 1).alias("at"),
                                      F.xxhash64("key", "token").alias("key")))
        spent.append(entries)
    pairs = staged(reduce(DataFrame.union, found).distinct())
    for done in (*spent, *found):
        discard(done)
    return pairs


def link(docs: DataFrame, size: int = 3, percent: int = 90) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    docs = docs.select("doc_id", "text")
    rows = staged(_keyed(docs).mapInArrow(_sets(size, percent, False), SET_SCHEMA))
    filled = rows.where("n > 0")
    nodes = staged(filled.groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x"), F.min("doc_id").alias("least")).select(
        "node", F.col("x.doc_id").alias("label"), F.col("x.th").alias("th"), "least"))
    heads = staged(filled.where(F.col("n") >= smallest(percent)).select("node", "n", "k", "tokens").dropDuplicates(["node"]))
    index = heads.select("node", "n", "k", F.size("tokens").alias("e"), F.explode("tokens").alias("token"))
    shared = index.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    hits = staged(index.join(shared, "token").withColumns({"comp": F.col("node"), "part": F.col("node")}))
    enough = hits.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.first("k").alias("k")).where("c >= k").select("node")
    live = staged(hits.join(enough, "node"))
    for done in (heads, hits):
        discard(done)
    edges = comps = homes = None
    for turn in range(STAR_ROUNDS):
        met = _compared(staged(_star_pairs(live, turn)), nodes, docs, size, percent)
        near = met.where("diff is not null")
        if homes is not None:
            near = near.join(homes.select(F.col("node").alias("a")), "a", "left_anti")
        links = met.where("like").count()
        found = staged(met.where("like").select("a", "b").union(_diff_pairs(near, percent)))
        if not found.isEmpty():
            own = near.select(F.col("a").alias("node"), F.xxhash64("b", F.lit(turn)).alias("home"))
            heads = near.select(F.col("b").alias("node"), F.xxhash64("b", F.lit(turn)).alias("home")).distinct()
            known = own if homes is None else homes.union(own)
            homes = staged(known.union(heads.join(known.select("node"), "node", "left_anti")))
            edges = found if edges is None else edges.union(found)
            comps, left = staged(components(edges)), live
            live = _live(left, comps, homes)
            discard(left)
        discard(met)
        if links * 4 <= live.select("node").distinct().count():
            break
    pairs, crowded = _rare_pairs(live, percent)
    rest = _verified(pairs, nodes, docs, size, percent)
    if not crowded.isEmpty():
        sets = _whole_sets(crowded, nodes, docs, size, percent)
        pairs = _frequent_pairs(crowded.join(sets, "node"), percent)
        rest = rest.union(_like(pairs, sets, percent))
        for done in (sets, pairs):
            discard(done)
    if not rest.isEmpty():
        edges = rest if edges is None else edges.union(rest)
        comps = staged(components(edges))
    named = nodes.select("node", "least")
    if comps is not None:
        whole = named.join(comps, "node", "left").select("node", "least", F.coalesce("comp", "node").alias("comp"))
        least = whole.groupBy("comp").agg(F.min("least").alias("component_id"))
        named = whole.join(least, "comp").select("node", "component_id")
    else:
        named = named.withColumnRenamed("least", "component_id")
    out = rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(named, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents of a component other than its first."""
    gone = staged(link(docs, size, percent).where(F.col("component_id") < F.col("doc_id")).select(
        F.col("doc_id").alias("gone_id")).distinct())
    known = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(known, docs["doc_id"] == known["gone_id"], "left_anti")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"), 3, 90)
