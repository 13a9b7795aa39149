"""Order MinHash fingerprints (operator 4).

A text's elements are its runs of K words, each with the number of equal runs
before it. Every element has a 64-bit hash; the hash's top bits deal the
elements to bins (one permutation instead of one per bin), and each bin selects
its SIZE = 2 smallest. The selected runs, in the order in which they stand in
the text, are hashed as a tuple: the bin's part of the signature. Moving,
inserting or repeating passages changes order or numbering and so the tuples,
which plain MinHash would not see. The likeness of two fingerprints is the
share of equal parts among the bins that either has.

All work stays inside the row. Neighbours in order of doc_id are found by
dealing rows to ranges of doc_id; the first row of each range also goes, as a
guest, to the range it follows, so that no range needs another.

A null text counts as empty; texts of fewer than K words are one element;
texts without words have the empty fingerprint, which is like itself only.
Null ids come last, rows with equal ids are ordered by their text's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanfold.llm.common import count_up, fresh, let, words_of
from scanfold.sources.tables import table

K = 5
BITS = 6
#: Rows per range of ids, and the most ranges; more rows make longer ranges then.
RANGE_ROWS, MOST_RANGES = 2_000, 65_536
LOWEST = -(1 << 63)


def _bin(h: Column) -> Column:
    return F.shiftright(h, 64 - BITS)


def _runs(words: Column, k: int) -> Column:
    whole = F.array(F.xxhash64(words))
    return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).when(F.size(words) < k, whole).otherwise(
        F.transform(count_up(F.size(words) - (k - 1)), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])))


def _numbered(runs: Column) -> Column:
    """Elements (h, i, g): hash of run and number, place in the text, hash of the run."""
    def element(g: Column, n: Column, i: Column) -> Column:
        return F.struct(F.xxhash64(g, n).alias("h"), i.alias("i"), g.alias("g"))

    def repeated(pairs: Column) -> Column:
        # among sorted pairs, the equal ones before a pair are counted by halving steps
        def before(g: Column, j: Column) -> Column:
            return F.aggregate(F.array(*[F.lit(1 << s) for s in range(21, -1, -1)]), F.lit(0), lambda n, step: F.when(
                (j - n - step >= 0) & (F.get(pairs, j - n - step)["g"] == g), n + step).otherwise(n))

        def number(p: Column, j: Column) -> Column:
            same = (j > 0) & (F.get(pairs, j - 1)["g"] == p["g"])
            return element(p["g"], F.when(same, before(p["g"], j)).otherwise(F.lit(0)), p["i"])
        return F.transform(pairs, number)

    def of(gs: Column) -> Column:
        plain = F.transform(gs, lambda g, i: element(g, F.lit(0), i))
        pairs = F.sort_array(F.transform(gs, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(gs)) == F.size(gs), plain).otherwise(let(pairs, repeated))

    return let(runs, of)


def fingerprint(text: Column, k: int = K) -> Column:
    """Array of longs, one per bin that has elements: the bin's number and 32 bits of its tuple's hash."""
    def smallest(xs: Column) -> Column:
        return F.filter(xs, lambda x, i: F.coalesce(_bin(F.get(xs, i - 2)["h"]) != _bin(x["h"]), F.lit(True)))

    def tuples(xs: Column) -> Column:
        def part(x: Column, i: Column) -> Column:
            y = F.get(xs, i + 1)
            alone = F.coalesce(_bin(y["h"]) != _bin(x["h"]), F.lit(True))
            hashed = F.when(alone, F.xxhash64(x["g"])).when(
                x["i"] < y["i"], F.xxhash64(x["g"], y["g"])).otherwise(F.xxhash64(y["g"], x["g"]))
            first = F.coalesce(_bin(F.get(xs, i - 1)["h"]) != _bin(x["h"]), F.lit(True))
            label = (_bin(x["h"]) + (1 << (BITS - 1))) * (1 << 32)
            return F.when(first, label + F.shiftrightunsigned(hashed, 32))
        return F.filter(F.transform(xs, part), lambda p: p.isNotNull())

    words = words_of(text)
    return let(words, lambda w: let(F.sort_array(_numbered(_runs(w, k))), lambda xs: let(smallest(xs), tuples)))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal parts among the bins of either fingerprint; 1 for two empty ones."""
    def number(x: Column) -> Column:
        return F.transform(x, lambda p: F.shiftright(p, 32))
    bins = F.size(F.array_union(number(a), number(b)))
    return F.when(bins == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / bins)


def as_text(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.lpad(F.lower(F.hex(p)), 10, "0")), "")


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id") -> DataFrame:
    """docs with next_<column> of the next row in descending order of id; the first follows the last."""
    place = F.coalesce(F.col(id_col).cast("bigint"), F.lit(LOWEST))
    ids = docs.select(place.alias("s"))
    n = ids.count()
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))
    cuts = sorted(set((ids.agg(F.percentile_approx("s", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] or [])
                      if ranges > 1 else []))
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")

    def range_of(s: Column) -> Column:
        steps = [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]
        return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(
            F.coalesce(F.get(bounds, at + step - 1) <= s, F.lit(False)), at + step).otherwise(at)) if cuts else F.lit(0)

    # at most MOST_RANGES rows, which name the first id of each range and the range whose last row it follows
    heads = sorted(ids.groupBy(range_of(F.col("s")).alias("r")).agg(F.max("s")).collect())
    head, above = [LOWEST] * (len(cuts) + 1), [0] * (len(cuts) + 1)
    for k, (r, s) in enumerate(heads):
        head[r], above[r] = s, heads[(k + 1) % len(heads)][0]
    s, r, guest, deal, order = (fresh(docs, x) for x in ("place", "range", "guest", "deal", "order"))
    keyed = docs.withColumn(s, place).withColumn(r, range_of(F.col(s)))
    known = lambda xs: F.array(*map(F.lit, xs))
    own = F.struct(F.col(r).alias("r"), F.lit(False).alias("guest"))
    extra = F.struct(F.get(known(above), F.col(r)).cast("int").alias("r"), F.lit(True).alias("guest"))
    dealt = keyed.withColumn(deal, F.explode(F.when(F.col(s) == F.get(known(head), F.col(r)), F.array(own, extra)).otherwise(
        F.array(own)))).select("*", F.col(deal)["r"].alias(order), F.col(deal)["guest"].alias(guest))
    window = Window.partitionBy(order).orderBy(guest, F.desc(s), F.xxhash64(*columns))
    return dealt.select("*", *[F.lead(c).over(window).alias(f"next_{c}") for c in columns]).where(~F.col(guest)).select(
        *docs.columns, *[f"next_{c}" for c in columns])


def edited(text: Column, following: Column) -> Column:
    """text whose last half is replaced by as much of the beginning of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, fingerprint_col: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of their text as hex; a column of that name is replaced."""
    return docs.withColumn(fingerprint_col, as_text(fingerprint(F.col("text"))))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    pairs = with_next(docs.withColumn("f", fingerprint(F.col("t"))), ["t", "f"])
    made = pairs.select("doc_id", F.char_length("t").cast("bigint").alias("n_chars"), "f", "next_f",
                        edited(F.col("t"), F.col("next_t")).alias("e"))
    both = made.select("doc_id", "n_chars", "f", "next_f", F.sha2("e", 256).alias("edited_sha256"),
                       fingerprint(F.col("e")).alias("ef"))
    return both.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("f")).alias("fingerprint"),
                       as_text(F.col("ef")).alias("edited_fingerprint"), likeness(F.col("f"), F.col("ef")).alias("near_edited"),
                       likeness(F.col("f"), F.col("next_f")).alias("near_next"))
