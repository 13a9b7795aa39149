"""Similarity of files to a corpus of known sources, exact at a threshold.

Texts are compared as sets of word shingles.  To reach the threshold a file must
share at least ``need`` shingles with a source, so it must share one of the
source's ``size - need + 1`` rarest shingles.  Only those prefixes are indexed,
which keeps common shingles out of the join; the overlap of each candidate pair
is then counted exactly.  Nothing is sampled and no candidate list is capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS = 3
DEFAULT_THRESHOLD = 0.85
METRICS = ("containment", "jaccard")


def shingles(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """Distinct hashes of all runs of ``words`` words; a shorter text is one shingle."""
    tokens = F.filter(F.split(F.lower(text), r"[^\p{L}0-9_]+"), lambda w: w != "")

    def runs(t: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(t) - words + 1, F.lit(1)))
        return F.when(F.size(t) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(
            F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(t, i, words), " ")))))

    return F.element_at(F.transform(F.array(tokens), runs), 1)


def _needed(size: Column, threshold: float) -> Column:
    # Guard the ceiling against results like 16.999999999999996 or 17.000000000000004.
    return F.ceil(F.round(size * F.lit(threshold), 9)).cast("int")


def similar_sources(files: DataFrame, sources: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                    metric: str = "containment") -> DataFrame:
    """Pairs (file_id, source_id) at or above the threshold, with their score.

    ``containment``: share of the source's shingles found in the file.
    ``jaccard``: shared shingles over all shingles of both.
    Jaccard >= t implies containment >= t, so both use the same candidates.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric: {metric}")
    files = files.select("file_id", shingles(F.col("code")).alias("f_set"))
    # Equal sources are compared once and expanded at the end.
    sets = sources.select("source_id", F.array_sort(shingles(F.col("text"))).alias("s_set")) \
        .filter(F.size("s_set") > 0).withColumn("group_id", F.sha2(F.to_json("s_set"), 256))
    groups = sets.groupBy("group_id").agg(F.any_value("s_set").alias("s_set"))

    # Rarest first: how many distinct source texts hold each shingle.
    rarity = groups.select(F.explode("s_set").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))
    ranked = (groups.select("group_id", F.explode("s_set").alias("shingle")).join(rarity, "shingle")
              .groupBy("group_id").agg(F.transform(
                  F.array_sort(F.collect_list(F.struct("df", "shingle"))), lambda x: x["shingle"]).alias("ordered")))
    size = F.size("ordered")
    index = ranked.select("group_id", F.explode(
        F.slice("ordered", F.lit(1), size - _needed(size, threshold) + 1)).alias("shingle"))

    # Outer explode: the inner form would evaluate the shingles a second time for its size check.
    candidates = (files.select("file_id", F.explode_outer("f_set").alias("shingle")).join(index, "shingle")
                  .select("file_id", "group_id").distinct())
    counted = (candidates.join(files, "file_id").join(ranked, "group_id")
               .withColumn("shared", F.size(F.array_intersect("f_set", "ordered")))
               .select("file_id", "group_id", "shared", F.size("f_set").alias("f_size"), size.alias("s_size")))
    total = F.col("s_size") if metric == "containment" else F.col("f_size") + F.col("s_size") - F.col("shared")
    matched = (counted.withColumn("similarity_score", F.col("shared") / total)
               .filter(F.round(F.col("similarity_score"), 9) >= threshold))
    risk = F.when(F.col("similarity_score") >= 0.9, "high").otherwise("medium")
    return matched.join(sets.select("group_id", "source_id"), "group_id").select(
        "file_id", "source_id", "shared", "similarity_score", risk.alias("risk_level"))
