"""De-duplication of hits that are already rows (for example after a union of sources)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_per_key(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row per key.

    ``min_by`` combines on the map side, so duplicates of one key shrink to one
    row per task before the shuffle, and no group is ever collected.
    """
    rest = [c for c in hits.columns if c not in keys]
    best = hits.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return best.select(*keys, "_first.*").select(*hits.columns)


def combine(*sources: DataFrame) -> DataFrame:
    """Concatenate hit sources, keeping their order in ``source_ord``."""
    out = None
    for i, source in enumerate(sources):
        tagged = source.withColumn("source_ord", F.lit(i))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out
