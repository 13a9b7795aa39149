"""Narrow tables that meet the files' narrow rows.

Files leave their text behind (``contents``) before they meet their organisation's or
repository's settings. A table that is small enough is broadcast; a larger one is met
by a shuffle of narrow rows. Both are one pass over the files.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.sources.tables import shared_folder, staged

#: Bytes of a part, by the size of its rows' texts.
PART_BYTES = 16 << 20


def parts_of(rows: DataFrame, size: Column, most: int | None = None) -> list[DataFrame]:
    """The rows in parts of at most ``most`` bytes by ``size``, a row that is larger in one with few others.

    Rows are dealt by hash, so keys of any skew give even parts; the sizes are
    summed and checked, with more parts if one came out too large.
    """
    spark, most = rows.sparkSession, PART_BYTES if most is None else most
    path = shared_folder(spark)
    rows.withColumn("_size", size.cast("bigint")).write.parquet(f"{path}-rows")
    written = spark.read.parquet(f"{path}-rows")
    whole, largest = written.agg(F.coalesce(F.sum("_size"), F.lit(0)), F.coalesce(F.max("_size"), F.lit(0))).first()
    if whole <= most:
        return [written.drop("_size")]
    n = -(-2 * whole // most)
    number = lambda n: F.pmod(F.xxhash64(*[F.to_json(F.struct(*written.columns))]), F.lit(n))
    while written.groupBy(number(n)).agg(F.sum("_size").alias("s")).agg(F.max("s")).first()[0] > max(most, 2 * largest):
        n *= 2
    written.withColumn("_part", number(n)).drop("_size").write.partitionBy("_part").parquet(path)
    found = sorted(r[0] for r in spark.read.parquet(path).select("_part").distinct().collect())
    return [spark.read.schema(written.drop("_size").schema).parquet(os.path.join(path, f"_part={k}")) for k in found]


def meet(rows: DataFrame, small: DataFrame, keys: list[str], size: Column | None = None, most: int | None = None) -> DataFrame:
    """Narrow rows with those of a written table that have equal keys; null keys meet null keys.

    The table is broadcast if its rows' texts, or their ``size``, are measured to be within
    ``most`` bytes; a larger one is met by one shuffle of both on the keys. Either way it
    is one pass over the rows, however many keys there are.
    """
    size = F.octet_length(F.to_json(F.struct(*small.columns))) if size is None else size
    whole = small.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    named = small.select(*[F.col(k).alias(f"_own_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    named = F.broadcast(named) if whole <= (PART_BYTES if most is None else most) else named.hint("shuffle_hash")
    meets = F.lit(True)
    for k in keys:
        meets = meets & F.col(k).eqNullSafe(F.col(f"_own_{k}"))
    return rows.join(named, meets).drop(*[f"_own_{k}" for k in keys])


def with_settings(files: DataFrame, settings: DataFrame, keys: list[str], size: Column, most: int | None = None) -> list[DataFrame]:
    """Narrow file rows, without their text, with the settings of their keys; one DataFrame, whatever the number of settings."""
    return [meet(files, staged(settings), keys, size, most)]


def together(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for more in frames[1:]:
        whole = whole.unionByName(more)
    return whole
