"""As-of join: for each row the newest version of its key at or before its position."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanfold.sources.tables import staged


def as_of(rows: DataFrame, versions: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``rows`` with ``version``, a struct of the further columns of ``versions``; null where no version is old enough.

    Both sides are sorted together by range of key and position, so a key that
    owns most versions is spread over many partitions. Within a partition the
    newest version so far is a running value. The last version of each key and
    partition is carried on to the partitions after it: a table with a row per
    key and partition, which is joined back where a key crosses a border.

    Versions of one key at one position: the one whose columns sort last counts.
    A row whose key is null has no version. Equal rows stay separate rows.
    """
    spark = rows.sparkSession
    here = F.struct(*[c for c in rows.columns if c not in (*keys, position)]).alias("_row")
    fields = [c for c in versions.columns if c not in (*keys, position)]
    other = F.struct(*fields).alias("_version")
    left = rows.select(*keys, position, F.lit(1).alias("_side"), here)
    right = versions.select(*keys, position, F.lit(0).alias("_side"), other)
    order = [*keys, position, "_side", "_version", "_row"]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = staged(right.unionByName(left, allowMissingColumns=True).repartitionByRange(parts, *order)
                   .sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("_part", F.shiftright("_at", 33))

    ends = dealt.where("_side = 0").groupBy(*keys, "_part").agg(F.max_by("_version", "_at").alias("_last"))
    asked = dealt.where("_side = 1").select(*keys, "_part").distinct().withColumn("_last", F.lit(None).cast(ends.schema["_last"].dataType))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    borders = ends.unionByName(asked).groupBy(*keys, "_part").agg(F.first("_last", ignorenulls=True).alias("_last"))
    carried = borders.withColumn("_carried", F.last("_last", ignorenulls=True).over(before)).where("_carried IS NOT NULL").select(
        *keys, "_part", "_carried")

    so_far = Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.withColumn("_near", F.last("_version", ignorenulls=True).over(so_far)).where("_side = 1")
    keyed = F.lit(True)
    for k in keys:
        keyed = keyed & F.col(k).isNotNull()
    return found.join(carried, [*keys, "_part"], "left").select(
        *keys, position, "_row.*", F.when(keyed, F.coalesce("_near", "_carried")).alias("version"))
