"""The rule catalogue as a versioned table: which rules were in force at a time.

A row is one version of a rule from ``valid_from`` until ``valid_to`` (null: still
in force). Registering closes the version before and opens a new one; nothing is
ever overwritten, so a scan of any time can be judged by the rules it ran with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY, SINCE, UNTIL = "id", "valid_from", "valid_to"


def changes_of(definitions: DataFrame, at: Column) -> DataFrame:
    """Rows that register definitions (id and any further columns) at a time."""
    return definitions.withColumn("at", at).withColumn("removed", F.lit(False))


def removals_of(ids: DataFrame, at: Column) -> DataFrame:
    """Rows that take rules out at a time."""
    return ids.select(KEY).withColumn("at", at).withColumn("removed", F.lit(True))


def register(versions: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The table after the changes: id, at, removed and the definition's columns.

    All versions of a rule meet in one window, in order of time; a rule has as many
    as it was changed. Registering what is in force already, by the same
    definition, changes nothing, so a batch can be applied again. Of changes at one
    time a removal counts first, then the definition that sorts last.
    """
    fields = [c for c in changes.columns if c not in (KEY, "at", "removed")] if versions is None else [
        c for c in versions.columns if c not in (KEY, SINCE, UNTIL)]
    body = F.struct(*[F.col(c) for c in fields])
    rows = changes.select(KEY, "at", "removed", F.when(~F.col("removed"), F.struct(*[
        F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in fields])).alias("_body"))
    if versions is not None:
        opened = versions.select(KEY, F.col(SINCE).alias("at"), F.lit(False).alias("removed"), body.alias("_body"))
        closed = versions.where(F.col(UNTIL).isNotNull()).select(KEY, F.col(UNTIL).alias("at"), F.lit(True).alias("removed"), F.lit(None).alias("_body"))
        rows = opened.unionByName(closed).unionByName(rows)
    # At one time, the last word counts: a definition over a removal.
    last = rows.groupBy(KEY, "at").agg(F.max(F.struct((~F.col("removed")).alias("stays"), "_body")).alias("w")).select(KEY, "at", "w.*")
    order = Window.partitionBy(KEY).orderBy("at")
    before = last.withColumn("_was", F.lag("_body").over(order)).withColumn("_stood", F.coalesce(F.lag("stays").over(order), F.lit(False)))
    turns = before.where(~(F.col("stays") & F.col("_stood") & F.col("_body").eqNullSafe(F.col("_was"))) & (F.col("stays") | F.col("_stood")))
    return turns.withColumn(UNTIL, F.lead("at").over(order)).where("stays").select(KEY, "_body.*", F.col("at").alias(SINCE), UNTIL)


def as_of(versions: DataFrame, time: Column) -> DataFrame:
    """The rules in force at a time; a version starts with its first moment and ends before its last."""
    return versions.where((F.col(SINCE) <= time) & (F.col(UNTIL).isNull() | (F.col(UNTIL) > time)))
