"""Audit log: query, export, creation from scans, resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.sources.sinks import commit, committed

# --- Fixed values: export columns and page size ------------------------------
EXPORT_COLUMNS = ("id", "timestamp", "event_type", "org", "repo", "pr_number", "commit_sha", "author",
                  "action_taken", "violations_count", "resolution_state")
DEFAULT_PAGE = 100


def filtered(logs: DataFrame, org=None, repo=None, event_type=None, action_taken=None,
             start=None, end=None) -> DataFrame:
    """AND of the given predicates; both time bounds are inclusive."""
    for name, value in (("org", org), ("repo", repo), ("event_type", event_type), ("action_taken", action_taken)):
        if value:
            logs = logs.filter(F.col(name) == value)
    if start is not None:
        logs = logs.filter(F.col("timestamp") >= start)
    if end is not None:
        logs = logs.filter(F.col("timestamp") <= end)
    return logs


def page(logs: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0) -> DataFrame:
    """Newest first; the id breaks ties.  Planned as a top-k, not as a full sort."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must not be negative")
    return logs.orderBy(F.desc("timestamp"), "id").offset(offset).limit(limit)


def write_by_day(logs: DataFrame, path: str) -> None:
    """Store entries in a partition for each day, for ``page_after``."""
    (logs.withColumn("day", F.col("timestamp").cast("date")).repartition("day", F.pmod(F.xxhash64("id"), F.lit(8)))
     .write.mode("append").partitionBy("day").parquet(path))


def page_after(logs: DataFrame, cursor: tuple[str, str] | None, limit: int = DEFAULT_PAGE, **filters) -> DataFrame:
    """The page that follows a cursor, the (timestamp, id) of the row last seen; newest first, the id breaks ties.

    ``logs`` has a partition column ``day``. Days are taken from the cursor's
    backwards until they hold a page: first as many as have ``limit`` rows, by the
    days' sizes, which stand in the files' footers, then four times as many as long
    as the filters leave too few. Other partitions are not read, so the millionth
    page costs what the first one does.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    sizes = logs.groupBy(F.col("day").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n")).collect()
    days = sorted(((r["day"], r["n"]) for r in sizes if cursor is None or r["day"] <= cursor[0][:10]), reverse=True)
    rows = filtered(logs, **filters)
    if cursor is not None:
        at, last = F.lit(cursor[0]).cast("timestamp_ntz"), F.lit(cursor[1])
        rows = rows.where((F.col("timestamp") < at) | ((F.col("timestamp") == at) & (F.col("id") > last)))
    wanted = limit
    while True:
        taken, held = 0, 0
        while taken < len(days) and held < wanted:
            held += days[taken][1]
            taken += 1
        newest, oldest = (days[0][0], days[taken - 1][0]) if taken else ("0001-01-01", "0001-01-01")
        part = rows.where(F.col("day").between(F.lit(oldest).cast("date"), F.lit(newest).cast("date")))
        if taken == len(days) or part.limit(limit).count() == limit:
            return part.orderBy(F.desc("timestamp"), "id").limit(limit)
        wanted *= 4


def query(logs: DataFrame, limit: int = DEFAULT_PAGE, offset: int = 0, **filters) -> DataFrame:
    return page(filtered(logs, **filters), limit, offset)


def export_rows(logs: DataFrame, limit: int | None = None, **filters) -> DataFrame:
    """All filtered rows, in no order, so that the export is written where it is read; or the newest ``limit``."""
    return filtered(logs, **filters) if limit is None else query(logs, limit=limit, **filters)


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601; the fraction only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.when(micros == "000000", whole).otherwise(F.concat_ws(".", whole, micros))


def csv_rows(logs: DataFrame, **filters) -> DataFrame:
    rows = export_rows(logs, **filters).select(*EXPORT_COLUMNS)
    return rows.withColumn("timestamp", iso_timestamp(F.col("timestamp")))


def json_rows(logs: DataFrame, **filters) -> DataFrame:
    """One JSON object per row; values JSON has no type for become text."""
    rows = export_rows(logs, **filters)
    columns = [F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c) if t.startswith("timestamp") else F.col(c)
               for c, t in rows.dtypes]
    return rows.select("id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def write_csv(logs: DataFrame, path: str, **filters) -> None:
    csv_rows(logs, **filters).write.mode("overwrite").option("header", True).csv(path)


def write_json(logs: DataFrame, path: str, **filters) -> None:
    export_rows(logs, **filters).write.mode("overwrite").json(path)


def append(entries: DataFrame, path: str, run: str) -> bool:
    """Append entries as one run, seen by readers as a whole or not at all; False if the run is there already."""
    return commit({"audit_logs": entries}, path, run)


def entry_rows(entries: DataFrame, run: str, now: Column) -> DataFrame:
    """Manual entries as stored rows: an id from the run and the entry's ``number``, the time, and defaults."""
    unset = {"scan_id": F.lit(None).cast("string"), "violations_count": F.lit(0), "resolution_state": F.lit("pending")}
    given = [F.coalesce(c, d).alias(c) if c in entries.columns else d.alias(c) for c, d in unset.items()]
    return entries.select(F.sha2(F.concat_ws("|", F.lit(run), F.col("number").cast("string")), 256).alias("id"), now.alias("timestamp"),
                          "event_type", "org", "repo", "action_taken", *given)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """All entries of committed runs."""
    return committed(spark, path, "audit_logs")


def from_scan(summarized: DataFrame, now: Column) -> DataFrame:
    """One audit row per scanned file; a file without hits has no path to take its organisation from."""
    return summarized.select(
        F.sha2(F.concat_ws("|", F.lit("scan"), F.col("file_id").cast("string")), 256).alias("id"),
        now.alias("timestamp"),
        F.lit("scan").alias("event_type"),
        F.when(F.col("total_issues") > 0, F.element_at(F.split("file_path", "/"), 1)).otherwise("unknown").alias("org"),
        F.lit("unknown").alias("repo"),
        F.col("enforcement_action").alias("action_taken"),
        F.col("file_id").cast("string").alias("scan_id"),
        F.col("total_issues").alias("violations_count"),
        F.to_json(F.struct(
            F.struct("total_issues", "critical", "high", "medium", "low", "info").alias("summary"),
            F.coalesce("detected_ai_code", F.lit(False)).alias("copilot_detected"))).alias("details"),
        F.lit("pending").alias("resolution_state"))


def resolve(logs: DataFrame, resolutions: DataFrame, now: Column) -> DataFrame:
    """Set state and resolver of the listed ids; other rows pass unchanged."""
    changes = resolutions.select(F.col("id"), F.col("resolution_state").alias("_state"),
                                 F.col("resolved_by").alias("_by"))
    joined = logs.join(changes, "id", "left")
    touched = F.col("_state").isNotNull()
    return (joined.withColumn("resolution_state", F.coalesce("_state", "resolution_state"))
            .withColumn("resolved_by", F.coalesce("_by", "resolved_by"))
            .withColumn("resolved_at", F.when(touched, now).otherwise(F.col("resolved_at")))
            .select(*logs.columns))
