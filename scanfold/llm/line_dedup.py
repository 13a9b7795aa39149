"""Removal of repeated three-line windows (operator 8).

Every three consecutive lines that aren't blank form a window; windows overlap.
A window's key is a 96-bit hash of its lines without outer blanks. Windows found
twice or more in the corpus stay where they come first (by doc_id, then place)
and go everywhere else: the lines that later occurrences cover are merged to
ranges and cut out. Blank lines stay.

A null text stays null, a text of fewer than three lines that aren't blank has
no window. Rows with equal doc_id and text count as one document and are
treated alike; so do null ids. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.common import BLANKS, count_up, fresh, let
from scanfold.sources.tables import staged, table

#: So many windows (4 bytes each, and some 60 for each document) are broadcast at most; longer lists are joined by shuffle.
BROADCAST_WINDOWS = 500_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _places(lines: Column) -> Column:
    """Indices of the lines that aren't blank."""
    return F.filter(count_up(F.size(lines)), lambda i: F.btrim(F.get(lines, i), F.lit(BLANKS)) != "")


def _windows(text: Column) -> Column:
    def over(lines: Column) -> Column:
        return F.transform(count_up(F.size(lines) - 2), lambda i: F.struct(
            F.xxhash64(F.get(lines, i), F.get(lines, i + 1), F.get(lines, i + 2)).alias("h1"),
            F.hash(F.get(lines, i), F.get(lines, i + 1), F.get(lines, i + 2)).alias("h2")))
    return let(F.filter(F.transform(_lines(text), lambda x: F.btrim(x, F.lit(BLANKS))), lambda x: x != ""), over)


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def window_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, at, h1, h2) for each window of each document."""
    return docs.select("doc_id", text_key(F.col("text")).alias("key"),
                       F.posexplode(_windows(F.col("text"))).alias("at", "w")).select(
        "doc_id", "key", "at", "w.h1", "w.h2")


def later_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, key, windows): per document, sorted starts of windows that came before in the corpus."""
    rows = staged(window_rows(docs))
    place = F.struct("doc_id", "key", "at")
    repeated = rows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).where(
        ~F.col("first").eqNullSafe(F.col("last"))).select("h1", "h2", "first")
    later = rows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "key").agg(F.sort_array(F.collect_set("at")).alias("windows"))


def _cut(text: Column, windows: Column) -> Column:
    """Struct of the text without the windows' lines, and how many lines went."""
    def ranges(ws: Column, lines: Column, at: Column) -> Column:
        starts = F.filter(ws, lambda x, i: F.coalesce(x - F.get(ws, i - 1) > 3, F.lit(True)))
        ends = F.transform(F.filter(ws, lambda x, i: F.coalesce(F.get(ws, i + 1) - x > 3, F.lit(True))), lambda x: x + 2)
        return let(starts, lambda s: let(ends, lambda e: rest(s, e, lines, at)))

    def rest(starts: Column, ends: Column, lines: Column, at: Column) -> Column:
        def gap(k: Column) -> Column:
            begin = F.when(k == 0, F.lit(0)).otherwise(F.get(at, F.get(ends, k - 1)) + 1)
            end = F.when(k == F.size(starts), F.size(lines)).otherwise(F.get(at, F.get(starts, k)))
            return F.slice(lines, begin + 1, F.greatest(end - begin, F.lit(0)))
        gone = F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a + 1), F.lit(0).cast("bigint"), lambda a, x: a + x)
        kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), gap))
        return F.struct(F.array_join(kept, "\n").alias("text"), gone.alias("n_removed"))

    return let(_lines(text), lambda ls: let(_places(ls), lambda at: ranges(windows, ls, at)))


def dedup_lines(docs: DataFrame, removed_col: str = "n_removed") -> DataFrame:
    """docs with later repeats cut out of text, and how many lines each row lost."""
    later = staged(later_windows(docs))
    if (later.agg(F.sum(F.size("windows"))).first()[0] or 0) <= BROADCAST_WINDOWS:
        later = F.broadcast(later)
    key, ident, windows, cut = (fresh(docs, x) for x in ("text_key", "cut_doc", "cut_windows", "cut"))
    keyed = docs.withColumn(key, text_key(F.col("text")))
    later = later.select(F.col("doc_id").alias(ident), F.col("key").alias(f"{key}2"), F.col("windows").alias(windows))
    joined = keyed.join(later, keyed["doc_id"].eqNullSafe(F.col(ident)) & (F.col(key) == F.col(f"{key}2")), "left")
    done = joined.withColumn(cut, F.when(F.col(windows).isNotNull(), _cut(F.col("text"), F.col(windows))))
    found = F.col(windows).isNotNull()
    return done.select(*[
        F.when(found, F.col(cut)["text"]).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c)
        for c in docs.columns if c != removed_col],
        F.when(found, F.col(cut)["n_removed"]).otherwise(F.lit(0).cast("bigint")).alias(removed_col))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_removed", F.char_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_chars"),
                      "text")


ORACLE = r"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
          FROM raw, unnest(range(1, len(ls) + 1)) AS u(i)),
solid AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines WHERE bare <> ''),
wins AS (SELECT doc_id, j, bare AS a, lead(bare) OVER d AS b, lead(bare, 2) OVER d AS c FROM solid
         WINDOW d AS (PARTITION BY doc_id ORDER BY j)),
later AS (SELECT doc_id, j FROM wins WHERE c IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, j) > 1),
gone AS (SELECT DISTINCT doc_id, j + k AS j FROM later, unnest([0, 1, 2]) AS v(k)),
placed AS (SELECT *, count(*) FILTER (bare <> '') OVER (PARTITION BY doc_id ORDER BY i) AS j FROM lines),
left_over AS (SELECT l.doc_id, l.i, l.line FROM placed l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.j = l.j
              LEFT JOIN gone h ON h.doc_id = l.doc_id AND h.j = l.j + 1
              WHERE g.j IS NULL OR (bare = '' AND h.j IS NULL)),
made AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM left_over GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT raw.doc_id, coalesce(n.n, 0) AS n_removed,
       length(CASE WHEN n.n IS NULL THEN coalesce(text, '') ELSE coalesce(t, '') END) AS n_chars,
       CASE WHEN n.n IS NULL THEN text ELSE coalesce(t, '') END AS text
FROM raw LEFT JOIN made USING (doc_id) LEFT JOIN n USING (doc_id)
"""
