"""Equal contents are scanned once, and each file gets the hits of its content.

    files --distinct texts--> texts --scan--> (unit, violations)
    files --digest of the text--> narrow rows (file, unit) --join on unit--> scan results

What a scan finds depends on the text, the language and the path exemptions that
hold, and on nothing else of a file. Forks, vendored folders and generated files make
texts recur, so the scan's time follows the distinct texts. A task keeps one copy of
each text before any is moved; the files' own rows go on without their text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.catalog import Rule
from scanfold.functions.dialect import any_of
from scanfold.operators.scan import FILE_COLUMNS, find_violations
from scanfold.operators.scope import meet
from scanfold.sources.tables import staged

#: Bytes of text that a task scans at most, where texts are shorter than that.
TASK_BYTES = 4 << 20


def exemptions(rules: list[Rule]) -> Column:
    """The path exemptions that hold for a file; a null path is exempt from all, as no pattern that has one runs on it."""
    patterns = sorted({any_of(r.skip_path, "i") for r in rules if r.skip_path})
    return F.array_compact(F.array(*[F.when(F.coalesce(F.rlike("file_path", F.lit(p)), F.lit(True)), F.lit(p)) for p in patterns]).cast("array<string>"))


def _unit(*parts: str) -> Column:
    """Digest of texts, null told from empty; with their lengths, so that no two lists of texts are written alike."""
    return F.unhex(F.sha2(F.concat(*[F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-")) for c in parts]), 256))


def _units(files: DataFrame, rules: list[Rule], beside: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    parts = ["_lang", "_exempt_text", "code", *beside]
    return files.withColumn("_lang", F.lower("language")).withColumn("_exempt", exemptions(rules)).withColumn(
        "_exempt_text", F.to_json("_exempt")), parts


def texts_of(files: DataFrame, rules: list[Rule], beside: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(files without their text and with ``unit``, the distinct texts by unit, written and dealt over the cores)."""
    keyed, parts = _units(files, rules, beside)
    narrow = keyed.select(*[c for c in files.columns if c not in ("code", *beside)], _unit(*parts).alias("unit"))
    texts = staged(keyed.select(F.col("_lang").alias("language"), "_lang", "_exempt", "_exempt_text", "code", *beside).distinct())
    size = texts.agg(F.coalesce(F.sum(F.octet_length("code")), F.lit(0))).first()[0]
    tasks = max(3 * files.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES))
    return narrow, texts.withColumn("unit", _unit(*parts)).drop("_lang", "_exempt_text").repartition(tasks, "unit")


def scan_contents(files: DataFrame, rules: list[Rule], *, languages: list[str], dedupe: str = "rule", beside: tuple[str, ...] = (),
                  each: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files without their text and with ``unit``, (unit, violations) of each content, written).

    ``beside`` names string columns that ``each`` needs, which are then part of the
    content; ``each`` goes over the contents' scan results before they are written.
    """
    narrow, texts = texts_of(files, rules, beside)
    scanned = find_violations(texts, rules, languages=languages, dedupe=dedupe, keep=("unit", *beside), exempt="_exempt").drop("language")
    return narrow, staged(each(scanned) if each else scanned)


def with_hits(files: DataFrame, hits: DataFrame, *fields: str) -> DataFrame:
    """Files with the ``violations`` of their content, all of their fields or the named ones."""
    if fields:
        hits = hits.withColumn("violations", F.transform("violations", lambda v: F.struct(*[v[c].alias(c) for c in fields])))
    return meet(files, hits, ["unit"])


def find_once(files: DataFrame, rules: list[Rule], *, languages: list[str], dedupe: str = "rule", keep: tuple[str, ...] = ()) -> DataFrame:
    """What ``find_violations`` gives, each content scanned once."""
    narrow, hits = scan_contents(files, rules, languages=languages, dedupe=dedupe)
    columns = [c for c in FILE_COLUMNS if c in files.columns] + [c for c in keep if c not in FILE_COLUMNS]
    return with_hits(narrow.select(*columns, "unit"), hits).drop("unit")
