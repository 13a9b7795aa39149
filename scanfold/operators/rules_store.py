"""Stored custom rules: partial update, delete, scoping, execution."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanfold.catalog import ANY, Catalogue
from scanfold.catalog.frames import PATTERN_FIELDS, _colon
from scanfold.functions import kernel
from scanfold.functions.dialect import literal_gate, pattern_error, to_jvm
from scanfold.operators.contents import texts_of
from scanfold.operators.scan import FILE_COLUMNS, explode_violations, find_violations
from scanfold.operators.scope import meet, together
from scanfold.ship import ship
from scanfold.sources.tables import staged

UPDATABLE = ("name", "description", "severity", "enabled", "pattern", "ai_prompt", "fix_suggestion")


def upsert(rules: DataFrame, updates: DataFrame, now: Column) -> DataFrame:
    """Partial update by id: given values replace stored ones; unknown ids change nothing."""
    fields = [f for f in UPDATABLE if f in updates.columns and f in rules.columns]
    changes = updates.select("id", *[F.col(f).alias(f"_new_{f}") for f in fields], F.lit(True).alias("_hit"))
    joined = rules.join(changes, "id", "left")
    for f in fields:
        joined = joined.withColumn(f, F.coalesce(f"_new_{f}", f))
    return (joined.withColumn("updated_at", F.when(F.col("_hit"), now).otherwise(F.col("updated_at")))
            .select(*rules.columns))


def delete(rules: DataFrame, ids: DataFrame) -> DataFrame:
    return rules.join(ids.select("id").distinct(), "id", "left_anti")


COMPILED = T.StructType([
    T.StructField("jvm", T.StringType()), T.StructField("jvm_ascii", T.StringType()),
    T.StructField("gate", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])


@F.pandas_udf(COMPILED)
def _compiled(patterns: pd.Series) -> pd.DataFrame:
    """Respell user patterns; runs over the rules table only, never over files."""
    rows = []
    for regex in patterns:
        error = pattern_error(regex)
        rows.append((None, None, [], error) if error else
                    (to_jvm(regex, "im"), to_jvm(regex, "im", True), literal_gate(regex), None))
    return pd.DataFrame(rows, columns=["jvm", "jvm_ascii", "gate", "error"])


def compiled_rules(rules: DataFrame) -> DataFrame:
    """Enabled regex rules with their spelled patterns; ``error`` tells why one cannot run."""
    ship(rules.sparkSession)
    usable = rules.filter((F.col("rule_type") == "regex") & F.col("enabled") & F.col("pattern").isNotNull())
    # Marked non-deterministic so that later filters on its result do not evaluate it again.
    return usable.withColumn("_p", _compiled.asNondeterministic()("pattern")).select("*", "_p.*").drop("_p")


def rule_errors(rules: DataFrame) -> DataFrame:
    """Rules that can't run, and why; ``scan_custom`` leaves them out."""
    return compiled_rules(rules).where(F.col("error").isNotNull()).select("id", "org", "repo", "name", "pattern", "error")


def _as_pattern() -> Column:
    """A custom rule in the shape of a catalogue pattern."""
    given = {
        "rule_ord": F.lit(100_000), "pattern_ord": F.lit(0), "rule_id": F.col("id"), "severity": F.col("severity"),
        "category": F.col("category"), "label": F.col("name"), "title": F.col("name"),
        "message": F.coalesce("description", "name"), "owasp": F.col("owasp_mapping"), "cwe": F.col("cwe_id"),
        "regex_id": F.lit(-1), "require_id": F.lit(-1), "suppress_id": F.lit(-1), "jvm": F.col("jvm"), "jvm_ascii": F.col("jvm_ascii"), "gate": F.col("gate"), "check": F.lit("plain"),
        "multi_line": F.lit(True), "snippet_span": F.lit(True),
    }
    blanks = {"int": F.lit(0), "string": F.lit(""), "boolean": F.lit(False)}
    out = []
    for field in PATTERN_FIELDS.split(", "):
        name, kind = field.strip("`").replace("`", "").split(" ", 1)
        out.append(given.get(name, blanks.get(kind, F.array())).cast(kind).alias(name))
    return F.struct(*out)


def scan_custom(files: DataFrame, rules: DataFrame, most: int | None = None) -> DataFrame:
    """Run stored regex rules in their scope: everywhere, one organisation or one repository.

    The files' narrow rows meet the rules of their scopes by joins. A pattern runs
    once on each content that any file brings to it, if the text has one of its
    literals, and its hits go back to the files and rules that asked. ``most``
    bounds the bytes of a table that is broadcast.
    """
    ready = staged(compiled_rules(rules).filter(F.col("error").isNull()).withColumn("_pattern", F.unhex(F.sha2("pattern", 256))).select(
        "id", "org", "repo", "name", "description", "severity", "category", "owasp_mapping", "cwe_id", "_pattern", "jvm", "jvm_ascii", "gate",
        F.coalesce(F.transform("languages", F.lower), F.array().cast("array<string>")).alias("languages")))
    narrow, texts = texts_of(files, [])
    columns = [c for c in FILE_COLUMNS if c in narrow.columns]
    wanted = _wanted(narrow.select(*columns, "unit"), ready, most)
    found = staged(_pattern_hits(wanted, texts, ready))
    hits = meet(wanted, found, ["unit", "_pattern"], most=most)
    blank = F.lit(None).cast("string")
    filled = lambda c: F.replace(c, F.lit("{detail}"), F.lit(""))
    rows = hits.select(*columns, F.transform("violations", lambda v: F.struct(
        v["line_start"].alias("line_start"), v["line_end"].alias("line_end"), F.lit(100_000).alias("rule_ord"), F.lit(0).alias("pattern_ord"),
        v["match_ord"].alias("match_ord"), F.col("id").alias("rule_id"), F.col("severity").alias("severity"), F.col("category").alias("category"),
        F.col("name").alias("label"), filled(F.col("name")).alias("title"), filled(F.coalesce("description", "name")).alias("description"),
        v["code_snippet"].alias("code_snippet"), F.col("owasp_mapping").alias("owasp_mapping"), F.col("cwe_id").alias("cwe_id"),
        blank.alias("detail"))).alias("violations"))
    return explode_violations(rows)


def _wanted(files: DataFrame, ready: DataFrame, most: int | None) -> DataFrame:
    """File rows with each rule that runs on them."""
    known = Catalogue.builtin().languages()
    every_key = F.array(*[F.lit(x) for x in [*known, ANY]])
    keys = F.when(F.size("languages") == 0, every_key).otherwise(F.array_distinct(F.transform(
        "languages", lambda x: F.when(x.isin(known), x).otherwise(F.lit(ANY)))))
    shown = [c for c in ready.columns if c not in ("org", "repo", "jvm", "jvm_ascii", "gate")]
    lang = F.lower("language")
    keyed = files.withColumn("_key", F.when(lang.isin(known), lang).otherwise(F.lit(ANY)))
    # Rules of all organisations are keyed by the language they can meet, as the built-in catalogue is.
    everywhere = ready.filter(F.col("org").isNull()).select(*shown, F.explode(keys).alias("_key"))
    by_org = ready.filter(F.col("org").isNotNull() & F.col("repo").isNull()).select("org", *shown)
    by_repo = ready.filter(F.col("org").isNotNull() & F.col("repo").isNotNull()).select("org", "repo", *shown)
    scoped = together([meet(keyed, part, on, most=most).drop("_key") for part, on in (
        (everywhere, ["_key"]), (by_org, ["org"]), (by_repo, ["org", "repo"]))])
    return scoped.where((F.size("languages") == 0) | F.array_contains("languages", lang)).drop("languages")


def _pattern_hits(wanted: DataFrame, texts: DataFrame, ready: DataFrame) -> DataFrame:
    """(unit, _pattern, violations) where there are any; a row is one content and one pattern."""
    names = [f.name for f in ready.schema if f.name in ("id", "name", "description", "severity", "category", "owasp_mapping", "cwe_id")]
    patterns = ready.groupBy("_pattern").agg(*[F.any_value(c).alias(c) for c in ("jvm", "jvm_ascii", "gate")])
    pairs = wanted.select("unit", "_pattern").distinct().join(patterns, "_pattern").join(texts.hint("merge"), "unit")
    low, odd = F.lower("code"), kernel.folds_oddly(F.col("code"))
    open_pairs = pairs.where((F.size("gate") == 0) | odd | F.exists("gate", lambda g: F.contains(low, g)))
    patterned = open_pairs.select("*", *[F.lit("").alias(c) for c in names]).withColumn("_patterns", F.array(_as_pattern()))
    scanned = find_violations(patterned, [], languages=Catalogue.builtin().languages(), extra_patterns="_patterns", keep=("unit", "_pattern"))
    slim = F.transform("violations", lambda v: F.struct(*[v[c].alias(c) for c in ("line_start", "line_end", "match_ord", "code_snippet")]))
    return scanned.select("unit", "_pattern", slim.alias("violations")).where(F.size("violations") > 0)
