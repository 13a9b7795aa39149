"""The catalogue as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.catalog import ANY, PACK_INFO, Catalogue, Rule
from scanfold.catalog.model import CAPTURE
from scanfold.catalog.remedies import REMEDIES
from scanfold.functions.dialect import any_gate, any_of, literal_gate, to_jvm

# The built-in catalogue is code, so its size is a constant of the release; this
# bound is what allows the explicit broadcast below.
MAX_BROADCAST_PATTERNS = 20_000

PATTERN_FIELDS = (
    "rule_ord int, pattern_ord int, rule_id string, severity string, category string, label string, "
    "title string, message string, owasp string, cwe string, regex_id int, require_id int, suppress_id int, "
    "jvm string, jvm_ascii string, gate array<string>, "
    "`check` string, before int, after int, require string, require_ascii string, require_gate array<string>, "
    "suppress string, suppress_ascii string, suppress_gate array<string>, drop_re string, "
    "multi_line boolean, snippet_span boolean, snippet_extra int, skip_path string, default_detail string, "
    "detail_words array<struct<raw:string,jvm:string,gate:string>>"
)


def pattern_records(rules: list[Rule], languages: list[str]) -> list[dict]:
    """One record per (language, pattern), in rule order then pattern order."""
    records = []
    for language in list(languages) + [ANY]:
        for rule_ord, rule in enumerate(rules):
            for pattern_ord, p in enumerate(rule.patterns_for(language)):
                if p.never_reports:
                    continue
                flags = rule.flags if p.flags is None else p.flags
                check = p.check or rule.check
                body = p.check is not None          # a pattern with its own check reports a single line
                drop_flags = "i" if (check == CAPTURE and "i" in flags) else ""
                records.append(dict(
                    language=language, rule_ord=rule_ord, pattern_ord=pattern_ord, rule_id=rule.rule_id,
                    severity=rule.severity, category=rule.category, label=p.label,
                    title=(p.title or rule.title).replace("{label}", p.label),
                    message=(p.message or rule.message).replace("{label}", p.label),
                    owasp=rule.owasp, cwe=rule.cwe,
                    regex=p.regex, flags=flags, jvm=to_jvm(p.regex, flags),
                    jvm_ascii=to_jvm(p.regex, flags, True), gate=literal_gate(p.regex),
                    check=check, before=rule.before, after=rule.after,
                    require_words=tuple(rule.require), suppress_words=rule.suppress_for(language),
                    require=any_of(rule.require, "i"), require_ascii=any_of(rule.require, "i", True),
                    require_gate=any_gate(rule.require),
                    suppress=any_of(rule.suppress_for(language), "i"),
                    suppress_ascii=any_of(rule.suppress_for(language), "i", True),
                    suppress_gate=any_gate(rule.suppress_for(language)),
                    drop=p.drop_re or "", drop_flags=drop_flags,
                    drop_re=to_jvm(p.drop_re, drop_flags) if p.drop_re else "",
                    multi_line=rule.multi_line and not body,
                    snippet_span=rule.snippet_span and not body,
                    snippet_extra=0 if body else rule.snippet_extra,
                    skip=rule.skip_path, skip_path=any_of(rule.skip_path, "i"),
                    default_detail=p.detail,
                    detail_words=[(w, to_jvm(w, "i"), (literal_gate(w) or [""])[0]) for w in rule.detail_words],
                ))
    return records


def distinct_regexes(records: list[dict]) -> tuple[list[str], list[str]]:
    """The regexes of the patterns, and those of their contexts; a pattern names them by their places."""
    patterns = sorted({r["jvm_ascii"] for r in records})
    contexts = sorted({r[k] for r in records for k in ("require_ascii", "suppress_ascii")} - {""})
    return patterns, contexts


def literal_index(patterns: list[dict]) -> list[tuple[str, list[int]]]:
    """Literal -> places of the patterns it opens; patterns that no literal guards are under the empty one."""
    index: dict[str, list[int]] = {}
    for i, p in enumerate(patterns):
        for literal in dict.fromkeys(p["gate"] or [""]):
            index.setdefault(literal, []).append(i)
    return list(index.items())


def language_patterns(spark: SparkSession, rules: list[Rule], languages: list[str]) -> DataFrame:
    """language -> array of pattern structs, and the index from literals to them; ANY stands for every other language."""
    records = pattern_records(rules, languages)
    if len(records) > MAX_BROADCAST_PATTERNS:
        raise ValueError(f"{len(records)} patterns exceed the broadcast bound of {MAX_BROADCAST_PATTERNS}")
    regexes, contexts = ({x: i for i, x in enumerate(xs)} for xs in distinct_regexes(records))
    for r in records:
        r |= dict(regex_id=regexes[r["jvm_ascii"]], require_id=contexts.get(r["require_ascii"], -1),
                  suppress_id=contexts.get(r["suppress_ascii"], -1))
    names = [f.split()[0].strip("`") for f in
             PATTERN_FIELDS.replace("struct<raw:string,jvm:string,gate:string>", "x").split(", ")]
    rows = []
    for language in list(languages) + [ANY]:
        own = [r for r in records if r["language"] == language]
        rows.append((language, [tuple(r[n] for n in names) for r in own], literal_index(own)))
    schema = (f"scan_language string, patterns array<struct<{_colon(PATTERN_FIELDS)}>>, "
              "literals array<struct<literal:string,opens:array<int>>>")
    return F.broadcast(spark.createDataFrame(rows, schema))


def _colon(fields: str) -> str:
    return ", ".join(part.replace(" ", ": ", 1) for part in fields.split(", "))


def rules_frame(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    """One row per rule: the lookup view of the registry."""
    rows = [
        (i, r.rule_id, r.name, r.description, r.severity, r.category, list(r.languages), r.owasp, r.cwe,
         list(r.references))
        for i, r in enumerate(catalogue.list_rules())
    ]
    return F.broadcast(spark.createDataFrame(
        rows, "rule_ord int, rule_id string, name string, description string, severity string, category string, "
              "languages array<string>, owasp_mapping string, cwe_id string, references array<string>"))


def packs_frame(spark: SparkSession, catalogue: Catalogue) -> DataFrame:
    """One row per pack, rules in pack order."""
    info = {name: rest for name, *rest in PACK_INFO}
    rows = []
    for i, (name, ids) in enumerate(catalogue.list_packs().items()):
        display, description, category = info.get(name, (name, "", "custom"))
        rows.append((i, name, display, description, category, list(ids)))
    return F.broadcast(spark.createDataFrame(
        rows, "pack_ord int, pack string, display_name string, description string, category string, "
              "rules array<string>"))


def remedies_frame(spark: SparkSession) -> DataFrame:
    rows = [(rule_id, language, text) for rule_id, texts in REMEDIES.items() for language, text in texts.items()]
    return F.broadcast(spark.createDataFrame(rows, "rule_id string, language string, suggested_fix string"))
