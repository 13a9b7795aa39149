"""Independent SQL spelling of the corpus and of the rule semantics, for result checks.

Written for an engine with RE2 regexes.  Nothing here is used by the Spark jobs.
"""

from __future__ import annotations

from scanfold.catalog import ANY, Catalogue, Rule
from scanfold.catalog.frames import pattern_records
from scanfold.catalog.government import CIPHER_CONTEXT_WORDS
from scanfold.functions.paths import LANGUAGE_BY_EXTENSION
from scanfold.sources import corpus


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(lit(v) for v in value) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(name: str, columns: list[str], rows: list[tuple]) -> str:
    body = ",\n".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


def language_sql(path: str) -> str:
    ext = f"lower(list_extract(string_split({path}, '.'), -1))"
    cases = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in LANGUAGE_BY_EXTENSION.items())
    return f"CASE {ext} {cases} ELSE {ext} END"


def files_cte(name: str = "files") -> str:
    bank = "CASE snippet_language " + " ".join(
        f"WHEN {lit(k)} THEN {lit(v)}" for k, v in corpus.SNIPPETS.items()) + " END"
    fields = ",\n".join(f"{sql} AS {k}" for k, sql in corpus.FILE_FIELDS.items())
    header = f"list_extract({lit(corpus.HEADERS)}, CAST({corpus.HEADER_INDEX} AS INT) + 1)"
    index = corpus.snippet_index("i", "len(bank)")
    return f"""
seeds AS (SELECT *, {corpus.SNIPPET_LANGUAGE} AS snippet_language FROM orders),
banks AS (SELECT snippet_language, {bank} AS bank FROM (SELECT DISTINCT snippet_language FROM seeds)),
{name} AS MATERIALIZED (
  SELECT {fields},
    {language_sql(corpus.FILE_FIELDS['file_path'])} AS language,
    {header} || array_to_string(list_transform(range(0, {corpus.SNIPPET_COUNT}),
        lambda i: list_extract(bank, {index} + 1)), chr(10)) AS code
  FROM seeds JOIN banks USING (snippet_language))"""


def documents_cte(name: str = "files") -> str:
    return f"""{name} AS MATERIALIZED (SELECT doc_id AS file_id, 'docs' AS org, source AS repo, 1 AS pr_number,
  'docs/' || doc_id || '.txt' AS file_path, 'txt' AS language, text AS code FROM documents)"""


def _re2(regex: str, flags: str) -> tuple[str, str, str]:
    """RE2 has no look-around: return the bare regex and the conditions on its neighbours."""
    before = after = ""
    if "(?<![A-Za-z])" in regex:
        regex, before = regex.replace("(?<![A-Za-z])", ""), "[A-Za-z]$"
    if "(?![0-9])" in regex:
        regex, after = regex.replace("(?![0-9])", ""), "^[0-9]"
    if "(?!3)" in regex:
        regex, after = regex.replace("(?!3)", ""), "^3"
    return (f"(?{flags})" if flags else "") + regex, before, after


def _flagged(regex: str, flags: str) -> str:
    return (f"(?{flags})" if flags else "") + regex


def _union(words) -> str:
    return "(?i)" + "|".join(f"(?:{w})" for w in words) if words else ""


def _candidates(rules: list[Rule], languages: list[str], rule_filter: str) -> str:
    """One branch per pattern, so that every regex is a constant of the query."""
    branches: dict[tuple, list[str]] = {}
    meta: dict[tuple, dict] = {}
    for r in pattern_records(rules, languages):
        regex, before, after = _re2(r["regex"], r["flags"])
        key = (r["rule_ord"], r["pattern_ord"], regex, r["label"], r["title"], r["check"])
        branches.setdefault(key, []).append(r["language"])
        meta[key] = dict(r, pat=regex, neighbours=(before, after))
    known = ", ".join(lit(x) for x in languages)
    parts = []
    for key, langs in branches.items():
        r = meta[key]
        before, after = r["neighbours"]
        if set(langs) == set(languages) | {ANY}:
            gate = "TRUE"
        else:
            gate = " OR ".join(
                [f"lower(language) IN ({', '.join(lit(x) for x in langs if x != ANY)})"] * bool(set(langs) - {ANY})
                + [f"lower(language) NOT IN ({known})"] * (ANY in langs))
        caps = f"regexp_extract_all(code, {lit(r['pat'])}, 1)" if r["check"] in ("capture", "body") else \
            "CAST(NULL AS VARCHAR[])"
        skip = f"AND NOT regexp_matches(file_path, {lit(_union(r['skip']))})" if r["skip"] else ""
        parts.append(f"""SELECT *, {r['rule_ord']} AS rule_ord, {r['pattern_ord']} AS pattern_ord,
  {lit(r['rule_id'])} AS rule_id, {lit(r['severity'])} AS severity, {lit(r['category'])} AS category,
  {lit(r['label'])} AS label, {lit(r['title'])} AS title_t, {lit(r['message'])} AS message_t,
  CAST({lit(r['owasp'])} AS VARCHAR) AS owasp, CAST({lit(r['cwe'])} AS VARCHAR) AS cwe, {lit(before)} AS not_before,
  {lit(after)} AS not_after,
  {lit(r['check'])} AS kind, {r['before']} AS w_before, {r['after']} AS w_after,
  {lit(r['multi_line'])} AS multi_line, {lit(r['snippet_span'])} AS snippet_span, {r['snippet_extra']} AS snippet_extra,
  {lit(r['default_detail'] or '')} AS default_detail,
  regexp_extract_all(code, {lit(r['pat'])}) AS m, string_split_regex(code, {lit(r['pat'])}) AS g, {caps} AS caps
FROM files WHERE ({gate}) {skip} AND regexp_matches(code, {lit(r['pat'])}) AND ({rule_filter.format(**r)})""")
    return "\nUNION ALL\n".join(parts)


def _by_rule(rules: list[Rule], languages: list[str], of, default: str) -> str:
    """CASE over rule (and language, where it matters) of a boolean built from constants."""
    cases = []
    for rule in rules:
        per_language = {language: of(rule, language) for language in list(languages) + [ANY]}
        if len(set(per_language.values())) == 1:
            cases.append(f"WHEN rule_id = {lit(rule.rule_id)} THEN {per_language[ANY]}")
        else:
            cases += [f"WHEN rule_id = {lit(rule.rule_id)} AND lower(language) = {lit(language)} THEN {sql}"
                      for language, sql in per_language.items() if language != ANY]
    return f"CASE {' '.join(cases)} ELSE {default} END"


def _searched(text: str, words, default: str) -> str:
    return f"regexp_matches({text}, {lit(_union(words))})" if words else default


def _dropped(rules: list[Rule], languages: list[str]) -> str:
    cases = {
        (r["rule_id"], r["label"], r["drop"]): f"WHEN rule_id = {lit(r['rule_id'])} AND label = {lit(r['label'])} "
        f"THEN regexp_matches(captured, {lit(_flagged(r['drop'], r['drop_flags']))})"
        for r in pattern_records(rules, languages) if r["check"] == "capture"
    }
    return f"CASE {' '.join(cases.values())} ELSE FALSE END" if cases else "FALSE"


def _word_found(rules: list[Rule]) -> str:
    cases = [
        f"WHEN rule_id = {lit(rule.rule_id)} AND regexp_matches(lines[l1], {lit('(?i)' + w)}) THEN {lit(w)}"
        for rule in rules for w in rule.detail_words
    ]
    return f"CASE {' '.join(cases)} END" if cases else "CAST(NULL AS VARCHAR)"


def _join_lines(first: str, last: str) -> str:
    return f"array_to_string(lines[greatest(1, {first}) : least(len(lines), {last})], chr(10))"


def _strip(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"


def hits_cte(rules: list[Rule], languages: list[str] | None = None, rule_filter: str = "TRUE") -> str:
    """CTEs ``raw`` (every kept hit) and ``hits`` (first per rule and span) over ``files``."""
    languages = languages or Catalogue.builtin().languages()
    cipher = " OR ".join(f"contains(lower(around), {lit(w)})" for w in CIPHER_CONTEXT_WORDS)
    required = _by_rule(rules, languages, lambda r, _: _searched("around", r.require, "TRUE"), "TRUE")
    suppressed = _by_rule(rules, languages, lambda r, x: _searched("around", r.suppress_for(x), "FALSE"), "FALSE")
    return f"""
cand AS MATERIALIZED (SELECT *, string_split(code, chr(10)) AS lines FROM (
{_candidates(rules, languages, rule_filter)})),
loc AS (
  SELECT * EXCLUDE (m, g, caps), i AS match_ord, m[i] AS match_text, caps[i] AS captured,
         array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '') AS prefix,
         g[i+1] || CASE WHEN i < len(m) THEN m[i+1] ELSE '' END AS following,
         CASE WHEN kind = 'cipher' THEN substr(code, len(array_to_string(g[1:i], '') || array_to_string(m[1:i], '')) + 1)
         END AS tail
  FROM cand, unnest(range(1, len(m) + 1)) AS u(i)),
pos AS (
  SELECT *, CAST(1 + len(prefix) - len(replace(prefix, chr(10), '')) AS INT) AS l1,
         CAST(1 + len(prefix || match_text) - len(replace(prefix || match_text, chr(10), '')) AS INT) AS l2
  FROM loc
  WHERE (not_before = '' OR NOT regexp_matches(prefix, not_before))
    AND (not_after = '' OR NOT regexp_matches(following, not_after))),
ctx AS (
  SELECT *, CASE WHEN multi_line THEN l2 ELSE l1 END AS l9,
    CASE kind
      WHEN 'window' THEN {_join_lines('l1 - w_before', '(CASE WHEN multi_line THEN l2 ELSE l1 END) + w_after')}
      WHEN 'glued' THEN {_join_lines('l1 - w_before', 'l1')} || lines[l1] || {_join_lines('l1 + 1', 'l1 + w_after')}
      WHEN 'comment' THEN list_extract(string_split(prefix, chr(10)), -1)
      WHEN 'cipher' THEN right(prefix, 50) || match_text || left(tail, 50)
      ELSE '' END AS around
  FROM pos),
kept AS (
  SELECT *,
    CASE WHEN kind = 'capture' THEN captured ELSE {_word_found(rules)} END AS detail
  FROM ctx
  WHERE CASE kind
      WHEN 'window' THEN ({required}) AND NOT ({suppressed})
      WHEN 'glued' THEN NOT ({suppressed})
      WHEN 'comment' THEN NOT contains(around, CASE WHEN language = 'python' THEN '#' ELSE '//' END)
      WHEN 'capture' THEN NOT ({_dropped(rules, languages)})
      WHEN 'cipher' THEN NOT ({cipher}) AND NOT CASE WHEN language = 'python'
          THEN starts_with(ltrim(lines[l1]), '#')
          ELSE starts_with(ltrim(lines[l1]), '//') OR starts_with(ltrim(lines[l1]), '/*') END
      WHEN 'body' THEN FALSE
      ELSE TRUE END),
{_bodies_cte() if any(p.check == 'body' for r in rules for ps in r.patterns.values() for p in ps) else ''}
raw AS (
  SELECT file_id, org, repo, pr_number, file_path, language, rule_ord, pattern_ord, CAST(match_ord AS INT) AS match_ord,
    rule_id, severity, category, label, owasp AS owasp_mapping, cwe AS cwe_id, l1 AS line_start, l9 AS line_end, detail,
    replace(title_t, '{{detail}}', coalesce(detail, '')) AS title,
    replace(message_t, '{{detail}}', coalesce(detail, '')) AS description,
    {_strip("array_to_string(lines[l1 : l1 + CASE WHEN snippet_span THEN l9 - l1 + snippet_extra ELSE 0 END], chr(10))")}
      AS code_snippet
  FROM (SELECT * FROM kept{" UNION ALL BY NAME SELECT * FROM handled" if any(p.check == 'body' for r in rules for ps in r.patterns.values() for p in ps) else ''})),
hits AS (
  SELECT * FROM raw
  QUALIFY row_number() OVER (PARTITION BY file_id, rule_ord, line_start, line_end ORDER BY pattern_ord, match_ord) = 1)"""


def _bodies_cte() -> str:
    """Brace bodies by a running depth over the tokens after the match."""
    return """
tok AS (
  SELECT file_id, pattern_ord, match_ord, k, t[k] AS token,
         1 + sum(CASE WHEN t[k] LIKE '%{' THEN 1 WHEN t[k] LIKE '%}' THEN -1 ELSE 0 END)
             OVER (PARTITION BY file_id, pattern_ord, match_ord ORDER BY k) AS depth
  FROM (SELECT file_id, pattern_ord, match_ord,
               regexp_extract_all(substr(code, len(prefix || match_text) + 1), '[^{}]*[{}]|[^{}]+$') AS t
        FROM ctx WHERE kind = 'body'), unnest(range(1, len(t) + 1)) AS u(k)),
ends AS (
  SELECT file_id, pattern_ord, match_ord, min(CASE WHEN depth = 0 THEN k END) AS stop
  FROM tok GROUP BY ALL),
bodies AS (
  SELECT file_id, pattern_ord, match_ord, string_agg(token, '' ORDER BY k) AS body
  FROM tok JOIN ends USING (file_id, pattern_ord, match_ord) WHERE stop IS NULL OR k <= stop GROUP BY ALL),
handled AS (
  SELECT c.*, CASE WHEN captured = '' THEN default_detail ELSE captured END AS detail
  FROM ctx c JOIN bodies b USING (file_id, pattern_ord, match_ord)
  WHERE kind = 'body' AND contains(body, 'await') AND NOT (contains(body, 'try') AND contains(body, 'catch'))
    AND NOT contains(body, '.catch') AND len(body) > 50),"""


def scan_sql(rules: list[Rule], select: str, files: str | None = None, rule_filter: str = "TRUE") -> str:
    return f"WITH {files or files_cte()}, {hits_cte(rules, rule_filter=rule_filter)}\n{select}"
