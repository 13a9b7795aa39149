"""SQL that recomputes the queries' results on the same tables, for checking."""

from __future__ import annotations

from scanfold.catalog import PACK_INFO, Catalogue
from scanfold.catalog.remedies import REMEDIES
from scanfold.functions.paths import SUPPORTED_EXTENSIONS
from scanfold.operators import config, settings
from scanfold.operators.license import LICENSE_NAMES, LICENSE_PATTERNS
from scanfold.operators.report import ACTION_TEXT, MARKS
from scanfold.oracle.rules_sql import documents_cte, files_cte, hits_cte, language_sql, lit, scan_sql, values
from scanfold.plans.queries import (
    BLOCK_RE, CALL_RE, CORE_PACKS, CURSOR, HIT_COLUMNS, OPEN_RE, PACK_KEYS, RETURN_RE, ROLLED_FIELDS, RULE_KEYS, SHORT, WORD_CALL_RE)
from scanfold.sources import corpus, derived

CATALOGUE = Catalogue.builtin()
NOW = "TIMESTAMP '2024-06-01 12:00:00'"
CORE = CATALOGUE.select(packs=CORE_PACKS)


def cte(name: str, spec) -> str:
    base, fields, *where = spec
    columns = ", ".join(f"{sql} AS {k}" for k, sql in fields.items())
    text = f"{name} AS (SELECT {columns} FROM {base}{' WHERE ' + where[0] if where else ''})"
    return text.replace("TIMESTAMP_NTZ", "TIMESTAMP")


def cols(names) -> str:
    return ", ".join(names)


def supported(path: str) -> str:
    return "(" + " OR ".join(f"ends_with({path}, {lit(e)})" for e in SUPPORTED_EXTENSIONS) + ")"


# One hit per location, then counters per file.
UNIQ = """uniq AS (SELECT * FROM hits QUALIFY row_number() OVER (
  PARTITION BY file_id, line_start, line_end ORDER BY rule_ord, pattern_ord, match_ord) = 1)"""
COUNTS = """count(rule_id) AS total_issues, count(*) FILTER (WHERE severity = 'critical') AS critical,
  count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'low') AS low,
  count(*) FILTER (WHERE rule_id IS NOT NULL AND severity NOT IN ('critical', 'high', 'medium', 'low')) AS info"""
SUMM = f"""summ AS (SELECT f.file_id, f.org, f.repo, f.pr_number, f.file_path, {COUNTS}
  FROM files f LEFT JOIN (SELECT file_id, rule_id, severity FROM uniq) u USING (file_id) GROUP BY ALL)"""


def core(select: str, *extra: str, rules=None) -> str:
    return "WITH " + ",\n".join([files_cte(), hits_cte(rules or CORE), UNIQ, SUMM, *extra]) + "\n" + select


def action(mode: str) -> str:
    return (f"CASE WHEN {mode} = 'warning' AND total_issues > 0 THEN 'annotate' "
            f"WHEN {mode} = 'blocking' AND critical + high > 0 THEN 'block' "
            f"WHEN {mode} = 'blocking' AND total_issues > 0 THEN 'annotate' ELSE 'none' END")


# --- configuration -------------------------------------------------------------
LISTS = {"enabled_rule_packs": "packs", "custom_rules": "rules", "allowed_licenses": "allowed",
         "blocked_licenses": "blocked", "include_patterns": "include", "exclude_patterns": "exclude",
         "override_approvers": "approvers"}


def resolved(repos: str = "SELECT DISTINCT org, repo FROM files") -> str:
    fields = []
    for name, short in LISTS.items():
        stored = ",".join(config.LIST_DEFAULTS[name])
        unset = ",".join(config.DEFAULT_EXCLUDE) if name == "exclude_patterns" else stored
        fields.append(f"CASE WHEN r.org IS NOT NULL THEN coalesce(nullif(r.{short}_csv, ''), {lit(stored)}) "
                      f"WHEN o.org IS NOT NULL THEN coalesce(nullif(o.{short}_csv, ''), {lit(stored)}) "
                      f"ELSE {lit(unset)} END AS {name}")
    return f"""{cte('repo_configs', derived.REPO_CONFIGS)}, {cte('org_configs', derived.ORG_CONFIGS)},
resolved AS (SELECT q.org, q.repo,
  CASE WHEN r.org IS NOT NULL THEN 'repo' WHEN o.org IS NOT NULL THEN 'org' ELSE 'default' END AS config_level,
  CASE WHEN r.org IS NOT NULL THEN r.enforcement_mode ELSE coalesce(o.enforcement_mode, 'warning') END AS enforcement_mode,
  {", ".join(fields)},
  CASE WHEN r.org IS NOT NULL THEN r.override_allowed ELSE coalesce(o.override_allowed, TRUE) END AS override_allowed
  FROM ({repos}) q LEFT JOIN repo_configs r ON r.org = q.org AND r.repo = q.repo
  LEFT JOIN org_configs o ON o.org = q.org)"""


ENFORCED = f"""enforced AS (SELECT s.*, enforcement_mode, override_allowed, {action('enforcement_mode')} AS enforcement_action
  FROM summ s JOIN resolved USING (org, repo))"""
ROLL = """CAST(count(*) AS BIGINT) AS files, CAST(sum(total_issues) AS BIGINT) AS total_issues,
  CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium,
  CAST(sum(low) AS BIGINT) AS low, CAST(sum(info) AS BIGINT) AS info,
  CASE WHEN sum(total_issues) = 0 THEN 'clean' ELSE 'violations_found' END AS status,
  CASE max(CASE enforcement_action WHEN 'block' THEN 2 WHEN 'annotate' THEN 1 ELSE 0 END)
    WHEN 2 THEN 'block' WHEN 1 THEN 'annotate' ELSE 'none' END AS enforcement_action"""


def pack_rules(packs: str, explicit: str) -> str:
    """Comma-joined rule ids chosen by csv expressions, in order."""
    members = "CASE p " + " ".join(
        f"WHEN {lit(name)} THEN {lit(list(ids))}" for name, ids in CATALOGUE.list_packs().items()) + " ELSE [] END"
    known = lit(list(CATALOGUE.rules))
    # The lists hold distinct packs with disjoint rules, so order-keeping de-duplication is not needed.
    return f"""CASE WHEN {explicit} <> '' THEN array_to_string(list_filter(string_split({explicit}, ','),
      lambda i: list_contains({known}, i)), ',')
    ELSE array_to_string(flatten(list_transform(string_split({packs}, ','), lambda p: {members})), ',') END"""


# --- globs, spelled by hand --------------------------------------------------------
GLOBS = {
    "src/**/*": "^src/(.*/)?[^/]*$", "lib/**/*": "^lib/(.*/)?[^/]*$", "src/*": "^src/[^/]*$",
    "node_modules/**": "^node_modules/.*$", "dist/**": "^dist/.*$", "build/**": "^build/.*$",
    "**/tests/**": "^(.*/)?tests/.*$", "src/api/**": "^src/api/.*$",
}


def matches_globs(csv: str) -> str:
    tests = [f"(list_contains(string_split({csv}, ','), {lit(g)}) AND regexp_matches(file_path, {lit(r)}))"
             for g, r in GLOBS.items()]
    tests.append(f"(list_contains(string_split({csv}, ','), '*.min.js') AND "
                 "regexp_matches(list_extract(string_split(file_path, '/'), -1), '^[^/]*\\.min\\.js$'))")
    return "(" + " OR ".join(tests) + ")"


# --- kernel ---------------------------------------------------------------------------
def kernel(regex: str, select: str) -> str:
    return f"""WITH {files_cte()},
cand AS (SELECT *, regexp_extract_all(code, {lit(regex)}) AS m, string_split_regex(code, {lit(regex)}) AS g,
  string_split(code, chr(10)) AS lines FROM files WHERE regexp_matches(code, {lit(regex)})),
found_at AS (SELECT *, m[i] AS match_text, array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '') AS prefix
  FROM cand, unnest(range(1, len(m) + 1)) AS u(i)),
spans AS (SELECT *, CAST(i - 1 AS INT) AS n, CAST(1 + len(prefix) - len(replace(prefix, chr(10), '')) AS INT) AS l1,
  CAST(1 + len(prefix || match_text) - len(replace(prefix || match_text, chr(10), '')) AS INT) AS l2 FROM found_at)
{select}"""


def stripped(text: str) -> str:
    return f"regexp_replace(regexp_replace({text}, '^\\s+', ''), '\\s+$', '')"


def brace_sql() -> str:
    return kernel(OPEN_RE, """,
tok AS (SELECT file_id, n, k, t[k] AS token,
    1 + sum(CASE WHEN t[k] LIKE '%{' THEN 1 WHEN t[k] LIKE '%}' THEN -1 ELSE 0 END)
        OVER (PARTITION BY file_id, n ORDER BY k) AS depth
  FROM (SELECT file_id, n, regexp_extract_all(substr(code, len(prefix || match_text) + 1), '[^{}]*[{}]|[^{}]+$') AS t
        FROM spans), unnest(range(1, len(t) + 1)) AS u(k)),
ends AS (SELECT file_id, n, min(CASE WHEN depth = 0 THEN k END) AS stop FROM tok GROUP BY ALL),
bodies AS (SELECT file_id, n, string_agg(token, '' ORDER BY k) AS body FROM tok JOIN ends USING (file_id, n)
  WHERE stop IS NULL OR k <= stop GROUP BY ALL)
SELECT file_id, n, CAST(len(coalesce(body, '')) AS BIGINT) AS body_chars, md5(coalesce(body, '')) AS body_md5
FROM spans LEFT JOIN bodies USING (file_id, n)""").replace("\n,\ntok", ",\ntok")


# --- licences ---------------------------------------------------------------------------
def license_ctes() -> str:
    cases = " ".join(
        f"WHEN regexp_matches(header, {lit('(?i)' + '|'.join(rs))}) THEN {lit(i)}" for i, rs in LICENSE_PATTERNS)
    names = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in LICENSE_NAMES.items())
    return f"""{files_cte()}, {documents_cte('docs')}, {cte('manifests', derived.MANIFESTS)},
lic_files AS (SELECT file_id, org, repo, file_path, code FROM files UNION ALL
  SELECT file_id, org, repo, file_path, code FROM docs UNION ALL SELECT file_id, org, repo, file_path, code FROM manifests),
headed AS (SELECT *, code AS header FROM lic_files),
found AS (SELECT *, CASE {cases} END AS by_header,
  CASE WHEN ends_with(file_path, 'package.json') AND json_valid(code) THEN json_extract_string(code, '$.license') END
    AS by_manifest FROM headed),
detected AS (SELECT file_id, org, repo, file_path, coalesce(by_header, by_manifest) AS license_id,
  CASE coalesce(by_header, by_manifest) {names} ELSE coalesce(by_header, by_manifest) END AS license_name,
  CASE WHEN by_header IS NOT NULL THEN 0.9::DOUBLE WHEN by_manifest IS NOT NULL THEN 1.0::DOUBLE END AS confidence,
  CASE WHEN by_header IS NOT NULL THEN 'file_header' WHEN by_manifest IS NOT NULL THEN 'package.json' END AS license_source
  FROM found)"""


def judged_ctes() -> str:
    return f"""{license_ctes()}, {resolved('SELECT DISTINCT org, repo FROM lic_files')},
judged AS (SELECT d.*, CASE WHEN license_id IS NULL THEN NULL
  WHEN list_contains(string_split(blocked_licenses, ','), license_id) THEN 'blocked'
  WHEN list_contains(string_split(allowed_licenses, ','), license_id) THEN 'allowed' ELSE 'review' END AS license_status
  FROM detected d JOIN resolved USING (org, repo))"""


LICENSE_COUNTS = """count(*) AS total_files, count(*) FILTER (WHERE license_status = 'allowed') AS compliant_count,
  count(*) FILTER (WHERE license_status = 'blocked') AS non_compliant_count, count(*) FILTER (WHERE license_status = 'review') AS review_count"""


# --- similarity -----------------------------------------------------------------------------
def similarity_sql(threshold: float, score: str, select: str) -> str:
    def grams(name, source):
        return f"""{name}_t AS (SELECT id, list_filter(string_split_regex(lower(text), '[^\\p{{L}}0-9_]+'), lambda x: x <> '') AS t
  FROM ({source})),
{name} AS (SELECT DISTINCT id, array_to_string(t[i:i+2], ' ') AS s
  FROM {name}_t, unnest(range(1, greatest(len(t) - 1, 2))) AS u(i) WHERE len(t) > 0)"""
    return f"""WITH {grams('fs', 'SELECT doc_id AS id, text FROM documents')},
{grams('ss', 'SELECT item_id AS id, text FROM benchmark')},
fn AS (SELECT id, count(*) AS n FROM fs GROUP BY id), sn AS (SELECT id, count(*) AS n FROM ss GROUP BY id),
pairs AS (SELECT fs.id AS f, ss.id AS s, count(*) AS shared FROM fs JOIN ss ON fs.s = ss.s GROUP BY ALL),
scored AS (SELECT f AS file_id, s AS source_id, CAST(shared AS INT) AS shared, {score} AS similarity_score
  FROM pairs JOIN fn ON fn.id = f JOIN sn ON sn.id = s)
SELECT {select} FROM scored WHERE round(similarity_score, 9) >= {threshold}"""


# --- AI responses ---------------------------------------------------------------------------
AI = f"""{cte('responses', derived.AI_RESPONSES)},
cleaned AS (SELECT *, {stripped("regexp_replace(regexp_replace(" + stripped('raw') + ", '^```(json)?', ''), '```$', '')")} AS doc
  FROM responses),
parsed AS (SELECT *, CASE WHEN json_valid(doc) AND doc <> '' THEN json_extract(doc, '$.violations[*]') ELSE [] END AS found,
  NOT (json_valid(doc) AND doc <> '') AS parse_failed FROM cleaned),
findings AS (SELECT file_id, file_path, category, i - 1 AS pos, found[i] AS v FROM parsed, unnest(range(1, len(found) + 1)) AS u(i))"""


def _js(name: str) -> str:
    return f"json_extract_string(v, '$.{name}')"


AI_ROWS = f"""ai_rows AS (SELECT file_id, file_path, category, pos,
  'AI-' || upper(category) || '-' || printf('%03d', pos + 1) AS rule_id,
  CASE WHEN lower({_js('severity')}) IN ('critical', 'high', 'medium', 'low', 'info') THEN lower({_js('severity')})
    ELSE 'medium' END AS severity,
  coalesce({_js('title')}, 'Unknown Issue') AS title,
  coalesce({_js('description')}, 'No description provided') AS description,
  CAST(coalesce({_js('line_start')}, '1') AS INT) AS line_start,
  CAST(coalesce({_js('line_end')}, {_js('line_start')}, '1') AS INT) AS line_end,
  coalesce({_js('code_snippet')}, '') AS code_snippet, {_js('owasp_mapping')} AS owasp_mapping, {_js('cwe_id')} AS cwe_id,
  coalesce({_js('explanation')}, {_js('description')}, '') AS explanation, {_js('suggested_fix')} AS suggested_fix
  FROM findings)"""


# --- naming -----------------------------------------------------------------------------------
def _cap(word: str) -> str:
    return f"upper({word}[1:1]) || lower({word}[2:])"


_WORDS = "string_split_regex(name, '[_\\s]+')"
_PASCAL = f"array_to_string(list_transform({_WORDS}, lambda w: {_cap('w')}), '')"
_CAMEL = f"lower({_WORDS}[1]) || array_to_string(list_transform({_WORDS}[2:], lambda w: {_cap('w')}), '')"
_UNDER = "regexp_replace(name, '([A-Z])', '_\\1', 'g')"

PR = "json_extract_string(payload, '$.{}')"


def pushes(spec) -> str:
    return f"""{cte('payloads', spec)},
pushes AS (SELECT *, replace({PR.format('ref')}, 'refs/heads/', '') AS branch,
  coalesce(nullif({PR.format('repository.owner.login')}, ''), {PR.format('repository.owner.name')}, '') AS org,
  {PR.format('repository.name')} AS repo, {PR.format('after')} AS commit_sha, {PR.format('pusher.name')} AS author,
  CAST(json_array_length(payload, '$.commits') AS INT) AS n_commits FROM payloads),
main AS (SELECT * FROM pushes WHERE branch IN ('main', 'master') AND n_commits > 0)"""


PUSHES = pushes(derived.PUSH_PAYLOADS)
CHANGED = f"""paths AS (SELECT event_id, org, repo, commit_sha, unnest(list_concat(
        json_extract_string(payload, '$.commits[*].added[*]'), json_extract_string(payload, '$.commits[*].modified[*]')))
        AS file_path FROM main),
      changed AS (SELECT DISTINCT event_id, org, repo, commit_sha, file_path FROM paths WHERE {supported('file_path')})"""
PUSHED = f"""{pushes(derived.PUSH_LOG)}, {CHANGED}, {cte('versions', derived.FILE_VERSIONS)},
      pushed AS (SELECT c.*, v.version_id, v.body_key, v.removed FROM changed c ASOF LEFT JOIN versions v
        ON c.org = v.org AND c.repo = v.repo AND c.file_path = v.file_path AND c.event_id >= v.position)"""
_AUTHORSHIP_DOC = stripped("regexp_replace(regexp_replace(" + stripped('raw') + ", '^```(json)?', ''), '```$', '')")
FLAGS = f"""{cte('responses_ai', derived.AUTHORSHIP)},
flags AS (SELECT file_id AS flag_id, coalesce(json_extract_string(CASE WHEN json_valid({_AUTHORSHIP_DOC}) THEN {_AUTHORSHIP_DOC} END,
  '$.is_ai_generated') = 'true', FALSE) AS detected_ai_code FROM responses_ai)"""

AUDIT = cte("logs", derived.AUDIT_LOGS)
ISO = """CASE WHEN strftime(timestamp, '%f') = '000000' THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
  ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END"""
_AUDIT_JSON = ", ".join(
    f"{lit(k)}: " + (f"strftime({k}, '%Y-%m-%d %H:%M:%S.%f')" if k in ("timestamp", "resolved_at") else k)
    for k in derived.AUDIT_LOGS[1])


def custom_sql() -> str:
    constants = ["db[.]query", "return [a-z]+", "patient", "import +([a-z]+)", "const"]
    branches = "\nUNION ALL\n".join(
        f"SELECT *, {lit(p)} AS pattern, regexp_extract_all(code, {lit('(?im)' + p)}) AS m, "
        f"string_split_regex(code, {lit('(?im)' + p)}) AS g FROM files WHERE regexp_matches(code, {lit('(?im)' + p)})"
        for p in constants)
    return f"""WITH {files_cte()}, {cte('rules', derived.CUSTOM_RULES)},
cand AS ({branches}),
found_at AS (SELECT *, m[i] AS match_text, array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '') AS prefix
  FROM cand, unnest(range(1, len(m) + 1)) AS u(i)),
spans AS (SELECT DISTINCT file_id, org, repo, language, pattern,
  CAST(1 + len(prefix) - len(replace(prefix, chr(10), '')) AS INT) AS line_start,
  CAST(1 + len(prefix || match_text) - len(replace(prefix || match_text, chr(10), '')) AS INT) AS line_end FROM found_at),
usable AS (SELECT * FROM rules WHERE enabled AND rule_type = 'regex'),
scoped AS (
  SELECT s.*, r.* EXCLUDE (org, repo, pattern) FROM spans s JOIN usable r ON r.pattern = s.pattern AND r.org IS NULL
  UNION ALL
  SELECT s.*, r.* EXCLUDE (org, repo, pattern) FROM spans s JOIN usable r ON r.pattern = s.pattern AND r.org = s.org AND r.repo IS NULL
  UNION ALL
  SELECT s.*, r.* EXCLUDE (org, repo, pattern) FROM spans s JOIN usable r ON r.pattern = s.pattern AND r.org = s.org AND r.repo = s.repo)
SELECT file_id, id AS rule_id, line_start, line_end, severity, category, name AS title, coalesce(description, name) AS description
FROM scoped WHERE languages_csv IS NULL OR list_contains(string_split(lower(languages_csv), ','), lower(language))"""


def markdown_sql() -> str:
    """Blocks of every pull request's report."""
    nl = "chr(10)"
    exact = [(r, x, t) for r, texts in REMEDIES.items() for x, t in texts.items() if x != "*"]
    general = [(r, t) for r, texts in REMEDIES.items() for x, t in texts.items() if x == "*"]
    table = " || ".join(f"'| {MARKS[s]} {s.capitalize()} | ' || {s} || ' |' || {nl}" for s in MARKS)
    acts = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in ACTION_TEXT.items())

    def escaped(column):
        return (f"replace(replace(replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), "
                "chr(34), '&quot;'), chr(39), '&#39;')")

    camel = _CAMEL.replace("(name", "(coalesce(detail, '')")
    lang = language_sql("file_path")
    fix = f"CASE WHEN rule_id = 'STD-001' THEN 'Rename to: ' || {camel} ELSE coalesce(x.fix, d.fix) END"
    body = f"""'<details>' || {nl} || '<summary><b>' || {escaped('title')} || '</b> - <code>' || {escaped('file_path')} || ':' ||
      line_start || '</code></summary>' || {nl} || {nl} || '**Rule:** `' || rule_id || '`' ||
      coalesce(' | **OWASP:** ' || owasp_mapping, '') || coalesce(' | **CWE:** ' || cwe_id, '') || {nl} || {nl} ||
      CASE WHEN code_snippet <> '' THEN '```' || {lang} || {nl} || '// Line ' || line_start || '-' || line_end || {nl} ||
        code_snippet || {nl} || '```' || {nl} || {nl} ELSE '' END ||
      '**Why this is an issue:**' || {nl} || description || {nl} || {nl} ||
      CASE WHEN coalesce(fix, '') <> '' THEN '**Suggested Fix:**' || {nl} || '```' || {lang} || {nl} || fix || {nl} ||
        '```' || {nl} || {nl} ELSE '' END || '</details>' || {nl}"""
    keys = "org, repo, pr_number"

    def frame(section, text, cond="TRUE"):
        return f"SELECT {keys}, {section} AS section, '' AS position, {text} AS block FROM prs WHERE {cond}"

    frames = [
        frame(0, f"'## Security & Compliance Report' || {nl} || {nl} || '### Summary' || {nl} || {nl} || '| Severity | Count |' "
                 f"|| {nl} || '|----------|-------|' || {nl} || {table} || {nl} || '**Enforcement Action:** ' || "
                 f"CASE enforcement_action {acts} END || {nl}"),
        frame(10, f"'### {MARKS['critical']} Critical Issues' || {nl}", "critical > 0"),
        frame(20, f"'### {MARKS['high']} High Issues' || {nl}", "high > 0"),
        frame(30, f"'### {MARKS['medium']} Medium Issues' || {nl}", "medium > 0"),
        frame(32, f"'<details><summary>Show ' || (medium - 5) || ' more medium issues</summary>' || {nl}", "medium > 5"),
        frame(34, f"'</details>' || {nl}", "medium > 5"),
        frame(90, f"'### Actions' || {nl} || {nl} || CASE WHEN critical + high > 0 THEN "
                  f"'- [ ] Fix critical and high severity issues before merge' || {nl} ELSE '' END || "
                  f"CASE WHEN medium > 0 THEN '- [ ] Review medium severity issues' || {nl} ELSE '' END || "
                  f"CASE WHEN enforcement_action = 'block' AND override_allowed THEN {nl} || "
                  f"'**Override:** comment the override command with a justification.' || {nl} ELSE '' END"),
    ]
    return core(f"""SELECT {keys}, section, position, block FROM (
        {' UNION ALL '.join(frames)}
        UNION ALL SELECT {keys}, CAST(CASE severity WHEN 'critical' THEN 11 WHEN 'high' THEN 21
            ELSE CASE WHEN n <= 5 THEN 31 ELSE 33 END END AS INT),
          file_path || '|' || printf('%09d', line_start) || '|' || printf('%09d', line_end) || '|' || rule_id, {body}
        FROM fixed)""",
        resolved(), ENFORCED,
        f"prs AS (SELECT {keys}, override_allowed, {ROLL} FROM enforced GROUP BY {keys}, override_allowed)",
        values("exact", ["rule", "lang", "fix"], exact), values("general", ["rule", "fix"], general),
        f"""fixed AS (SELECT h.*, row_number() OVER (PARTITION BY {keys}, severity
            ORDER BY file_path, line_start, line_end, rule_id) AS n, {fix} AS fix
          FROM uniq h LEFT JOIN exact x ON x.rule = h.rule_id AND x.lang = h.language
          LEFT JOIN general d ON d.rule = h.rule_id)""")


def settings_columns(*documents: str) -> str:
    """Each field of the settings from JSON documents, the most general first; null documents say nothing."""
    out = []
    for section, fields in settings.SECTIONS.items():
        for name, default in fields.items():
            kind = {bool: "BOOLEAN", str: "VARCHAR", float: "DOUBLE", dict: "VARCHAR"}.get(type(default))
            default = "'{}'" if default == {} else lit(",".join(default)) if kind is None else f"CAST({lit(default)} AS {kind})"
            value = default
            for d in documents:
                path = f"'$.{section}.{name}'"
                given = (f"CAST(json_extract_string({d}, {path}) AS {kind})" if kind else
                         f"array_to_string(json_extract_string({d}, '$.{section}.{name}[*]'), ',')")
                value = (f"CASE json_type({d}, '$.{section}') WHEN 'NULL' THEN {default} WHEN 'OBJECT' THEN CASE "
                         f"WHEN json_type({d}, {path}) = 'NULL' THEN {default} WHEN json_type({d}, {path}) IS NULL THEN {value} "
                         f"ELSE {given} END ELSE {value} END")
            out.append(f"{value} AS {section}_{name}")
    return ", ".join(out)


def valid(document: str) -> str:
    return f"CASE WHEN json_valid({document}) THEN {document} END"


SETTINGS = f"""{cte('repo_settings', derived.REPO_SETTINGS)}, {cte('org_settings', derived.ORG_SETTINGS)},
settled AS (SELECT q.org, q.repo, {settings_columns('od', 'rd')} FROM (SELECT f.org, f.repo, {valid('o.document')} AS od, {valid('r.document')} AS rd
  FROM (SELECT DISTINCT org, repo FROM files) f LEFT JOIN org_settings o ON o.org = f.org
  LEFT JOIN repo_settings r ON r.org = f.org AND r.repo = f.repo) q)"""


def body_files() -> str:
    """The contents of file versions as files, each with the path of its versions."""
    own = files_cte().replace("FROM orders)", "FROM body_keys)").replace(corpus.FILE_FIELDS["file_path"], derived.version_path("o_orderkey"))
    return f"body_keys AS (SELECT DISTINCT {derived.BODY_KEY} AS o_orderkey, 0 AS o_custkey FROM orders),{own}"


def push_ctes() -> str:
    """Roll-up of pushes: files as of the push, hits of the repository's packs, one per location."""
    chosen = pack_rules("enabled_rule_packs", "custom_rules")
    return f"""{body_files()}, {hits_cte(CATALOGUE.list_rules())}, {PUSHED}, {FLAGS}, {resolved('SELECT DISTINCT org, repo FROM main')},
seen AS (SELECT p.event_id, p.file_path, body_key, enforcement_mode, string_split({chosen}, ',') AS ids, detected_ai_code
  FROM pushed p JOIN resolved USING (org, repo) JOIN flags ON flag_id = version_id WHERE NOT removed),
push_hits AS (SELECT event_id, s.file_path, h.severity, h.rule_id FROM seen s JOIN hits h ON h.file_id = s.body_key
  WHERE list_contains(ids, rule_id) QUALIFY row_number() OVER (PARTITION BY event_id, s.file_path, line_start, line_end
    ORDER BY list_position(ids, rule_id), pattern_ord, match_ord) = 1),
push_summ AS (SELECT s.event_id, s.file_path, enforcement_mode, detected_ai_code, {COUNTS}
  FROM seen s LEFT JOIN push_hits h ON h.event_id = s.event_id AND h.file_path = s.file_path GROUP BY ALL),
push_acted AS (SELECT *, {action('enforcement_mode')} AS enforcement_action FROM push_summ),
push_sums AS (SELECT event_id, bool_or(detected_ai_code) AS detected_ai_code, {ROLL} FROM push_acted GROUP BY event_id),
push_rolled AS (SELECT m.event_id, m.org, m.repo, m.branch, m.commit_sha, m.author,
  {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("files", "total_issues", "critical", "high", "medium", "low", "info"))},
  coalesce(status, 'clean') AS status, coalesce(detected_ai_code, FALSE) AS detected_ai_code,
  coalesce(enforcement_action, 'none') AS enforcement_action, r.enforcement_mode
  FROM main m LEFT JOIN push_sums USING (event_id) JOIN resolved r ON r.org = m.org AND r.repo = m.repo
  WHERE event_id IN (SELECT event_id FROM changed))"""


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    hit_columns = cols(HIT_COLUMNS)
    for key, rule_id in RULE_KEYS.items():
        out[key] = scan_sql([CATALOGUE.rules[rule_id]], f"SELECT {hit_columns} FROM hits")
    for key, pack in PACK_KEYS.items():
        out[key] = scan_sql(CATALOGUE.select(packs=[pack]), f"SELECT {cols(SHORT)} FROM hits")
    out["std_003_async"] = scan_sql([CATALOGUE.rules["STD-003"]],
                                    f"SELECT {hit_columns} FROM hits WHERE label = 'unhandled async'")
    out["secrets_in_documents"] = scan_sql(
        [CATALOGUE.rules["SEC-001"]],
        "SELECT file_id, line_start, line_end, md5(code_snippet) AS snippet_md5 FROM hits", documents_cte())
    out["scan_security"] = scan_sql(CATALOGUE.select(category="security"), f"SELECT {cols(SHORT)} FROM hits")
    out["scan_standards"] = scan_sql(CATALOGUE.select(category="standards"), f"SELECT {cols(SHORT)} FROM hits")

    out["src_code_files"] = f"""WITH {files_cte()} SELECT file_id, file_path, language,
      CAST(len(code) AS BIGINT) AS n_chars, sha256(code) AS digest FROM files
      WHERE file_id % 29 <> 0 AND file_id % 31 <> 0 AND code <> ''"""
    out["src_pr_events"] = f"""WITH {cte('payloads', derived.PR_PAYLOADS)}
      SELECT event_id, {PR.format('action')} AS action, {PR.format('repository.owner.login')} AS org,
        {PR.format('repository.name')} AS repo, CAST({PR.format('number')} AS INT) AS pr_number,
        {PR.format('pull_request.head.sha')} AS commit_sha, {PR.format('pull_request.user.login')} AS author
      FROM payloads WHERE {PR.format('action')} IN ('opened', 'synchronize')"""
    out["src_push_events"] = f"WITH {PUSHES} SELECT event_id, branch, org, repo, commit_sha, author, n_commits FROM main"
    out["changed_files"] = f"WITH {PUSHES}, {CHANGED} SELECT * FROM changed"
    out["pushed_versions"] = f"WITH {PUSHED} SELECT event_id, org, repo, commit_sha, file_path, version_id FROM pushed"
    out["detect_language"] = f"""WITH {files_cte()}, paths AS (SELECT file_path FROM files UNION ALL SELECT url FROM pages)
      SELECT file_path, {language_sql('file_path')} AS language, {supported('file_path')} AS supported FROM paths"""
    out["supported_files"] = f"""WITH {files_cte()} SELECT file_id, file_path, language,
      CASE file_id % 6 WHEN 1 THEN 'added' ELSE 'modified' END AS change_status
      FROM files WHERE file_id % 6 <> 0 AND {supported('file_path')}"""
    languages = CATALOGUE.languages()
    pairs = [(r.rule_id, x.lower()) for r in CATALOGUE.list_rules() for x in (r.languages or [*languages, "*"])]
    known = cols(lit(x) for x in languages)
    out["rules_applicable"] = f"""WITH {files_cte()}, {values('supports', ['rule_id', 'lang'], pairs)}
      SELECT file_id, language, rule_id FROM files JOIN supports
        ON lang = CASE WHEN lower(language) IN ({known}) THEN lower(language) ELSE '*' END"""
    out["config_resolve"] = f"WITH {files_cte()}, {resolved()} SELECT * FROM resolved"
    chosen = pack_rules("enabled_rule_packs", "custom_rules")
    out["rules_selected"] = f"WITH {files_cte()}, {resolved()} SELECT org, repo, {chosen} AS rule_ids FROM resolved"
    out["scan_pack"] = f"""WITH {files_cte()}, {hits_cte(CATALOGUE.list_rules())}, {resolved()},
      chosen AS (SELECT org, repo, string_split({chosen}, ',') AS ids FROM resolved)
      SELECT {cols(SHORT)} FROM hits JOIN chosen USING (org, repo) WHERE list_contains(ids, rule_id)"""
    out["path_scope_filter"] = f"""WITH {files_cte()}, {resolved()}
      SELECT file_id, file_path, {matches_globs('include_patterns')} AND NOT {matches_globs('exclude_patterns')} AS in_scope
      FROM files JOIN resolved USING (org, repo)"""
    out["diff_only_hits"] = scan_sql(
        CATALOGUE.list_rules(),
        f"SELECT {cols(SHORT)} FROM hits WHERE len(list_filter(range(line_start, line_end + 1), lambda n: (n - 1 + file_id) % 3 = 0)) > 0")
    out["config_overlay"] = f"""WITH {cte('parsed', derived.PARSED_FILES)} SELECT org, repo,
      CASE WHEN has_file THEN coalesce(nullif(enforcement_mode, ''), 'warning') ELSE 'warning' END AS enforcement_mode,
      CASE WHEN has_file THEN coalesce(packs_csv, 'default-security,enterprise-standards')
        ELSE 'default-security,enterprise-standards' END AS rule_packs,
      CASE WHEN has_file THEN block_threshold ELSE 'high' END AS block_threshold,
      CASE WHEN has_file THEN secrets ELSE TRUE END AS secrets_enabled,
      CASE WHEN has_file THEN naming ELSE TRUE END AS naming_enabled,
      CASE WHEN has_file AND allowed_csv IS NOT NULL THEN allowed_csv ELSE 'MIT,Apache-2.0,BSD-3-Clause' END AS allowed,
      CASE WHEN has_file AND allowed_csv IS NOT NULL THEN blocked_csv ELSE 'GPL-3.0,AGPL-3.0' END AS blocked,
      CASE WHEN has_file THEN strict_mode ELSE TRUE END AS strict_mode FROM parsed"""
    out["settings_resolve"] = f"WITH {files_cte()}, {SETTINGS} SELECT * FROM settled"
    out["settings_update"] = f"""WITH {cte('stored', derived.REPO_SETTINGS)}, {cte('patches', derived.SETTINGS_PATCHES)},
      met AS (SELECT coalesce(s.org, p.org) AS org, coalesce(s.repo, p.repo) AS repo, {valid('s.document')} AS sd, {valid('p.document')} AS pd
        FROM stored s FULL JOIN patches p ON s.org = p.org AND s.repo = p.repo)
      SELECT org, repo, {settings_columns('sd', 'pd')} FROM met"""
    switched = " AND ".join(f"(rule_id <> {lit(rule)} OR {s}_{n})" for (s, n), rule in settings.SWITCHES.items())
    rank = "CASE {} WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END"
    out["scan_with_settings"] = f"""WITH {files_cte()}, {hits_cte(CATALOGUE.list_rules())}, {SETTINGS},
      on_hits AS (SELECT h.file_id, h.severity, security_block_threshold AS threshold FROM hits h JOIN settled USING (org, repo) WHERE {switched})
      SELECT f.file_id, CAST(count(h.file_id) AS INT) AS total_issues,
        CASE WHEN bool_or(h.file_id IS NOT NULL AND {rank.format('h.severity')} <= {rank.format('threshold')}) THEN 'block' WHEN count(h.file_id) > 0 THEN 'annotate'
          ELSE 'none' END AS enforcement_action
      FROM files f LEFT JOIN on_hits h ON h.file_id = f.file_id GROUP BY f.file_id"""
    out["list_rules"] = f"""WITH {cte('rules', derived.CUSTOM_RULES)}
      SELECT id, name, severity, rule_type, org, repo FROM rules WHERE category = 'security' AND enabled"""
    packs = [(n, d, c, len(CATALOGUE.packs[n]), ",".join(CATALOGUE.packs[n])) for n, d, _, c in PACK_INFO]
    out["pack_listing"] = f"""WITH {files_cte()}, {resolved()},
      {values('packs', ['pack', 'display_name', 'category', 'rule_count', 'rules'], packs)},
      used AS (SELECT unnest(string_split(enabled_rule_packs, ',')) AS pack FROM resolved)
      SELECT p.pack, display_name, category, rule_count, rules, count(u.pack) AS enabled_in
      FROM packs p LEFT JOIN used u ON u.pack = p.pack GROUP BY ALL"""

    out["regex_finditer"] = kernel(CALL_RE, """SELECT file_id, CAST(len(prefix) AS BIGINT) AS start_at,
      CAST(len(prefix) + len(match_text) AS BIGINT) AS end_at, match_text AS match FROM spans""")
    out["line_numbers"] = kernel(BLOCK_RE, "SELECT file_id, n, l1 AS line_start, l2 AS line_end FROM spans")
    out["snippets"] = kernel(BLOCK_RE, f"""SELECT file_id, n, {stripped("array_to_string(lines[l1:l2], chr(10))")}
      AS snippet FROM spans""")
    out["context_window"] = kernel(RETURN_RE, """SELECT file_id, n,
      array_to_string(lines[greatest(1, l1 - 2) : least(len(lines), l1 + 3)], chr(10)) AS context FROM spans""")
    out["comment_skip"] = kernel(WORD_CALL_RE, """SELECT file_id, l1 AS line,
      contains(list_extract(string_split(prefix, chr(10)), -1), CASE WHEN language = 'python' THEN '#' ELSE '//' END)
        AS commented
      FROM spans QUALIFY row_number() OVER (PARTITION BY file_id, l1 ORDER BY n) = 1""")
    out["brace_body"] = brace_sql()
    out["naming_fix"] = f"""WITH {cte('names', derived.NAMES)} SELECT name_id, name, 'Rename to: ' || CASE
      WHEN language = 'python' AND element = 'class' THEN {_PASCAL}
      WHEN language = 'python' THEN ltrim(lower({_UNDER}), '_')
      WHEN element IN ('class', 'interface', 'type') THEN {_PASCAL}
      WHEN element = 'constant' THEN ltrim(upper({_UNDER}), '_') ELSE {_CAMEL} END AS suggestion FROM names"""
    out["custom_regex_rules"] = custom_sql()
    out["custom_rule_errors"] = f"""WITH {cte('rules', derived.CUSTOM_RULES)} SELECT id, org, repo, name, pattern, TRUE AS rejected
      FROM rules WHERE enabled AND rule_type = 'regex' AND pattern = '(unclosed'"""

    out["license_detect"] = f"""WITH {license_ctes()} SELECT file_path, license_id, confidence, license_source
      FROM detected WHERE license_id IS NOT NULL"""
    out["license_name"] = f"""WITH {license_ctes()} SELECT license_id, license_name, count(*) AS files FROM detected
      WHERE license_id IS NOT NULL GROUP BY ALL"""
    out["license_status"] = f"""WITH {judged_ctes()} SELECT file_path, org, repo, license_id, license_status FROM judged
      WHERE license_id IS NOT NULL"""
    out["license_report"] = f"""WITH {judged_ctes()}, counts AS (SELECT org, repo, {LICENSE_COUNTS} FROM judged GROUP BY ALL)
      SELECT *, CASE WHEN non_compliant_count > 0 THEN 'non_compliant' WHEN review_count > 0 THEN 'review_required'
        ELSE 'compliant' END AS status FROM counts"""
    out["license_recommendations"] = f"""WITH {judged_ctes()},
      counts AS (SELECT org, {LICENSE_COUNTS} FROM judged GROUP BY ALL)
      SELECT org, 1 AS section, CAST(0 AS BIGINT) AS position,
        'Remove or replace ' || non_compliant_count || ' file(s) with blocked licenses' AS recommendation
        FROM counts WHERE non_compliant_count > 0
      UNION ALL SELECT org, 2, file_id, '  - ' || file_path || ': ' || license_id FROM judged WHERE license_status = 'blocked'
      UNION ALL SELECT org, 3, 0, 'Review ' || review_count || ' file(s) with unclassified licenses'
        FROM counts WHERE review_count > 0"""
    # The look-ahead of the copyright pattern is vacuous, so it is left out here.
    out["ip_markers"] = f"""WITH {license_ctes()},
      marks AS (SELECT file_path, regexp_matches(code, '(?i)Copyright.*\\d{{4}}') AS a,
        regexp_matches(code, '(?i)@author\\s+[^your-team]') AS b FROM lic_files)
      SELECT file_path, a OR b AS has_similar_code, CASE WHEN a AND b
        THEN 'Potential external copyright,External author attribution' WHEN a THEN 'Potential external copyright'
        WHEN b THEN 'External author attribution' ELSE '' END AS sources,
        CASE WHEN a OR b THEN 0.7::DOUBLE END AS similarity_score, CASE WHEN a OR b THEN 'medium' ELSE 'low' END AS ip_risk
      FROM marks"""
    out["code_similarity"] = similarity_sql(
        0.85, "shared::DOUBLE / sn.n", "file_id, source_id, shared, similarity_score, "
        "CASE WHEN similarity_score >= 0.9 THEN 'high' ELSE 'medium' END AS risk_level")
    out["code_similarity_jaccard"] = similarity_sql(
        0.4, "shared::DOUBLE / (fn.n + sn.n - shared)", "file_id, source_id, shared, similarity_score")

    out["violations_by_repo"] = scan_sql(
        CATALOGUE.list_rules(),
        "SELECT org, repo, severity, count(*) AS violations FROM hits GROUP BY ALL")
    out["cascade_delete"] = scan_sql(
        CATALOGUE.list_rules(),
        f"SELECT {cols(SHORT)} FROM hits WHERE file_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
    out["override_events"] = f"""WITH {cte('comments', derived.COMMENTS)},
      {resolved('SELECT DISTINCT org, repo FROM comments')}
      SELECT comment_id, author,
        nullif(trim(regexp_extract(body, '(?i)/scanfold\\s+override(?:\\s+(.+))?', 1)), '') AS justification,
        override_allowed AND (override_approvers = '' OR list_contains(string_split(override_approvers, ','), author))
          AS can_override
      FROM comments JOIN resolved USING (org, repo) WHERE regexp_matches(body, '(?i)/scanfold\\s+override')"""
    out["config_upsert"] = f"""WITH {cte('repo_configs', derived.REPO_CONFIGS)}, {cte('org_configs', derived.ORG_CONFIGS)},
      old AS (SELECT * FROM repo_configs UNION ALL SELECT * FROM org_configs), {cte('new', derived.CONFIG_UPDATES)}
      SELECT coalesce(o.org, n.org) AS org, coalesce(o.repo, n.repo) AS repo,
        coalesce(n.enforcement_mode, o.enforcement_mode, 'warning') AS enforcement_mode,
        coalesce(n.packs_csv, o.packs_csv) AS enabled_rule_packs, coalesce(n.blocked_csv, o.blocked_csv) AS blocked_licenses,
        o.allowed_csv AS allowed_licenses, coalesce(n.override_allowed, o.override_allowed, TRUE) AS override_allowed,
        CASE WHEN n.org IS NOT NULL THEN {NOW} ELSE o.updated_at END AS updated_at
      FROM old o FULL JOIN new n ON o.org = n.org AND o.repo = n.repo"""
    out["rule_upsert"] = f"""WITH {cte('rules', derived.CUSTOM_RULES)}, {cte('changes', derived.RULE_UPDATES)}
      SELECT r.id, name, coalesce(c.severity, r.severity) AS severity, coalesce(c.enabled, r.enabled) AS enabled,
        coalesce(c.pattern, r.pattern) AS pattern, CASE WHEN c.id IS NOT NULL THEN {NOW} ELSE updated_at END AS updated_at
      FROM rules r LEFT JOIN changes c ON c.id = r.id
      WHERE r.id NOT IN (SELECT 'R' || p_partkey FROM part WHERE p_partkey % 13 = 2)"""
    out["audit_query"] = f"""WITH {AUDIT} SELECT id, timestamp, org, repo, action_taken, violations_count FROM logs
      WHERE event_type = 'scan' AND timestamp >= TIMESTAMP '2024-01-02 00:00:00'
        AND timestamp <= TIMESTAMP '2024-01-20 00:00:00'
      ORDER BY timestamp DESC, id LIMIT 100 OFFSET 20"""
    out["audit_page"] = f"""WITH {AUDIT} SELECT id, timestamp, org, repo, action_taken, violations_count FROM logs
      WHERE event_type = 'scan' AND (timestamp < TIMESTAMP {lit(CURSOR[0])} OR timestamp = TIMESTAMP {lit(CURSOR[0])} AND id > {lit(CURSOR[1])})
      ORDER BY timestamp DESC, id LIMIT 100"""
    changes = f"""{cte('stored', derived.CUSTOM_RULES)},
      keyed AS (SELECT id, name, severity, pattern, CAST(substr(id, 2) AS BIGINT) AS k FROM stored),
      versions AS (SELECT id, name, severity, pattern, TIMESTAMP '2024-01-01 00:00:00' AS valid_from,
          CASE WHEN k % 3 = 1 THEN TIMESTAMP '2024-02-01 00:00:00' WHEN k % 13 = 2 THEN TIMESTAMP '2024-03-01 00:00:00' END AS valid_to FROM keyed
        UNION ALL SELECT id, name, 'low', 'changed', TIMESTAMP '2024-02-01 00:00:00',
          CASE WHEN k % 13 = 2 THEN TIMESTAMP '2024-03-01 00:00:00' END FROM keyed WHERE k % 3 = 1
        UNION ALL SELECT id, name, severity, pattern, TIMESTAMP '2024-04-01 00:00:00', NULL FROM keyed WHERE k % 26 = 2)"""
    out["register_rules"] = f"WITH {changes} SELECT * FROM versions"
    out["catalogue_as_of"] = f"""WITH {changes} SELECT id, severity, pattern FROM versions
      WHERE valid_from <= TIMESTAMP '2024-03-15 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-03-15 00:00:00')"""
    defaults = lit(list(config.DEFAULT_PACKS))
    out["pack_enable"] = f"""WITH {cte('repo_configs', derived.REPO_CONFIGS)}, {cte('org_configs', derived.ORG_CONFIGS)},
      old AS (SELECT * FROM repo_configs UNION ALL SELECT * FROM org_configs), {cte('requests', derived.PACK_REQUESTS)},
      wanted AS (SELECT org, repo, list_sort(list(DISTINCT pack)) AS more FROM requests WHERE pack IN ({cols(lit(x) for x in CATALOGUE.packs)}) GROUP BY ALL),
      met AS (SELECT coalesce(o.org, w.org) AS org, coalesce(o.repo, w.repo) AS repo, o.enforcement_mode, o.packs_csv, more,
          CASE WHEN o.packs_csv = '' THEN [] ELSE coalesce(string_split(o.packs_csv, ','), {defaults}) END AS held
        FROM old o FULL JOIN wanted w ON o.org = w.org AND o.repo IS NOT DISTINCT FROM w.repo)
      SELECT org, repo, enforcement_mode, CASE WHEN more IS NULL THEN packs_csv
        ELSE array_to_string(list_concat(held, list_filter(more, lambda p: NOT list_contains(held, p))), ',') END AS enabled_rule_packs FROM met"""
    out["audit_resolve"] = f"""WITH {AUDIT}, changes AS (SELECT 'a' || event_id AS id, 'user' || user_id AS who
        FROM events WHERE event_id % 7 = 3)
      SELECT l.id, CASE WHEN c.id IS NOT NULL THEN 'resolved' ELSE resolution_state END AS resolution_state,
        coalesce(who, resolved_by) AS resolved_by, CASE WHEN c.id IS NOT NULL THEN {NOW} ELSE resolved_at END AS resolved_at
      FROM logs l LEFT JOIN changes c ON c.id = l.id"""
    out["audit_from_scan"] = core(f"""SELECT 'scan' AS event_type,
        CASE WHEN total_issues > 0 THEN string_split(file_path, '/')[1] ELSE 'unknown' END AS org, 'unknown' AS repo,
        {action("CASE WHEN file_id % 2 = 0 THEN 'blocking' ELSE 'warning' END")} AS action_taken,
        CAST(file_id AS VARCHAR) AS scan_id, CAST(total_issues AS INT) AS violations_count,
        CAST(to_json({{'summary': {{'total_issues': total_issues, 'critical': critical, 'high': high, 'medium': medium,
          'low': low, 'info': info}}, 'copilot_detected': detected_ai_code}}) AS VARCHAR) AS details,
        'pending' AS resolution_state FROM summ JOIN flags ON flag_id = file_id""", FLAGS)
    export = "FROM logs"
    out["export_audit_csv"] = f"""WITH {AUDIT} SELECT id, {ISO} AS timestamp, event_type, org, repo, pr_number, commit_sha,
      author, action_taken, violations_count, resolution_state {export}"""
    out["export_audit_json"] = f"WITH {AUDIT} SELECT id, CAST(to_json({{{_AUDIT_JSON}}}) AS VARCHAR) AS json {export}"

    out["dedup_rule"] = scan_sql(
        CATALOGUE.list_rules(),
        "SELECT file_id, rule_id, line_start, line_end, label, pattern_ord FROM hits")
    out["dedup_location"] = core(f"SELECT {cols(SHORT)} FROM uniq", rules=CATALOGUE.list_rules())
    out["severity_summary"] = core("""SELECT file_id, total_issues, critical, high, medium, low, info,
      CASE WHEN total_issues = 0 THEN 'clean' ELSE 'violations_found' END AS status FROM summ""")
    out["enforcement"] = core("SELECT file_id, enforcement_mode, enforcement_action FROM enforced", resolved(), ENFORCED)
    out["owasp_coverage"] = scan_sql(
        CATALOGUE.select(category="security"),
        "SELECT org, owasp_mapping, count(*) AS hits FROM hits WHERE owasp_mapping IS NOT NULL GROUP BY ALL")
    out["standards_compliance"] = scan_sql(
        CATALOGUE.select(category="standards"),
        """SELECT f.file_id,
          NOT coalesce(bool_or(contains(lower(description), 'naming')), FALSE) AS naming,
          NOT coalesce(bool_or(contains(lower(description), 'logging') OR contains(lower(description), 'console')), FALSE) AS logging,
          NOT coalesce(bool_or(contains(lower(description), 'error') OR contains(lower(description), 'catch')), FALSE)
            AS error_handling
        FROM files f LEFT JOIN hits USING (file_id) GROUP BY ALL""")
    flagged = "(SELECT e.*, detected_ai_code FROM enforced e JOIN flags ON flag_id = file_id)"
    out["pr_rollup"] = core(f"""SELECT r.*, coalesce(CAST(to_json(found) AS VARCHAR), '[]') AS violations
      FROM (SELECT org, repo, pr_number, bool_or(detected_ai_code) AS detected_ai_code, {ROLL}
        FROM {flagged} GROUP BY org, repo, pr_number) r
      LEFT JOIN (SELECT org, repo, pr_number, list({{{", ".join(f"'{c}': {c}" for c in ("file_path", *ROLLED_FIELDS))}}}
          ORDER BY file_path, line_start, line_end, rule_id) AS found
        FROM uniq GROUP BY org, repo, pr_number) v
      ON v.org IS NOT DISTINCT FROM r.org AND v.repo IS NOT DISTINCT FROM r.repo AND v.pr_number IS NOT DISTINCT FROM r.pr_number""",
        resolved(), ENFORCED, FLAGS)
    out["push_rollup"] = f"WITH {push_ctes()} SELECT * EXCLUDE (enforcement_mode) FROM push_rolled"
    mode = "enforcement_mode"
    prs = core(f"""SELECT 'pull_request' AS kind, org, repo, pr_number, commit_sha,
        CASE WHEN {action(mode)} = 'block' THEN 'failure' ELSE 'success' END AS state,
        left(CASE WHEN {mode} = 'advisory' THEN 'Advisory mode - informational only'
          WHEN {mode} = 'warning' AND total_issues > 0 THEN 'Found ' || total_issues || ' issues (warning mode)'
          WHEN {mode} = 'blocking' AND critical + high > 0
            THEN 'Found ' || critical || ' critical and ' || high || ' high severity issues'
          WHEN {mode} = 'blocking' AND total_issues > 0 THEN 'Found ' || total_issues || ' medium/low issues'
          ELSE 'All checks passed' END, 140) AS description FROM prs""",
        resolved(), ENFORCED,
        f"""prs AS (SELECT org, repo, pr_number, commit_sha, {mode}, {ROLL} FROM enforced
          JOIN (SELECT file_id, commit_sha FROM files) USING (file_id) GROUP BY org, repo, pr_number, commit_sha, {mode})""")
    out["commit_status"] = f"""SELECT * FROM ({prs})
      UNION ALL SELECT * FROM (WITH {push_ctes()} SELECT 'push', org, repo, CAST(NULL AS INT), commit_sha,
        CASE WHEN {mode} = 'blocking' AND critical + high > 0 THEN 'failure' ELSE 'success' END,
        left(CASE WHEN {mode} = 'blocking' AND critical + high > 0
            THEN 'Found ' || critical || ' critical and ' || high || ' high severity issues'
          WHEN total_issues > 0
            THEN 'Found ' || total_issues || ' issues (' || critical || ' critical, ' || high || ' high)'
          ELSE 'All security checks passed' END, 140) FROM push_rolled)"""
    out["report_totals"] = core("""SELECT *, CAST(critical + high > 0 AS INT) AS exit_code,
        CAST(to_json({'summary': {'totalFiles': total_files, 'totalIssues': total_issues, 'critical': critical,
          'high': high, 'medium': medium, 'low': low, 'info': info}}) AS VARCHAR) AS report_json
      FROM (SELECT count(*) AS total_files, CAST(sum(total_issues) AS BIGINT) AS total_issues,
        CAST(sum(critical) AS BIGINT) AS critical, CAST(sum(high) AS BIGINT) AS high, CAST(sum(medium) AS BIGINT) AS medium,
        CAST(sum(low) AS BIGINT) AS low, CAST(sum(info) AS BIGINT) AS info FROM summ)""")
    out["quality_score"] = scan_sql(CORE, """, counted AS (SELECT f.file_id,
          greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - 10 * count(*) FILTER (WHERE category = 'security'))) AS security_score,
          greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE - 5 * count(*) FILTER (WHERE category = 'standards')))
            AS maintainability_score
        FROM files f LEFT JOIN hits USING (file_id) GROUP BY ALL)
      SELECT *, round(CASE file_id % 4 WHEN 0 THEN security_score WHEN 1 THEN 0.0::DOUBLE
        ELSE (security_score + 85 + maintainability_score) / 3 END, 6) AS overall_score FROM counted""")
    out["report_tiers"] = core(f"""SELECT {cols(SHORT)}, CASE WHEN severity IN ('critical', 'high')
        OR (severity = 'medium' AND n <= 5) THEN 'open' ELSE 'folded' END AS tier
      FROM (SELECT *, row_number() OVER (PARTITION BY org, repo, pr_number, severity
        ORDER BY file_path, line_start, line_end, rule_id) AS n FROM uniq)""")
    out["severity_sorted"] = scan_sql(
        CATALOGUE.list_rules(),
        f"""SELECT CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 WHEN 'low' THEN 4 ELSE 5 END
          AS severity_rank, {cols(SHORT)} FROM hits ORDER BY severity_rank, file_path, line_start, line_end, rule_id""")
    out["ai_parse"] = f"WITH {AI} SELECT file_id, parse_failed, CAST(len(found) AS INT) AS findings FROM parsed"
    out["ai_violations"] = f"WITH {AI}, {AI_ROWS} SELECT * EXCLUDE (pos, file_path) FROM ai_rows"
    out["ai_recommendations"] = f"""WITH {AI} SELECT file_id, array_to_string(list_transform(list_filter(found,
        lambda v: coalesce({_js('suggested_fix')}, '') <> ''),
        lambda v: 'Fix: ' || coalesce({_js('title')}, 'Issue')), '; ') AS recommendations FROM parsed"""
    doc = stripped("regexp_replace(regexp_replace(" + stripped('raw') + ", '^```(json)?', ''), '```$', '')")
    out["ai_authorship"] = f"""WITH {cte('responses', derived.AUTHORSHIP)},
      docs AS (SELECT file_id, CASE WHEN json_valid({doc}) THEN {doc} END AS doc FROM responses),
      read AS (SELECT *, coalesce(json_extract_string(doc, '$.ai_code_lines[*]'), []) AS lines FROM docs)
      SELECT file_id, coalesce(json_extract_string(doc, '$.is_ai_generated') = 'true', FALSE) AS detected_ai_code,
        coalesce(CAST(json_extract_string(doc, '$.confidence') AS DOUBLE), 0) / 100 AS ai_code_percentage,
        array_to_string(lines, ', ') AS ai_lines FROM read"""
    out["report_markdown"] = markdown_sql()
    out["combine_hits"] = core("""SELECT file_path, line_start, line_end, rule_id, source_ord FROM (
        SELECT file_path, line_start, line_end, rule_id, 0 AS source_ord,
          {'r': rule_ord, 'p': pattern_ord, 'm': match_ord} AS ord FROM uniq
        UNION ALL SELECT file_path, line_start, line_end, rule_id, CASE category WHEN 'security' THEN 1 ELSE 2 END,
          {'r': 0, 'p': 0, 'm': pos}
          FROM ai_rows)
      QUALIFY row_number() OVER (PARTITION BY file_path, line_start, line_end ORDER BY source_ord, ord) = 1""",
        AI, AI_ROWS, rules=CATALOGUE.list_rules())
    out["sink_scan_results"] = core(f"""SELECT sha256('first|' || e.file_id || '|' || commit_sha) AS scan_id, e.org, e.repo, e.pr_number,
        commit_sha, e.file_path, 'full' AS scan_type, {", ".join(f"CAST(e.{c} AS INT) AS {c}" for c in ("total_issues", "critical", "high", "medium", "low", "info"))},
        CASE WHEN e.total_issues = 0 THEN 'clean' ELSE 'violations_found' END AS status, detected_ai_code, enforcement_action,
        CASE WHEN rule_id IS NOT NULL THEN sha256(sha256('first|' || e.file_id || '|' || commit_sha) || '|' || rule_id || '|' || line_start
          || '|' || line_end) END AS violation_id,
        CASE WHEN rule_id IS NOT NULL THEN {NOW} END AS timestamp, rule_id, severity, category, title, line_start, line_end, owasp_mapping,
        cwe_id, CASE WHEN rule_id IS NOT NULL THEN FALSE END AS is_ai_generated,
        CASE WHEN rule_id IS NOT NULL THEN 'open' END AS resolution_state
      FROM enforced e JOIN flags ON flag_id = e.file_id JOIN (SELECT file_id, commit_sha FROM files) f ON f.file_id = e.file_id
        LEFT JOIN uniq u ON u.file_id = e.file_id""", resolved(), ENFORCED, FLAGS)
    out["audit_append"] = f"""WITH {AUDIT} SELECT CASE event_type WHEN 'scan' THEN id ELSE sha256('manual|' || id) END AS id,
        CASE event_type WHEN 'scan' THEN timestamp ELSE {NOW} END AS timestamp, event_type, org, repo, action_taken,
        CASE event_type WHEN 'scan' THEN scan_id END AS scan_id, CASE event_type WHEN 'scan' THEN violations_count ELSE 0 END AS violations_count,
        CASE event_type WHEN 'scan' THEN resolution_state ELSE 'pending' END AS resolution_state FROM logs"""
    out["stream_scan"] = scan_sql(CATALOGUE.list_rules(), f"SELECT {cols(SHORT)} FROM hits")
    out["stream_latest_report"] = scan_sql(CATALOGUE.list_rules(), """,
      dated AS (SELECT f.file_id, f.org, f.repo, f.pr_number, o_orderdate AS scanned_at, count(h.rule_id) AS total_issues,
          count(*) FILTER (WHERE h.severity = 'critical') AS critical, count(*) FILTER (WHERE h.severity = 'high') AS high
        FROM files f JOIN orders ON o_orderkey = f.file_id LEFT JOIN hits h USING (file_id) GROUP BY ALL),
      newest AS (SELECT org, repo, pr_number, max(scanned_at) AS scanned_at FROM dated GROUP BY ALL)
      SELECT org, repo, pr_number, scanned_at, count(*) AS files, CAST(sum(total_issues) AS BIGINT) AS total_issues,
        CAST(sum(critical) AS BIGINT) AS critical,
        CASE WHEN sum(critical) + sum(high) > 0 THEN 'block' WHEN sum(total_issues) > 0 THEN 'annotate' ELSE 'none' END AS enforcement_action
      FROM dated JOIN newest USING (org, repo, pr_number, scanned_at) GROUP BY ALL""")
    out["stream_dedup"] = f"WITH {cte('payloads', derived.PR_PAYLOADS)} SELECT DISTINCT delivery_id FROM payloads"
    return {k: v.replace(")\n,\n", "),\n").replace(")\n, ", "), ") for k, v in out.items()}


ORACLES = build()
