"""Service tables derived from the given ones: configurations, audit logs, events, rules, comments.

Each is a projection of one given table, written as SQL expressions both Spark
and an ANSI-style engine evaluate alike.  They grow with their base table.
Lists are stored as comma-separated text and split by the reader.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.sources.corpus import EXTENSION, build_files
from scanfold.sources.tables import spread, table


def _s(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR(40))"


AUDIT_LOGS = ("events", {
    "id": f"'a' || {_s('event_id')}",
    "timestamp": "ts",
    "event_type": "CASE event_type WHEN 'error' THEN 'violation' WHEN 'purchase' THEN 'override' "
                  "WHEN 'signup' THEN 'config_change' ELSE 'scan' END",
    "org": f"'org' || {_s('user_id % 25')}",
    "repo": f"'repo' || {_s('user_id')}",
    "pr_number": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(event_id % 40 AS INT) END",
    "commit_sha": f"md5({_s('event_id')})",
    "author": f"'user' || {_s('user_id % 97')}",
    "action_taken": "CASE event_id % 4 WHEN 0 THEN 'advisory' WHEN 1 THEN 'warning' WHEN 2 THEN 'blocked' "
                    "ELSE 'override' END",
    "scan_id": f"'s' || {_s('event_id')}",
    "violations_count": "CAST(event_id % 9 AS INT)",
    "details": "props",
    "resolution_state": "CASE event_id % 6 WHEN 0 THEN 'resolved' WHEN 1 THEN 'dismissed' ELSE 'pending' END",
    "resolved_by": "CASE WHEN event_id % 6 < 2 THEN 'lead' END",
    "resolved_at": "CASE WHEN event_id % 6 < 2 THEN ts END",
})

_LISTS = {
    "packs": "CASE {k} % 7 WHEN 0 THEN 'default-security' WHEN 1 THEN 'default-security,enterprise-standards' "
             "WHEN 2 THEN 'healthcare,telecom' WHEN 3 THEN 'government,unknown-pack' WHEN 4 THEN '' WHEN 5 THEN NULL "
             "ELSE 'enterprise-standards,default-security' END",
    "rules": "CASE WHEN {k} % 9 = 4 THEN 'SEC-003,STD-002,NOPE-1' ELSE '' END",
    "allowed": "CASE {k} % 4 WHEN 0 THEN 'MIT,ISC' WHEN 1 THEN NULL ELSE 'MIT,Apache-2.0,GPL-3.0' END",
    "blocked": "CASE {k} % 5 WHEN 0 THEN 'GPL-3.0' WHEN 1 THEN 'AGPL-3.0,BSD-3-Clause' ELSE '' END",
    "include": "CASE {k} % 6 WHEN 0 THEN 'src/**/*' WHEN 1 THEN 'lib/**/*,src/*' ELSE '' END",
    "exclude": "CASE {k} % 8 WHEN 0 THEN '*.min.js,**/tests/**' WHEN 1 THEN 'src/api/**' ELSE '' END",
    "approvers": "CASE {k} % 3 WHEN 0 THEN 'user1,user2,user3' WHEN 1 THEN '' ELSE 'user5,user8,user13,user21' END",
}
_MODE = "CASE {k} % 4 WHEN 0 THEN 'advisory' WHEN 1 THEN 'warning' WHEN 2 THEN 'blocking' ELSE 'other' END"


def _config(base: str, key: str, org: str, repo: str, where: str):
    fields = {"org": org, "repo": repo, "enforcement_mode": _MODE.format(k=key)}
    fields |= {f"{name}_csv": sql.format(k=key) for name, sql in _LISTS.items()}
    fields |= {"override_allowed": f"{key} % 5 <> 0", "updated_at": "TIMESTAMP_NTZ '2024-01-01 00:00:00'"}
    return base, fields, where


REPO_CONFIGS = _config("customer", "c_custkey", f"'org' || {_s('c_custkey % 25')}", f"'repo' || {_s('c_custkey')}",
                       "c_custkey % 3 = 0")
ORG_CONFIGS = _config("nation", "n_nationkey", f"'org' || {_s('n_nationkey')}", "CAST(NULL AS VARCHAR(40))",
                      "n_nationkey % 2 = 0")
CONFIG_UPDATES = ("customer", {
    "org": f"'org' || {_s('c_custkey % 25')}",
    "repo": f"'repo' || {_s('c_custkey')}",
    "enforcement_mode": "CASE c_custkey % 3 WHEN 0 THEN 'blocking' WHEN 1 THEN NULL ELSE 'advisory' END",
    "packs_csv": "CASE WHEN c_custkey % 2 = 0 THEN 'healthcare' END",
    "blocked_csv": "CASE WHEN c_custkey % 7 = 0 THEN 'ISC' END",
    "override_allowed": "CASE WHEN c_custkey % 11 = 0 THEN FALSE END",
}, "c_custkey % 4 = 1")

# Parsed repository files: `has_file` false stands for a repository without one.
PARSED_FILES = ("customer", {
    "org": f"'org' || {_s('c_custkey % 25')}",
    "repo": f"'repo' || {_s('c_custkey')}",
    "has_file": "c_custkey % 4 <> 0",
    "enforcement_mode": "CASE c_custkey % 3 WHEN 0 THEN 'blocking' WHEN 1 THEN '' ELSE NULL END",
    "packs_csv": "CASE WHEN c_custkey % 5 < 2 THEN 'telecom,healthcare' END",
    "block_threshold": "CASE WHEN c_custkey % 6 < 3 THEN 'critical' END",
    "secrets": "CASE WHEN c_custkey % 7 < 3 THEN FALSE END",
    "naming": "CASE WHEN c_custkey % 8 < 3 THEN TRUE END",
    "allowed_csv": "CASE WHEN c_custkey % 9 < 4 THEN 'MIT' END",
    "blocked_csv": "CASE WHEN c_custkey % 9 < 4 THEN 'ISC,GPL-2.0' END",
    "strict_mode": "CASE WHEN c_custkey % 10 < 4 THEN FALSE END",
})

CUSTOM_RULES = ("part", {
    "id": f"'R' || {_s('p_partkey')}",
    "name": "p_name",
    "description": "CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'Custom check of ' || p_name END",
    "category": "CASE p_partkey % 3 WHEN 0 THEN 'security' WHEN 1 THEN 'standards' ELSE 'license' END",
    "severity": "CASE p_partkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' "
                "ELSE 'info' END",
    "enabled": "p_partkey % 5 <> 3",
    "rule_type": "CASE WHEN p_partkey % 11 = 5 THEN 'ast' ELSE 'regex' END",
    "languages_csv": "CASE p_partkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript,TypeScript' WHEN 2 THEN NULL "
                     "ELSE 'java,go' END",
    "pattern": "CASE p_partkey % 7 WHEN 0 THEN 'db[.]query' WHEN 1 THEN 'return [a-z]+' WHEN 2 THEN 'patient' "
               "WHEN 3 THEN 'import +([a-z]+)' WHEN 4 THEN '(unclosed' WHEN 5 THEN NULL ELSE 'const' END",
    "owasp_mapping": "CASE WHEN p_partkey % 6 = 0 THEN 'A03:2021 - Injection' END",
    "cwe_id": "CASE WHEN p_partkey % 6 = 1 THEN 'CWE-1' END",
    "fix_suggestion": "CASE WHEN p_partkey % 2 = 0 THEN 'see the guide' END",
    # The first parts are the few wide-scope rules every estate has; all others belong to one repository.
    "org": f"CASE WHEN p_partkey < 4 THEN NULL WHEN p_partkey < 29 THEN 'org' || {_s('(p_partkey - 4) % 25')} "
           f"ELSE 'org' || {_s('p_partkey % 25')} END",
    "repo": f"CASE WHEN p_partkey < 29 THEN NULL ELSE 'repo' || {_s('p_partkey')} END",
    "updated_at": "TIMESTAMP_NTZ '2024-01-01 00:00:00'",
})
RULE_UPDATES = ("part", {
    "id": f"'R' || {_s('p_partkey * 2')}",
    "severity": "CASE WHEN p_partkey % 3 = 0 THEN 'low' END",
    "enabled": "CASE WHEN p_partkey % 4 = 0 THEN FALSE END",
    "pattern": "CASE WHEN p_partkey % 5 = 0 THEN 'changed' END",
}, "p_partkey % 3 <> 1")

# Settings documents of repositories and organisations, and patches of them: sections, fields and nulls at several depths.
_DOCUMENT = ("CASE {k} % 7 WHEN 0 THEN '{{\"security\":{{\"block_threshold\":\"critical\",\"secrets_enabled\":false}}}}' "
             "WHEN 1 THEN '{{\"security\":{{\"block_threshold\":null,\"sql_injection_enabled\":false}},\"naming\":{{\"enabled\":false}}}}' "
             "WHEN 2 THEN '{{\"license\":{{\"allowed\":[\"MIT\",\"ISC\"],\"similarity_threshold\":0.5}},\"copilot\":{{\"strict_mode\":null}},\"other\":1}}' "
             "WHEN 3 THEN '{{\"logging\":null,\"error_handling\":{{\"enabled\":false}},\"override\":{{\"approvers\":[\"user1\",\"user2\"]}}}}' "
             "WHEN 4 THEN '{{\"security\":{{\"block_threshold\":\"medium\",\"command_execution_enabled\":false}},\"copilot\":{{\"additional_checks\":[]}}}}' "
             "WHEN 5 THEN 'not a document' ELSE '{{\"logging\":{{\"enabled\":false,\"forbid_console_log\":false}},\"override\":{{\"enabled\":false}}}}' END")
REPO_SETTINGS = ("customer", {"org": f"'org' || {_s('c_custkey % 25')}", "repo": f"'repo' || {_s('c_custkey')}",
                              "document": _DOCUMENT.format(k="c_custkey")}, "c_custkey % 3 <> 0")
ORG_SETTINGS = ("nation", {"org": f"'org' || {_s('n_nationkey')}", "repo": "CAST(NULL AS VARCHAR(40))",
                           "document": _DOCUMENT.format(k="(n_nationkey + 4)")}, "n_nationkey % 3 <> 1")
SETTINGS_PATCHES = ("customer", {"org": f"'org' || {_s('c_custkey % 25')}", "repo": f"'repo' || {_s('c_custkey')}",
                                 "document": _DOCUMENT.format(k="(c_custkey * 3 + 1)")}, "c_custkey % 4 < 2")

PACK_REQUESTS = ("customer", {
    "org": f"'org' || {_s('c_custkey % 25')}",
    "repo": f"CASE WHEN c_custkey % 50 = 7 THEN NULL ELSE 'repo' || {_s('c_custkey')} END",
    "pack": "CASE c_custkey % 5 WHEN 0 THEN 'healthcare' WHEN 1 THEN 'telecom' WHEN 2 THEN 'unheard-of' WHEN 3 THEN NULL "
            "ELSE 'default-security' END",
}, "c_custkey % 2 = 1")

PR_PAYLOADS = ("events", {
    "event_id": "event_id",
    "delivery_id": "'d' || " + _s("CAST(floor(event_id / 2.0) AS BIGINT)"),
    "ts": "ts",
    "payload": "'{\"action\":\"' || CASE event_id % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'closed' "
               "ELSE 'reopened' END || '\",\"number\":' || " + _s("event_id % 40") +
               " || ',\"pull_request\":{\"number\":' || " + _s("event_id % 40") +
               " || ',\"head\":{\"sha\":\"' || md5(" + _s("event_id") + ") || '\",\"ref\":\"topic\"},\"user\":{\"login\":\"user' || "
               + _s("user_id % 97") + " || '\"}},\"repository\":{\"owner\":{\"login\":\"org' || " + _s("user_id % 25") +
               " || '\"},\"name\":\"repo' || " + _s("user_id") + " || '\"}}'",
})


def _path(key: str) -> str:
    ext = f"CASE {key} % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.txt' WHEN 3 THEN '.go' ELSE '.PY' END"
    return f"'\"src/mod' || {_s(f'{key} % 1000')} || {ext} || '\"'"


_COMMIT_A = ("'{\"added\":[' || " + _path("event_id") + " || '],\"modified\":[' || " + _path("(event_id + 1)") + " || ',' || "
             + _path("(event_id + 5)") + " || '],\"removed\":[' || " + _path("event_id") + " || ']}'")
_COMMIT_B = ("'{\"added\":[],\"modified\":[' || " + _path("event_id") + " || ',' || " + _path("(event_id + 3)") +
             " || '],\"removed\":[]}'")
PUSH_PAYLOADS = ("events", {
    "event_id": "event_id",
    "payload": "'{\"ref\":\"' || CASE event_id % 5 WHEN 0 THEN 'refs/heads/main' WHEN 1 THEN 'refs/heads/master' "
               "WHEN 2 THEN 'refs/heads/dev' WHEN 3 THEN 'refs/tags/v1' ELSE 'refs/heads/main' END || '\",\"after\":\"' || md5("
               + _s("event_id") + ") || '\",\"repository\":{\"owner\":{' || CASE WHEN event_id % 3 = 0 THEN '\"name\"' "
               "ELSE '\"login\"' END || ':\"org' || " + _s("user_id % 25") + " || '\"},\"name\":\"repo' || " + _s("user_id") +
               " || '\"},\"pusher\":{\"name\":\"user' || " + _s("user_id % 97") + " || '\"},\"commits\":[' || "
               "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN " + _COMMIT_A + " WHEN 2 THEN " + _COMMIT_B + " ELSE "
               + _COMMIT_A + " || ',' || " + _COMMIT_B + " END || ']}'",
})

# Versions of files by commit order: repositories with some hundred versions of 20 paths. Three versions share a content,
# that of the code corpus' file body_key.
_REPO_KEY = "(o_custkey - o_custkey % 8)"
BODY_KEY = "o_orderkey - 20 * (CAST(floor(o_orderkey / 20.0) AS BIGINT) % 3)"


def version_path(key: str) -> str:
    """The path of a version, which depends on its key's rest by 20 only, as the language of the content does."""
    folder = f"CASE WHEN ({key}) % 20 IN (2, 7) THEN 'src/tests/test_mod' ELSE 'src/mod' END"
    return f"{folder} || {_s(f'({key}) % 20')} || {EXTENSION.replace('o_orderkey', f'({key})')}"


FILE_VERSIONS = ("orders", {
    "version_id": "o_orderkey", "position": "o_orderkey", "body_key": BODY_KEY,
    "org": f"'org' || {_s(f'{_REPO_KEY} % 25')}", "repo": f"'repo' || {_s(_REPO_KEY)}",
    "file_path": version_path("o_orderkey"), "removed": "o_orderkey % 23 = 7",
})


def _commit(added: str, *modified: str) -> str:
    paths = [f"'\"' || {version_path(k)} || '\"'" for k in (added, *modified)]
    return ("'{\"added\":[' || " + paths[0] + " || '],\"modified\":[' || " + " || ',' || ".join(paths[1:]) +
            " || '],\"removed\":[\"src/gone.py\"]}'")


PUSH_LOG = ("orders", {
    "event_id": "o_orderkey",
    "payload": "'{\"ref\":\"refs/heads/' || CASE o_orderkey % 7 WHEN 0 THEN 'dev' WHEN 1 THEN 'master' ELSE 'main' END || "
               "'\",\"after\":\"' || md5(" + _s("o_orderkey") + ") || '\",\"repository\":{\"owner\":{\"login\":\"org' || "
               + _s(f"{_REPO_KEY} % 25") + " || '\"},\"name\":\"repo' || " + _s(_REPO_KEY) +
               " || '\"},\"pusher\":{\"name\":\"user' || " + _s("o_custkey % 97") + " || '\"},\"commits\":[' || "
               "CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN " + _commit("o_orderkey", "o_orderkey + 7", "o_orderkey + 13") +
               " ELSE " + _commit("o_orderkey + 1", "o_orderkey + 4", "o_orderkey") + " || ',' || "
               + _commit("o_orderkey + 4", "o_orderkey + 9", "o_orderkey + 18") + " END || ']}'",
}, "o_orderkey % 3 <> 0")

OVERRIDE_COMMAND = "/scanfold override"
COMMENTS = ("conversations", {
    "comment_id": f"{_s('conv_id')} || '-' || {_s('turn')}",
    "org": f"'org' || {_s('conv_id % 25')}",
    "repo": f"'repo' || {_s('conv_id')}",
    "author": f"'user' || {_s('(conv_id + turn) % 24')}",
    "body": "CASE (conv_id * 7 + turn) % 5 WHEN 0 THEN text || chr(10) || '/scanfold override  hotfix for release ' "
            "WHEN 1 THEN '/SCANFOLD   Override' || chr(10) || chr(10) || text WHEN 2 THEN 'please /scanfold overrule' ELSE text END",
})

AI_RESPONSES = ("orders", {
    "file_id": "o_orderkey",
    "file_path": f"'src/mod' || {_s('o_orderkey')} || '.py'",
    "category": "CASE WHEN o_orderkey % 3 = 0 THEN 'standards' ELSE 'security' END",
    "raw": "CASE o_orderkey % 9 "
           "WHEN 0 THEN '```json' || chr(10) || '{\"violations\": [{\"severity\":\"critical\",\"title\":\"Key in code\","
           "\"description\":\"A key\",\"line_start\":3,\"line_end\":4,\"code_snippet\":\"k = 1\",\"owasp_mapping\":\"A07:2021\","
           "\"cwe_id\":\"CWE-798\",\"suggested_fix\":\"Use env\"}]}' || chr(10) || '```' "
           "WHEN 1 THEN '{\"violations\":[{\"severity\":\"BAD\",\"title\":\"One\"},{\"description\":\"Two\",\"line_start\":9}]}' "
           "WHEN 2 THEN 'I could not find anything.' "
           "WHEN 3 THEN '```' || chr(10) || '{\"violations\": []}' || chr(10) || '```' "
           "WHEN 4 THEN '  {\"violations\":[{\"severity\":\"HIGH\",\"title\":\"Up\",\"line_start\":' || " + _s("o_orderkey % 50 + 1") +
           " || '}]}  ' "
           "WHEN 5 THEN '{\"violations\":[{\"severity\":\"low\",\"title\":\"cut' "
           "WHEN 6 THEN '{\"note\":\"none\"}' "
           "WHEN 7 THEN '```json' || chr(10) || '{\"violations\":[{\"severity\":\"info\"},{\"severity\":\"low\"},{\"severity\":\"medium\","
           "\"line_start\":2,\"line_end\":2}]}```' "
           "ELSE '' END",
})

AUTHORSHIP = ("orders", {
    "file_id": "o_orderkey",
    "raw": "CASE o_orderkey % 5 WHEN 0 THEN 'unsure' "
           "WHEN 1 THEN '```json' || chr(10) || '{\"is_ai_generated\":true,\"confidence\":' || " + _s("o_orderkey % 101") +
           " || ',\"ai_code_lines\":[1,2,3,' || " + _s("o_orderkey % 90 + 4") + " || ']}' || chr(10) || '```' "
           "WHEN 2 THEN '{\"is_ai_generated\":false,\"confidence\":12.5,\"ai_code_lines\":[]}' "
           "WHEN 3 THEN '{\"is_ai_generated\":true,\"confidence\":80,\"ai_code_lines\":[' || "
           "'1,2,3,4,5,6,7,8,9,10,11,12,13,14,15,16,17,18,19,20,21,22]}' "
           "ELSE '{\"confidence\":40}' END",
})

MANIFESTS = ("part", {
    "file_id": "p_partkey + 1000000000",
    "org": "'pkg'",
    "repo": f"'brand' || {_s('p_partkey % 40')}",
    "file_path": f"'pkg' || {_s('p_partkey')} || '/package.json'",
    "code": "CASE p_partkey % 8 WHEN 0 THEN '{\"name\":\"a\",\"license\":\"MIT\"}' WHEN 1 THEN '{\"name\":\"b\"}' "
            "WHEN 2 THEN '{\"license\":\"LGPL-2.1\"}' WHEN 3 THEN '{broken' WHEN 4 THEN '{\"license\":\"GPL-2.0\"}' "
            "WHEN 5 THEN '{\"license\":\"Proprietary\"}' WHEN 6 THEN '{\"license\":\"AGPL-3.0\"}' "
            "ELSE '{\"license\":\"BSD-2-Clause\",\"version\":\"1\"}' END",
})

NAMES = ("part", {
    "name_id": "p_partkey",
    "name": "CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN "
            "upper(replace(p_name, ' ', '_')) ELSE 'Get' || upper(substr(p_name, 1, 1)) || "
            "replace(substr(p_name, 2, 99), ' ', '') || 'ID' END",
    "element": "CASE p_partkey % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' WHEN 2 THEN 'constant' WHEN 3 THEN 'interface' "
               "ELSE 'variable' END",
    "language": "CASE WHEN p_partkey % 3 = 0 THEN 'python' ELSE 'typescript' END",
})


def frame(spark: SparkSession, sf_dir: str, spec) -> DataFrame:
    base, fields, *where = spec
    df = table(spark, sf_dir, base)
    if where:
        df = df.filter(where[0])
    return df.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])


def split_list(csv: Column) -> Column:
    """Null stays null, the empty text becomes the empty list."""
    return F.when(csv == "", F.array().cast("array<string>")).otherwise(F.split(csv, ","))


def configurations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, REPO_CONFIGS).unionByName(frame(spark, sf_dir, ORG_CONFIGS))
    names = {"packs": "enabled_rule_packs", "rules": "custom_rules", "allowed": "allowed_licenses",
             "blocked": "blocked_licenses", "include": "include_patterns", "exclude": "exclude_patterns",
             "approvers": "override_approvers"}
    return rows.select("org", "repo", "enforcement_mode",
                       *[split_list(F.col(f"{k}_csv")).alias(v) for k, v in names.items()],
                       "override_allowed", "updated_at")


def config_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, CONFIG_UPDATES)
    return rows.select("org", "repo", "enforcement_mode",
                       split_list(F.col("packs_csv")).alias("enabled_rule_packs"),
                       split_list(F.col("blocked_csv")).alias("blocked_licenses"), "override_allowed")


def parsed_config_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, PARSED_FILES)
    return rows.select(
        "org", "repo", "has_file", "enforcement_mode", split_list(F.col("packs_csv")).alias("rule_packs"),
        F.struct("block_threshold", "secrets").alias("security"), F.struct("naming").alias("standards"),
        F.when(F.col("allowed_csv").isNotNull(), F.struct(
            split_list(F.col("allowed_csv")).alias("allowed"), split_list(F.col("blocked_csv")).alias("blocked")))
        .alias("license"),
        F.struct("strict_mode").alias("copilot"))


def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frame(spark, sf_dir, CUSTOM_RULES)
    return rows.withColumn("languages", split_list(F.col("languages_csv"))).drop("languages_csv")


def file_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version_id, org, repo, file_path, position, code: null where the version removes the file."""
    base, fields = FILE_VERSIONS
    rows = spread(table(spark, sf_dir, base).select("o_orderkey", "o_custkey"), "o_orderkey").select(
        "o_custkey", *[F.expr(sql).alias(f"v_{name}") for name, sql in fields.items()]).withColumn("o_orderkey", F.col("v_body_key"))
    built = build_files(rows, **{f"v_{name}": f"v_{name}" for name in fields})
    return built.select(*[F.col(f"v_{c}").alias(c) for c in ("version_id", "org", "repo", "file_path", "position")],
                        F.when(~F.col("v_removed"), F.col("code")).alias("code"))
