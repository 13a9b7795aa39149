"""Pull-request and push events, changed files, diffs, override comments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanfold.functions.paths import is_supported
from scanfold.functions.text import let, prefix_sums
from scanfold.operators.config import resolve

# --- Fixed values: handled actions and branches ------------------------------
PR_ACTIONS = ("opened", "synchronize")
PUSH_BRANCHES = ("main", "master")

PR_SCHEMA = (
    "action string, number int, pull_request struct<number:int,head:struct<sha:string,ref:string>,"
    "base:struct<ref:string>,user:struct<login:string>>, repository struct<owner:struct<login:string>,name:string>"
)
PUSH_SCHEMA = (
    "ref string, after string, repository struct<owner:struct<login:string,name:string>,name:string>, "
    "pusher struct<name:string>, "
    "commits array<struct<id:string,added:array<string>,modified:array<string>,removed:array<string>>>"
)


def pr_events(payloads: DataFrame) -> DataFrame:
    """Typed pull-request events; only actions that bring new code."""
    e = payloads.select("event_id", F.from_json("payload", PR_SCHEMA).alias("e"))
    return e.filter(F.col("e.action").isin(list(PR_ACTIONS))).select(
        "event_id", F.col("e.action").alias("action"), F.col("e.repository.owner.login").alias("org"),
        F.col("e.repository.name").alias("repo"), F.col("e.number").alias("pr_number"),
        F.col("e.pull_request.head.sha").alias("commit_sha"), F.col("e.pull_request.user.login").alias("author"))


def push_events(payloads: DataFrame) -> DataFrame:
    """Typed pushes to a main branch that carry commits."""
    e = payloads.select("event_id", F.from_json("payload", PUSH_SCHEMA).alias("e"))
    branch = F.replace(F.col("e.ref"), F.lit("refs/heads/"), F.lit(""))
    return (e.withColumn("branch", branch)
            .filter(F.col("branch").isin(list(PUSH_BRANCHES)) & (F.size("e.commits") > 0))
            .select("event_id", "branch",
                    F.coalesce(F.nullif(F.col("e.repository.owner.login"), F.lit("")),
                               F.col("e.repository.owner.name"), F.lit("")).alias("org"),
                    F.col("e.repository.name").alias("repo"), F.col("e.after").alias("commit_sha"),
                    F.col("e.pusher.name").alias("author"), F.col("e.commits").alias("commits")))


def changed_files(pushes: DataFrame) -> DataFrame:
    """Distinct added or modified supported files of each push; removals are not subtracted.

    Distinct inside the event's own row first: a push is one document.
    """
    paths = F.array_distinct(F.flatten(F.transform(
        "commits", lambda c: F.concat(F.coalesce(c["added"], F.array().cast("array<string>")),
                                      F.coalesce(c["modified"], F.array().cast("array<string>"))))))
    rows = pushes.select("event_id", "org", "repo", "commit_sha", F.explode_outer(paths).alias("file_path"))
    return rows.filter(is_supported(F.col("file_path")))


def supported_files(files: DataFrame) -> DataFrame:
    """Files a scan takes: a supported extension, not removed, with a body."""
    return files.filter(is_supported(F.col("file_path")) & (F.col("change_status") != "removed"))


def decoded_files(files: DataFrame) -> DataFrame:
    """Base64 bodies to text; missing or empty bodies are skipped."""
    body = F.decode(F.unbase64("content_b64"), "utf-8")
    return files.withColumn("code", body).filter(F.col("code").isNotNull() & (F.col("code") != "")).drop("content_b64")


def added_lines(patch: Column) -> Column:
    """New-file numbers of the lines a unified diff adds, in order.

    Hunks are taken one by one: the header gives the first number, and every
    context or added line before a line moves it on.
    """
    header = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,\d+)? @@"

    def numbers(hunk: Column) -> Column:
        return let(F.split(hunk, "\n"), lambda lines: let(F.slice(lines, 2, F.size(lines)), lambda body: F.zip_with(
            F.transform(body, lambda x: F.startswith(x, F.lit("+"))),
            prefix_sums(F.transform(body, lambda x: F.when(F.rlike(x, F.lit("^[ +]")), F.lit(1)).otherwise(F.lit(0)))),
            lambda added, before: F.when(added, F.regexp_extract(F.get(lines, F.lit(0)), header, 1).try_cast("int") + before))))

    hunks = F.filter(F.split(patch, f"(?md)^(?={header[1:]})"),
                     lambda h: F.rlike(h, F.lit(header)))
    return F.filter(F.flatten(F.transform(hunks, numbers)), lambda n: n.isNotNull())


def touching(spans: Column, lines: Column) -> Column:
    """For each span (line_start, line_end) of an array, in its order: does it hold one of the lines?

    Starts, lines and ends are merged in order of place, as one sorted text of
    tokens. Cut at its lines, the text's k-th piece names the starts and ends that
    have k lines before them; a span holds a line if its two numbers differ. The
    work is that of the sort, whatever the number of spans and lines.
    """
    def event(line: Column, kind: int, token: Column) -> Column:
        return F.struct(line.cast("int").alias("line"), F.lit(kind).alias("kind"), token.alias("token"))

    def of(vs: Column) -> Column:
        merged = F.sort_array(F.concat(
            F.transform(vs, lambda v, i: event(v["line_start"], 0, F.concat(F.lit("a"), i.cast("string"), F.lit(",")))),
            F.transform(lines, lambda n: event(n, 1, F.lit("|"))),
            F.transform(vs, lambda v, i: event(v["line_end"], 2, F.concat(F.lit("b"), i.cast("string"), F.lit(","))))))
        pieces = F.split(F.array_join(F.transform(merged, lambda e: e["token"]), ""), r"\|")
        counted = F.flatten(F.transform(pieces, lambda piece, k: F.transform(
            F.filter(F.split(piece, ","), lambda x: x != ""), lambda x: F.struct(
                F.left(x, F.lit(1)).alias("side"), F.substring(x, 2, 10).cast("int").alias("i"), k.alias("k")))))
        side = lambda cs, name: F.sort_array(F.transform(
            F.filter(cs, lambda c: c["side"] == name), lambda c: F.struct(c["i"].alias("i"), c["k"].alias("k"))))
        return let(counted, lambda cs: F.zip_with(side(cs, "a"), side(cs, "b"), lambda a, b: b["k"] > a["k"]))

    return let(spans, of)


def on_added_lines(scanned: DataFrame) -> DataFrame:
    """Scan-result rows with the violations that touch a line of ``added``; none where there is no patch."""
    def kept(vs: Column) -> Column:
        held = touching(F.transform(vs, lambda v: F.struct(v["line_start"].alias("line_start"), v["line_end"].alias("line_end"))),
                        F.coalesce("added", F.array().cast("array<int>")))
        return let(held, lambda flags: F.filter(vs, lambda v, i: F.get(flags, i)))
    return scanned.withColumn("violations", let(F.col("violations"), kept)).drop("added")


def override_events(comments: DataFrame, configs: DataFrame, command: str) -> DataFrame:
    """Override commands in comments, with whether their author may override.

    The configuration is resolved for the comments that hold a command only.
    """
    word = command.lstrip("/").replace(" ", r"\s+")
    pattern = rf"(?i)/{word}(?:\s+(.+))?"
    commands = comments.filter(F.col("body").rlike(pattern)).withColumn(
        "justification", F.nullif(F.trim(F.regexp_extract("body", pattern, 1)), F.lit("")))
    joined = resolve(commands, configs.select("org", "repo", "override_allowed", "override_approvers"))
    allowed = F.col("override_allowed") & (
        (F.size("override_approvers") == 0) | F.array_contains("override_approvers", F.col("author")))
    return joined.withColumn("can_override", allowed).drop(
        "override_allowed", "override_approvers", "config_level")
