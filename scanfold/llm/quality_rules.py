"""Host-level quality rules (operator 2).

Each document is measured in place, in one narrow stage. Rule failures are
summed by host; a host's failure rate is shrunk towards the rate of all hosts
by a beta prior whose two parameters are fitted to the hosts by moments, so a
host with few documents needs more evidence. A host whose shrunk rate passes
the limit, one document in twenty, is strict for that rule: there, documents
failing the rule go. Elsewhere a failure now and then is let pass. A document
that fails no rule always stays.

A null or empty text has no words and fails the base rule; a null host counts
as the host with the empty name; repeated rows are measured each for
themselves; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.common import BLANKS, count_up, fresh, let, total, words_of
from scanfold.sources.tables import staged, table

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Shrunk failure rate from which a host is strict for a rule.
HOST_LIMIT = 0.05
SYMBOLS = "[#*$%&|<>]"
#: Soft rules, judged host by host. Each names when a document fails.
RULES = {
    "symbols": lambda m: m.n_symbols * 10 > m.n_words,
    "dup_lines": lambda m: m.n_dup_lines * 10 > m.n_lines * 3,
    "word_length": lambda m: (m.word_chars < m.n_words * 3) | (m.word_chars > m.n_words * 12),
    "repeats": lambda m: m.n_repeat_words * 5 > m.n_words,
}


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more."""
    def covered(at: Column) -> Column:
        last = F.size(at) - 1
        return F.aggregate(count_up(F.size(at)), F.lit(0).cast("bigint"), lambda a, i: a + F.when(
            i == last, F.lit(3)).otherwise(F.least(F.lit(3), F.get(at, i + 1) - F.get(at, i))))

    def positions(pairs: Column) -> Column:
        again = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["w"] == p["w"], F.lit(False))
                         | F.coalesce(F.get(pairs, i + 1)["w"] == p["w"], F.lit(False)))
        return F.sort_array(F.transform(again, lambda p: p["i"]))

    def count(windows: Column) -> Column:
        pairs = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("bigint")).otherwise(
            let(let(pairs, positions), covered))

    return let(words, lambda w: let(
        F.transform(count_up(F.size(w) - 2), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), count))


def measures(text: Column) -> Column:
    """One struct of counts for a text."""
    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")

    def of(t: Column) -> Column:
        return let(words_of(t), lambda w: let(lines(t), lambda ls: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.regexp_replace(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            F.size(ls).cast("bigint").alias("n_lines"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"))))

    return let(F.coalesce(text, F.lit("")), of)


def base_failed(m: Column) -> Column:
    return (m.n_words < MIN_WORDS) | (m.n_repeat_words * 100 > m.n_words * REPEAT_PERCENT)


def measured(docs: DataFrame, host_col: str = "source") -> DataFrame:
    """doc_id, host, the counts m, and per rule whether the document fails it."""
    df = docs.select("doc_id", F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("host"),
                     measures(F.col("text")).alias("m"))
    return df.select("doc_id", "host", "m", base_failed(F.col("m")).alias("base_failed"),
                     F.struct(*[f(F.col("m")).alias(name) for name, f in RULES.items()]).alias("fails"))


def host_rates(rows: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """Per host: documents, failures and shrunk failure rate of each rule, and which rules it is strict for.

    ``rows`` is what ``measured`` returns. Sums are combined before the shuffle,
    so a host with a third of the rows costs no more than another. The prior
    needs three sums over hosts per rule: one row, which is fetched.
    """
    hosts = staged(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *[
        F.sum(F.col(f"fails.{r}").cast("bigint")).alias(f"k_{r}") for r in RULES]))
    sums = hosts.agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("n"), *[
        F.sum(f"k_{r}").alias(f"k_{r}") for r in RULES], *[
        F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"q_{r}") for r in RULES]).first()
    columns, strict = [], []
    for r in RULES:
        a, s = beta_prior(sums["hosts"], sums["n"] or 0, sums[f"k_{r}"] or 0, sums[f"q_{r}"] or 0.0)
        rate = (F.col(f"k_{r}") + F.lit(a)) / (F.col("n") + F.lit(s))
        columns.append(rate.alias(f"rate_{r}"))
        strict.append((rate > limit).alias(r))
    return hosts.select("host", "n", *[f"k_{r}" for r in RULES], *columns, F.struct(*strict).alias("strict"))


def beta_prior(hosts: int, n: int, k: int, q: float) -> tuple[float, float]:
    """(alpha, alpha + beta) by moments; q is the sum over hosts of k * k / n.

    The variance between hosts is the weighted variance of their rates less
    what chance alone gives. Strength lies between 2 and 10,000 documents.
    """
    if not n:
        return 1.0, 2.0
    mean = k / n
    between = (q / n - mean * mean) - mean * (1 - mean) * hosts / n
    strength = mean * (1 - mean) / between - 1 if between > 0 else 10_000.0
    strength = min(max(strength, 2.0), 10_000.0)
    return mean * strength, strength


def rejected(fails: Column, strict: Column) -> Column:
    out = F.lit(False)
    for r in RULES:
        out = out | (fails[r] & F.coalesce(strict[r], F.lit(False)))
    return out


def judge(docs: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """Per row of docs: counts, base_failed, kept, and the rules it fails at a strict host."""
    rows = staged(measured(docs, host_col))
    hosts = host_rates(rows, limit).select("host", "strict")
    return rows.join(hosts, "host", "left").select(
        "doc_id", "host", "m", "base_failed", "fails", "strict",
        (~(F.col("base_failed") | rejected(F.col("fails"), F.col("strict")))).alias("kept"))


def keep_good(docs: DataFrame, host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns.

    The texts are measured once: rows that pass the base rule are written with
    what they fail, and the host verdicts are joined to these.
    """
    host, base, fails, strict = (fresh(docs, x) for x in ("host_key", "base_key", "fails_key", "strict_key"))
    of = let(measures(F.col("text")), lambda m: F.struct(
        base_failed(m).alias("base"), F.struct(*[f(m).alias(name) for name, f in RULES.items()]).alias("fails")))
    marked = docs.withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit(""))).withColumn(fails, of)
    # a text that the base rule rejects counts for its host, but needs not be written
    kept_text = {"text": F.when(~F.col(fails)["base"], F.col("text"))}
    rows = staged(marked.select(*[kept_text.get(c.lower(), F.col(c)).alias(c) for c in docs.columns], host, F.col(fails)["base"].alias(base),
                                F.col(fails)["fails"].alias(fails)))
    hosts = host_rates(rows.select(F.col(host).alias("host"), F.col(fails).alias("fails")), limit)
    joined = rows.where(~F.col(base)).join(hosts.select(F.col("host").alias(host), F.col("strict").alias(strict)), host, "left")
    return joined.where(~rejected(F.col(fails), F.col(strict))).select(*docs.columns)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
                       "base_failed", "kept")


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
           FROM documents),
windows AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, unnest([0, 1, 2]) AS v(d) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
             [n_symbols * 10 > n_words, n_dup_lines * 10 > n_lines * 3,
              word_chars < n_words * 3 OR word_chars > n_words * 12, n_repeat_words * 5 > n_words] AS fails FROM m),
k AS (SELECT host, r, count(*) AS n, sum(fails[r]::INT) AS k FROM f, unnest([1, 2, 3, 4]) AS u(r) GROUP BY host, r),
s AS (SELECT r, count(*) AS hosts, sum(n) AS n, sum(k) AS k, sum(k * k / n) AS q FROM k GROUP BY r),
b AS (SELECT r, hosts, n, k / n AS mean, q / n - (k / n) * (k / n) - (k / n) * (1 - k / n) * hosts / n AS between_hosts FROM s),
p AS (SELECT r, mean, least(greatest(CASE WHEN between_hosts > 0 THEN mean * (1 - mean) / between_hosts - 1
                                          ELSE 10000.0 END, 2.0), 10000.0) AS strength FROM b),
strict AS (SELECT host, list((k + mean * strength) / (n + strength) > 0.05 ORDER BY r) AS strict
           FROM k JOIN p USING (r) GROUP BY host)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR (fails[1] AND strict[1]) OR (fails[2] AND strict[2]) OR (fails[3] AND strict[3])
            OR (fails[4] AND strict[4])) AS kept
FROM f JOIN strict USING (host)
"""
