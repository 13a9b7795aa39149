"""Secret scans by sliding-window entropy (operator 9).

Three base patterns find assignments, access keys and long hex strings. The
entropy method looks at every other candidate: a run of 20 or more characters
of keys and tokens. A window of 20 characters slides over it; its Shannon
entropy is kept by counts, one up for the character that enters and one down
for the one that leaves. Each character class has its own threshold, and an
allow-list drops what is known to be harmless.

Everything happens inside the row: no shuffle, no Python. Offsets are code
points, ends exclusive. A null text counts as empty, repeated rows are scanned
each for themselves, other columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.common import count_up, fresh, let, running_maxima, running_sums
from scanfold.sources.tables import table

WINDOW = 20
#: Base kinds in their order, and their patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
CANDIDATE = r"[A-Za-z0-9+/_=.-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-"
#: Character classes: the candidates that belong to it, and the bits a window must reach. The first that fits counts.
CLASSES = {
    "entropy_hex": (r"^[0-9A-Fa-f]*$", 2.8),
    "entropy_alnum": (r"^[A-Za-z0-9]*$", 3.4),
    "entropy_base64": (r"^[A-Za-z0-9+/_=.-]*$", 3.7),
}
#: A candidate must mix letters and digits, else it is a word or a number.
MIXED = r"(?s)(?=.*[A-Za-z])(?=.*[0-9])"
#: Runs of digits that only fill a placeholder.
FILLER = r"(?:0{5,}+|0?12345678(?:90?)?)[0-9]{0,4}(?![0-9])"
#: Harmless candidates: placeholders, UUIDs, dates and times, versions, addresses and paths made of words. A placeholder
#: clears a candidate only if no other part could be a key: each segment between separators is letters, filler and at
#: most four digits at its end. Versions and file extensions have bounded parts.
ALLOWED = (r"^wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY$",
           r"^(?=.*(?i:example|placeholder|changeme|dummy|sample|xxxxx|00000|12345678|abcdefgh))"
           rf"(?!.*(?<![0-9])(?!{FILLER})(?:[0-9]++[A-Za-z]|[0-9]{{5}}))",
           r"^[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}$",
           r"^[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-]?[0-9.:+-]*Z?$",
           r"^[vV]?[0-9]{1,8}(\.[0-9]{1,8}){1,4}([.+_-]([A-Za-z]{1,12}[0-9]{0,4}|[0-9]{1,14})){0,4}([.+-]g?[0-9a-f]{7,8})?$",
           r"^/*([A-Za-z_.-]+[0-9]{0,4}/)+[A-Za-z_.-]*[0-9]{0,4}(\.[A-Za-z0-9]{1,5})?/*$",
           r"^([A-Za-z]+[0-9]{0,4}[_.-])+[A-Za-z]+[0-9]{0,4}$")
KINDS = [*BASE, *CLASSES]


def entropy_peak(text: Column, window: int = WINDOW) -> Column:
    """Highest Shannon entropy in bits of any window of a string over ALPHABET.

    The state is one count per character and the running sum of c * log2(c), so
    a step costs the same at every length. A string shorter than the window is
    one window of its own length; an empty one has entropy 0.
    """
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])

    def slide(codes: Column) -> Column:
        width = F.least(F.size(codes), F.lit(window))
        zero = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"),
                        F.lit(1e18).alias("least"))

        def step(state: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-1))
            up = F.get(state["counts"], enters)
            grown = state["sum"] + F.get(weight, up + 1) - F.get(weight, up)
            down = F.get(state["counts"], leaves)
            moved = F.when(i < window, grown).when(enters == leaves, state["sum"]).otherwise(
                grown - F.get(weight, down) + F.get(weight, down - 1))
            counts = F.transform(state["counts"], lambda c, j: c + F.when(j == enters, F.lit(1)).otherwise(F.lit(0))
                                 - F.when(j == leaves, F.lit(1)).otherwise(F.lit(0)))
            return let(moved, lambda s: F.struct(
                counts.alias("counts"), s.alias("sum"),
                F.when(i >= width - 1, F.least(state["least"], s)).otherwise(state["least"]).alias("least")))

        end = F.aggregate(count_up(F.size(codes)), zero, step)
        return F.when(width <= 1, F.lit(0.0)).otherwise(let(end["least"], lambda s: F.log2(width) - s / width))

    return let(F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), slide)


def _allowed(text: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOWED:
        out = out | text.rlike(pattern)
    return out


def _entropy_kind(text: Column) -> Column:
    """The class a candidate is caught by, or null."""
    peak = let(entropy_peak(text), lambda h: F.coalesce(*[
        F.when(text.rlike(pattern), F.when(h >= bits, F.lit(name)).otherwise(F.lit("")))
        for name, (pattern, bits) in CLASSES.items()]))
    return F.nullif(F.when(text.rlike(MIXED) & ~_allowed(text), peak), F.lit(""))


def _matches(text: Column, pattern: str) -> Column:
    """Array of (match, start) of a pattern; the regex runs only where it is found at all."""
    def place(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        steps = F.zip_with(gaps, found, lambda g, m: F.char_length(g) + F.char_length(m))
        return let(gaps, lambda g: F.transform(F.arrays_zip(
            found.alias("m"), running_sums(steps).alias("s"), F.transform(g, F.char_length).alias("g")),
            lambda x: F.struct(x["m"].alias("m"), (x["s"] + x["g"]).cast("bigint").alias("s"))))

    empty = F.array().cast("array<struct<m:string,s:bigint>>")
    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(empty)


def _spans(text: Column) -> Column:
    """All spans of a text in order: array of (start, rank of the kind, kind, end)."""
    def span(kind: Column | str, rank: Column, x: Column) -> Column:
        return F.struct(x["s"].alias("start"), rank.alias("rank"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
                        (x["s"] + F.char_length(x["m"])).cast("bigint").alias("end"))

    def base(rank: int, kind: str, pattern: str) -> Column:
        found = _matches(text, pattern)
        if kind == "assign":
            found = F.filter(found, lambda x: F.char_length(F.regexp_extract(x["m"], f"(?s)^{ASSIGN}$", 2)) >= 6)
        return F.transform(found, lambda x: span(kind, F.lit(rank), x))

    parts = [base(rank, kind, pattern) for rank, (kind, pattern) in enumerate(BASE.items())]
    named = F.transform(_matches(text, CANDIDATE), lambda x: F.struct(
        x["m"].alias("m"), x["s"].alias("s"), _entropy_kind(x["m"]).alias("kind")))
    caught = F.filter(named, lambda x: x["kind"].isNotNull())
    parts.append(F.transform(caught, lambda x: span(x["kind"], F.array_position(
        F.array(*map(F.lit, KINDS)), x["kind"]).cast("int") - 1, x)))
    return F.sort_array(F.concat(*parts))


#: No candidate of any kind can begin without one of these.
ANY = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_=.-]{20}"


def secret_spans(text: Column) -> Column:
    """Array of (start, rank, kind, end) of all secrets in a text."""
    none = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    return let(F.coalesce(text, F.lit("")), lambda t: F.when(t.rlike(ANY), _spans(t)).otherwise(none))


def mask(text: Column, spans: Column, label: str = "[secret]") -> Column:
    """The text with every maximal run of overlapping spans replaced by a label."""
    def runs(xs: Column, reach: Column) -> Column:
        heads = F.filter(count_up(F.size(xs)), lambda i: (i == 0) | (F.get(xs, i)["start"] >= F.get(reach, i)))
        return let(heads, lambda h: F.transform(count_up(F.size(h)), lambda k: F.struct(
            F.get(xs, F.get(h, k))["start"].alias("start"),
            F.coalesce(F.get(reach, F.get(h, k + 1)), F.array_max(F.transform(xs, lambda x: x["end"]))).alias("end"))))

    def cut(rs: Column) -> Column:
        def piece(k: Column) -> Column:
            begin = F.coalesce(F.get(rs, k - 1)["end"], F.lit(0).cast("bigint"))
            end = F.coalesce(F.get(rs, k)["start"], F.char_length(text).cast("bigint"))
            return F.substring(text, (begin + 1).cast("int"), (end - begin).cast("int"))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(rs)), piece), label)

    masked = let(spans, lambda xs: let(running_maxima(F.transform(xs, lambda x: x["end"])),
                                       lambda reach: let(runs(xs, reach), cut)))
    return F.when(F.size(spans) == 0, text).otherwise(masked)


def find_secrets(docs: DataFrame, spans_col: str = "secret_spans") -> DataFrame:
    """docs with an array column of spans; a column of that name is replaced."""
    return docs.withColumn(spans_col, secret_spans(F.col("text")))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """docs with the secrets in text replaced by a label; n_chars, if there is one, follows."""
    spans = fresh(docs, "spans")
    out = docs.withColumn(spans, secret_spans(F.col("text"))).withColumn("text", mask(F.col("text"), F.col(spans)))
    return with_length(out, docs).select(*docs.columns)


def with_length(df: DataFrame, like: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in like.columns else df


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), "spans").select("doc_id", "spans")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE],
                        F.sha2(_joined(F.filter("spans", lambda x: x["rank"] < len(BASE))), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))
