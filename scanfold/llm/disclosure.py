"""Sanitisation of personal data by disclosure (operator 3).

Four base patterns find protected entities: e-mail addresses, IP addresses, card
and phone numbers. Words near an entity can give it away even when it is masked.
How strongly a term t reveals an entity e is estimated from the whole corpus:

    PMI(e, t) = log(n_et * N / (n_e * n_t)),   IC(e) = log(N / n_e)

with N documents, n_e that hold e, n_t that hold t anywhere, and n_et where t
stands within REACH words of e. PMI / IC is the share of e's information that t
discloses. Terms seen near e in at least SUPPORT documents are generalised from
GENERALISE on and removed from REMOVE on, where they stand near e. Terms are
words of LETTERS letters or more, in lower case.

Counts are combined before each shuffle; a pair of a common entity and a term is
joined on both, and Spark splits it if it is too much for one task. Texts are
not shuffled.

A null or empty text holds nothing. Rows with equal doc_id and text are found
alike, and count as documents each. Other columns play no part.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanfold.llm.common import fresh
from scanfold.sources.tables import staged, table

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
REACH, LETTERS, SUPPORT = 8, 3, 2
GENERALISE, REMOVE = 0.6, 0.9
#: So many candidate terms are sent to the tasks at most; beyond that, all terms are counted and joined by shuffle.
SENT_TERMS = 200_000
#: Terms that a task holds before it hands on their counts.
HELD_TERMS = 200_000

LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{%d,}" % LETTERS)
DIGIT = re.compile(r"[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from their @, so that long runs are read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in LEFT:
            begin -= 1
        m = RIGHT.match(text, at) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the base patterns, in order."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        for m in IP.finditer(text):
            parts = [p.lstrip("0") for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            d = digits_of(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, rank: int) -> str:
    """What counts as the same entity: addresses without case, numbers by their digits."""
    return f"{KINDS[rank]}:{text.lower() if rank < 2 else digits_of(text)}"


def contexts(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[str, str, int, int]]:
    """(entity, term, start, end) of the words near each span that lie in no span, within 25 * REACH characters."""
    out, far = [], 25 * REACH
    starts, reach = [a for a, _, _ in spans], list(accumulate((b for _, _, b in spans), max))

    def free(m: re.Match[str]) -> bool:
        before = bisect_left(starts, m.end())
        return not before or reach[before - 1] <= m.start()

    for start, rank, end in spans:
        name, low, high = entity(text[start:end], rank), max(0, start - far), min(len(text), end + far)
        for m in [*list(WORD.finditer(text, low, start))[-REACH:], *list(WORD.finditer(text, end, high))[:REACH]]:
            cut = (m.start() == low > 0 and text[low - 1].isalpha()) or (m.end() == high < len(text) and text[high].isalpha())
            if not cut and free(m):
                out.append((name, m[0].lower(), m.start(), m.end()))
    return out


FOUND = ("doc_id long, th long, spans array<struct<start:long,rank:int,end:long>>, entities array<string>, "
         "near array<struct<entity:string,term:string,start:long,end:long>>")


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, text) to base spans, entities and the terms near them."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64())]))
    near = pa.list_(pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            spans, names, terms = [], [], []
            for value in part.column(2):
                text = value.as_py() or ""
                own = base_spans(text)
                spans.append([{"start": a, "rank": k, "end": b} for a, k, b in own])
                names.append(sorted({entity(text[a:b], k) for a, k, b in own}))
                terms.append([{"entity": e, "term": t, "start": a, "end": b} for e, t, a, b in contexts(text, own)])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(spans, span), pa.array(names, pa.list_(pa.string())),
                 pa.array(terms, near)], ["doc_id", "th", "spans", "entities", "near"])


def _count_terms(only: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(text) to terms and the number of the task's documents that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                               ["term", "n"])
            held.clear()
            return batch

        for batch in batches:
            for value in batch.column(0):
                words = {w.lower() for w in set(WORD.findall(value.as_py() or ""))}
                held.update(words if only is None else words & only)
                if len(held) > HELD_TERMS:
                    yield out()
        yield out()
    return run


def risky_pairs(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(entity, term, rank): terms that disclose an entity, rank 4 to generalise and 5 to remove."""
    total = found.count()
    seen = found.select(F.explode("entities").alias("entity")).groupBy("entity").agg(
        F.count(F.lit(1)).alias("n_e")).where((F.col("n_e") >= SUPPORT) & (F.col("n_e") < total))
    pairs = found.select(F.explode(F.array_distinct(F.transform("near", lambda x: F.struct(
        x["entity"].alias("entity"), x["term"].alias("term"))))).alias("p")).select(
        "p.entity", "p.term").groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_et")).where(F.col("n_et") >= SUPPORT)
    pairs = staged(pairs.join(seen, "entity"))
    terms = pairs.select("term").distinct()
    few = terms.limit(SENT_TERMS + 1).collect()                 # a fixed number of words
    only = frozenset(r["term"] for r in few) if len(few) <= SENT_TERMS else None
    counts = docs.select("text").mapInArrow(_count_terms(only), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    ratio = F.log(F.col("n_et") * F.lit(float(total)) / (F.col("n_e") * F.col("n_t"))) / F.log(F.lit(float(total)) / F.col("n_e"))
    return pairs.join(counts, "term").withColumn("share", ratio).where(F.col("share") >= generalise).select(
        "entity", "term", F.when(F.col("share") >= remove, F.lit(5)).otherwise(F.lit(4)).alias("rank"))


def find_personal(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """Per row of docs: doc_id, th (a hash of the text), spans (start, rank, end) of all kinds in order."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    found = staged(rows.mapInArrow(_find, FOUND))
    risky = staged(risky_pairs(found, rows, generalise, remove))
    near = found.where(F.size("near") > 0).select("doc_id", "th", F.explode("near").alias("x")).select("doc_id", "th", "x.*")
    terms = near.join(risky, ["entity", "term"]).groupBy("doc_id", "th", "start", "end").agg(F.max("rank").alias("rank"))
    extra = terms.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "rank", "end")).alias("extra")).select(
        F.col("doc_id").alias("of"), F.col("th").alias("hash"), "extra")
    joined = found.join(extra, found["doc_id"].eqNullSafe(F.col("of")) & (found["th"] == F.col("hash")), "left")
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>")
    return joined.select("doc_id", "th", F.sort_array(F.concat("spans", F.coalesce("extra", none))).alias("spans"))


def sanitised(text: str, spans: list) -> str:
    """The text with entities replaced by their kind, terms by their shape or by nothing."""
    out, at = [], 0
    for start, rank, end in spans:
        if start >= at:
            word = text[start:end]
            out += [text[at:start], f"[{KINDS[rank]}]" if rank < 4 else "" if rank == 5 else "[Name]" if word[:1].isupper() else "[word]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """docs with personal data and disclosing terms taken out of text."""
    of, th, spans = (fresh(docs, x) for x in ("of_doc", "text_hash", "spans"))
    hits = find_personal(docs, generalise, remove).where(F.size("spans") > 0).select(
        F.col("doc_id").alias(of), F.col("th").alias(th), F.col("spans").alias(spans)).dropDuplicates([of, th])
    clean = F.pandas_udf(lambda t, s: pd.Series([x if x is None or y is None else sanitised(x, [(v["start"], v["rank"], v["end"]) for v in y])
                                                 for x, y in zip(t, s)], dtype=object), "string")
    joined = docs.join(hits, docs["doc_id"].cast("bigint").eqNullSafe(F.col(of)) & (F.xxhash64(docs["text"]) == F.col(th)), "left")
    return joined.withColumn("text", clean(F.col("text"), F.col(spans))).select(*docs.columns)


def _joined(keep: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(filter(spans, x -> {keep}), x -> concat_ws(':', array({names})[x.rank], x.start, x.end)), ',')"


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_personal(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.rank = {k})) as bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS[:4])]
    return rows.select("doc_id", *counts, F.sha2(F.expr(_joined("x.rank < 4")), 256).alias("base_sha256"),
                       F.expr(_joined("true")).alias("spans"))
