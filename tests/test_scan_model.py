"""The scan plan against the plain loop, on random mixes of snippets, lines and odd characters."""

import random
import re
import time

from pyspark.sql import functions as F

from model import Model
from scanfold.catalog import Catalogue
from scanfold.catalog.frames import pattern_records
from scanfold.functions import kernel
from scanfold.functions.dialect import literal_gate, pattern_error, to_jvm
from scanfold.operators.scan import explode_violations, find_violations, scan
from scanfold.sources.corpus import SNIPPETS

CATALOGUE = Catalogue.builtin()
FILE_SCHEMA = "file_id long, org string, repo string, file_path string, language string, code string"
ODD = ["é", "ſ", "İ", "K", "ı", "\u2028", "\x1c", "\r\n", "\t", "日本", "﷐", "{", "}", "\x85", "\xa0", "\n\n"]


def random_texts(seed: int, n: int):
    rng = random.Random(seed)
    everything = [s for group in SNIPPETS.values() for s in group]
    for i in range(n):
        language = rng.choice(["python", "javascript", "TypeScript", "java", "go", "ruby", "php", "csharp", "rust"])
        own = SNIPPETS.get(language.lower(), SNIPPETS["other"])
        parts = [rng.choice(own if rng.random() < 0.8 else everything) for _ in range(rng.randint(1, 6))]
        text = "".join(parts)
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(text))
            text = text[:at] + rng.choice(ODD) + text[at:]
        path = rng.choice(["src/a.py", "src/tests/b.js", "lib/x.config.ts", "c.go"])
        yield i, "org", "repo", path, language, text


def scanned(spark, rows, rules):
    files = spark.createDataFrame(rows, FILE_SCHEMA).repartition(8, "file_id")
    got: dict[int, list] = {r[0]: [] for r in rows}
    found = explode_violations(find_violations(files, rules, languages=CATALOGUE.languages()))
    for r in found.select("file_id", "rule_id", "line_start", "line_end", "label", "detail", "code_snippet").collect():
        got[r[0]].append(tuple(r)[1:])
    return {k: sorted(v, key=str) for k, v in got.items()}


def expected(rows, rules):
    model = Model(rules, CATALOGUE.languages())
    return {r[0]: sorted(model.violations(r[5], r[4], r[3]), key=str) for r in rows}


def test_random_files_equal_the_loop(spark):
    rows = list(random_texts(7, 600))
    rules = CATALOGUE.list_rules()
    got, want = scanned(spark, rows, rules), expected(rows, rules)
    wrong = [(rows[k][5], set(got[k]) ^ set(want[k])) for k in want if got[k] != want[k]]
    assert not wrong, wrong[:2]
    assert sum(map(len, want.values())) > 1500


def test_one_file_with_very_many_hits(spark):
    """A single hot file stays exact and finishes."""
    code = "\n".join(f'os.system("x{i} " + a)\nprint(patient_name)\nhashlib.md5(a)' for i in range(1500))
    rows = [(1, "o", "r", "src/a.py", "python", code)]
    rules = CATALOGUE.select(["SEC-003", "STD-002", "HIPAA-001", "FED-003"])
    got, want = scanned(spark, rows, rules), expected(rows, rules)
    assert got == want and len(got[1]) >= 6000


def test_adding_a_line_on_top_shifts_every_hit(spark):
    rows = [r for r in random_texts(11, 150) if r[5].isascii()]
    rules = CATALOGUE.select(packs=["default-security"])
    base = scanned(spark, rows, rules)
    shifted = scanned(spark, [(*r[:5], "x = 1\n" + r[5]) for r in rows], rules)
    # SEC-005 looks at a window, so a line on top cannot change its verdict; spans move by one.
    moved = {k: sorted(((h[0], h[1] + 1, h[2] + 1, *h[3:]) for h in v), key=str) for k, v in base.items()}
    assert moved == shifted


def test_finditer_equals_re(spark):
    regexes = [r"\w+", r"\s+", r"[a-z]+\s*\(", r"^\s*\w+", r"(?:os|db)\.\w+", r"a|ab", r"\d+(?=\))", r"[^\n]*$"]
    rows = [(i, r[5]) for i, r in enumerate(random_texts(3, 120)) if not set(r[5]) & set("\x85")]
    df = spark.createDataFrame(rows, "id long, code string")
    for regex in regexes:
        flags = "m" if "^" in regex or "$" in regex else ""
        found = kernel.finditer(F.col("code"), F.lit(to_jvm(regex, flags)), kernel.markers(F.col("code")))
        got = {r["id"]: [(h["start"], h["match"]) for h in r["f"]] for r in df.select("id", found.alias("f")).collect()}
        compiled = re.compile(regex, re.M if flags else 0)
        want = {i: [(m.start(), m.group()) for m in compiled.finditer(code) if m.group() != "" or "$" not in regex]
                for i, code in rows}
        if "$" in regex:
            got = {k: [h for h in v if h[1] != ""] for k, v in got.items()}
        assert got == want, regex


def test_gates_never_hide_a_match():
    texts = [r[5] for r in random_texts(5, 400)]
    for r in pattern_records(CATALOGUE.list_rules(), CATALOGUE.languages()):
        flags = (re.I if "i" in r["flags"] else 0) | (re.M if "m" in r["flags"] else 0)
        for text in texts:
            if any(c in text for c in "ſİıK"):
                continue
            if r["gate"] and re.search(r["regex"], text, flags):
                assert any(g in text.lower() for g in r["gate"]), r["regex"]


def test_literal_gate_shapes():
    assert literal_gate(r"os\.system\s*\(") == ["os.system"]
    assert literal_gate(r"login|sign[_\s]?in") == ["login", "sign"]
    assert literal_gate(r"\w+") == []
    assert literal_gate(r"(?:abc)*x") == ["x"]


def _one_file(spark, line, times, language="javascript"):
    return spark.range(1).select(
        F.lit(1).cast("bigint").alias("file_id"), F.lit("o").alias("org"), F.lit("r").alias("repo"), F.lit(1).alias("pr_number"),
        F.lit("src/a.js").alias("file_path"), F.lit(language).alias("language"), F.repeat(F.lit(line), times).alias("code"))


def test_time_follows_the_number_of_hits(spark):
    spent = {}
    for times in (100, 20_000, 80_000):
        start = time.perf_counter()
        assert scan(_one_file(spark, "console.log(x)\n", times), rule_ids=["STD-002"], dedupe="none").count() == times
        spent[times] = time.perf_counter() - start
    assert spent[80_000] < 5.3 * spent[20_000] + 5


def test_text_with_every_marker(spark):
    line = "console.log(x) // " + "".join(c for pair in kernel.MARKERS for c in pair) + "\n"
    rows = scan(_one_file(spark, line, 3), rule_ids=["STD-002"], dedupe="none").collect()
    assert [r["line_start"] for r in rows] == [1, 2, 3]


def test_python_only_syntax(spark):
    cases = [(r"a{,3}b", "caaab"), (r"(?P<q_1>['\"]).*?(?P=q_1)", "x 'y' z"), (r"end\Z", "the end"), (r"end\Z", "the end\n"),
             (r"\U0001F642", "smile \U0001F642"), (r"[a{,3}]b", ",b"), (r"x\{,3}", "x{,3}")]
    for regex, text in cases:
        assert pattern_error(regex) is None
        found = spark.range(1).select(F.lit(text).rlike(to_jvm(regex))).first()[0]
        assert found == bool(re.search(regex, text)), regex
    assert all("not supported" in pattern_error(p) for p in (r"(a)?(?(1)b|c)", r"(?a)\w", r"(?u:x)"))
    assert pattern_error(r"[(?(]x\(?(y)") is None
