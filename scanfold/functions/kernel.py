"""The scan kernel: locate regex matches in a text and judge each one.

``regexp_replace`` brackets every match with two marker characters.  After
splitting the marked text at newlines, the index of a line holding a marker is
the line number of a match start or end.  The text is read a constant number of
times per pattern, however many matches it has.

All of it is Column expressions over one row: no shuffle, no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scanfold.catalog import model
from scanfold.catalog.government import CIPHER_CONTEXT_CHARS, CIPHER_CONTEXT_WORDS
from scanfold.functions.dialect import FOLDING_CHARS
from scanfold.functions.text import before_first, count_up, let, line_range, lines_of, newlines, occurrences, prefix_minima, prefix_sums, strip

# Unicode noncharacters, reserved for use inside a process.
MARKERS = (("﷐", "﷑"), ("﷒", "﷓"), ("﷔", "﷕"), ("﷖", "﷗"))

#: Matches up to which a text is read once for each of them.
FEW = 8

VIOLATION_SCHEMA = (
    "array<struct<line_start:int,line_end:int,rule_ord:int,pattern_ord:int,match_ord:int,"
    "rule_id:string,severity:string,category:string,label:string,title:string,description:string,"
    "code_snippet:string,owasp_mapping:string,cwe_id:string,detail:string>>"
)


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def unmarked(text: Column) -> Column:
    """The text; if it holds every marker pair, with the first pair's characters replaced, one for one."""
    def held(pair):
        return F.contains(text, F.lit(pair[0])) | F.contains(text, F.lit(pair[1]))

    every = F.lit(True)
    for pair in MARKERS:
        every = every & held(pair)
    return F.when(~is_ascii(text) & every, F.translate(text, "".join(MARKERS[0]), "\ufffd\ufffd")).otherwise(text)


def markers(text: Column) -> Column:
    """A marker pair absent from a text that ``unmarked`` gave."""
    def absent(pair):
        return ~F.contains(text, F.lit(pair[0])) & ~F.contains(text, F.lit(pair[1]))

    def as_struct(pair):
        return F.struct(F.lit(pair[0]).alias("open"), F.lit(pair[1]).alias("close"))

    choice = F.when(is_ascii(text) | absent(MARKERS[0]), as_struct(MARKERS[0]))
    for pair in MARKERS[1:-1]:
        choice = choice.when(absent(pair), as_struct(pair))
    return choice.otherwise(as_struct(MARKERS[-1]))


def folds_oddly(text: Column) -> Column:
    """True when the text holds a character the literal gate could miss."""
    found = F.lit(False)
    for char in FOLDING_CHARS:
        found = found | F.contains(text, F.lit(char))
    return ~is_ascii(text) & found


def bracket(text: Column, regex: Column, marks: Column) -> Column:
    return F.regexp_replace(text, regex, F.concat(marks["open"], F.lit("$0"), marks["close"]))


def by_regex(number: Column, regexes: list[str], use: Callable[[Column], Column], other: Column) -> Column:
    """``use`` of the regex with this number, or ``other`` for a number below 0.

    A regex that is a constant of the expression is compiled once for a task; one
    that is data is compiled for every call. Halving finds the number's branch.
    """
    def branch(a: int, b: int) -> Column:
        if b - a == 1:
            return use(F.lit(regexes[a]))
        middle = (a + b) // 2
        return F.when(number < middle, branch(a, middle)).otherwise(branch(middle, b))
    return F.when(number < 0, other).otherwise(branch(0, len(regexes))) if regexes else other


def sql_text(value: str) -> str:
    """A text as a literal of SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bracketed(patterns: str, regexes: list[str]) -> Column:
    """For each pattern of an array column, ``code`` with the matches bracketed; as ``by_regex``, for hundreds of regexes.

    The branches are one SQL text, which is parsed in one go.
    """
    put = "concat(_marks.open, '$0', _marks.close)"

    def branch(a: int, b: int) -> str:
        if b - a == 1:
            return f"regexp_replace(code, {sql_text(regexes[a])}, {put})"
        middle = (a + b) // 2
        return f"CASE WHEN p.regex_id < {middle} THEN {branch(a, middle)} ELSE {branch(middle, b)} END"
    own = f"regexp_replace(code, CASE WHEN _ascii THEN p.jvm_ascii ELSE p.jvm END, {put})"
    whole = f"CASE WHEN NOT _ascii OR p.regex_id < 0 THEN {own} ELSE {branch(0, len(regexes))} END" if regexes else own
    return F.expr(f"transform({patterns}, p -> {whole})")


def few_spans(marked: Column, marks: Column, count: Column) -> Column:
    """``match_spans`` by reading the text up to each of its matches; for a small ``count`` of them."""
    def line(mark: Column, k: Column) -> Column:
        return (newlines(F.call_function("substring_index", marked, mark, k)) + 1).cast("int")
    return F.transform(F.sequence(F.lit(1), count.cast("int")), lambda k: F.struct(
        line(marks["open"], k).alias("first"), line(marks["close"], k).alias("last")))


def match_spans(marked: Column, marks: Column) -> Column:
    """array<struct<first:int,last:int>>: line of each match's start and end.

    A line of the marked text that holds n opening markers is the first line of
    n matches, likewise for closing ones; both lists come in order of the matches.
    """
    def lines_holding(lines: Column, mark: Column) -> Column:
        return F.flatten(F.transform(lines, lambda x, i: F.array_repeat((i + 1).cast("int"), occurrences(x, mark))))

    return let(lines_of(marked), lambda lines: F.zip_with(
        lines_holding(lines, marks["open"]), lines_holding(lines, marks["close"]),
        lambda a, b: F.struct(a.alias("first"), b.alias("last"))))


def finditer(text: Column, regex: Column, marks: Column) -> Column:
    """array<struct<start:int,end:int,match:string>>, character offsets, in order."""
    pieces = F.split(bracket(text, regex, marks), marks["open"])

    def matches(p: Column) -> Column:
        bare = F.transform(p, lambda x: F.replace(x, marks["close"], F.lit("")))
        found = F.transform(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))),
                            lambda x: before_first(x, marks["close"]))
        starts = F.slice(prefix_sums(F.transform(bare, lambda x: F.length(x))), 2,
                         F.greatest(F.size(p) - 1, F.lit(0)))
        return F.zip_with(starts, found, lambda s, m: F.struct(
            s.alias("start"), (s + F.length(m)).cast("int").alias("end"), m.alias("match")))

    return let(pieces, matches)


# --- checks -----------------------------------------------------------------

def _searched(default: bool, text: Column, ascii_text: Column, p: Column, name: str, contexts: list[str]) -> Column:
    """Does the text match the named word set of ``p``?  Asks the literal gate before the regex."""
    gate = p[f"{name}_gate"]
    gated = let(F.lower(text), lambda low: F.exists(gate, lambda g: F.contains(low, g)))
    found = F.when(ascii_text, by_regex(p[f"{name}_id"], contexts, lambda r: F.rlike(text, r), F.rlike(text, p[f"{name}_ascii"]))
                   ).otherwise(F.rlike(text, p[name]))
    return F.when(p[name] == "", F.lit(default)).otherwise(((F.size(gate) == 0) | ~ascii_text | gated) & found)


def _window_kept(context: Column, ascii_text: Column, p: Column, contexts: list[str]) -> Column:
    return (_searched(True, context, ascii_text, p, "require", contexts)
            & ~_searched(False, context, ascii_text, p, "suppress", contexts))


def glued_context(lines: Column, first: Column, before: Column, after: Column) -> Column:
    """Lines before and including the hit, the hit line, lines after: no separators between the parts."""
    return F.concat(
        line_range(lines, first - before, first),
        F.element_at(lines, first),
        line_range(lines, first + 1, first + after),
    )


def comment_marker(language: Column) -> Column:
    return F.when(language == "python", F.lit("#")).otherwise(F.lit("//"))


def commented_before(marked_line: Column, open_mark: Column, language: Column) -> Column:
    """A comment marker stands before the first match of the line.

    Later matches on the same line report the same span, so the first decides.
    """
    return F.contains(before_first(marked_line, open_mark), comment_marker(language))


def comment_line(line: Column, language: Column) -> Column:
    bare = strip(line)
    return F.when(language == "python", F.startswith(bare, F.lit("#"))).otherwise(
        F.startswith(bare, F.lit("//")) | F.startswith(bare, F.lit("/*")))


def char_contexts(marked: Column, marks: Column, width: int = CIPHER_CONTEXT_CHARS) -> Column:
    """For each match, the text from ``width`` characters before it to ``width`` after it.

    Looks at a bounded number of neighbouring pieces: with a match of at least
    one character, ``width`` + 1 pieces always hold ``width`` characters.
    """
    span = width + 1

    def contexts(pieces: Column) -> Column:
        def one(i: Column) -> Column:                      # 1-based match number
            first = F.greatest(F.lit(1), i + 1 - span)
            left = F.array_join(F.slice(pieces["bare"], first, i + 1 - first), "")
            right = F.array_join(F.slice(pieces["bare"], i + 1, span), "")
            keep = F.length(F.element_at(pieces["match"], i + 1)) + width
            return F.concat(F.right(left, F.lit(width)), F.left(right, keep))
        count = F.size(pieces["bare"]) - 1
        return F.when(count < 1, F.array().cast("array<string>")).otherwise(
            F.transform(F.sequence(F.lit(1), count), one))

    cut = F.split(marked, marks["open"])
    return let(
        let(cut, lambda c: F.struct(
            F.transform(c, lambda x: F.replace(x, marks["close"], F.lit(""))).alias("bare"),
            F.transform(c, lambda x: before_first(x, marks["close"])).alias("match"))),
        contexts)


def cipher_noted(context: Column) -> Column:
    lowered = F.lower(context)
    found = F.lit(False)
    for word in CIPHER_CONTEXT_WORDS:
        found = found | F.contains(lowered, F.lit(word))
    return found


def brace_bodies(marked: Column, marks: Column) -> Column:
    """Body after each match that ends in ``{``: up to its closing brace, or the end of the text.

    Braces get the level at which they open or close; a closing one without an
    open one has none. Sorted by level and place, an opening brace is followed by
    the one that closes it, or by nothing of its level if the text ends first.
    """
    token_re = F.concat(F.lit(r"\{"), marks["close"], F.lit(r"|[{}]|[^{}]+"))
    opener = F.concat(F.lit("{"), marks["close"])

    def levels(tokens: Column) -> Column:
        braces = F.filter(F.transform(tokens, lambda t, i: F.struct(
            (i + 1).cast("int").alias("at"), F.startswith(t, F.lit("{")).alias("opens"), (t == opener).alias("wanted"),
            F.when(F.startswith(t, F.lit("{")), F.lit(1)).when(t == "}", F.lit(-1)).otherwise(F.lit(0)).alias("step"))),
            lambda x: x["step"] != 0)

        def placed(bs: Column) -> Column:
            steps = F.transform(bs, lambda x: x["step"])
            return let(prefix_sums(steps), lambda before: let(
                prefix_minima(F.zip_with(before, steps, lambda s, d: s + d)), lambda low: F.filter(F.transform(
                    bs, lambda x, i: F.struct(
                        (F.get(before, i) - F.get(low, i) + F.when(x["opens"], F.lit(1)).otherwise(F.lit(0))).alias("level"),
                        x["at"].alias("at"), x["opens"].alias("opens"), x["wanted"].alias("wanted"))),
                    lambda x: x["level"] > 0)))

        return let(braces, lambda bs: F.sort_array(placed(bs)))

    def spans(sorted_braces: Column, end: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            after = F.get(sorted_braces, i + 1)
            return F.when(x["wanted"], F.struct(x["at"].alias("first"), F.when(
                after["level"] == x["level"], after["at"]).otherwise(end).alias("last")))
        return F.sort_array(F.filter(F.transform(sorted_braces, span), lambda s: s.isNotNull()))

    def bodies(tokens: Column) -> Column:
        found = let(levels(tokens), lambda bs: spans(bs, F.size(tokens)))
        return F.transform(found, lambda s: F.replace(
            F.replace(F.array_join(F.slice(tokens, s["first"] + 1, s["last"] - s["first"]), ""),
                      marks["close"], F.lit("")), marks["open"], F.lit("")))

    return let(F.regexp_extract_all(marked, token_re, F.lit(0)), bodies)


def unhandled_body(body: Column) -> Column:
    caught = F.contains(body, F.lit("try")) & F.contains(body, F.lit("catch"))
    return (F.contains(body, F.lit("await")) & ~caught & ~F.contains(body, F.lit(".catch"))
            & (F.length(body) > 50))


# --- one pattern on one text -------------------------------------------------

def _fill(template: Column, detail: Column) -> Column:
    return F.replace(template, F.lit("{detail}"), F.coalesce(detail, F.lit("")))


def pattern_hits(code: Column, lines: Column, language: Column, marks: Column, ascii_text: Column, p: Column,
                 marked: Column, checks: set[str], contexts: list[str]) -> Column:
    """Every kept hit of pattern ``p``, whose matches ``marked`` has bracketed.

    ``checks`` limits the expression to the checks in use; ``contexts`` are the
    regexes that the numbers of require and suppress stand for.
    """
    regex = F.when(ascii_text, p["jvm_ascii"]).otherwise(p["jvm"])
    empty = F.array().cast(VIOLATION_SCHEMA)

    none = F.lit(None).cast("string")

    def kept(j: Column, extra: Column) -> Column:
        span, i = j["span"], j["match_ord"]
        line = F.element_at(lines, span["first"])

        def around() -> Column:
            """One expression for both kinds of context, so that their regexes occur once."""
            texts = {model.WINDOW: lambda: line_range(lines, span["first"] - p["before"], _last(span, p) + p["after"]),
                     model.GLUED: lambda: glued_context(lines, span["first"], p["before"], p["after"])}
            return let(_by_check(p, {c: f for c, f in texts.items() if c in checks}),
                       lambda c: _window_kept(c, ascii_text, p, contexts))

        return _by_check(p, {c: f for c, f in {
            model.PLAIN: lambda: F.lit(True),
            model.WINDOW: around,
            model.GLUED: around,
            model.COMMENT: lambda: ~commented_before(
                F.element_at(extra, span["first"]), marks["open"], language),
            model.CAPTURE: lambda: ~F.rlike(F.element_at(extra, i + 1), p["drop_re"]),
            model.CIPHER: lambda: ~comment_line(line, language) & ~cipher_noted(F.element_at(extra, i + 1)),
            model.BODY: lambda: unhandled_body(F.element_at(extra, 2 * i + 1)),
        }.items() if c in checks})

    def detail_of(j: Column, extra: Column) -> Column:
        span, i = j["span"], j["match_ord"]

        def first_word():
            line = F.element_at(lines, span["first"])
            return F.when(F.size(p["detail_words"]) > 0, let(F.lower(line), lambda low: F.get(F.filter(
                p["detail_words"], lambda w: (~ascii_text | F.contains(low, w["gate"])) & F.rlike(line, w["jvm"])),
                F.lit(0))["raw"]))

        return _by_check(p, {c: f for c, f in {
            model.WINDOW: first_word,
            model.CAPTURE: lambda: F.element_at(extra, i + 1),
            model.BODY: lambda: F.coalesce(
                F.nullif(F.element_at(extra, 2 * i + 2), F.lit("")), p["default_detail"]),
        }.items() if c in checks}, none)

    def hit(j: Column, detail: Column) -> Column:
        first, last = j["span"]["first"], _last(j["span"], p)
        count = F.when(p["snippet_span"], last - first + 1 + p["snippet_extra"]).otherwise(1)
        return F.struct(
            first.alias("line_start"), last.alias("line_end"),
            p["rule_ord"].alias("rule_ord"), p["pattern_ord"].alias("pattern_ord"), j["match_ord"].alias("match_ord"),
            p["rule_id"].alias("rule_id"), p["severity"].alias("severity"), p["category"].alias("category"),
            p["label"].alias("label"), _fill(p["title"], detail).alias("title"),
            _fill(p["message"], detail).alias("description"),
            strip(F.array_join(F.slice(lines, first, count), "\n")).alias("code_snippet"),
            p["owasp"].alias("owasp_mapping"), p["cwe"].alias("cwe_id"), detail.alias("detail"))

    def extras(marked: Column) -> Column:
        """What the check needs beside the lines, one array per pattern and text."""
        need = {
            model.COMMENT: lambda: lines_of(marked),
            model.CAPTURE: lambda: F.regexp_extract_all(code, regex, F.lit(1)),
            model.CIPHER: lambda: char_contexts(marked, marks),
            model.BODY: lambda: F.flatten(F.zip_with(
                brace_bodies(marked, marks), F.regexp_extract_all(code, regex, F.lit(1)), lambda b, n: F.array(b, n))),
        }
        out = F.array().cast("array<string>")
        for check, expression in need.items():
            if check in checks:
                out = F.when(p["check"] == check, expression()).otherwise(out)
        return out

    def found(marked: Column, count: Column) -> Column:
        spans = F.when(count <= FEW, few_spans(marked, marks, count)).otherwise(match_spans(marked, marks))
        numbered = F.transform(spans, lambda s, i: F.struct(s.alias("span"), i.cast("int").alias("match_ord")))
        return let(extras(marked), lambda extra: F.transform(
            F.filter(numbered, lambda j: kept(j, extra)),
            lambda j: let(detail_of(j, extra), lambda d: hit(j, d))))

    return F.when(F.contains(marked, marks["open"]), let(
        occurrences(marked, marks["open"]), lambda n: found(marked, n))).otherwise(empty)


def _last(span: Column, p: Column) -> Column:
    return F.when(p["multi_line"], span["last"]).otherwise(span["first"])


def _by_check(p: Column, expressions: dict, default: Column | None = None) -> Column:
    """The expression of the pattern's own check; the others are not evaluated. Checks with one expression share it."""
    groups: dict = {}
    for name, expression in expressions.items():
        groups.setdefault(expression, []).append(name)
    order = list(groups.items())
    if default is None:
        default = order.pop()[0]()
    for expression, names in order:
        default = F.when(p["check"].isin(names), expression()).otherwise(default)
    return default


# --- de-duplication inside one row ------------------------------------------

def sorted_hits(hits: Column) -> Column:
    """By line span, then catalogue order, then match order (the struct's own field order)."""
    return F.array_sort(hits)


def first_wins(hits: Column, *key: str) -> Column:
    """Keep the first hit per key; ``hits`` must be sorted so that equal keys are adjacent."""
    return let(hits, lambda h: F.filter(h, lambda x, i: (i == 0) | _differs(F.get(h, i - 1), x, key)))


def _differs(a: Column, b: Column, key) -> Column:
    out = F.lit(False)
    for k in key:
        out = out | (a[k] != b[k])
    return out


def dedupe_rule(hits: Column) -> Column:
    return first_wins(hits, "line_start", "line_end", "rule_ord")


def dedupe_location(hits: Column) -> Column:
    return first_wins(hits, "line_start", "line_end")
