"""Declarative rule records.

A rule is data, not code: regex patterns per language plus the name of the
check that decides whether a match is kept.  The scan turns the records into a
small DataFrame and joins it to the files, so adding a rule never adds a stage.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# Checks a match can be put to (see functions/kernel.py for their meaning).
PLAIN = "plain"        # keep every match
WINDOW = "window"      # lines around the hit must / must not match a regex
GLUED = "glued"        # like WINDOW, over an unseparated concatenation of line blocks
CAPTURE = "capture"    # capture group 1 must not match a regex
COMMENT = "comment"    # drop when a comment marker precedes the match on its line
CIPHER = "cipher"      # drop on comment lines and next to words that mark the use as known-weak
BODY = "body"          # inspect the brace-delimited body that follows the match

ANY = "*"


@dataclass(frozen=True)
class Pattern:
    regex: str
    label: str = ""
    # Overrides of the rule-level templates, used where one rule has two kinds of hit.
    check: str | None = None
    title: str | None = None
    message: str | None = None
    drop_re: str | None = None
    flags: str | None = None
    detail: str | None = None
    # True when the capture always satisfies drop_re, so the pattern can never report.
    never_reports: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: str
    name: str
    description: str
    severity: str
    category: str
    languages: tuple[str, ...]
    title: str
    message: str
    patterns: dict[str, tuple[Pattern, ...]]
    owasp: str | None = None
    cwe: str | None = None
    references: tuple[str, ...] = ()
    flags: str = ""                 # subset of "im"
    check: str = PLAIN
    before: int = 0                 # window: lines before the first hit line
    after: int = 0                  # window: lines after the anchor line
    require: tuple[str, ...] = ()
    suppress: dict[str, tuple[str, ...]] | tuple[str, ...] = ()
    multi_line: bool = False        # report the true last line (else last = first)
    snippet_span: bool = False      # snippet covers first..last line (else the first line only)
    snippet_extra: int = 0          # further lines appended to a span snippet
    skip_path: tuple[str, ...] = ()
    detail_words: tuple[str, ...] = ()   # first of these found on the line fills {detail}
    pack: str | None = None

    def supports(self, language: str) -> bool:
        if not self.languages:
            return True
        return language.lower() in {x.lower() for x in self.languages}

    def patterns_for(self, language: str) -> tuple[Pattern, ...]:
        if not self.supports(language):
            return ()
        return self.patterns.get(language, ()) + self.patterns.get(ANY, ())

    def suppress_for(self, language: str) -> tuple[str, ...]:
        if isinstance(self.suppress, dict):
            return self.suppress.get(language, ())
        return tuple(self.suppress)


def pats(*pairs) -> tuple[Pattern, ...]:
    return tuple(Pattern(*p) if isinstance(p, tuple) else Pattern(p) for p in pairs)
