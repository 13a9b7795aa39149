"""The rule semantics once more, as a plain loop over one text: what the Spark plan is checked against."""

from __future__ import annotations

import re

from scanfold.catalog import ANY, Catalogue
from scanfold.catalog.frames import pattern_records
from scanfold.catalog.government import CIPHER_CONTEXT_CHARS, CIPHER_CONTEXT_WORDS


class Model:
    def __init__(self, rules, languages=None):
        self.languages = languages or Catalogue.builtin().languages()
        self.by_language: dict[str, list] = {}
        for r in pattern_records(rules, self.languages):
            flags = (re.I if "i" in r["flags"] else 0) | (re.M if "m" in r["flags"] else 0)
            self.by_language.setdefault(r["language"], []).append((r, re.compile(r["regex"], flags)))

    def hits(self, code: str, language: str, path: str):
        """Kept hits in catalogue order: (rule, first, last, label, detail, snippet)."""
        language = language.lower()
        lines = code.split("\n")
        out = []
        for r, regex in self.by_language.get(language if language in self.languages else ANY, []):
            if any(re.search(s, path, re.I) for s in r["skip"]):
                continue
            for m in regex.finditer(code):
                first = code.count("\n", 0, m.start()) + 1
                last = code.count("\n", 0, m.end()) + 1 if r["multi_line"] else first
                keep, detail = self._judge(r, m, code, lines, first, last, language)
                if keep:
                    stop = last + r["snippet_extra"] if r["snippet_span"] else first
                    out.append((r["rule_id"], first, last, r["label"], detail, "\n".join(lines[first - 1:stop]).strip()))
        return out

    def violations(self, code, language, path):
        """First hit per rule and span."""
        seen = {}
        for hit in self.hits(code, language, path):
            seen.setdefault(hit[:3], hit)
        return sorted(seen.values())

    @staticmethod
    def _judge(r, m, code, lines, first, last, language):
        def found(words, text):
            return any(re.search(w, text, re.I) for w in words)

        check = r["check"]
        if check in ("window", "glued"):
            if check == "window":
                text = "\n".join(lines[max(0, first - 1 - r["before"]):last + r["after"]])
            else:
                text = ("\n".join(lines[max(0, first - 1 - r["before"]):first]) + lines[first - 1]
                        + "\n".join(lines[first:first + r["after"]]))
            if r["require_words"] and not found(r["require_words"], text):
                return False, None
            if found(r["suppress_words"], text):
                return False, None
            word = next((w for w, *_ in r["detail_words"] if re.search(w, lines[first - 1], re.I)), None)
            return True, word
        if check == "comment":
            before = code[code.rfind("\n", 0, m.start()) + 1:m.start()]
            return ("#" if language == "python" else "//") not in before, None
        if check == "capture":
            flags = re.I if r["drop_flags"] else 0
            return not re.search(r["drop"], m.group(1), flags), m.group(1)
        if check == "cipher":
            line = lines[first - 1].strip()
            if line.startswith("#" if language == "python" else ("//", "/*")):
                return False, None
            near = code[max(0, m.start() - CIPHER_CONTEXT_CHARS):m.end() + CIPHER_CONTEXT_CHARS].lower()
            return not any(w in near for w in CIPHER_CONTEXT_WORDS), None
        if check == "body":
            depth, at = 1, m.end()
            while at < len(code) and depth:
                depth += {"{": 1, "}": -1}.get(code[at], 0)
                at += 1
            body = code[m.end():at]
            caught = ("try" in body and "catch" in body) or ".catch" in body
            return "await" in body and not caught and len(body) > 50, m.group(1) or r["default_detail"]
        return True, None
