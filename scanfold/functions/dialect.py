"""Regex dialect: one source pattern, spelled for the JVM, plus its literal gate.

Patterns are written in Python syntax.  The JVM spelling switches on Unicode
classes and newline-only line ends, and widens ``\\s`` by the four control
characters Python counts as white space.

The gate is a set of lower-case literals of which every matching text holds at
least one.  ``contains`` is about ten times cheaper than a regex search, so the
scan asks the gate first.  It never decides a hit, it only skips texts that
cannot have one.
"""

from __future__ import annotations

import re
from functools import lru_cache
from re import _constants as _op
from re import _parser

_EXTRA_SPACE = r"\x1c-\x1f"

# Characters that fold to an ASCII letter without lower-casing to it; texts
# holding one bypass the gate.
FOLDING_CHARS = ("ſ", "İ", "ı", "K")


_UP_TO = re.compile(r"\{,\d+\}")
#: Syntax the JVM has nothing for: conditions on a group, and flags of the character set.
_UNKNOWN = re.compile(r"\(\?(?:\(|[aiLmsux]*[aLu])")


def _jvm_name(name: str) -> str:
    """A group name of letters and digits only."""
    return re.sub("[^A-Za-z0-9]", lambda m: f"x{ord(m[0]):x}x", f"g{name}")


@lru_cache(maxsize=4096)
def to_jvm(regex: str, flags: str = "", ascii_only: bool = False) -> str:
    """JVM spelling.  ``ascii_only`` gives the cheaper spelling for texts known to be ASCII."""
    out, in_class, i = [], False, 0
    while i < len(regex):
        c = regex[i]
        if c == "\\" and i + 1 < len(regex):
            pair = regex[i:i + 2]
            if pair == r"\s":
                out.append(r"\s" + _EXTRA_SPACE if in_class else r"[\s" + _EXTRA_SPACE + "]")
            elif pair == r"\Z" and not in_class:
                out.append(r"\z")
            elif pair == r"\U":
                out.append(r"\x{" + regex[i + 2:i + 10].lstrip("0").rjust(1, "0") + "}")
                i += 8
            else:
                out.append(pair)
            i += 2
            continue
        if c == "[":
            out.append(r"\[" if in_class else "[")
            in_class = True
        elif c == "]" and in_class:
            in_class = False
            out.append(c)
        elif c == "&" and in_class:
            out.append(r"\&")
        elif regex.startswith("(?P", i) and regex[i + 3:i + 4] in ("<", "=") and not in_class:
            end = regex.index(">" if regex[i + 3] == "<" else ")", i)
            name = _jvm_name(regex[i + 4:end])
            out.append(f"(?<{name}>" if regex[i + 3] == "<" else rf"\k<{name}>")
            i = end + 1
            continue
        elif not in_class and _UP_TO.match(regex, i):
            out.append("{0")
        else:
            out.append(c)
        i += 1
    return f"(?d{'' if ascii_only else 'U'}{flags})" + "".join(out)


def any_of(regexes, flags: str = "", ascii_only: bool = False) -> str:
    """One alternation, for checks where only existence matters."""
    if not regexes:
        return ""
    return to_jvm("|".join(regexes), flags, ascii_only)


def any_gate(regexes) -> list[str]:
    """Literals, one of which occurs wherever any of the regexes matches; [] if none is certain."""
    gates = [literal_gate(r) for r in regexes]
    return list(dict.fromkeys(g for gate in gates for g in gate)) if all(gates) else []


def _weight(gate) -> int:
    return min(map(len, gate)) if gate else 0


def _gate_of(items) -> tuple[str, ...]:
    """Best required any-of literal set of a parsed sequence."""
    best: tuple[str, ...] = ()
    run: list[str] = []

    def offer(gate):
        nonlocal best
        if _weight(gate) > _weight(best):
            best = tuple(gate)

    def flush():
        if run:
            offer(("".join(run),))
        run.clear()

    for op, arg in items:
        if op is _op.LITERAL:
            run.append(chr(arg).lower())
            continue
        flush()
        if op is _op.SUBPATTERN:
            offer(_gate_of(arg[-1]))
        elif op in (_op.MAX_REPEAT, _op.MIN_REPEAT, _op.POSSESSIVE_REPEAT) and arg[0] >= 1:
            offer(_gate_of(arg[-1]))
        elif op is _op.BRANCH:
            gates = [_gate_of(branch) for branch in arg[1]]
            if all(gates):
                offer(tuple(dict.fromkeys(x for g in gates for x in g)))
    flush()
    return best


@lru_cache(maxsize=4096)
def _literal_gate(regex: str) -> tuple[str, ...]:
    gate = _gate_of(_parser.parse(regex))
    return gate if all(g.isascii() for g in gate) else ()


def literal_gate(regex: str) -> list[str]:
    """Lower-case literals, one of which occurs in every match; [] if none is certain."""
    return list(_literal_gate(regex))


def pattern_error(regex: str | None) -> str | None:
    """Why a user pattern cannot be used, or None."""
    if not regex:
        return "empty pattern"
    try:
        re.compile(regex)
    except (re.error, OverflowError) as exc:
        return f"invalid pattern: {exc}"
    bare = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", regex, flags=re.S)       # without escapes and classes
    if found := _UNKNOWN.search(bare):
        return f"not supported: {found[0]}"
    return None
