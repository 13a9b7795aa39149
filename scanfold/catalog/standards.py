"""Enterprise coding-standards pack."""

from __future__ import annotations

from scanfold.catalog.model import BODY, CAPTURE, COMMENT, WINDOW, Pattern, Rule, pats

# --- Fixed values: STD-001 -------------------------------------------------
# (element, capture regex, convention, regex a valid name satisfies)
NAMING = {
    "python": (
        ("function", r'def\s+([a-z][a-z0-9_]*)\s*\(', "snake_case", r'^[a-z][a-z0-9_]*$'),
        ("class", r'class\s+([A-Z][a-zA-Z0-9]*)\s*[:\(]', "PascalCase", r'^[A-Z][a-zA-Z0-9]*$'),
        ("constant", r'([A-Z][A-Z0-9_]*)\s*=\s*(?!.*class|def)', "SCREAMING_SNAKE_CASE", r'^[A-Z][A-Z0-9_]*$'),
        ("variable", r'^\s*([a-z][a-z0-9_]*)\s*=', "snake_case", r'^[a-z][a-z0-9_]*$'),
    ),
    "javascript": (
        ("function",
         r'(?:function|const|let|var)\s+([a-zA-Z][a-zA-Z0-9]*)\s*(?:=\s*(?:async\s*)?\(?|[\(])',
         "camelCase", r'^[a-z][a-zA-Z0-9]*$'),
        ("class", r'class\s+([A-Z][a-zA-Z0-9]*)', "PascalCase", r'^[A-Z][a-zA-Z0-9]*$'),
        ("constant", r'const\s+([A-Z][A-Z0-9_]*)\s*=', "SCREAMING_SNAKE_CASE", r'^[A-Z][A-Z0-9_]*$'),
    ),
    "typescript": (
        ("function",
         r'(?:function|const|let)\s+([a-zA-Z][a-zA-Z0-9]*)\s*(?:<[^>]*>)?\s*(?:=\s*(?:async\s*)?\(?|[\(])',
         "camelCase", r'^[a-z][a-zA-Z0-9]*$'),
        ("class", r'class\s+([A-Z][a-zA-Z0-9]*)', "PascalCase", r'^[A-Z][a-zA-Z0-9]*$'),
        ("interface", r'interface\s+([A-Z][a-zA-Z0-9]*)', "PascalCase", r'^[A-Z][a-zA-Z0-9]*$'),
        ("type", r'type\s+([A-Z][a-zA-Z0-9]*)\s*=', "PascalCase", r'^[A-Z][a-zA-Z0-9]*$'),
        ("constant", r'const\s+([A-Z][A-Z0-9_]*)\s*=', "SCREAMING_SNAKE_CASE", r'^[A-Z][A-Z0-9_]*$'),
    ),
    "java": (
        ("method", r'(?:public|private|protected|static|\s)+\w+\s+([a-z][a-zA-Z0-9]*)\s*\(', "camelCase",
         r'^[a-z][a-zA-Z0-9]*$'),
        ("class", r'class\s+([A-Z][a-zA-Z0-9]*)', "PascalCase", r'^[A-Z][a-zA-Z0-9]*$'),
        ("constant", r'(?:static\s+final|final\s+static)\s+\w+\s+([A-Z][A-Z0-9_]*)\s*=', "SCREAMING_SNAKE_CASE",
         r'^[A-Z][A-Z0-9_]*$'),
    ),
}
NAMING_IGNORED = ("i", "j", "k", "x", "y", "z", "id", "db", "fs", "os", "_", "__")


def _naming_patterns(language: str) -> tuple[Pattern, ...]:
    """Every capture except the JS/TS function one already implies a valid name."""
    ignored = "^(?:" + "|".join(NAMING_IGNORED) + ")$"
    return tuple(
        Pattern(
            regex, element, drop_re=f"{valid}|{ignored}",
            title=f"{element.capitalize()} name '{{detail}}' violates {convention} convention",
            message=f"The {element} name '{{detail}}' should follow {convention} convention.",
            never_reports=not (element == "function" and language in ("javascript", "typescript")),
        )
        for element, regex, convention, valid in NAMING[language]
    )


NAMING_CONVENTION = Rule(
    rule_id="STD-001",
    name="Naming Convention Violations",
    description="Detects violations of standard naming conventions",
    severity="medium",
    category="standards",
    languages=("python", "javascript", "typescript", "java"),
    references=(
        "https://peps.python.org/pep-0008/#naming-conventions",
        "https://google.github.io/styleguide/tsguide.html#naming-conventions",
    ),
    title="", message="",
    flags="m",
    check=CAPTURE,
    patterns={language: _naming_patterns(language) for language in NAMING},
    pack="enterprise-standards",
)

# --- Fixed values: STD-002 -------------------------------------------------
_CONSOLE = pats(
    (r'console\.log\s*\(', 'console.log'),
    (r'console\.info\s*\(', 'console.info'),
    (r'console\.warn\s*\(', 'console.warn'),
    (r'console\.error\s*\(', 'console.error'),
    (r'console\.debug\s*\(', 'console.debug'),
)
LOGGING = Rule(
    rule_id="STD-002",
    name="Logging Requirements",
    description="Detects console.log usage and missing structured logging",
    severity="medium",
    category="standards",
    languages=("javascript", "typescript", "python"),
    references=(
        "https://12factor.net/logs",
        "https://www.loggly.com/ultimate-guide/node-logging-basics/",
    ),
    title="Avoid {label} in production code",
    message="Using {label} is not recommended in production code. Use a structured logging library instead.",
    flags="m",
    check=COMMENT,
    skip_path=(
        r'\.test\.', r'\.spec\.', r'_test\.', r'test_', r'/tests?/',
        r'__tests__', r'\.config\.', r'webpack\.', r'vite\.', r'jest\.',
    ),
    patterns={
        "javascript": _CONSOLE,
        "typescript": _CONSOLE,
        "python": pats((r'print\s*\(', 'print()')),
    },
    pack="enterprise-standards",
)

# --- Fixed values: STD-003 -------------------------------------------------
_EMPTY_CATCH = pats(
    (r'catch\s*\([^)]*\)\s*\{\s*\}', 'empty catch block'),
    (r'catch\s*\([^)]*\)\s*\{\s*//[^\n]*\s*\}', 'catch with only comment'),
)
_IGNORED_CATCH = pats((r'catch\s*\(\s*_\s*\)\s*\{', 'catch ignoring error with _'))
UNHANDLED_ASYNC = Pattern(
    r'async\s+(?:function\s+)?(\w+)?\s*\([^)]*\)\s*\{', 'unhandled async',
    check=BODY, flags="", detail="anonymous",
    title="Async function '{detail}' may have unhandled rejections",
    message="Async function contains await calls but no try-catch. "
            "Unhandled promise rejections can crash the application.",
)
ERROR_HANDLING = Rule(
    rule_id="STD-003",
    name="Error Handling Violations",
    description="Detects empty catch blocks and swallowed exceptions",
    severity="high",
    category="standards",
    languages=("javascript", "typescript", "python", "java"),
    cwe="CWE-390",
    references=(
        "https://cwe.mitre.org/data/definitions/390.html",
        "https://docs.python.org/3/tutorial/errors.html",
    ),
    title="Improper error handling: {label}",
    message="Detected {label}. Errors should be properly logged or handled, not silently ignored.",
    flags="im",
    check=WINDOW,
    after=2,
    suppress=(r'log', r'throw', r'raise', r'console\.error', r'logger\.', r'logging\.', r'return', r'reject'),
    multi_line=True,
    snippet_span=True,
    snippet_extra=2,
    patterns={
        "javascript": _EMPTY_CATCH + _IGNORED_CATCH + (UNHANDLED_ASYNC,),
        "typescript": _EMPTY_CATCH + _IGNORED_CATCH + (UNHANDLED_ASYNC,),
        "python": pats(
            (r'except\s*:\s*\n\s*pass', 'bare except with pass'),
            (r'except\s+\w+\s*:\s*\n\s*pass', 'except with pass'),
            (r'except[^:]*:\s*\n\s*#[^\n]*\n\s*pass', 'except with only comment'),
            (r'except\s*:', 'bare except (catches all exceptions)'),
        ),
        "java": _EMPTY_CATCH,
    },
    pack="enterprise-standards",
)

RULES = (NAMING_CONVENTION, LOGGING, ERROR_HANDLING)
