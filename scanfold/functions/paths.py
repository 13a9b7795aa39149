"""Paths, extensions, languages and globs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: extension -> language, supported extensions --------------
LANGUAGE_BY_EXTENSION = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "py": "python",
    "java": "java", "go": "go", "rb": "ruby", "rs": "rust", "cpp": "cpp", "c": "c", "cs": "csharp",
    "php": "php", "swift": "swift", "kt": "kotlin",
}
SUPPORTED_EXTENSIONS = (
    ".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".go", ".rb", ".rs", ".cpp", ".c", ".cs", ".php",
    ".swift", ".kt",
)


def extension(path: Column) -> Column:
    """Text after the last dot, lower-cased; the whole name when there is no dot."""
    return F.lower(F.substring_index(path, ".", -1))


def detect_language(path: Column) -> Column:
    ext = extension(path)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGE_BY_EXTENSION.items() for x in pair])
    return F.coalesce(known[ext], ext)


def is_supported(path: Column) -> Column:
    """Case-sensitive on purpose, as the extension list is."""
    alternatives = "|".join(e[1:] for e in SUPPORTED_EXTENSIONS)
    return path.rlike(rf"\.({alternatives})\z")


def glob_to_regex(glob: Column) -> Column:
    """``**`` crosses directories, ``*`` and ``?`` do not; ``**/`` also matches no directory."""
    quoted = F.regexp_replace(glob, r"([.+^$(){}\[\]|\\])", r"\\$1")
    marked = F.replace(F.replace(quoted, F.lit("**/"), F.lit("\u0001")), F.lit("**"), F.lit("\u0002"))
    single = F.replace(F.replace(marked, F.lit("*"), F.lit("[^/]*")), F.lit("?"), F.lit("[^/]"))
    full = F.replace(F.replace(single, F.lit("\u0001"), F.lit("(?:.*/)?")), F.lit("\u0002"), F.lit(".*"))
    return F.concat(F.lit("(?s)^"), full, F.lit("$"))


def matches_any_glob(path: Column, globs: Column) -> Column:
    """A glob without a slash is matched against the file name, others against the whole path."""
    name = F.substring_index(path, "/", -1)
    return F.exists(globs, lambda g: F.rlike(
        F.when(F.contains(g, F.lit("/")), path).otherwise(name), glob_to_regex(g)))
