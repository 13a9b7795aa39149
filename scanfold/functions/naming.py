"""Suggested names: snake, Pascal, SCREAMING and camel case."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TYPE_LIKE = ("class", "interface", "type")


def _capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.left(word, F.lit(1))), F.lower(F.substring(word, 2, 1_000_000)))


def _words(name: Column) -> Column:
    return F.split(name, r"[_\s]+")


def pascal(name: Column) -> Column:
    return F.array_join(F.transform(_words(name), _capitalized), "")


def camel(name: Column) -> Column:
    """The first word goes fully lower case, so ``ProcessData`` becomes ``processdata``."""
    words = _words(name)
    rest = F.transform(F.slice(words, 2, F.size(words)), _capitalized)
    return F.concat(F.lower(F.element_at(words, 1)), F.array_join(rest, ""))


def _underscored(name: Column) -> Column:
    return F.regexp_replace(name, "([A-Z])", "_$1")


def snake(name: Column) -> Column:
    return F.ltrim(F.lower(_underscored(name)), F.lit("_"))


def screaming(name: Column) -> Column:
    return F.ltrim(F.upper(_underscored(name)), F.lit("_"))


def suggestion(name: Column, element: Column, language: Column) -> Column:
    fixed = (F.when((language == "python") & (element == "class"), pascal(name))
             .when(language == "python", snake(name))
             .when(element.isin(list(TYPE_LIKE)), pascal(name))
             .when(element == "constant", screaming(name))
             .otherwise(camel(name)))
    return F.concat(F.lit("Rename to: "), fixed)
