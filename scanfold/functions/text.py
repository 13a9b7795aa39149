"""Small Column builders used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?U)\A{_SPACE}+|{_SPACE}+\z", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def line_range(lines: Column, first: Column, last: Column) -> Column:
    """Lines first..last (1-based, clipped to the text) joined by newlines."""
    start = F.greatest(F.lit(1), first)
    stop = F.least(F.size(lines), last)
    return F.array_join(F.slice(lines, start, F.greatest(F.lit(0), stop - start + 1)), "\n")


def occurrences(text: Column, char: Column) -> Column:
    """How often a single character occurs."""
    return F.length(text) - F.length(F.replace(text, char, F.lit("")))


def before_first(text: Column, delimiter: Column) -> Column:
    """Text before the first delimiter (all of it when there is none)."""
    return F.call_function("substring_index", text, delimiter, F.lit(1))


def newlines(text: Column) -> Column:
    return occurrences(text, F.lit("\n"))


def count_up(size: Column) -> Column:
    """0, 1, ... size - 1; empty for a size of 0 or less."""
    return F.when(size > 0, F.sequence(F.lit(0), F.greatest(size.cast("int"), F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>"))


def running(values: Column, fold, join) -> Column:
    """For each position of an array, the fold of all values before it.

    Blocks of about the root of the length keep the work near n * sqrt(n), and
    nothing grows step by step. ``fold`` gives the neutral value for an empty array.
    """
    def whole(v: Column) -> Column:
        block = F.greatest(F.ceil(F.sqrt(F.size(v))).cast("int"), F.lit(1))
        return let(block, lambda b: let(
            F.transform(count_up(F.ceil(F.size(v) / b)), lambda k: fold(F.slice(v, k * b + 1, b))),
            lambda folded: let(
                F.transform(count_up(F.size(folded)), lambda k: fold(F.slice(folded, F.lit(1), k))),
                lambda heads: F.transform(count_up(F.size(v)), lambda i: join(
                    F.get(heads, F.floor(i / b).cast("int")),
                    fold(F.slice(v, F.floor(i / b).cast("int") * b + 1, i % b)))))))
    return let(values, whole)


def prefix_sums(values: Column) -> Column:
    """[0, v1, v1+v2, ...]: running totals before each element."""
    return running(values, lambda v: F.aggregate(v, F.lit(0), lambda a, x: (a + x).cast("int")), lambda a, b: (a + b).cast("int"))


def prefix_minima(values: Column) -> Column:
    """Smallest of 0 and the values before each element."""
    return running(values, lambda v: F.least(F.coalesce(F.array_min(v), F.lit(0)), F.lit(0)), F.least)
