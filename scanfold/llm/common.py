"""Column helpers the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII blanks that separate words, and the same as a set for a regex.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words between ASCII blanks, in order; none for a null text."""
    whole = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return let(whole, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK_RUN)))


def count_up(size: Column) -> Column:
    """0, 1, ... size - 1; empty for a size of 0 or less."""
    return F.when(size > 0, F.sequence(F.lit(0), F.greatest(size.cast("int"), F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>"))


def running(values: Column, fold: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Column:
    """For each position of an array, the fold over all values before it.

    Blocks of about the root of the length keep the work near n * sqrt(n)
    without an accumulator that grows. ``fold`` must give the neutral value for
    an empty array.
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


def running_sums(values: Column) -> Column:
    """Sum of the values before each position."""
    return running(values, total, lambda a, b: a + b)


def running_maxima(values: Column) -> Column:
    """Largest of the values before each position; 0 where there is none larger."""
    return running(values, lambda v: F.coalesce(F.array_max(v).cast("bigint"), F.lit(0).cast("bigint")), F.greatest)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the input doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
