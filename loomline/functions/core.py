"""Small building blocks of column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def unlines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def words(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def indexes(array: Column) -> Column:
    """1 ... size, or an empty array."""
    return F.when(F.size(array) > 0, F.sequence(F.lit(1), F.size(array))).otherwise(F.array().cast("array<int>"))


def any_of(predicates: Iterable[Column]) -> Column:
    out = F.lit(False)
    for p in predicates:
        out = out | p
    return out


def sha16(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)
