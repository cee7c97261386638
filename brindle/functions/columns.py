"""Helpers shared by the function modules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def num(x: Column | str | int | float) -> Column:
    """A column, a column's name, or a constant number."""
    return F.lit(x) if isinstance(x, int | float) else col(x)


def long(x: int | Column) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def chars(x: Column | str) -> Column:
    """The characters of a string; an empty array for an empty string."""
    return F.filter(F.split(col(x), ""), lambda c: c != "")


def total(array: Column) -> Column:
    """The sum of an array of integers, 0 if it is empty."""
    return F.aggregate(array, long(0), lambda a, x: a + x.cast("long"))


def lookup(values: dict) -> Column:
    """A constant map."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
