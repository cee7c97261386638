"""Random values; equal seeds over equal partitions give equal values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ANIMALS = ("ant", "beaver", "cat", "dog", "elephant", "fox", "giraffe", "hedgehog")


def roll_die(seed: int, sides: int = 20) -> Column:
    """1 to sides."""
    return (F.floor(F.rand(seed) * sides) + 1).cast("long")


def wand_energy(seed: int) -> Column:
    """From 0 to below 12."""
    return F.rand(seed) * 12.0


def shuffled_animals(seed: int) -> Column:
    return F.shuffle(F.array(*map(F.lit, ANIMALS)), seed)
