"""Tables that loops would fill."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.columns import col


def sieve(spark: SparkSession, limit: int) -> DataFrame:
    """Primes up to limit, ascending in ``prime``: numbers without those that a smaller factor generates."""
    if limit < 2:
        return spark.createDataFrame([], "prime long")
    numbers = spark.range(2, limit + 1).select(F.col("id").alias("prime"))
    factors = spark.range(2, math.isqrt(limit) + 1).select(F.col("id").alias("p"))
    composite = factors.select(F.explode(F.sequence(F.col("p") * F.col("p"), F.lit(limit).cast("long"), F.col("p"))).alias("prime")).distinct()
    return numbers.join(composite, "prime", "left_anti")


def primes_among(df: DataFrame, column: str) -> DataFrame:
    """The rows whose number is a prime: a sieve up to the largest one, joined by number."""
    most = df.agg(F.max(column)).first()[0]
    primes = sieve(df.sparkSession, int(most or 0)).withColumnRenamed("prime", "__prime")
    return df.join(primes, F.col(column) == F.col("__prime"), "left_semi")


def fizz_buzz_lines(df: DataFrame, column: str, name: str = "line") -> DataFrame:
    """df with the line of each number; NULL below 1."""
    return df.withColumn(name, F.when(F.col(column) > 0, text.fizz_buzz_line(column)))


def guesses(target: Column | str, seed: Column | str, low: int = 1, high: int = 100) -> Column:
    """The guesses of a random bisection up to the target, in order; NULL for a target that isn't from low to high.

    The n-th guess takes its place in what is left from a hash of the seed and n, so equal seeds guess alike.
    """
    target, number = col(target).cast("long"), lambda x: F.lit(x).cast("long")
    state = F.struct(number(low).alias("low"), number(high).alias("high"), F.array().cast("array<bigint>").alias("made"))

    def step(s: Column, n: Column) -> Column:
        guess = s["low"] + F.pmod(F.xxhash64(col(seed), n), F.greatest(s["high"] - s["low"] + 1, number(1)))
        open_ = s["low"] <= s["high"]
        after = F.struct(F.when(guess < target, guess + 1).when(guess == target, s["high"] + 1).otherwise(s["low"]).alias("low"), F.when(guess > target, guess - 1).otherwise(s["high"]).alias("high"), F.array_append(s["made"], guess).alias("made"))
        return F.when(open_, after).otherwise(s)

    made = F.aggregate(F.sequence(F.lit(1), F.lit(high - low + 1)), state, step)["made"]
    return F.when(target.between(low, high), made)


def guess_trace(target: int, seed: int, low: int = 1, high: int = 100) -> list[int]:
    """Guesses of a random bisection up to the target, which must be from low to high."""
    import random

    if not low <= target <= high:
        raise ValueError(f"must be from {low} to {high}")
    rnd, out = random.Random(seed), []
    while not out or out[-1] != target:
        out.append(rnd.randint(low, high))
        low, high = (out[-1] + 1, high) if out[-1] < target else (low, out[-1] - 1)
    return out
