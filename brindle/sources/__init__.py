"""Tables: Parquet inputs by name, small constant ones, and Parquet or console output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import GREETINGS
from ..operators.relational import add_books, new_book, new_book_store


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table; any path that Spark can read."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replace the Parquet table at path."""
    (df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")).parquet(path)


def demo_books(spark: SparkSession) -> DataFrame:
    """The three books of the demonstration."""
    books = [("The Go Programming Language", "Alan A. A. Donovan", 39.99, 5), ("Learning Go", "Jon Bodner", 29.99, 3), ("Introducing Go", "Caleb Doxsey", 24.99, 2)]
    return add_books(new_book_store(spark), [new_book(*b) for b in books])


def greeters(spark: SparkSession) -> DataFrame:
    """(language, template)."""
    return spark.createDataFrame(list(GREETINGS.items()), "language string, template string")
