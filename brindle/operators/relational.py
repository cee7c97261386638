"""Selection, look-up, aggregation and windows over rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scan, text
from ..functions.arrays import UNITS
from .segments import Position, Segments

BOOKS = "title string, author string, price double, in_stock bigint, ins_seq bigint"


def keep(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows for which the predicate holds; the scan gets it as a filter."""
    return df.filter(predicate)


def discard(df: DataFrame, predicate: Column) -> DataFrame:
    """All other rows, also those for which it is unknown: keep and discard make up df."""
    return df.filter(~predicate | predicate.isNull())


# ---- a store of books, in order of insertion ---------------------------------------------------------------


def new_book_store(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], BOOKS)


def new_book(title: Any, author: Any, price: Any, in_stock: Any) -> tuple:
    """A book of values, or of columns."""
    return title, author, price, in_stock


def add_books(store: DataFrame, books: list[tuple] | DataFrame, order: list[str] | None = None) -> DataFrame:
    """The store with books behind its last one; repeated ones are kept.

    Books are tuples, or rows with the columns title, author, price and in_stock, which are added as ``order`` says.
    """
    last = store.agg(F.coalesce(F.max("ins_seq"), F.lit(-1))).first()[0]
    if isinstance(books, DataFrame):
        rows = positions(books.withColumn("__all", F.lit(0)), "__all", order or books.columns, "ins_seq")
        return store.unionByName(rows.select("title", "author", F.col("price").cast("double").alias("price"), F.col("in_stock").cast("long").alias("in_stock"), (F.col("ins_seq") + last + 1).alias("ins_seq")))
    return store.unionByName(store.sparkSession.createDataFrame([(*b, last + 1 + i) for i, b in enumerate(books)], BOOKS))


def find_first(df: DataFrame, condition: Column, order: str) -> DataFrame:
    """The first row in order for which the condition holds, or none: the least row of each task, then of all."""
    return df.filter(condition).orderBy(order).limit(1)


def find_containing(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose text has the pattern in it; the scan gets it as a filter."""
    return df.filter(F.col(column).contains(pattern))


def inventory_value(df: DataFrame, price: str, quantity: str, by: list[str] | None = None) -> DataFrame:
    """Sum of price times quantity in decimals, so that the order of rows doesn't matter; 0 for none."""
    value = F.sum(F.col(price).cast("decimal(18,2)") * F.col(quantity)).cast("decimal(38,2)")
    return df.groupBy(*(by or [])).agg(F.coalesce(value, F.lit(0)).cast("decimal(38,2)").alias("value"))


def sell(df: DataFrame, sales: DataFrame, key: str, stock: str) -> DataFrame:
    """Stock after sales of one each: sold while there is any, the rest rejected."""
    asked = sales.groupBy(key).agg(F.count("*").alias("__asked"))
    zero = F.lit(0).cast("long")
    sold = F.least(F.greatest(F.col(stock), zero), F.coalesce("__asked", zero))
    return df.join(asked, key, "left").select(*[c for c in df.columns if c != stock], (F.col(stock) - sold).alias(stock), sold.alias("sold"), (F.coalesce("__asked", zero) - sold).alias("rejected"))


# ---- counts ---------------------------------------------------------------------------------------------------


#: Bytes of text that are scanned at once.
PIECE = 4 << 20


def _part_counts(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """(by, __part, __n): how often each distinct part, as ASCII white space and punctuation cut it, is in a piece of text.

    With ``by`` a piece counts each row on its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(len(by))), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            for piece in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(sizes // PIECE)) + 1):
                if not len(piece):
                    continue
                rows = batch.slice(int(piece[0]), len(piece))
                found, row = scan.parts(rows.column(len(by)))
                words = found.dictionary
                if by:
                    size = max(1, len(words))
                    key, n = np.unique(row * size + found.indices.to_numpy(), return_counts=True)
                    out = [rows.column(i).take(pa.array(key // size)) for i in range(len(by))] + [words.take(pa.array(key % size))]
                else:
                    n, out = np.bincount(found.indices.to_numpy(), minlength=len(words)), [words]
                yield pa.RecordBatch.from_arrays([*out[:-1], out[-1].cast(pa.string()), pa.array(n.astype(np.int64))], names=[*by, "__part", "__n"])

    low = df.select(*by, F.lower(column).alias("__text"))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in low.schema.fields[:-1])
    return low.mapInArrow(run, f"{fields}__part string, __n bigint")


def word_counts(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Occurrences of each word in ``n``.

    Tasks scan the bytes of whole texts for ASCII cuts and pass on distinct parts with their counts.  Only these are cut
    at the other white space and punctuation and cleaned, and what becomes the same word is added up.
    """
    by = by or []
    counted = _part_counts(df, column, by).groupBy(*by, "__part").agg(F.sum("__n").alias("__n"))
    parts = counted.select(*by, F.explode(text.word_parts("__part")).alias("__part"), "__n")
    words = parts.select(*by, text.clean_word("__part").alias("word"), "__n").where(F.col("word") != "")
    return words.groupBy(*by, "word").agg(F.sum("__n").alias("n"))


#: Words of an anagram class that are stored in one row, on average.
CLASS_BLOCK = 256


def anagram_classes(words: DataFrame, column: str = "word", block: int = CLASS_BLOCK) -> DataFrame:
    """Words of the same letters: (letters, block, words, members, pairs), large classes in several rows.

    ``pairs`` counts the ordered pairs of different words of the whole class; spellings that differ in case alone are
    the same word and make none.  Words without an anagram are in no class; repeated words count once.
    """
    keyed = words.select(F.col(column).alias("word"), F.lower(column).alias("low"), text.sort_letters(F.lower(column)).alias("letters")).where("word is not null").distinct()
    spelled = keyed.groupBy("letters", "low").agg(F.count("*").alias("n"))
    sizes = spelled.groupBy("letters").agg(F.sum("n").alias("members"), (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))).alias("pairs")).where("pairs > 0")
    dealt = keyed.join(sizes, "letters").withColumn("block", F.pmod(F.xxhash64("word"), F.ceil(F.col("members") / block)).cast("int"))
    return dealt.groupBy("letters", "block", "members", "pairs").agg(F.array_sort(F.collect_list("word")).alias("words")).select("letters", "block", "words", "members", "pairs")


def anagram_pairs(words: DataFrame, column: str = "word", block: int = CLASS_BLOCK) -> DataFrame:
    """All pairs (word, other) of different words of the same letters: each block of a class with each other one."""
    classes = anagram_classes(words, column, block).select("letters", "words")
    pairs = classes.join(classes.select("letters", F.col("words").alias("others")), "letters")
    return pairs.select(F.explode("words").alias("word"), "others").select("word", F.explode("others").alias("other")).where(F.lower("word") != F.lower("other"))


def total_by(df: DataFrame, key: str, value: str, scale: str = "decimal(18,2)") -> DataFrame:
    return df.groupBy(key).agg(F.coalesce(F.sum(F.col(value).cast(scale)), F.lit(0)).cast("decimal(28,2)").alias("total"))


def invert_map(df: DataFrame, key: str, values: str) -> DataFrame:
    """(letter, score) from rows of a score and an array of letters; the highest score of a letter counts."""
    return df.select(F.col(key).alias("score"), F.explode(values).alias("letter")).groupBy(F.lower("letter").alias("letter")).agg(F.max("score").alias("score"))


# ---- windows by position -----------------------------------------------------------------------------------------


def positions(df: DataFrame, key: str, order: list[str], name: str = "position") -> DataFrame:
    """Row number from 0 within each key, as the column ``name``; a key's rows may span any number of tasks."""
    return Segments(df, [key], order).scan(Position(name))


def tumbling_totals(df: DataFrame, key: str, order: list[str], value: str, size: int = 7) -> DataFrame:
    """Sums of each whole run of ``size`` rows of a key; an unfinished run is left out."""
    run = positions(df.select(key, *order, F.col(value).cast("decimal(18,2)").alias("__v")), key, order, "__position")
    week = F.expr(f"__position div {size} + 1").cast("long").alias("week")
    return run.groupBy(key, week).agg(F.sum("__v").cast("decimal(28,2)").alias("total"), F.count("*").alias("__n")).where(F.col("__n") == size).drop("__n")


def fix_alternate(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """One more on the first and every second row of a key."""
    return positions(df, key, order, "__position").withColumn(value, F.col(value) + F.when(F.col("__position") % 2 == 0, 1).otherwise(0)).drop("__position")


def units_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UNITS.items()), "unit string, quantity bigint")


def bill_totals(items: DataFrame, item: str = "item", unit: str = "unit") -> DataFrame:
    """Quantities by item; rows with an unknown unit are left out."""
    known = F.broadcast(units_table(items.sparkSession))  # six rows
    return items.join(known, items[unit] == known["unit"]).groupBy(items[item].alias("item")).agg(F.sum("quantity").alias("quantity"))


def unknown_units(items: DataFrame, unit: str = "unit") -> DataFrame:
    known = F.broadcast(units_table(items.sparkSession))
    return items.join(known, items[unit] == known["unit"], "left_anti")
