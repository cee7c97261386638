"""A training-corpus pipeline over ``documents``, one operator after the other.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of ``documents``:

1. language: texts that are in no language the labels know go;
2. lines: repeated lines, fuzzy ones included, stay at their first occurrence;
3. near_duplicates: of each group of near-duplicate documents the one with the
   least id stays (five-word shingles, similarity 0.8);
4. decontamination: documents that share ten words in a row with ``benchmark`` go;
5. packing: the rest is packed into training sequences, one row per piece.

Nulls and empty texts go in the first stage, as they are in no language; a null
id is allowed: its row is neither compared with others nor removed for copies of
others.  Very long texts are worked on whole.  Of ties (equal lines, equal
documents) the one of the least id stays; repeated rows share one fate.  Further
columns are kept by all stages but the last, whatever their names.  Empty tables
give an empty result; an empty benchmark removes nothing, and without labels no
language is known and nothing is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontam, language, lines, neardup, packing
from brindle.llm.workspace import Workspace


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_known_languages(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_repeated_lines(docs, flips=None)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language", keep_languages),
    ("lines", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The fitted language model and the tokenizer are beyond SQL; tests compare stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole of ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = space.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
