"""From raw documents to packed training sequences: five stages, each a call of one operator on what the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm.common import discard, made, table, written
from vellum.llm.compression import without_toxic
from vellum.llm.decontaminate import clean
from vellum.llm.packing import packed
from vellum.llm.simhash import one_row_of_each
from vellum.llm.suffix_array import without_repeats


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be toxic go."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays."""
    return one_row_of_each(docs)


def repeated_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes or more that a document before has go from the text; every document stays."""
    return without_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_substrings", repeated_substrings),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Trained models, suffix arrays and packing aren't SQL: tests/llm/test_pipeline.py compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep.

    Null texts are empty; rows with a null or repeated doc_id are rows of their own; other columns of documents are
    carried to the last stage; an empty table gives an empty result. What a stage wrote is deleted once its result is
    saved, as is that result once the next one is.
    """
    docs, last = table(spark, sf_dir, "documents"), made()
    for name, stage in STAGES[:-1]:
        first = made()
        found = stage(spark, docs, sf_dir)
        stop = made()
        docs = written(found, name)
        discard(spark, last, first)  # the stage before's result
        discard(spark, first, stop)
        last = stop
    return STAGES[-1][1](spark, docs, sf_dir)
