"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import common, decontamination, line_dedup, ngram_join, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, fitted on their labels, predicts to be good.

    Null and empty texts are scored as texts without words, equal texts alike; without labels all stay, since every
    score is one half. Other columns than COLUMNS are left out first, whatever they are called; no rows give none.
    """
    own = docs.select(*COLUMNS)
    model = quality.fit(own, common.table(spark, sf_dir, "labels"))
    return quality.score(own, model).where("predicted = 1").select(*COLUMNS)


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text of every document without repeated windows of three lines; n_chars is counted anew.

    A null text becomes an empty one; rows of one id, or without one, are ordered by a hash of their text, and of equal
    rows the first stays whole. No document goes, though one may be left empty; a very long text is one of its range.
    """
    return line_dedup.deduplicate(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the least id.

    Classes are of texts: rows that share an id or have none stay unless their texts are alike, of equal rows one stays,
    and texts without words (null, empty, left empty by the stage before) are one class.
    """
    return ngram_join.one_of_each(docs.select(*COLUMNS)).select(*COLUMNS)


def _decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item. Null and empty texts hold none; equal texts are judged alike; an empty benchmark leaves all."""
    return decontamination.clean(docs.select(*COLUMNS), common.table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of all documents in sequences: a row for each piece, with its ids and their checksum.

    A null or empty text is its end id alone; rows of one id, or without one, are packed each; no rows give none.
    """
    return packing.pack(docs.select(*COLUMNS)).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", _quality),
    ("line_dedup", _line_dedup),
    ("near_duplicates", _near_duplicates),
    ("decontamination", _decontamination),
    ("packing", _packing),
]

#: The fitted classifier and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents table; what a stage leaves is stored, and removed once the next has stored its own."""
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        got = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            got = common.stored(got)
            if i:
                common.discard(docs)
        docs = got
    return docs
