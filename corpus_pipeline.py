"""A corpus from documents to packed sequences, in five stages, each over all that its predecessor kept.

All stages take nulls in any column, texts of any length and rows that repeat; columns beside doc_id, text, lang, source
and n_chars come back as they were, whatever their names. Of an empty table each makes an empty one.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkloom.llm import langid, linededup, mixing, packing, simhash
from sparkloom.llm.common import documents
from sparkloom.operators.scratch import settled


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model does not reject; texts that are null or have no letter go. Repeated rows
    are kept or go together."""
    return langid.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that a document of a smaller doc_id holds; n_chars follows. All rows stay, with an empty
    text where all its lines went; rows without doc_id count as the last document."""
    return linededup.without_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, the one with the smallest doc_id; null and empty texts are copies of
    each other. Rows without doc_id all stay."""
    return simhash.one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each epoch of each document that the mix takes; documents without words are not taken, and a null
    source is one like any other."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, in sequences; a null text is an empty one, and each of several rows of a doc_id is
    packed."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash_dedup", near_duplicates), ("mixing", mixture), ("packing", packed)]

#: Packing needs a tokenizer, and language ID a trained model, which SQL has not; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's rows written and read again; what a stage wrote meanwhile, and its input,
    are deleted when its rows are written."""
    docs, held = documents(spark, sf_dir), []
    for _, stage in STAGES[:-1]:
        docs = settled(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), *held)
        held = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
