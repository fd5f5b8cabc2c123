"""A corpus from raw documents to packed sequences: five stages, each written and read again.

Every stage takes whole tables: null and empty texts, texts of any length, repeated rows, null ids, ties,
empty tables and further columns of any name, which all stages but the last carry along unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.llm import mixing, near_dedup, packing, pii, quality_classifier
from tracelode.llm.common import discard, materialize, table

#: SQL can't express the learnt stages; tests hold each against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts; every row is judged on its own text.

    A null or empty text is judged as one without words; repeated rows get the same verdict each;
    without trusted documents among the labels all score one half and stay.
    """
    trusted = quality_classifier.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, trusted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of the smallest id.

    Rows that repeat id and text are one document. Texts without words are near nothing and stay;
    rows without an id stay, and join what they resemble to one group.
    """
    return near_dedup.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, personal data replaced by its kind; null texts stay null, ``n_chars`` follows the text."""
    return pii.mask_pii(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's budget takes them, the last cut at the exact word.

    A null source is a source; texts without words are in no mix; rows alike in source, id and size
    share what their group takes, row by row.
    """
    return mixing.apply_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of every row with their place in sequences of 4096; each copy of a document is packed."""
    return packing.pack_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mix_sources", mix_sources), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read is deleted when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        read, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(read)
    out = STAGES[-1][1](spark, docs, sf_dir).withColumn("round", F.col("round").cast("long"))
    discard(docs)  # its pieces are written
    return out
