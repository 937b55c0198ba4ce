"""The corpus pipeline: stages over documents, each written and read again.

language -> near duplicates -> personal data -> mixing -> packing.  Every stage
takes what its predecessor kept and, but for the last, returns the columns of
``documents``; see the operators' modules for their defined results on nulls,
empty and long texts, ties and repeated rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusloom.llm import langid, minhash, mixing, packing, pii
from corpusloom.session import cut, free, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of an identified language, ``lang`` set to it."""
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers replaced by their kind in brackets."""
    return pii.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks drawn from the sources by target weight; one row is a document's part in a block."""
    parts = mixing.mix(docs)
    return parts.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def packs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture packed into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixture),
    ("packing", packs),
]

#: Suffix automata, sketches and seeded draws are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each result but the last is written to the shared folder and read again; it
    is removed once the next one is written, the last one when the driver ends.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        free(before)
    return STAGES[-1][1](spark, docs, sf_dir)
