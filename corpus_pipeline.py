"""Training-text pipeline: five stages over whole documents.

Each stage takes what its predecessor kept; all but the last return the columns
of ``documents``. ``run`` writes every stage's result to the shared folder and
reads it back, so that a lost executor costs one stage at most; what a stage has
written on its way, and the result before it, are deleted once the next is there.
The pipeline is an application of its own: its stages set the session's batches for
Python to a size that fits whole texts, unless the session names one.

All stages take any table with the columns of ``documents``, extra columns of any
name included, null and repeated ids, repeated rows, texts of any length and
tables without a row; an empty table gives an empty result. What a stage does with
null and empty texts and with ties is said at each.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from factloom.llm.common import new_path, remove, small_batches, table, written
from factloom.llm.decontamination import drop_contaminated
from factloom.llm.language_id import drop_unknown_language
from factloom.llm.packing import pack_documents
from factloom.llm.pii import pseudonymize_text, session_key
from factloom.llm.simhash import drop_near_duplicates


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which some language can be recognised. Null and empty texts and
    others without a letter go; a tie between languages drops nothing."""
    small_batches(spark)
    return drop_unknown_language(docs)


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the smallest id, then the least
    text hash, then the row that is least as JSON. Null and empty texts would be one
    group, though none reaches this stage of ``run``."""
    small_batches(spark)
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text. Null and empty
    texts have no words and stay; just a twentieth is too much."""
    small_batches(spark)
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by pseudonyms of the same format,
    under the session's key. Null and empty texts stay as they are; equal values get
    equal pseudonyms."""
    return pseudonymize_text(docs, session_key(spark))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document, with its place in a sequence. A null or
    empty text is the one piece of its end id; equal pieces are interchangeable."""
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash", simhash),
    ("decontamination", decontamination),
    ("pii", pii),
    ("packing", packing),
]

#: Language models, fingerprints and tokenizers can't be written in SQL; the
#: stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, others = table(spark, sf_dir, "documents"), set(written(spark))
    for name, stage in STAGES[:-1]:
        kept, path = stage(spark, docs, sf_dir), new_path(spark, name)
        schema = kept.schema
        kept.write.parquet(path)
        docs = spark.read.schema(schema).parquet(path)
        for used in set(written(spark)) - others - {path}:
            remove(spark, used)
    return STAGES[-1][1](spark, docs, sf_dir)
