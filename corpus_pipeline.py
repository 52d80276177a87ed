"""Corpus pipeline: documents -> packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet below the shared checkpoint folder and read again as the
next stage's ``docs``. All stages but the last return the columns of
``documents``; each works on all that its predecessor kept.

1. Language ID: texts no language can be given to (null or without a letter)
   are rejected; a null ``lang`` is filled in.
2. SimHash near-dedup: one document of each group stays, the one of the
   smallest id.
3. PII: protected spans are masked, disclosing terms generalised or removed.
4. Mixing: documents are repeated or left out towards the sources' targets.
5. Packing: documents become pieces in sequences of at most 2048 tokens.

An empty table passes through as an empty one; nulls, ties and repeated rows are
handled as the operators' docstrings say, and extra columns are kept.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import langid, mixing, packing, pii, simhash
from tessera.llm.common import documents, materialise
from tessera.session import prepare, ship_package


def _stage(fn):
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        prepare(spark)
        return fn(spark, docs, sf_dir)
    return run_stage


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs)


@_stage
def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, shingle_words=simhash.SHINGLE_WORDS, max_bits=simhash.MAX_BITS)


@_stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs, length_col="n_chars")


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, length_col="n_chars")


@_stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", simhash_near_dedup),
    ("PII", personal_data),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: a trained network and a tokenizer have no SQL form; tests compare each stage with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the rows of the last one."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialise(docs)
    return docs
