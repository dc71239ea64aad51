"""The corpus pipeline: language ID, exact dedup, SimHash near-dedup, mixing, packing.

Each stage takes what the stage before kept. All but the last return the columns of documents; the last returns the
pieces of the packed sequences.

Defined cases are those of the stages: null and empty texts have no language and go in the first; very long texts are
taken whole; repeated rows become one in the second; a null doc_id is kept like any other; an empty table gives an empty
result; other columns, whatever their names, come along to the end of the fourth stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sightline.llm import common, exact_dedup, language_id, mixing, packing, simhash


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without letters, and those torn between languages, go."""
    return language_id.keep_known(docs)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, cut where a source's target ends."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens in sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify),
    ("exact_dedup", dedup_exact),
    ("simhash_near_dedup", dedup_near),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]
#: Language scores, hashes of word shingles and token ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
