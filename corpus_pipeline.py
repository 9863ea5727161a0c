"""From raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on all rows that it is given
and returns a DataFrame, which is written and read again as the next one's
input.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import language, mixing, packing, quality, similarity
from strandline.llm.workspace import Workspace

#: Least lead of a document's language over the next one for it to stay.
LEAD = 0.1
#: Least probability that a document is good for it to stay.
KEEP_QUALITY = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter and those between two languages go."""
    return language.clear(docs, language.train(docs), LEAD)


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are more likely bad than good go."""
    return quality.good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), KEEP_QUALITY)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of 5-word shingles overlap by 0.8 or more one stays."""
    return similarity.one_of_each(docs, words=5, threshold=Fraction(8, 10))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it, in training order."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs, length=2048, end_id=1)


STAGES = [
    ("language", identify_language),
    ("quality", judge_quality),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]

#: SQL cannot fit classifiers or encode tokens; tests hold stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    space = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, space.save(stage(spark, docs, sf_dir), name)
        space.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
