"""A corpus from raw documents: quality, near duplicates, benchmark leaks, privacy, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read back as the next stage's docs. In all stages null and empty texts, null and repeated ids, repeated
rows and texts of any length are taken as they come, whole; an empty table gives an empty one; and all
but the last return the columns they got, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import bpe, decontaminate, neardup, pii, quality
from tidemark.llm.common import stored


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; all of them where the labels are of one kind or none.
    A null text is judged as an empty one; rows with equal texts stay or go together."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the smallest id, null ids last. Null and empty texts are
    one group; rows that only share an id stay apart."""
    return neardup.drop_near_duplicates(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window. Null and empty texts have none; rows with equal texts stay or
    go together; an empty benchmark keeps all."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, n_chars counted anew. No row goes; null texts
    stay null."""
    return pii.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text; a null text counts as an empty one."""
    return bpe.encode_digests(docs, bpe.default_vocabulary())


STAGES = [
    ("quality classifier", good_quality),
    ("near duplicates", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("personal data", without_personal_data),
    ("tokens", tokens),
]

#: The classifier, the SimHash groups, the contexts and the tokens have no SQL; tests compare the
#: stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
