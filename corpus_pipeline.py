"""A corpus pipeline of the operators of ``corpusaudit.llm``: from raw documents to packed sequences."""

from pyspark.sql import DataFrame, SparkSession

from corpusaudit.llm import decontamination, jaccard, language, packing, suffixes
from corpusaudit.llm.queries import CAPACITY, END_ID, byte_ranks, vocabulary
from corpusaudit.session import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told, learned from the stated languages of all of them."""
    return language.identified(docs, language.fit(docs))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the least id."""
    return jaccard.one_of_each(docs, 0.8)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 bytes or more that an earlier one has."""
    return suffixes.without_repeats(docs, 50, length="n_chars")


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, each with its sequence and its place there."""
    return packing.packed_documents(docs, vocabulary("byte_bpe_50k.json"), END_ID, CAPACITY, **byte_ranks())


STAGES = [
    ("language", known_language),
    ("near copies", one_of_near_copies),
    ("repeated passages", without_repeated_passages),
    ("benchmark", without_benchmark),
    ("packing", packed),
]

#: Fitted classifiers, shingles and token ids are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; each is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
