"""The corpus pipeline: documents through five operators, each on the written result of the one before.

Each stage takes all that its predecessor kept and returns the columns of ``documents`` (the last one the
digests of the token ids). Documents whose language cannot be told go; of every class of near duplicates the
one with the smallest id stays; byte strings that repeat an earlier one are cut out of the texts; documents
that share a window with a benchmark item go; the rest is encoded.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pitspark.llm import byte_bpe, decontaminate, language, minhash, suffixes
from pitspark.session import durable

LEAST_SCORE = 0.5           # of a language to be taken as told

ORACLE_SQL = None           # sampling, a fitted model and BPE are no SQL; tests hold the stages against brute force


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.train(docs.where(~language.held_out(F.col("doc_id"))))
    return language.identified(docs, model, LEAST_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = suffixes.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(docs)


STAGES = [
    ("language identification", tell_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
