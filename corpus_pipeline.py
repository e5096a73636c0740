"""The corpus pipeline: language ID, line dedup, near-dedup, mixing, tokenizer.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents. No stage needs SQL: three of them have no SQL form, so ``ORACLE_SQL`` is
None and the tests hold the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import byte_bpe, language_id, line_dedup, mixing, near_dedup
from textloom.llm.common import documents, written

ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay and ``lang`` becomes that language; those without a letter or text, and those that no
    learned language explains (``language_id.limits``), go. Without a labelled text all with a letter stay, ``lang`` as given."""
    return language_id.identified(docs, language_id.train(docs))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more found in 5 documents or more stay in the largest id only; ``n_chars`` follows the text."""
    from pyspark.sql import functions as F

    out = line_dedup.drop_repeated_lines(docs).drop("line_dedup")
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of five words, similarity 0.8 or more."""
    return near_dedup.representatives(docs, size=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as often as it is taken."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of the whole text, n_tokens, and whether decoding gives the text back."""
    return byte_bpe.encoded_and_checked(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
