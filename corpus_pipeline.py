"""A training corpus out of raw documents: each stage's decisions take effect on what the one before has kept.

Stages are functions of (session, documents, folder of the tables) and return a DataFrame, which is written as Parquet
and read again as the next one's documents. All but the last return the columns of ``documents``.

Edge cases: null and empty texts are clean, have no lines to lose, are near duplicates of each other (one stays) and hit
nothing; texts of any length are read whole; of rows that are equal, and of rows under one id with similar texts, one
stays; ids of null are kept like others; without labels nothing is toxic, without a benchmark nothing is contaminated;
a table without rows gives none; columns of any name pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import bpe, decontaminate, lines, shingles, toxicity
from quillstream.llm.common import discard, saved, table
from quillstream.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.drop_similar_lines(docs, length="n_chars")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.keep_one_of_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.token_digests(docs, tokenizer_path(), ["doc_id"])


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", tokenize),
]

#: SQL expresses neither the trained model nor the tokenizer; the tests hold every stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if hasattr(before, "saved_at"):  # what the stage before had written is not read any more
            discard(before)
    return docs
