"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, html, licenses, lines, runs, secrets, sigtrees, simhash, topk, toxicity, treaps, urls
from .common import table


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(spark, sf_dir)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.page_texts(spark, sf_dir)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_documents(spark, sf_dir)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_path(), ["doc_id"])


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(spark, sf_dir)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(spark, sf_dir)


def op8_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.deduplicated_lines(spark, sf_dir)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_documents(spark, sf_dir)


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_pages(spark, sf_dir)


def op11_sigtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtrees.linked_documents(spark, sf_dir)


def op12_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return treaps.ranked_documents(spark, sf_dir)


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.document_runs(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_simhash, op3_html, op4_topk, op5_bpe, op6_licenses, op7_decontaminate, op8_lines, op9_secrets, op10_urls, op11_sigtrees, op12_treaps, op13_runs)
}
