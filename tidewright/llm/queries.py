"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, html_extract, license_scan, ngram_join, quality_classifier, quality_rules, secret_scan, source_mix, token_store, topk_search


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.train(docs, _read(spark, sf_dir, "labels")))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.plan_mix(_read(spark, sf_dir, "documents")).drop("copies")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.line_quality(_read(spark, sf_dir, "documents")).drop("cleaned")


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    return topk_search.top_k(rows, rows.where("vec_id % 100 = 0"), k=10)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_read(spark, sf_dir, "documents")).drop("masked", "n_added")


def tokenizer_path() -> str:
    """The file of the public tokenizer; every machine has it at the same place."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(_read(spark, sf_dir, "documents"), tokenizer_path())


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(_read(spark, sf_dir, "documents"), tokenizer_path())


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents")).drop("spans")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_html_extract, op3_source_mix, op4_ngram_join, op5_quality_rules, op6_topk_search, op7_secret_scan, op8_bpe, op9_token_store, op10_license_scan)}
