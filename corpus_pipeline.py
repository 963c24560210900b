"""The corpus pipeline: quality rules, near-duplicate removal, secret masking, mixing of sources, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidewright.llm import bpe, ngram_join, quality_rules, secret_scan, source_mix
from tidewright.llm.common import shared_dir
from tidewright.llm.queries import tokenizer_path


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line-first rules keep, with their whole text: only the verdict on a document takes effect here."""
    return quality_rules.keep_clean(docs)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken."""
    return source_mix.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE encoding and decoding: ``doc_id, n_tokens, ids, decoded_sha256`` of every document of the mix; the last is the digest of the text decoded."""
    # fewer known words than alone, as the executors' memory still holds what the stages before have touched
    return bpe.encode_ids(docs, tokenizer_path(), digest=True, memo_words=50_000)


STAGES = [
    ("quality rules", keep_clean),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("secret scans", mask_secrets),
    ("mixing sources", mix_sources),
    ("BPE encoding and decoding", encode),
]

#: SQL can't express the field of the secret scan nor BPE; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written as Parquet below the shared checkpoint folder and read by the next."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        if k:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
        docs = stage(spark, docs, sf_dir)
    return docs
