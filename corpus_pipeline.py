"""A training corpus from raw documents, in five stages. Each stage works on all that its predecessor kept.

Rows are documents (doc_id, text, lang, source, n_chars) until the last stage, which returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, linededup, mixing, neardup, quality
from gridloom.llm.queries import tokenizer_file
from gridloom.llm.shared import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, fitted on the labels of these documents, accepts."""
    return quality.keep_good(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines deleted from their later places; documents of which nothing is left go."""
    out = linededup.dedup_lines(docs, n_chars_col="n_chars", n_deleted_col="__deleted")
    return out.where("__deleted = 0 or trim(text) != ''").drop("__deleted")


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return neardup.keep_representatives(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents repeat where a source's target exceeds its size."""
    return mixing.materialize(docs, n_chars_col="n_chars")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids (packed little-endian unsigned 32-bit integers), decoded_sha256."""
    return bpe.encode_documents(docs, tokenizer_file("word_bpe_49k.json"), outputs=("n_tokens", "token_ids", "decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", without_repeated_lines),
    ("MinHash near-dedup", one_of_each_class),
    ("mixing sources", mixed_sources),
    ("BPE encoding", token_ids),
]

#: The stages rest on hashes, compression and subword merges that SQL can't express; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
