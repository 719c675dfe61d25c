"""The corpus pipeline: language, exact and near dedup, mixing, tokens.

Each stage takes the documents that the one before kept and decides over all of them. ``run``
writes every stage's result to the shared folder and reads it again, so a lost executor
costs at most the stage that is running.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from weirlog.llm import bpe, exact_dedup, language, mixing, ngram_join
from weirlog.llm.common import stored, table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Words of a shingle, and the similarity of near copies as a fraction. The op6 contract's 3 words and 0.9 hold for that query only.
NEAR_COPIES = (5, 80, 100)


#: Rows that go to a Python worker together. Texts are long: with the usual 10,000, buffers of some 100 MB a task lie beside the heap.
ROWS_AT_ONCE = 1_000
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """For stages that read texts in Python; a smaller setting of the session stays."""
    spark.conf.set(_BATCHES, str(min(ROWS_AT_ONCE, int(spark.conf.get(_BATCHES)))))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter in their text, each with the language that is found in it, by which the mix goes."""
    _small_batches(spark)
    return language.drop_unidentified(docs, language.learn(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same bytes the one with the largest doc_id, and of its rows one."""
    return exact_dedup.one_per_text(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of similar shingle sets connect the one with the smallest doc_id."""
    _small_batches(spark)
    return ngram_join.one_per_group(docs, *NEAR_COPIES)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often and as far as the mix takes them; those that it does not take go.

    A source's languages, as identified, keep their shares of its words.
    """
    return mixing.mixed_documents(docs, "lang" if "lang" in docs.columns else None)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids and of the decoded bytes of every document of the mix."""
    _small_batches(spark)
    return bpe.encode_digests(docs, RANKS, public_tokenizers.PATTERN)


STAGES = [
    ("language ID", identify_language),
    ("exact dedup", drop_exact_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: SQL cannot express the first and the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
