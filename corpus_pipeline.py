"""Corpus pipeline: from raw documents to packed training sequences.

1. ``language_id``: documents whose language can't be told go (no letters, or a
   calibrated score below 0.4).
2. ``line_dedup``: lines that an earlier document (or line) has, exactly or with
   one character changed, go; under 30 characters, exact copies alone; a document
   that loses all its text goes.
3. ``ngram_jaccard_join``: of documents with a 5-word-shingle similarity of 0.8 or
   more, directly or through others, that with the smallest id stays.
4. ``substring_dedup``: repeated lines and sentences of eight words or more go,
   also such as stand inside a line; a document that loses all its text goes.
5. ``best_fit_packing``: the rest is tokenized and packed into sequences.

Each stage works on all that its predecessor kept and is written as Parquet;
what it wrote on its way is deleted when the next stage starts.
Null and empty texts have no language and go in stage 1.  An empty table of
documents gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import langid, line_dedup, ngram_join, packing, substring_dedup
from tillroll.llm.common import discard, stage, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage(spark, docs):
        return langid.keep_identified(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage(spark, docs):
        return line_dedup.deduplicated(docs, exact_chars=1)


def ngram_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage(spark, docs):
        return ngram_join.one_of_each(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage(spark, docs):
        return substring_dedup.deduplicated(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with stage(spark, docs):
        return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", ngram_stage),
    ("substring_dedup", substring_stage),
    ("best_fit_packing", packing_stage),
]

#: Neither language identification nor tokenizing can be said in SQL; the stages
#: are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, step in STAGES[:-1]:
        docs = written(step(spark, docs, sf_dir), name)
        if old is not None:
            discard(old)
        old = docs
    return STAGES[-1][1](spark, docs, sf_dir)
