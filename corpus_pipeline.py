"""Corpus pipeline: from raw documents to token ids, in five stages.

Each stage is a function of (spark, docs, folder) and gives a DataFrame, which is written as Parquet
and read again as the next stage's documents; so an executor that is lost costs the work of its
tasks in one stage only. All stages but the last keep the columns of `documents`.

1. quality_rules: documents that the base rules or the learned decision list reject go.
2. exact_dedup: of equal texts the document with the smallest id stays.
3. simhash_dedup: of each group of linked fingerprints the document with the smallest id stays.
4. mixing: each source gets its target share; documents are repeated, or left out, whole.
5. sentencepiece: doc_id, n_tokens and the digests of the ids and of the decoded text, one
   row per mixed document.

Edge cases, as the stages define them: a null or empty text has no words, so the base rules of the
first stage reject it. Very long texts are read whole by their task in each stage and stay one
document. Rows that repeat an id with different texts are decided one by one; rows that repeat both
are reduced to one by the second stage. Rows may lack ids and sources (no source is a source of its
own). Of ties the smallest id stays. An empty table passes as an empty table. Extra columns pass
through the first four stages unchanged, whatever their names.

The last stage has no SQL form, so neither has the whole; tests hold it against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact_dedup, mixing, quality_rules, sentencepiece_codec, simhash
from weftline.llm.queries import read_bytes, tokenizer_file
from weftline.sources.tables import table
from weftline.staging import stage


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, quality_rules.learn_rules(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(docs, read_bytes(tokenizer_file("piece_bpe_32k.model")))


STAGES = [
    ("quality_rules", keep_good),
    ("exact_dedup", drop_copies),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
