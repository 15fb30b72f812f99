"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs.  All but the last return the columns of documents.

* toxicity: rejects documents that are predicted toxic;
* exact dedup: keeps one row of those whose texts are equal but for white space;
* n-gram Jaccard join: keeps the smallest id of each component of near duplicates;
* secret scans: replaces secrets by a mark, keeps every document;
* best-fit packing: cuts and packs what is left into sequences of 2048 tokens.

Null texts pass through as empty ones, rows that repeat a doc_id are reduced by the dedup stages
to one, rows without a doc_id are kept, extra columns pass through to the last stage, and an empty
table gives empty results.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import bestfit_packing, exact_dedup, jaccard_join, secret_scan, toxicity
from wayfold.llm.scratch import saved, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bestfit_packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", mask_secrets),
    ("best-fit packing", pack),
]

#: A learnt classifier and a tokenizer are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)
