"""The corpus pipeline: language identification, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and all documents that its predecessor kept; all but the last
return rows of documents with all the columns that they came with. run() writes each stage's rows as
Parquet in the shared folder and reads them again for the next; what a stage wrote for itself, and the
rows of the stage before, are then deleted.

Every stage takes nulls in any column, empty and very long texts, repeated rows, ties, further columns of
any name, and an empty table. A text that is null or has no letter has no language and goes in the first
stage. Labels that are null or that name no document teach nothing; without labels of both kinds the second
stage judges by its counts alone. Of rows that share a doc_id each is judged by its own text, and of a group of
near copies one row stays: of smallest doc_id, a row without one only where none has one. The last stage packs
every row that is left, whatever its doc_id.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandflow.llm import langid, packing, quality_rules, simhash
from strandflow.llm.common import deleted, new_path, read_table, scratch, written
from strandflow.llm.labelled import key_mod

#: A text is rejected without a language, if its language has less than this share of its letters, or if its words
#: are known less than this in the languages found (99 % of texts in a language left out at sf0.1 stay below 0.62).
LEAST_LANGUAGE_SHARE, LEAST_LANGUAGE_CONFIDENCE = 0.3, 0.6
#: Texts whose five-word shingles agree by this share (Jaccard) are near copies.
LEAST_SIMILARITY = 0.8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.learn(docs.where(key_mod("doc_id", 4) != 2))
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE) & (F.col("confidence") >= LEAST_LANGUAGE_CONFIDENCE)
    return langid.detect(docs, model, keep=known)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_rules.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality_rules.judged(docs, model, only_kept=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest doc_id of each component stays; links are op10's and LEAST_SIMILARITY."""
    return simhash.one_of_each(docs, similar=LEAST_SIMILARITY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality),
    ("simhash_near_duplicates", near_duplicates),
    ("packing", packed),
]

#: Fitted models, iteration and tokenisation are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        with scratch(spark, f"{name}-own"):
            docs = written(stage(spark, docs, sf_dir), name, path)
        if before:
            deleted(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
