"""The corpus pipeline: quality, language, near duplicates, mixture, token ids. Each stage reads what the last one wrote.

All stages but the last keep the columns of their input, whatever others there are and however they are called. Null texts count
as empty, are no language, and so go at the second stage; null ids never train, are no near duplicate of anything, and are mixed
and encoded like others. Repeated rows are judged alike; of rows that are alike in id and text one stays after near duplicates.
Ties are settled by ids, then by hashes of rows, so reruns agree. Whole texts are read, of any length. An empty table passes
through every stage and gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm import bpe, jaccard, langid, mixing, quality
from streamloom.llm.common import Scratch, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the positive-unlabelled classifier accepts."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a letter and a language told with fair certainty."""
    return langid.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class under five-word shingles and a similarity of 0.8 or more."""
    return jaccard.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixing.apply_mix(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number and digests of the token ids and of the decoded text, for each copy of a document."""
    return bpe.digests(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("near duplicates", near_duplicate_stage), ("mixing", mixing_stage), ("tokens", token_stage)]
#: Learned scores cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.save(docs)
            if k:
                scratch.drop(before)
    return docs
