"""Corpus pipeline: drop toxic texts, keep one of each group of near duplicates, cut repeated passages, mix sources, tokenise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import bpe, mixing, neardup, suffixes, toxicity
from lexforge.llm.common import materialize

#: A repeated passage goes if it has more words than this.
REPEAT_WORDS = 50


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled texts of the input, reject what scores at the threshold or above."""
    lexicon = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject_toxic(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays: the one with the smallest doc_id."""
    return neardup.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated passages of more than REPEAT_WORDS words; n_chars is the new length. Every document stays, an empty one too."""
    return suffixes.word_repeats(docs, REPEAT_WORDS + 1)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the slot and place of an order that gives every source its target share of any stretch."""
    return mixing.mixed_files(docs, places=True)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left, each with its slot and place in the mixed order; rows come in any order."""
    return bpe.token_digests(docs, keep=("mix_slot", "mix_place"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("mix_sources", mix_sources),
    ("byte_level_bpe", tokenise),
]

#: Learned scores, signatures and byte-pair merges can't be said in SQL; a test holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what each one keeps is written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
