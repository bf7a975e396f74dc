"""Documents from raw text to token ids: toxic ones go, repeated passages and copies go, benchmark leaks go, the rest is encoded."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.llm import bpe, decontaminate, linededup, neardup, toxicity
from reliefspark.llm.shared import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that are predicted to be toxic; the model is fitted on ``docs`` and the labels table.

    A document of score 0.5 goes. Null and empty texts have the score of a text
    without known words, and stay unless most labelled documents are toxic.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without repeated passages; a document that loses all its words goes, and n_chars follows the text.

    The smallest doc_id keeps a passage, within a document its first place. Null
    texts, and texts that had no word before, stay as they are.
    """
    out = linededup.line_dedup(docs, drop_emptied=True)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more; the smallest doc_id stays.

    Null and empty texts, and rows without a doc_id, stay.
    """
    return neardup.without_copies(docs, size=5)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold half of a benchmark item or more, in whatever order; null and empty texts hold nothing and stay."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids of each document, their number, and digests of the ids and of the text decoded from them; null and empty texts have no ids."""
    tokenizer = bpe.default_tokenizer()
    return bpe.round_trip(docs, tokenizer, bpe.build_lexicon(docs, tokenizer), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("bpe", bpe_stage),
]

#: The stages' models and hashes have no SQL; tests hold each stage against its operator's brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of ``sf_dir``, one after another, each result written and read again.

    Every stage takes nulls in any column, empty and very long texts (whole),
    ties (see the stages), rows that repeat (each is a row of its own but in near
    dedup, where rows of one doc_id count as one document), tables without rows
    and columns beside those of documents, whatever their names, but for names
    that begin with an underscore and gone and chunks.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
