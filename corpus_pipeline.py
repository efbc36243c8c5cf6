"""The corpus pipeline: quality, language, near duplicates, contamination, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quiresmith.llm.bytebpe import encode_decode
from quiresmith.llm.decontam import find_contamination, judged
from quiresmith.llm.jaccard import one_of_each
from quiresmith.llm.langid import UNKNOWN, fit_language, identify
from quiresmith.llm.quality import fit_quality, score_quality
from quiresmith.llm.sampling import remainder
from quiresmith.session import ship, table, work_path

#: A document whose best language has a smaller pooled probability is in no one language.
LEAST_LANGUAGE_SCORE = 0.4


def _private(docs: DataFrame, *inputs: str) -> DataFrame:
    """``docs`` with names of its own for all columns but ``inputs``, so that none is taken for a result of an operator."""
    return docs.select(*(F.col(f"`{c}`") if c in inputs else F.col(f"`{c}`").alias(f"kept {i}") for i, c in enumerate(docs.columns)))


def _public(rows: DataFrame, docs: DataFrame, *inputs: str) -> DataFrame:
    """The columns of ``docs`` again, with their own values."""
    return rows.select(*(F.col(f"`{c}`") if c in inputs else F.col(f"`kept {i}`").alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones that are not held out, predicts as 1.

    Null and empty texts are judged as one empty passage, texts of any length whole; a null doc_id matches no label.
    Every row is judged alone: repeated ones stay or go together. Without rows or labels the result follows
    from the shares of the labels. Columns of any name stay as they are.
    """
    model = fit_quality(docs, table(ship(spark), sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0))
    return _public(score_quality(_private(docs, "doc_id", "text"), model).where("predicted = 1"), docs, "doc_id", "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language, by a tagger fitted on documents that are not held out.

    Texts that are null or hold no letter are in no language and go, as does everything if no lang is given; texts
    of any length are read whole. Equal probabilities go to the language first in the alphabet; repeated rows stay or go
    together. Columns of any name stay as they are.
    """
    ship(spark)
    model = fit_language(docs.where(remainder(F.col("doc_id"), 4) != 2))
    found = identify(_private(docs, "text"), model)
    return _public(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)), docs, "text")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of smallest doc_id, a null one being the last.

    Texts without words, null or empty, are like no other and all stay; whole texts of any length are compared. Of rows
    equal in doc_id and words one stays; rows that only share a doc_id, or have none, are judged by their texts. An
    empty table stays empty. Columns of any name stay as they are.
    """
    ship(spark)
    return _public(one_of_each(_private(docs, "doc_id", "text")), docs, "doc_id", "text")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words is in benchmark passages.

    Texts without words, null or empty, are clean; whole texts of any length are searched. Every row is judged
    alone: repeated ones stay or go together. Columns of any name stay as they are.
    """
    mine = _private(docs, "doc_id", "text")
    found = judged(find_contamination(mine, table(ship(spark), sf_dir, "benchmark"), keep=mine.columns))
    return _public(found.where(~F.col("contaminated")), docs, "doc_id", "text")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes, of every row.

    A null text is empty; texts of any length are encoded whole; a null or repeated doc_id is kept as it is. Other
    columns of the documents end here.
    """
    ship(spark)
    return encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_payload=False)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("tokenize", tokenize)]

#: The trained models can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
