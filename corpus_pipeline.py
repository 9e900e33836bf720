"""The corpus pipeline: quality, language, exact copies, near copies, packing.

Each stage is a (name, function) pair; a function takes (spark, docs, sf_dir) and returns the rows that stay, with the
columns of documents, and the last one the packed pieces. Every stage's result is written as Parquet and read again.
Empty input passes through every stage; null texts count as empty, which the language stage rejects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import exact_dedup, langid, packing, quality, simhash
from wayfold.llm.common import read, written
from wayfold.llm.queries import WORD_TOKENIZER

#: A document whose best language scores less is rejected.
LEAST_LANGUAGE_SCORE = 0.5


def _where(marked: DataFrame, docs: DataFrame, test: Callable[..., Column]) -> DataFrame:
    """The rows of docs whose further columns in ``marked`` pass the test."""
    columns = [F.col(f"`{c}`") for c in marked.columns]
    return marked.where(test(*columns[len(docs.columns) :])).select(*columns[: len(docs.columns)])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier scores at its threshold or above."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return _where(quality.score(docs, model), docs, lambda score: score >= quality.THRESHOLD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter whose language the output codes tell with a score of LEAST_LANGUAGE_SCORE or more."""
    known = langid.identify(docs, langid.train(docs))
    return _where(known, docs, lambda pred, score, _: (pred != langid.UNKNOWN) & (score >= LEAST_LANGUAGE_SCORE))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id."""
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles have a Jaccard similarity of 0.8 or more, the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their token ids, sequences and offsets."""
    import public_tokenizers

    packed = packing.pack(docs, public_tokenizers.path(WORD_TOKENIZER))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_classifier", quality_stage),
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", near_stage),
    ("best_fit_packing", packing_stage),
]

#: Trained models and packing can't be put in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
