"""A pipeline from raw documents to token ids: quality, exact and near copies, the mix of sources, encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before it kept. ``run`` writes each stage's
rows as Parquet in the shared folder and reads them again, so a lost executor costs at most the work of one stage.

Odd rows, in all stages: a null text counts as empty, a null or repeated id stands for a row of its own, extra columns go through but for
``encode``, whatever their names, and an empty table gives an empty result. What else a stage does with such rows stands with it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import compression_classifier, exact_dedup, mixing, near_dedup, sentence_pieces
from pulsegrid.llm.common import discard, keep_rows, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good. Empty texts get the calibration's score for no difference and go or stay by it; equal texts go or stay together."""
    model = compression_classifier.fit_on_labels(docs, table(spark, sf_dir, "labels"))
    score = f"score_{uuid.uuid4().hex}"
    return compression_classifier.score_quality(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: most code points, then smallest id, null last, then first row. Empty texts are one group."""
    return keep_rows(docs, "doc_id", exact_dedup.exact_dedup)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the smallest id, null last. Empty texts have no partner and stay."""
    return keep_rows(docs, "doc_id", near_dedup.near_dedup)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. Empty texts go; null sources are one source, last in order."""
    return mixing.mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each row under merge-dropout. Rows of equal id and text, as the mix repeats them, get equal ids."""
    return sentence_pieces.encode_pieces(docs)


STAGES = [("quality", quality), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL can express neither the classifier nor the mix nor the encoder; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        discard(*last)
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
