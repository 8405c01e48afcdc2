"""Quality classifier by compression: zstandard dictionaries of good and of bad text."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Labelled rows of each class that the model is fitted on, at most, and the code points that such a row may have.
SAMPLE_ROWS, SAMPLE_CHARS = 2500, 10_000
DICTIONARY_BYTES = 80 << 10
CHUNK_BYTES = 1024
#: A text is compressed in blocks of so many bytes, each against the dictionary alone, so that its own history hides no part of it.
BLOCK_BYTES = 1024
LEVEL = 3
#: Bytes that every text's length counts more, so that a few bytes alone say little.
MORE_BYTES = 10
RIDGE = 0.05


@dataclass(frozen=True)
class CompressionModel:
    """Dictionaries of bad and good text and a logistic calibration of their normalised size difference: the score's log odds are ``intercept`` + ``slope`` * difference."""

    bad: bytes
    good: bytes
    intercept: float
    slope: float

    def scores(self, texts) -> np.ndarray:
        both = [_compressor(d) for d in (self.bad, self.good)]
        return _logistic(self.intercept + self.slope * np.array([size_difference(t, both) for t in texts], dtype=float))


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    options = {"write_checksum": False, "write_content_size": False, "write_dict_id": False}
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), **options)


def size_difference(text: str | None, compressors) -> float:
    """How many bytes less the text takes with the dictionary of good texts than with that of bad ones, by its length. Sizes are sums over all blocks; 0 for no text."""
    data = (text or "").encode("utf-8", "replace")
    bad, good = (sum(len(c.compress(data[i : i + BLOCK_BYTES])) for i in range(0, len(data), BLOCK_BYTES)) for c in compressors)
    return (bad - good) / (len(data) + MORE_BYTES)


def _dictionary(texts: list[str]) -> bytes:
    chunks = [b[i : i + CHUNK_BYTES] for t in texts for b in [t.encode("utf-8", "replace")] for i in range(0, len(b), CHUNK_BYTES)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, chunks).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(chunks)[-DICTIONARY_BYTES:]


def fit(bad: list[str], good: list[str], good_share: float) -> CompressionModel:
    """Dictionaries from every other text, calibration on the rest, weighted to ``good_share``.

    Without texts of one class the score is ``good_share`` for any text.
    """
    dictionaries = [_dictionary(x[::2]) for x in (bad, good)]
    both = [_compressor(d) for d in dictionaries]
    held = [(x[1::2] or x) for x in (bad, good)]
    start = math.log((good_share + 1e-3) / (1 - good_share + 1e-3))
    if not all(held):
        return CompressionModel(*dictionaries, start, 0.0)
    x = np.array([size_difference(t, both) for h in held for t in h])
    y = np.repeat([0.0, 1.0], [len(h) for h in held])
    w = np.where(y == 1, good_share / len(held[1]), (1 - good_share) / len(held[0])) * len(y)
    mean, scale = x.mean(), max(x.std(), 1e-9)
    intercept, slope = calibrate((x - mean) / scale, y, w, start)
    return CompressionModel(*dictionaries, intercept - slope * mean / scale, slope / scale)


def calibrate(x: np.ndarray, y: np.ndarray, w: np.ndarray, start: float) -> tuple[float, float]:
    """Intercept and slope of the weighted logistic regression of y on x by Newton's method; the slope is held a little by RIDGE."""
    a, b, ridge = np.column_stack([np.ones(len(x)), x]), np.array([start, 0.0]), np.array([1e-6, RIDGE])
    for _ in range(50):
        p = _logistic(a @ b)
        step = np.linalg.solve((a.T * (w * p * (1 - p))) @ a + np.diag(ridge), a.T @ (w * (y - p)) - ridge * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit_on_labels(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS) -> CompressionModel:
    """Fit on a bounded sample: of the labelled rows that are not held out, the ``sample_rows`` of each class that come first in hash order, without those of over ``sample_chars`` code points."""
    ids = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    ids = ids.groupBy("_id").agg(F.min("_y").alias("_y"))
    counts = {r["_y"]: r["count"] for r in ids.groupBy("_y").count().collect()}

    def first_rows(y: int) -> DataFrame:
        # The first rows in hash order lie below this share of all hashes, so no task sorts or sends more than a few times the sample.
        share = (4 * sample_rows + 100) / max(1, counts.get(y, 0))
        rows = ids.where(F.col("_y") == y)
        if share < 1:
            rows = rows.where(F.xxhash64("_id") < int(share * 2**64) - 2**63)
        return rows.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)

    first = [first_rows(y) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * sample_rows pairs of numbers
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t")).where(F.char_length("_t") <= sample_chars).join(chosen, "_id")
    rows = rows.orderBy(F.xxhash64("_id"), "_id", "_t").limit(2 * sample_rows).collect()
    texts = [[r["_t"] for r in rows if r["_y"] == y] for y in (0, 1)]
    return fit(*texts, counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5)


def score_quality(docs: DataFrame, model: CompressionModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is good in ``score_col``. Only the text is looked at, as a whole; null counts as empty."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(texts))

    return docs.withColumn(score_col, score(F.col(text_col).cast("string")))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **sample) -> DataFrame:
    """Score every row of ``docs`` by a model fitted on ``labels``.

    Nulls: a null text counts as empty; an empty text gets the calibration's score for a difference of 0; a null id is not held out and not
    learned from. Repeated rows are scored alike, each on its own. Empty tables give an empty result; without labels
    every score is 0.5. Of a doc_id labelled both ways the lower label counts. Other columns are ignored.

    Returns doc_id, held_out, score, predicted.
    """
    model = fit_on_labels(docs, labels, id_col, text_col, label_col, **sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return score_quality(rows, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_compression_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
