"""Quality by compression: which of two zstandard dictionaries fits a text better.

One dictionary is built from good and one from bad labelled text.  A text is cut
into pieces of ``PIECE`` bytes, all of which are compressed with both; the
difference of the two sizes over the text's own size is turned into a
probability by a logistic curve fitted on labelled documents that the
dictionaries have not seen.

Fitting reads a bounded sample: at most ``sample`` labelled documents of each
class, none longer than ``LONGEST_SAMPLE`` bytes (longer ones are still scored,
whole).  Class frequencies come from all labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remainder, text_of, texts_in

PIECE = 1024
LEVEL = 3
DICTIONARY = 112_640
SAMPLE = 3_000
LONGEST_SAMPLE = 32_768


def pieces(text: bytes) -> list[bytes]:
    return [text[i:i + PIECE] for i in range(0, len(text), PIECE)]


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary, or the raw text as one where there is too little to train on."""
    parts = [p for t in texts for p in pieces(t)]
    if not parts:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY, parts).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(dictionary) < 8:
        return zstandard.ZstdCompressor(**plain)
    return zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary), **plain)


@dataclass(frozen=True)
class CompressionModel:
    """Two dictionaries (bounded by ``DICTIONARY`` bytes each) and the calibration curve."""

    good: bytes
    bad: bytes
    slope: float = 0.0
    offset: float = 0.0

    def differences(self, texts: Iterator[bytes]) -> np.ndarray:
        """(size with the bad dictionary - size with the good one) / bytes; 0 for an empty text."""
        good, bad = _compressor(self.good), _compressor(self.bad)
        out = []
        for text in texts:
            parts = pieces(text)
            gap = sum(len(bad.compress(p)) for p in parts) - sum(len(good.compress(p)) for p in parts)
            out.append(gap / len(text) if text else 0.0)
        return np.array(out, dtype=np.float64)

    def scores(self, texts: Iterator[bytes]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.differences(texts) + self.offset, -60, 60)))


def _calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit with a small ridge, by Newton steps until they settle."""
    scale = float(np.std(x)) or 1.0
    a = np.c_[x / scale, np.ones(len(x))]
    beta, ridge = np.zeros(2), np.diag([1e-3, 1e-6])
    loss = lambda b: float(weight @ np.logaddexp(0.0, -(2 * y - 1) * (a @ b))) + b @ ridge @ b / 2
    while True:
        p = 1.0 / (1.0 + np.exp(-np.clip(a @ beta, -60, 60)))
        gradient = a.T @ (weight * (p - y)) + ridge @ beta
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge, gradient)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-8:
            size /= 2
        if size <= 1e-8 or np.abs(size * step).max() < 1e-10:
            return float(beta[0] / scale), float(beta[1])
        beta = beta - size * step


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        sample: int = SAMPLE, longest: int = LONGEST_SAMPLE) -> CompressionModel:
    """Fit on the labelled rows given (the caller leaves out those held back): at most ``sample`` documents of each
    class, none above ``longest`` bytes.  Of rows with one id the greatest text counts, and of its labels the greater.

    Rows with a NULL id or label, or another label than 0 and 1, teach nothing.
    With one class only the score is the add-one class frequency of every text.
    """
    marked = (labels.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label}`").isin(0, 1))
              .groupBy(F.col(f"`{id_col}`").alias("_id")).agg(F.max(F.col(f"`{label}`").cast("int")).alias("_y")))
    counts = {r["_y"]: r["n"] for r in marked.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    picks = [marked.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample) for y in (0, 1)]
    chosen = picks[0].unionByName(picks[1])
    rows = (docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text"))
            .join(F.broadcast(chosen), "_id")  # 2 x sample rows of two numbers at most
            .where(F.octet_length("_text") <= longest)
            .groupBy("_id", "_y").agg(F.max("_text").alias("_text"))
            .orderBy(F.xxhash64("_id", F.lit(1)), "_id").select("_y", "_text").toArrow())
    found = [(y, t) for y, t in zip(rows.column("_y").to_pylist(), texts_in(rows.column("_text")))]
    halves = {y: [t for v, t in found if v == y] for y in (0, 1)}
    prior = math.log((counts.get(1, 0) + 1) / (counts.get(0, 0) + 1))
    cut = {y: (len(halves[y]) + 1) // 2 for y in halves}
    model = CompressionModel(_dictionary(halves[1][:cut[1]]), _dictionary(halves[0][:cut[0]]))
    rest = [(y, t) for y in (0, 1) for t in halves[y][cut[y]:]]
    if {y for y, _ in rest} != {0, 1}:
        return CompressionModel(model.good, model.bad, 0.0, prior)
    y = np.array([v for v, _ in rest], dtype=np.float64)
    # Both classes are sampled to the same size; weights restore their true frequency.
    share = {v: counts[v] / sum(counts.values()) * len(y) / float((y == v).sum()) for v in (0, 1)}
    slope, offset = _calibrated(model.differences(t for _, t in rest), y, np.where(y == 1, share[1], share[0]))
    return CompressionModel(model.good, model.bad, slope, offset)


def score(docs: DataFrame, model: CompressionModel, text: str = "text", name: str = "score") -> DataFrame:
    """All columns of the documents and the score, ``name``, which takes the place of a column of that name.

    NULL texts score as empty ones; texts of any length are read whole.
    """
    return docs.withColumn(name, scorer(docs.sparkSession, model)(text_of(text)))


def scorer(spark: SparkSession, model: CompressionModel):
    """A function from a text column to its score: only texts go to the workers and only scores come back."""
    held = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(held.value.scores(texts_in(texts)), pa.float64())

    return scores


def quality_scores(docs: DataFrame, labels: DataFrame, held_out_of: int = 3, held_out: int = 1,
                   id_col: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """id, held_out, score, predicted of every document; only labels of rows that are not held out are learnt."""
    learnt = labels.where(remainder(id_col, held_out_of) != held_out)
    model = fit(docs, learnt, id_col, text, sample=sample)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(text).alias("_text"))
    return score(rows, model, "_text").select(
        F.col("_id").alias(id_col), (remainder("_id", held_out_of) == held_out).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
