"""Quality classifier by compression: zstandard dictionaries of good and bad text, their size difference calibrated.

A text that resembles the good samples compresses better with the dictionary built from them, and the other way
round. ``(bad size - good size) / bytes``, with the text's length and its compression ratio, goes through a logistic
calibration fitted on labelled rows that its dictionaries did not see.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.frequent import least_hashed

LEVEL = 3


@dataclass
class QualityModel:
    """Two zstandard dictionaries and the weights of the calibration; small and bounded, so it travels in closures."""

    good: bytes
    bad: bytes
    weights: np.ndarray = field(default_factory=lambda: np.zeros(7))

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        made = []
        for data in (self.good, self.bad):
            words = zstandard.ZstdCompressionDict(data)
            words.precompute_compress(LEVEL)
            made.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
        return made

    def features(self, texts: list[str | None], made: list | None = None) -> np.ndarray:
        """Rows of calibration inputs; a null text is an empty one."""
        good, bad = made or self.compressors()
        out = np.empty((len(texts), 3))
        for i, text in enumerate(texts):
            data = (text or "").encode("utf-8", "surrogatepass")
            n = max(1, len(data))
            g, b = len(good.compress(data)), len(bad.compress(data))
            out[i] = (b - g) / n, np.log(n), min(g, b) / n
        diff, size, ratio = out.T
        ratio = np.minimum(ratio, 2)
        return np.column_stack([np.ones(len(out)), 20 * diff, size, diff * size * 4, 4 * ratio, 4 * ratio**2, ratio * size])

    def scores(self, texts: list[str | None], made: list | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts, made) @ self.weights, -30, 30)))


def dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary of at most ``size`` bytes; of too few samples, their plain content."""
    try:
        return zstandard.train_dictionary(size, texts).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:size] or b"\n" * 8


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weighted ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_quality(docs: DataFrame, labels: DataFrame, usable: Column | None = None, sample_rows: int = 6000, sample_chars: int = 20_000, dictionary_bytes: int = 32_768, folds: int = 4) -> QualityModel:
    """Fits a model on a bounded sample of labelled rows.

    docs: ``doc_id``, ``text``; labels: ``doc_id``, ``quality`` (1 good, 0 bad); others columns are not read.
    usable: a condition on ``doc_id`` that labels must meet to be learnt from. sample_rows: labels of either class
    taken at most, those with the smallest hash of doc_id, so the same ones at every partitioning. sample_chars:
    longer texts are left out of the sample (they are scored whole like all others). The calibration is fitted on
    sizes by dictionaries that leave out the fold of the text at hand, and weighted to the share of each class among
    all usable labels; the dictionaries kept are built from the whole sample.
    Null ids, texts and labels are not learnt from; of conflicting labels of one id the lower holds, of its texts
    the least. With a class
    missing the model scores every text by the share of good labels, 0.5 with none at all.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if usable is not None:
        known = known.where(usable)
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 0.5) / (total + 1)
        return QualityModel(b"\n" * 8, b"\n" * 8, np.array([np.log(share / (1 - share))] + [0.0] * 6))
    picks = [least_hashed(known.where(F.col("quality") == q), sample_rows, counts[q]) for q in (0, 1)]
    picked = picks[0].union(picks[1])
    rows = docs.select("doc_id", "text").where("text is not null").where(F.length("text") <= sample_chars).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (hash_of(r["doc_id"]), r["doc_id"]))
    texts = {q: [r["text"] for r in rows if r["quality"] == q] for q in (0, 1)}
    model = QualityModel(*(dictionary([t.encode() for t in texts[q] if t], dictionary_bytes) for q in (1, 0)))
    if min(map(len, texts.values())) < folds:
        model.weights = np.array([np.log(counts[1] / counts[0])] + [0.0] * 6)
        return model
    x, y = [], []
    for k in range(folds):
        seen = {q: [t for i, t in enumerate(texts[q]) if i % folds != k] for q in (0, 1)}
        part = QualityModel(*(dictionary([t.encode() for t in seen[q] if t], dictionary_bytes) for q in (1, 0)))
        for q in (0, 1):
            x.append(part.features(texts[q][k::folds]))
            y += [float(q)] * len(x[-1])
    y = np.array(y)
    weight = np.where(y == 1, counts[1] / total / y.sum(), counts[0] / total / (1 - y).sum()) * len(y)
    model.weights = logistic(np.vstack(x), y, weight)
    return model


def hash_of(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF


def score_quality(docs: DataFrame, model: QualityModel, score: str = "score") -> DataFrame:
    """``docs`` with a column ``score`` (0 to 1, higher: better), from the whole ``text`` alone, in one pass without a shuffle.

    A null or empty text is scored as empty text; an existing column of that name is replaced; no rows give no rows.
    """

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        made = model.compressors()
        for column in columns:
            yield pa.array(np.concatenate([model.scores(column.slice(i, 500).to_pylist(), made) for i in range(0, len(column), 500)] or [np.empty(0)]), pa.float64())

    return docs.withColumn(score, scored(F.col("text")))


def held_out(doc_id: Column) -> Column:
    """Whether labels of this id are kept for evaluation: crc32 of its decimal text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Scores all documents; labels of held-out ids are never learnt from."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit_quality(docs, labels, ~held_out(F.col("doc_id")))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
