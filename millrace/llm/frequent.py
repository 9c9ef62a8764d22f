"""Frequent content, by a bounded sample: what is in it comes last as a key, so that few rows meet under one key."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
MASK = U((1 << 20) - 1)
LAST = U(1 << 63)


def least_hashed(rows: DataFrame, n: int, total: int) -> DataFrame:
    """The ``n`` of ``total`` rows with the smallest hash of ``doc_id``; the same ones at every partitioning.

    Only hashes below a bound that about twice as many rows meet are sorted, so that no task gathers ``n`` rows from
    every other; few rows are sorted as they are.
    """
    draw = F.xxhash64("doc_id")
    if total > 4 * n:
        rows = rows.where(draw < F.lit(int(-(2**63) + 2 * n / total * 2**64)))
    return rows.orderBy(draw, "doc_id").limit(n)


def sampled_texts(docs: DataFrame, rows: int, chars: int) -> list[str]:
    """Texts of ``rows`` documents at most, those with the smallest hash of ``doc_id``, without texts over ``chars``.

    Null ids and texts are left out; of texts under one id the least counts.
    """
    ids = [r[0] for r in least_hashed(docs.select("doc_id").where("doc_id is not null"), rows, docs.count()).distinct().collect()]
    if not ids:
        return []
    found = docs.select("doc_id", "text").where(F.col("doc_id").isin(ids) & (F.length("text") <= chars)).groupBy("doc_id").agg(F.min("text").alias("text")).collect()
    return [r["text"] for r in sorted(found, key=lambda r: r["doc_id"])]


class Frequent:
    """Hashes (the upper 63 bits of 64) that a sample has often. They only order keys: any set of them gives right results."""

    def __init__(self, hashes: np.ndarray, least: int):
        values, n = np.unique(hashes >> U(1), return_counts=True)
        self.values = values[n >= least]
        self.table = np.zeros(int(MASK) + 1, bool)
        self.table[(self.values & MASK).astype(np.int64)] = True

    def last(self, hashes: np.ndarray) -> np.ndarray:
        """The upper 63 bits of each hash, below a bit that is set for frequent ones."""
        out = hashes >> U(1)
        if len(self.values):
            maybe = np.flatnonzero(self.table[(out & MASK).view(np.int64)])
            known = self.values[np.minimum(np.searchsorted(self.values, out[maybe]), len(self.values) - 1)] == out[maybe]
            out[maybe[known]] |= LAST
        return out


def often(rows: int, share: float = 0.005) -> int:
    """How often a sample of so many documents must have something for it to count as frequent."""
    return max(10, int(share * rows))
