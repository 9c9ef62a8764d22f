"""Vector expressions over arrays of numbers, and the embedding contract."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands in for a zero norm.
TINY = 1e-10

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 minus the cosine; a zero vector is at distance 1 from everything."""
    safe = lambda v: F.when(norm(v) == 0, F.lit(TINY)).otherwise(norm(v))
    return 1 - dot(a, b) / (safe(a) * safe(b))


def distance(a: Column, b: Column, metric: str = "l2") -> Column:
    """Squared Euclidean (``l2``), ``cosine`` or inner-product (``ip``, 1 minus it) distance."""
    if metric == "l2":
        return squared_l2(a, b)
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "ip":
        return 1 - dot(a, b)
    raise ValueError(f"unknown metric: {metric}")


def distances(query: np.ndarray, vectors: np.ndarray, metric: str = "l2") -> np.ndarray:
    """The distances of one vector to many, as ``distance`` gives them."""
    if metric == "l2":
        return ((vectors - query) ** 2).sum(axis=1)
    inner = vectors @ query
    if metric == "ip":
        return 1 - inner
    if metric == "cosine":
        size = lambda v: np.where(v == 0, TINY, v)
        return 1 - inner / (size(np.linalg.norm(vectors, axis=1)) * size(np.linalg.norm(query)))
    raise ValueError(f"unknown metric: {metric}")


def paired_distances(queries: np.ndarray, vectors: np.ndarray, metric: str = "l2") -> np.ndarray:
    """The distance of each row to the row of the same number."""
    if metric == "l2":
        return ((vectors - queries) ** 2).sum(axis=1)
    inner = np.einsum("ij,ij->i", vectors, queries)
    if metric == "ip":
        return 1 - inner
    if metric == "cosine":
        size = lambda v: np.where(v == 0, TINY, v)
        return 1 - inner / (size(np.linalg.norm(vectors, axis=1)) * size(np.linalg.norm(queries, axis=1)))
    raise ValueError(f"unknown metric: {metric}")


def all_distances(queries: np.ndarray, vectors: np.ndarray, metric: str = "l2") -> tuple[np.ndarray, np.ndarray]:
    """About how far all vectors (rows) are from all queries (columns), as one product of matrices, and what it may be wrong by, a number a query."""
    size, long = np.linalg.norm(queries, axis=1), np.linalg.norm(vectors, axis=1)
    error = 1e-12 * vectors.shape[1]
    if metric == "l2":
        left = np.column_stack([vectors, long**2, np.ones(len(vectors))])
        return left @ np.column_stack([-2 * queries, np.ones(len(queries)), size**2]).T, error * (size + long.max(initial=0)) ** 2
    if metric == "ip":
        return 1 - vectors @ queries.T, error * (1 + size * long.max(initial=0))
    if metric == "cosine":
        unit = lambda v, s: v / np.where(s == 0, TINY, s)[:, None]
        return 1 - unit(vectors, long) @ unit(queries, size).T, np.full(len(queries), 2 * error)
    raise ValueError(f"unknown metric: {metric}")


class HashEmbedder:
    """Feature hashing: each search token counts in the bucket that its MD5 names; vectors have unit length.

    The stand-in where no model is installed: deterministic, and the same in every process. Blank texts give zeros.
    """

    def __init__(self, dim: int = 64):
        self.dim, self.known = dim, {}

    def bucket(self, token: str) -> int:
        if token not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % self.dim
        return self.known[token]

    def __call__(self, texts: list[str]) -> np.ndarray:
        found = [[self.bucket(t) for t in (text or "").lower().split()] for text in texts]
        row = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        cells = row * self.dim + np.fromiter(chain.from_iterable(found), np.int64, len(row))
        out = np.bincount(cells, minlength=len(texts) * self.dim).reshape(-1, self.dim).astype(float)
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)


#: The embedder that this worker process has built, by name.
BUILT: dict[str, Embedder] = {}


def worker_model(name: str, make: Callable[[], Embedder]) -> Embedder:
    """The embedder of that name, built once in a process, for all of its tasks; one of another name takes its place."""
    if name not in BUILT:
        BUILT.clear()
        BUILT[name] = make()
    return BUILT[name]


def embed(text: Column, make: Callable[[], Embedder] = HashEmbedder, batch: int = 64, flatten_newlines: bool = False, name: str | None = None) -> Column:
    """Vectors (array of doubles) of a text column by an embedder.

    make: builds the embedder, once for each task, so that a model loads where it runs. Texts go to it in order, at most
    ``batch`` at a time; null counts as empty. flatten_newlines: newlines become spaces first, as remote services want.
    name: the embedder is kept under it for later tasks of the same worker process.
    """

    @F.arrow_udf("array<double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = worker_model(name, make) if name else make()
        for column in columns:
            texts = [(t or "").replace("\n", " ") if flatten_newlines else t or "" for t in column.to_pylist()]
            found = [np.asarray(v, float) for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])]
            yield pa.array(found, pa.list_(pa.float64()))

    return run(text)
