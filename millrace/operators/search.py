"""Retrieval: nearest vectors, BM25 ranking, and reciprocal rank fusion of both."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import vectors as V
from millrace.operators.keywords import B, DENSE, EPSILON, K1, PAIRS, SLICE, Weights, lists, words
from millrace.operators.ordering import discard, kept

#: Scores held at once.
CELLS = 2_000_000
#: Tokens of documents that are looked up together.
ENTRIES = 1_000_000


def candidate_count(n: int, multiplier: int, stored: int) -> int:
    """How many hits of either kind to fuse: ``n`` times the multiplier, no more than are stored, at least one."""
    return min(max(n, n * multiplier), stored or 1)


def best(rows: DataFrame, number: Column, n: int) -> DataFrame:
    """The first ``n`` rows by a row number, with ``rank`` from 0.

    The filter is on the number itself, so that each task drops what cannot be among them before the shuffle.
    """
    return rows.withColumn("_number", number).where(F.col("_number") <= n).withColumn("rank", F.col("_number") - 1)


def first_of_each(query: np.ndarray, score: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Which rows are the ``n`` of the highest score of each query, of equal scores those of the least rank."""
    order = np.lexsort((rank, -score, query))
    at = query[order]
    return order[np.arange(len(at)) - np.searchsorted(at, at) < n]


class Best:
    """The ``n`` best hits of each query of a block that a task has met so far; of equal scores those first in order (``ord``).

    ``least`` is what the n-th of each query scores: what scores less is no hit.
    """

    def __init__(self, queries: int, n: int):
        self.n, self.least, self.rows, self.more, self.waiting = n, np.full(queries, -np.inf), None, [], 0

    def offer(self, about: np.ndarray, slack: np.ndarray | float, exact: Callable[[np.ndarray, np.ndarray], np.ndarray], ids: pa.Array, ord_: pa.Array) -> None:
        """Takes what counts of a slice of hits. about: a row a hit and a column a query, scores to within ``slack``; only those of pairs that may count are made exact, from the numbers of query and hit."""
        n, queries = self.n, len(self.least)
        if len(about) > n and np.isneginf(self.least).any():
            self.least = np.fmax(self.least, -np.partition(-about, n - 1, axis=0)[n - 1] - slack)
        low = about < self.least - slack
        hit, query = np.divmod(np.flatnonzero(~low.reshape(-1)), queries)
        score = exact(query, hit)
        left = np.flatnonzero(~(score < self.least[query]))
        if len(left) > n * queries:
            rank = np.empty(len(ids), np.int64)
            rank[pc.array_sort_indices(ord_).to_numpy()] = np.arange(len(ids))
            left = left[first_of_each(query[left], score[left], rank[hit[left]], n)]
        if len(left):
            at = pa.array(hit[left])
            self.more.append(pa.table([pa.array(query[left]), ids.take(at), ord_.take(at), pa.array(score[left])], names=["query", "id", "ord", "score"]))
            self.waiting += len(left)
        if self.waiting > n * queries or self.rows is None and self.more:
            self.settle()

    def settle(self) -> pa.Table | None:
        """The best so far, by query, score and order."""
        if self.more:
            rows = pa.concat_tables([*([] if self.rows is None else [self.rows]), *self.more])
            rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("score", "descending"), ("ord", "ascending")]))
            query = rows.column("query").to_numpy()
            place = np.arange(len(query)) - np.searchsorted(query, query)
            last = place == self.n - 1
            self.least[query[last]] = np.fmax(self.least[query[last]], rows.column("score").to_numpy()[last])
            self.rows, self.more, self.waiting = rows.filter(pa.array(place < self.n)).combine_chunks(), [], 0
        return self.rows


def met_in_batches(asked: DataFrame, stored: DataFrame, n: int, metric: str, places: int | None) -> DataFrame:
    """Of each task's ``stored`` (``id``, ``vec``) the ``n`` nearest to each query of one block, with ``distance``.

    The block (``query_id``, ``query_vec``) is collected and travels to the tasks. Rows without a vector are no hits. A slice
    of vectors and the block are multiplied as matrices; only pairs that come as near as the n-th so far, but for rounding, are measured one by one.
    """
    rows = asked.where("query_vec is not null").collect()
    ids = pa.array([r["query_id"] for r in rows])
    wanted, cells = np.array([r["query_vec"] for r in rows], float), CELLS
    unit = 0.0 if places is None else 10.0**-places

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_, step = Best(len(wanted), n), max(1, cells // max(1, len(wanted)))
        for frame in frames if len(wanted) else ():
            frame = frame.filter(frame.column(1).is_valid())
            for at in range(0, frame.num_rows, step):
                part = frame.slice(at, step)
                vectors = np.asarray(part.column(1).flatten(), float).reshape(part.num_rows, -1)

                def exact(query: np.ndarray, hit: np.ndarray, vectors=vectors) -> np.ndarray:
                    d = [V.paired_distances(wanted[query[k : k + 20_000]], vectors[hit[k : k + 20_000]], metric) for k in range(0, len(query), 20_000)]
                    d = np.concatenate(d) if d else np.zeros(0)
                    return -(d if places is None else np.round(d, places))

                about, error = V.all_distances(wanted, vectors, metric)
                best_.offer(-about, error + unit, exact, part.column(0), part.column(0))
        found = best_.settle()
        if found is not None:
            found = pa.table([ids.take(found.column("query").combine_chunks()), found.column("id"), pc.subtract(0.0, found.column("score"))], names=["query_id", "id", "distance"])
            yield from found.to_batches(10_000)

    kinds = asked.schema["query_id"].dataType.simpleString(), stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(run, f"query_id {kinds[0]}, id {kinds[1]}, distance double")


def nearest(queries: DataFrame, stored: DataFrame, n: int = 5, metric: str = "l2", id_: str = "id", vec: str = "embedding", query_id: str = "query_id", query_vec: str = "query_vec", block_rows: int = 5000, places: int | None = None, query_rows: int | None = None) -> DataFrame:
    """The ``n`` nearest of ``stored`` to each query: ``query_id``, ``rank`` (from 0), ``id``, ``distance``.

    Queries are a stated set. They are sent to the stored vectors in blocks of about ``block_rows``, and each block's
    partial results are cut to ``n`` a query and batch, then task, before the last ranking, so what is shuffled is the number of
    queries times ``n`` times the tasks. Equal distances are ranked by ``id``. places: rounds distances before ranking.
    query_rows: how many queries there are, if known; else they are counted.
    """
    count = queries.count() if query_rows is None else query_rows
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    if count == 1:
        # One query needs no grouping: each task keeps its best, and the best of those are taken in order.
        one = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec"))
        d = V.distance(F.col("query_vec"), F.col("vec"), metric)
        scored = stored.select(F.col(id_).alias("id"), F.col(vec).alias("vec")).crossJoin(F.broadcast(one)).select("query_id", "id", (d if places is None else F.round(d, places)).alias("distance"))
        return scored.orderBy("distance", "id").limit(n).select("query_id", (rank - 1).alias("rank"), "id", "distance")
    blocks = max(1, -(-count // block_rows))
    side = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    asked, rows = queries.select(F.col(query_id).alias("query_id"), F.col(query_vec).alias("query_vec")), stored.select(F.col(id_).alias("id"), F.col(vec).alias("vec"))
    if blocks > 1:
        asked, rows = kept(asked), kept(rows)
    parts = []
    for k in range(blocks):
        found = best(met_in_batches(asked.where(side == k), rows, n, metric, places), rank, n).select("query_id", "rank", "id", "distance")
        parts.append(found if blocks == 1 else kept(found))
    return reduce(DataFrame.unionByName, parts)


def counted(docs: DataFrame, id_: Column, text: Column, order: Column) -> DataFrame:
    """The different search tokens of each text and how often it has them: ``id``, ``ord``, ``dl`` (tokens in all), ``tokens``, ``tf``.

    Texts are cut in the tasks, a bounded slice at a time.
    """
    bytes_ = SLICE

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            ends, at = np.cumsum(pc.binary_length(frame.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < frame.num_rows:
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + bytes_, "right")))
                part = frame.slice(at, stop - at)
                at = stop
                found, size = words(part.column("text"))
                coded = found.dictionary_encode()
                many = max(1, len(coded.dictionary))
                key, tf = np.unique(np.repeat(np.arange(len(size)), size) * many + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                begin = np.searchsorted(key, np.arange(len(size) + 1) * many)
                tokens = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), coded.dictionary.take(pa.array(key % many)))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("ord"), pa.array(size), tokens, lists(tf, begin)], names=["id", "ord", "dl", "tokens", "tf"])

    rows = docs.select(id_.alias("id"), order.alias("ord"), F.lower(text).alias("text"))
    types = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {types['id']}, ord {types['ord']}, dl long, tokens array<string>, tf array<int>")


def term_statistics(docs: DataFrame) -> tuple[DataFrame, int, float, float]:
    """Of ``counted``: Okapi weights (``term``, ``idf``), the number of documents, their mean length, and the mean weight.

    Negative weights become a quarter of the mean before that. One pass counts the documents of each term, first in the
    tasks, and, in a row of its own, documents and lengths; its result, a row per term, is kept for the caller's join.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part in slices(frame, frame.num_rows, ENTRIES):
                met = part.column("tokens").flatten().value_counts()
                terms, df = (pa.concat_arrays([met.field(k).cast(t), pa.array([x], t)]) for k, t, x in ((0, pa.string(), None), (1, pa.int64(), part.num_rows)))
                yield pa.RecordBatch.from_arrays([terms, df, pa.array(np.append(np.zeros(len(met), np.int64), pc.sum(part.column("dl")).as_py()))], names=["term", "df", "dl"])

    rows = docs.select("dl", "tokens").mapInArrow(run, "term string, df long, dl long")
    counts = rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl")).persist()
    whole = counts.where("term is null").first()
    n, length = (whole["df"], whole["dl"]) if whole else (0, 0)
    raw = counts.where("term is not null").withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", F.when(F.col("raw") < 0, F.lit(EPSILON * mean)).otherwise(F.col("raw")).alias("idf")), n, (length / n if length else 1.0), mean


def scored_in_batches(asked: DataFrame, queries: DataFrame, docs: DataFrame, n: int, avgdl: float, places: int | None) -> DataFrame:
    """The ``n`` best documents of each task for each query of one block: ``query_id``, ``id``, ``ord``, ``score``.

    asked: ``query_id``, ``term``, ``weight``; it and the block's ``queries`` (``query_id``) are collected and travel to the tasks.
    docs: ``id``, ``ord``, ``tokens``, and where these are counted already ``dl`` and ``tf``. A slice of documents and the block are two sparse matrices; terms that many of both
    have are multiplied as dense ones. No score leaves the task but those of its best, documents that score 0 included.
    """
    known = queries.toArrow().column(0).combine_chunks()
    weights, cells, entries = Weights(asked, known, PAIRS, DENSE), CELLS, ENTRIES
    slack = 0.0 if places is None else 10.0**-places

    def parts(frame: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The entries of a slice, by document: the number of the term, that of the document, the part of the weight."""
        size = frame.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        code, doc = weights.code(frame.column("tokens").flatten()), np.repeat(np.arange(len(size)), size)
        held = code >= 0
        code, doc = code[held], doc[held]
        if "tf" in frame.schema.names:
            size, tf = frame.column("dl").to_numpy(), frame.column("tf").flatten().to_numpy(zero_copy_only=False)[held].astype(float)
        else:
            many = max(1, len(weights.vocabulary))
            key, tf = np.unique(doc * many + code, return_counts=True)
            code, doc = key % many, key // many
        return code, doc, tf * (K1 + 1) / (tf + (K1 * (1 - B + B * size / avgdl))[doc])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_, step = Best(len(known), n), max(1, cells // max(1, len(known)))
        for frame in frames if len(known) else ():
            for whole in slices(frame, frame.num_rows, entries):
                code, doc, part = parts(whole)
                for at in range(0, whole.num_rows, step):
                    few = whole.slice(at, step)
                    its = slice(*np.searchsorted(doc, [at, at + few.num_rows]))
                    found = weights.added(code[its], doc[its] - at, part[its], few.num_rows).T
                    exact = lambda query, hit, found=found: found[hit, query] if places is None else np.round(found[hit, query], places)
                    best_.offer(found, slack, exact, few.column("id"), few.column("ord"))
        found = best_.settle()
        if found is not None:
            yield from found.set_column(0, "query_id", known.take(found.column("query").combine_chunks())).to_batches(10_000)

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, f"query_id {dict(queries.dtypes)['query_id']}, id {types['id']}, ord {types['ord']}, score double")


def slices(frame: pa.RecordBatch, most: int, tokens: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows and, but for a single longer row, ``tokens``."""
    sizes, at = np.cumsum(frame.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < frame.num_rows:
        stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + tokens, "right")))
        part = frame.slice(at, min(stop - at, most))
        yield part
        at += part.num_rows


def bm25_top(queries: DataFrame, docs: DataFrame, n: int = 5, id_: str = "id", text: str = "document", order: str | None = None, query_id: str = "query_id", query: str = "query", places: int | None = None, block_rows: int = 5000, block_terms: int = 1_500_000) -> DataFrame:
    """The ``n`` best documents for each query by BM25: ``query_id``, ``rank`` (from 0), ``id``, ``score``.

    A term counts as often as the query repeats it. Statistics cover all documents. Documents without a query term score
    0; ties keep the order of ``order`` (insertion order of the store; by default ``id_``). places: rounds scores before
    ranking. Texts are cut into tokens once, and what is counted of them is kept. Queries are a stated set and go to the documents in blocks of about ``block_rows`` queries and
    ``block_terms`` terms of theirs; of several, the result of each is kept before the next. A task sends on its ``n`` best a query.
    """
    rows = kept(counted(docs, F.col(id_), F.col(text), F.col(order or id_)))
    weights, _, avgdl, _ = term_statistics(rows)
    ids = queries.select(F.col(query_id).alias("query_id")).distinct()
    asking = counted(queries, F.col(query_id), F.col(query), F.lit(0)).select(F.col("id").alias("query_id"), F.inline(F.arrays_zip("tokens", "tf")).alias("term", "tf"))
    times = asking.groupBy("query_id", "term").agg(F.sum("tf").alias("times"))
    asked = kept(times.join(weights, "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")))
    blocks = max(1, -(-ids.count() // block_rows), -(-asked.count() // block_terms))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    parts = []
    for k in range(blocks):
        mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k
        found = best(scored_in_batches(asked.where(mine), ids.where(mine), rows, n, avgdl, places), rank, n).select("query_id", "rank", "id", "score")
        parts.append(found if blocks == 1 else kept(found))
    if blocks > 1:
        discard(rows)
    return reduce(DataFrame.unionByName, parts)


def fuse(vectors: DataFrame, keywords: DataFrame, n: int = 5, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists a query: ``query_id``, ``rank``, ``id``, ``score``, ``distance``.

    A hit's score sums 1 / (k + rank), ranks from 0, over the lists that have it. Ties: the better vector rank, then
    the better keyword rank, then the id. A hit of the keyword list alone has distance 0.
    """
    a = vectors.select("query_id", "id", F.col("rank").alias("vec_rank"), "distance")
    b = keywords.select("query_id", "id", F.col("rank").alias("key_rank"))
    both = a.join(b, ["query_id", "id"], "full_outer")
    share = lambda c: F.coalesce(1.0 / (F.lit(k) + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", share("vec_rank") + share("key_rank")).withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    order = [F.desc("score"), F.asc_nulls_last("vec_rank"), F.asc_nulls_last("key_rank"), F.asc("id")]
    return best(scored, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)), n).select("query_id", "rank", "id", "score", "distance")


def search(queries: DataFrame, chunks: DataFrame, n: int = 5, hybrid: bool = False, candidates: int = 3, k: int = 60, metric: str = "l2", make=V.HashEmbedder, order: str | None = None, places: int | None = None, keywords: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Searches stored ``chunks`` (``id``, ``document``, ``embedding``, more) for ``queries`` (``query_id``, ``query``).

    A column ``embed_text``, where it is there and not empty, is embedded in place of the query; keywords always come
    from the query. With ``hybrid`` both rankings are fused, over ``candidates`` times ``n`` hits each. Returns
    ``query_id``, ``rank`` (from 0), ``id``, ``distance`` and, with ``hybrid``, ``score``. keywords: ranks by keywords in
    place of ``bm25_top``, from queries and the number of hits (a stored index).
    """
    text = F.coalesce(F.nullif(F.col("embed_text"), F.lit("")), F.col("query")) if "embed_text" in queries.columns else F.col("query")
    asked = queries.select("query_id", "query", V.embed(text, make).alias("query_vec"))
    if not hybrid:
        return nearest(asked, chunks, n, metric, places=places)
    wide = candidate_count(n, candidates, chunks.count())
    found = nearest(asked, chunks, wide, metric, places=places)
    words = keywords(queries, wide) if keywords else bm25_top(queries, chunks, wide, order=order, places=places)
    return fuse(found, words, n, k)
