"""A stored inverted index: postings by term and cell of documents, statistics that add up, top-k by bounds of cells."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.operators.ordering import discard, kept, numbered
from millrace.operators.tables import Change, Log, Table, Version

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Divisions of the terms by hash. Within one, files are sorted by term, so a reader skips most of what it does not ask for.
BUCKETS = 16
#: So many query terms are also given to the scan as a filter.
FILTERED = 1000
#: Finer divisions, a multiple of the buckets: within one, a cell's rarer terms are one row.
SLOTS = 256
#: Bytes of text that are laid out together, or one document.
SLICE = 6_000_000
#: A term that so many documents of a cell have is a row of its own there.
ALONE = 64
#: Products of single entries made at once; a term is dense where one in so many pairs of query and document has it.
PAIRS, DENSE = 50_000, 250
#: A cell is a group of documents; postings name a document by its place in its cell. Rows of bucket -1 are the cells: the documents' ids and lengths.
#: Other rows have ``terms`` of a cell: ``n`` documents each, with the greatest count and the least length, from ``start`` in the lists ``at`` and ``tf``.
POSTINGS = "collection string, bucket int, slot int, term string, cell string, terms array<string>, start array<int>, n array<int>, most array<int>, least array<int>, at array<int>, tf array<int>, ids array<string>, dl array<int>"
TABLES = {
    "postings": Table(POSTINGS, ("collection", "bucket"), masked=("id", "cell", "ids")),
    "terms": Table("collection string, bucket int, term string, df long", ("collection", "bucket"), added="df"),
    "spread": Table("collection string, df long, terms long", added="terms"),
    "corpus": Table("collection string, what string, total long", added="total"),
}
CELLS = "bucket = -1"
CELL = "collection string, cell string, terms array<string>, n array<int>, most array<int>, least array<int>, at array<int>, tf array<int>, ids array<string>, dl array<int>"


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def slot(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in columns], axis=0)))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The search tokens (``text.tokens``) of lower-cased texts one after another, and the number of each text's."""
    found = pc.utf8_split_whitespace(texts.fill_null(""))
    flat, size = found.flatten(), found.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return flat.filter(real), np.diff(upto[np.append(0, np.cumsum(size))])


def built(chunks: DataFrame, cell_docs: int) -> DataFrame:
    """Cells and postings of ``chunks`` (``collection``, ``id``, ``document``), made where the chunks are read, without a shuffle.

    Of each batch of documents (bounded by their tokens), those of like length make a cell of ``cell_docs`` at most, so a cell's bounds are close.
    A cell is a row (``ids``, ``dl``). Its postings are a row for each slot, and one for each term (``term``, else null)
    that many of its documents have: so rows are few, where most terms are in a document or two of a cell. Places (``at``) ascend.
    """
    slice_, alone_from = SLICE, ALONE
    texts = chunks.select("collection", "id", F.lower("document").alias("text"))

    def laid(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell, with all its terms."""
        for frame in frames:
            # A token and the space after it are two bytes at least, and about seven.
            sizes, at = np.cumsum(pc.binary_length(frame.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < frame.num_rows:
                stop = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + slice_, "right")))
                part = frame.slice(at, min(stop - at, 4 * cell_docs))
                at += part.num_rows
                names = part.column("collection").to_pylist()
                for name in sorted(set(names)):
                    yield block(name, part.filter(pa.array([n == name for n in names])))

    def block(name: str, part: pa.RecordBatch) -> pa.RecordBatch:
        tokens, size = words(part.column("text"))
        order = np.argsort(size, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        cells = -(-len(order) // cell_docs)
        coded = tokens.dictionary_encode()
        spot, many = np.repeat(place, size), max(1, len(coded.dictionary))
        key, tf = np.unique((spot // cell_docs * many + coded.indices.to_numpy(zero_copy_only=False)) * cell_docs + spot % cell_docs, return_counts=True)
        at, group = key % cell_docs, key // cell_docs
        first = changes(group)
        cell, term = group[first] // many, group[first] % many
        dl = size[order][group // many * cell_docs + at]
        ends_ = np.minimum(np.arange(cells + 1) * cell_docs, len(order))
        heads = np.searchsorted(cell, np.arange(cells + 1))
        bodies = np.append(first, len(key))[heads]
        most = np.maximum.reduceat(tf, first) if len(first) else first
        least = np.minimum.reduceat(dl, first) if len(first) else first
        columns = [
            pa.array([name] * cells), pa.array([uuid.uuid4().hex[:16] for _ in range(cells)]), pa.ListArray.from_arrays(pa.array(heads, pa.int32()), coded.dictionary.take(pa.array(term))),
            *[lists(v, heads) for v in (np.diff(np.append(first, len(key))), most, least)], *[lists(v, bodies) for v in (at, tf)],
            pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), part.column("id").take(pa.array(order))), lists(size[order], ends_),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in CELL.split(", ")])

    def divided(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each cell's row, and its terms by slot."""
        for frame in frames:
            for k in range(frame.num_rows):
                yield rows(frame.slice(k, 1))

    def rows(whole: pa.RecordBatch) -> pa.RecordBatch:
        flat = {c: whole.column(c).flatten() for c in ("terms", "slots", "n", "most", "least", "at", "tf", "ids", "dl")}
        slot, n, most, least, at, tf = (flat[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("slots", "n", "most", "least", "at", "tf"))
        alone = np.where(n >= alone_from, 1 + np.arange(len(n)), 0)
        by = np.lexsort((alone, slot))
        begin, n = (np.cumsum(n) - n)[by], n[by]
        row = changes(slot[by], alone[by])
        entry = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(at))
        heads, upto = np.append(row, len(n)), np.append(0, np.cumsum(n))
        start = upto[:-1] - np.repeat(upto[row], np.diff(heads))
        terms, k = flat["terms"].take(pa.array(by)), len(row)
        ints, texts_, one = pa.list_(pa.int32()), pa.list_(pa.string()), [0, len(flat["ids"])]
        both = lambda x, y: pa.concat_arrays([x, y])
        columns = [
            pa.array(whole.column("collection").to_pylist() * (k + 1)), pa.array(np.append(slot[by][row] % BUCKETS, -1), pa.int32()), both(pa.array(slot[by][row], pa.int32()), pa.nulls(1, pa.int32())),
            both(pc.if_else(pa.array(alone[by][row] > 0, pa.bool_()), terms.take(pa.array(row)), pa.scalar(None, pa.string())), pa.nulls(1, pa.string())), pa.array(whole.column("cell").to_pylist() * (k + 1)),
            both(pa.ListArray.from_arrays(pa.array(heads, pa.int32()), terms), pa.nulls(1, texts_)), *[both(lists(v, heads), pa.nulls(1, ints)) for v in (start, n, most[by], least[by])],
            *[both(lists(v[entry], upto[heads]), pa.nulls(1, ints)) for v in (at, tf)],
            both(pa.nulls(k, texts_), pa.ListArray.from_arrays(pa.array(one, pa.int32()), flat["ids"])), both(pa.nulls(k, ints), pa.ListArray.from_arrays(pa.array(one, pa.int32()), flat["dl"])),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTINGS.split(", ")])

    return texts.mapInArrow(laid, CELL).withColumn("slots", F.transform("terms", slot)).mapInArrow(divided, POSTINGS)


def totals(made: DataFrame, sign: int) -> tuple[DataFrame, DataFrame]:
    """Of cells and postings: documents and words of each collection, and documents of each term, as differences."""
    words = F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x)
    whole = made.where(CELLS).select("collection", F.inline(F.array(F.struct(F.lit("docs").alias("what"), F.size("ids").cast("long").alias("total")), F.struct(F.lit("words").alias("what"), words.alias("total")))))
    terms = made.where(f"not {CELLS}").select("collection", "bucket", F.inline(F.arrays_zip("terms", "n")).alias("term", "n"))
    return whole.withColumn("total", sign * F.col("total")), terms.select("collection", "bucket", "term", (sign * F.col("n")).cast("long").alias("df"))


def update(change: Change, added: DataFrame, removed: DataFrame | None = None, cell_docs: int = 1024, task_bytes: int = 16_000_000) -> None:
    """Brings the index to what a change makes of its store: ``added`` chunks and ``removed`` ones (``collection``, ``id``, ``document``).

    The caller removes the same ids from the store. Postings are written where the chunks are read, without a shuffle, to
    buckets by their term's hash, first those of several terms by slot, then those of one by term. So that a bucket's files are few, tasks read about ``task_bytes`` of what the change has written so far. Document counts of terms, and
    the number of terms of each count, are changed by differences. A null document has no tokens.
    """
    log, base = change.log, change.base
    size = sum(p["bytes"] for p in change.parts if p["seq"] == change.seq)
    tasks = max(log.spark.sparkContext.defaultParallelism, size // task_bytes)
    new = change.add("postings", built(added.coalesce(tasks), cell_docs).sortWithinPartitions("collection", "bucket", "term", "slot", "cell"))
    corpus, terms = totals(new, 1)
    if removed is not None:
        gone = kept(built(removed, cell_docs).select("collection", "bucket", "terms", "n", "ids", "dl"))
        less, fewer = totals(gone, -1)
        corpus, terms = corpus.unionByName(less), terms.unionByName(fewer)
    change.add("corpus", corpus.groupBy("collection", "what").agg(F.sum("total").alias("total")))
    counts = terms.groupBy("collection", "bucket", "term").agg(F.sum("df").alias("df")).where("df <> 0")
    # A file a bucket: there are as many rows as different terms.
    delta = change.add("terms", counts.repartition("collection", "bucket").sortWithinPartitions("collection", "bucket", "term"))
    before = log.read("terms", base).select("collection", "bucket", "term", F.col("df").alias("old"))
    met = delta.join(before, ["collection", "bucket", "term"], "left").select("collection", F.coalesce("old", F.lit(0)).alias("old"), "df")
    moves = met.select("collection", F.inline(F.array(F.struct(F.col("old").alias("df"), F.lit(-1).alias("terms")), F.struct((F.col("old") + F.col("df")).alias("df"), F.lit(1).alias("terms")))))
    change.add("spread", moves.where("df > 0").groupBy("collection", "df").agg(F.sum("terms").alias("terms")).where("terms <> 0"))
    if removed is not None:
        discard(gone)


def saturation(tf: Column, dl: Column, avgdl: float) -> Column:
    """The part of a term's weight that its count gives; it grows with ``tf`` and falls with ``dl``."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(avgdl)))


def ends(column: pa.Array) -> np.ndarray:
    """Where the lists of a column begin and end, counted from its first."""
    return np.append(0, np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))


class Weights:
    """A block of queries, as it travels to the tasks: the weights of ``asked`` (``query_id``, ``term``, ``weight``), collected, by term.

    queries: the ids, all that may be asked for (by default those of ``asked``).
    """

    def __init__(self, asked: DataFrame, queries: pa.Array | None = None, pairs: int = PAIRS, dense: int = DENSE):
        met = asked.toArrow()
        self.queries = pc.unique(met.column("query_id").combine_chunks()) if queries is None else queries
        coded = met.column("term").combine_chunks().dictionary_encode()
        self.vocabulary, term = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        by_term = np.argsort(term, kind="stable")
        self.ask = self.number(met.column("query_id").combine_chunks())[by_term]
        self.weight = met.column("weight").to_numpy()[by_term]
        self.begin = np.searchsorted(term[by_term], np.arange(len(self.vocabulary) + 1))
        self.pairs, self.dense = pairs, dense

    def number(self, ids: pa.Array) -> np.ndarray:
        return pc.index_in(ids, value_set=self.queries).to_numpy(zero_copy_only=False).astype(np.int64)

    def code(self, terms: pa.Array) -> np.ndarray:
        """The terms' numbers, -1 for those that no query has."""
        return pc.index_in(terms, value_set=self.vocabulary).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

    def only(self, chosen: np.ndarray) -> Weights:
        """The same of some queries, by number, which are numbered anew in their order."""
        place = np.full(len(self.queries), -1)
        place[chosen] = np.arange(len(chosen))
        mine = place[self.ask] >= 0
        few = copy(self)
        few.queries, few.ask, few.weight = self.queries.take(pa.array(chosen)), place[self.ask[mine]], self.weight[mine]
        few.begin = np.append(0, np.cumsum(mine))[self.begin]
        return few

    def added(self, code: np.ndarray, doc: np.ndarray, part: np.ndarray, docs: int) -> np.ndarray:
        """The scores of each query and each of ``docs`` documents, from entries: a term's number, a document's, the part of the weight.

        Both are sparse matrices; terms that many of both have are multiplied as dense ones. A document's scores lie
        together and its entries are added up one document after another, so that sums stay near.
        """
        many = len(self.queries)
        ask, weight, begin = self.ask, self.weight, self.begin
        held = code >= 0
        code, doc, part = code[held], doc[held], part[held]
        if np.any(doc[1:] < doc[:-1]):
            by = np.argsort(doc, kind="stable")
            code, doc, part = code[by], doc[by], part[by]
        times = begin[code + 1] - begin[code]
        count = np.bincount(code, minlength=len(self.vocabulary))
        dense = np.flatnonzero(count * np.diff(begin) * self.dense > docs * many)
        if len(dense):
            place = np.full(len(self.vocabulary), -1)
            place[dense] = np.arange(len(dense))
            left, right = np.zeros((many, len(dense))), np.zeros((docs, len(dense)))
            n_ = begin[dense + 1] - begin[dense]
            its = np.repeat(begin[dense] - (np.cumsum(n_) - n_), n_) + np.arange(n_.sum())
            left[ask[its], np.repeat(np.arange(len(dense)), n_)] = weight[its]
            thick = place[code] >= 0
            right[doc[thick], place[code[thick]]] = part[thick]
            out = right @ left.T
            code, doc, part, times = code[~thick], doc[~thick], part[~thick], times[~thick]
        else:
            out = np.zeros((docs, many))
        flat, upto = out.reshape(-1), np.cumsum(times)
        at = 0
        while at < len(code):
            stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + self.pairs, "right")))
            n_ = times[at:stop]
            entry = np.repeat(begin[code[at:stop]] - (np.cumsum(n_) - n_), n_) + np.arange(n_.sum())
            first, last = doc[at], doc[stop - 1] + 1
            key = ask[entry] + np.repeat((doc[at:stop] - first) * many, n_)
            flat[first * many : last * many] += np.bincount(key, weight[entry] * np.repeat(part[at:stop], n_), (last - first) * many)
            at = stop
        return out.T


class Keywords:
    """BM25 over a collection's stored index as of one version."""

    def __init__(self, log: Log, collection: str, version: Version | None = None):
        self.log, self.collection, self.version = log, collection, version or log.version()

    def read(self, name: str, removed: bool = True) -> DataFrame:
        return self.log.read(name, self.version, removed).where(F.col("collection") == self.collection)

    def weighed(self, queries: DataFrame, query_id: str, query: str) -> DataFrame:
        """The queries' terms (``query_id``, ``term``, ``bucket``, ``weight``), repeats counted; ``self.avgdl`` and ``self.mean`` are set.

        Of counts and postings only the buckets of the queries' terms are read, and in them, if these are few, the row groups that may have one. The mean weight, which negative weights are
        replaced by a quarter of, follows from the number of terms of each count.
        """
        asked = queries.select(F.col(query_id).alias("query_id"), F.explode(T.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        asked = kept(asked.withColumn("bucket", bucket(F.col("term"))))
        self.buckets = sorted(r["bucket"] for r in asked.select("bucket").distinct().collect())
        few = asked.select("term", slot(F.col("term")).alias("slot")).distinct().limit(FILTERED + 1).collect()
        self.few, self.slots = F.lit(True), F.lit(True)
        if len(few) <= FILTERED:
            self.few, self.slots = F.col("term").isin([r["term"] for r in few]), F.col("slot").isin(sorted({r["slot"] for r in few}))
        totals = {r["what"]: r["total"] for r in self.read("corpus").collect()}
        n = totals.get("docs", 0)
        self.avgdl = totals["words"] / n if totals.get("words") else 1.0
        raw = lambda df: F.log(F.lit(n) - df + 0.5) - F.log(df + 0.5)
        self.mean = self.read("spread").agg(F.sum(F.col("terms") * raw(F.col("df"))) / F.sum("terms")).first()[0] or 0.0
        known = self.read("terms").where(F.col("bucket").isin(self.buckets) & self.few).select("term", raw(F.col("df")).alias("raw"))
        idf = F.when(F.col("raw") < 0, F.lit(EPSILON * self.mean)).otherwise(F.col("raw"))
        return kept(asked.join(known, "term").select("query_id", "term", "bucket", (F.col("times") * idf).alias("weight")))

    def postings(self, *columns: Column) -> DataFrame:
        """A row for each term of the queries' buckets and each cell, of the queries' terms alone if these are few: ``term``, ``cell`` and the named ``columns``,
        which may be the stored lists and, of the term, ``start``, ``n``, ``most`` and ``least``."""
        rows = self.read("postings", removed=False).where(F.col("bucket").isin(self.buckets) & (self.few | F.col("term").isNull() & self.slots))
        heads = F.inline(F.arrays_zip("terms", "start", "n", "most", "least")).alias("term", "start", "n", "most", "least")
        return rows.select("cell", "at", "tf", heads).where(self.few).select("term", "cell", *columns)

    def bounds(self, asked: DataFrame) -> DataFrame:
        """No document of a cell scores more than ``bound`` for a query: ``query_id``, ``cell``, ``bound``, ``blocks``, ``entries``. The lists themselves are not read."""
        part = F.greatest("weight", F.lit(0.0)) * saturation(F.col("most"), F.col("least"), self.avgdl)
        return self.postings("n", "most", "least").join(asked, "term").groupBy("query_id", "cell").agg(F.sum(part).alias("bound"), F.count("*").alias("blocks"), F.sum("n").alias("entries"))

    def scores(self, asked: DataFrame, cells: DataFrame, n: int | None, places: int | None = None, block_rows: int = 2000, block_terms: int = 1_000_000) -> DataFrame:
        """The scores (``query_id``, ``id``, ``score``) other than 0 of the documents in chosen cells (``query_id``, ``cell``) that still exist; of each cell the ``n`` best, or all.

        The queries' terms are collected, in blocks of about ``block_rows`` queries and ``block_terms`` terms of theirs (the result of each
        is kept, where there are several), and travel to the tasks. A list is shuffled once for all queries of a block that
        have its term: a cell's lists come together as they are stored and are added up for its queries there.
        """
        blocks = max(1, -(-asked.select("query_id").distinct().count() // block_rows), -(-asked.count() // block_terms))
        parts = []
        for k in range(blocks):
            mine = F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k
            found = self.scores_of_block(asked.where(mine), cells.where(mine).select("query_id", "cell"), n, places)
            parts.append(found if blocks == 1 else kept(found))
        return reduce(DataFrame.unionByName, parts)

    def scores_of_block(self, asked: DataFrame, cells: DataFrame, n: int | None, places: int | None) -> DataFrame:
        part = lambda c: F.slice(c, F.col("start") + 1, F.col("n")).alias(c)
        met = self.postings(part("at"), part("tf")).join(asked.select("term").distinct(), "term", "left_semi")
        who = cells.groupBy("cell").agg(F.collect_list("query_id").alias("who"))
        lists_ = met.join(cells.select("cell").distinct(), "cell", "left_semi").groupBy("cell").agg(F.collect_list(F.struct("term", "at", "tf")).alias("lists"))
        rows = lists_.join(who, "cell").join(self.cells(), "cell").select("lists", "who", "ids", "dl")
        weights = Weights(asked)
        avgdl = self.avgdl

        def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                lists_, who = frame.column("lists"), frame.column("who")
                inner, asks = lists_.flatten(), weights.number(who.flatten())
                code = weights.code(inner.field("term"))
                size = inner.field("at").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                at, tf = (inner.field(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "tf"))
                upto, of_list, of_who = np.append(0, np.cumsum(size)), ends(lists_), ends(who)
                for row in range(frame.num_rows):
                    ids, dl = frame.column("ids")[row].values, frame.column("dl")[row].values.to_numpy(zero_copy_only=False)
                    its = slice(of_list[row], of_list[row + 1])
                    spots = slice(upto[its.start], upto[its.stop])
                    doc, count = at[spots], tf[spots]
                    saturated = count * (K1 + 1) / (count + K1 * (1 - B + B * dl[doc] / avgdl))
                    chosen = asks[of_who[row] : of_who[row + 1]]
                    score = weights.only(chosen).added(np.repeat(code[its], size[its]), doc, saturated, len(ids))
                    score = score if places is None else np.round(score, places)
                    score[:, ids.is_null().to_numpy(zero_copy_only=False)] = 0.0
                    left = score != 0
                    if n is not None and len(ids) > n:
                        left &= score >= -np.partition(-score, n - 1, axis=1)[:, n - 1 : n]
                    ask, doc = np.nonzero(left)
                    rank = np.empty(len(ids), np.int64)
                    rank[pc.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
                    order = np.lexsort((rank[doc], -score[ask, doc], ask))
                    ask, doc = ask[order], doc[order]
                    near = slice(None) if n is None else np.arange(len(ask)) - np.searchsorted(ask, ask) < n
                    ask, doc = ask[near], doc[near]
                    yield pa.RecordBatch.from_arrays([weights.queries.take(pa.array(chosen[ask])), ids.take(pa.array(doc)), pa.array(score[ask, doc])], names=["query_id", "id", "score"])

        return rows.mapInArrow(run, f"query_id {dict(asked.dtypes)['query_id']}, id string, score double")

    def cells(self) -> DataFrame:
        """The cells' lists of ids, null where a document is gone, and of lengths (``dl``)."""
        rows = self.log.without_removed(self.read("postings", removed=False).where(CELLS).select("collection", "seq", "cell", "ids", "dl"), self.version.parts, (), self.version.cleared)
        return self.log.without_listed(rows, self.version.parts, TABLES["postings"]).select("cell", "ids", "dl")

    def ids(self) -> DataFrame:
        """The ids of all documents that still exist."""
        return self.cells().select(F.explode("ids").alias("id")).where("id is not null")

    def top(self, queries: DataFrame, n: int = 5, query_id: str = "query_id", query: str = "query", places: int | None = None, first: int = 4, prune: bool = True) -> DataFrame:
        """The ``n`` best documents for each query: ``query_id``, ``rank`` (from 0), ``id``, ``score``; ties by id.

        The ``first`` cells of the highest bounds are scored; what the n-th document of them scores is the least that
        counts, and of all other cells only those whose bound reaches it are read. The result is that of scoring all
        (``prune=False``). Documents without a query term score 0 and fill short lists up, the lowest ids first. places:
        rounds scores before ranking. ``self.work`` has the cells of each query and whether they were read.
        """
        asked = self.weighed(queries, query_id, query)
        bounds = kept(self.bounds(asked))
        slack = 1e-9 if places is None else 10.0**-places
        if prune:
            lead = bounds.withColumn("_at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "cell"))).where(F.col("_at") <= first)
            order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
            least = self.scores(asked, lead, n).withColumn("_at", order).where(F.col("_at") <= n).where(F.col("_at") == n).select("query_id", F.col("score").alias("least"))
            self.work = kept(bounds.join(least, "query_id", "left").withColumn("chosen", F.col("least").isNull() | (F.col("bound") >= F.col("least") - slack)))
        else:
            self.work = bounds.withColumn("chosen", F.lit(True))
        # Where weights are negative, a document that is left out could pass for one without the terms.
        scored = self.scores(asked, self.work.where("chosen"), None if self.mean < 0 else n, places)
        known = self.ids().select("id", F.col("id").alias("ord"))
        return filled(queries.select(F.col(query_id).alias("query_id")), scored.withColumn("ord", F.col("id")), known, n, self.mean < 0)


def filled(queries: DataFrame, scored: DataFrame, known: DataFrame, n: int, negative: bool) -> DataFrame:
    """The ``n`` best of ``scored`` (``query_id``, ``id``, ``ord``, ``score``) for each of ``queries``, filled up with documents that score 0.

    known: ``id``, ``ord`` of all documents; ties are in this order. Where no score is negative, the first ``n`` documents
    are enough to fill a list. Otherwise the first ``n`` and as many more as a query has scores hold ``n`` without one.
    """
    asked = queries.distinct()
    if negative:
        scored = kept(scored)
        known = numbered(known, [F.asc("ord")], "number")
        need = asked.join(scored.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("m", F.lit(0)) + F.lit(n - 1))).alias("number"))
        zero = need.join(known, "number").select("query_id", "id", "ord")
    else:
        zero = known.orderBy("ord").limit(n).crossJoin(asked)
    filler = zero.join(scored, ["query_id", "id"], "left_anti").withColumn("score", F.lit(0.0))
    listed = scored.select("query_id", "id", "ord", "score").unionByName(filler.select("query_id", "id", "ord", "score"))
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "ord"))
    return listed.withColumn("_at", at).where(F.col("_at") <= n).select("query_id", (F.col("_at") - 1).alias("rank"), "id", "score")
