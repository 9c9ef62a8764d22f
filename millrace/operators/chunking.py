"""Chunking: ordered sentences become chunks with the number of their first sentence."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from millrace.functions import text as T
from millrace.functions import vectors as V

RANGES = ArrayType(StructType([StructField("start", IntegerType()), StructField("stop", IntegerType())]))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row."""
    return F.get(F.transform(F.array(value), body), 0)


def sentence_windows(sents: Column, size: int = 40, overlap: int = 5) -> Column:
    """Windows of ``size`` sentences, each ``size - overlap`` after the last, as an array of chunks.

    Every start below the number of sentences gives a chunk, even one that the chunk before holds whole.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")
    step = size - overlap

    def windows(s: Column) -> Column:
        starts = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct((i / step).cast("int").alias("chunk_id"), F.array_join(F.slice(s, i + 1, F.lit(size)), " ").alias("text"), i.alias("first_sentence")))

    return let(sents, windows)


def stripped(sents: Column) -> Column:
    return F.filter(F.transform(sents, T.strip), lambda s: s != "")


def contexts(sents: Column, buffer: int = 1) -> Column:
    """Each sentence joined with up to ``buffer`` neighbours on either side."""
    if buffer <= 0:
        return sents
    return let(sents, lambda s: F.transform(s, lambda x, i: F.array_join(F.slice(s, F.greatest(i - buffer, F.lit(0)) + 1, F.least(F.size(s) - 1, i + buffer) - F.greatest(i - buffer, F.lit(0)) + 1), " ")))


@F.arrow_udf(RANGES)
def budget_ranges(counts: pa.Array, most: pa.Array, overlap: pa.Array) -> pa.Array:
    starts, stops, ends = array("i"), array("i"), array("i", [0])
    for cell, budget, shared in zip(counts, most.to_pylist(), overlap.to_pylist()):
        row = cell.as_py() or []
        i, n = 0, len(row)
        while i < n:
            j, used = i + 1, row[i]
            while j < n and used + row[j] <= budget:
                used += row[j]
                j += 1
            starts.append(i)
            stops.append(j)
            k, back = j, 0
            while k - 1 > i and back + row[k - 1] <= shared:
                k -= 1
                back += row[k]
            i = k if shared > 0 else j
        ends.append(len(starts))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=["start", "stop"]))


def token_chunks(sents: Column, most: int = 512, overlap: int = 50, count: Callable[[Column], Column] = T.token_estimate, drop_tail_repeats: bool = False, counts: Callable[[Column], Column] | None = None) -> Column:
    """Chunks of sentences within a token budget, as an array.

    Sentences are stripped, blank ones dropped. A chunk takes sentences while they fit ``most``, at least one; the next
    starts with as many of its last sentences as fit ``overlap``, but after its first. So the tail of a document is given
    again in ever shorter chunks while it fits the overlap; ``drop_tail_repeats`` leaves out chunks that the one before
    holds whole. count: the tokens of a sentence; counts: those of an array of sentences, in its place (as
    ``encodings.exact_counts`` gives).
    """

    def cut(s: Column) -> Column:
        ranges = budget_ranges(counts(s) if counts else F.transform(s, count), F.lit(most), F.lit(overlap))
        return let(ranges, lambda r: F.filter(r, lambda x, i: (i == 0) | (x["stop"] > F.get(r, i - 1)["stop"])) if drop_tail_repeats else r)

    clean = stripped(sents)
    joined = F.struct(clean.alias("s"), cut(clean).alias("r"))
    return let(joined, lambda x: F.transform(x["r"], lambda r, i: F.struct(i.alias("chunk_id"), F.array_join(F.slice(x["s"], r["start"] + 1, r["stop"] - r["start"]), " ").alias("text"), r["start"].alias("first_sentence"))))


def embedded_sentences(docs: DataFrame, sents: str = "sentences", id_: str = "doc_id", buffer: int = 1, make: Callable[[], V.Embedder] = V.HashEmbedder) -> DataFrame:
    """A row per non-blank sentence, stripped: ``id_``, ``pos``, ``sentence``, ``vec`` of its context."""
    clean = docs.select(id_, stripped(F.col(sents)).alias("s"))
    pairs = F.arrays_zip(F.col("s").alias("sentence"), contexts(F.col("s"), buffer).alias("context"))
    rows = clean.select(id_, F.posexplode(pairs).alias("pos", "x")).select(id_, "pos", F.col("x.sentence").alias("sentence"), F.col("x.context").alias("context"))
    return rows.select(id_, "pos", "sentence", V.embed(F.col("context"), make).alias("vec"))


def adjacent_distances(rows: DataFrame, id_: str = "doc_id", pos: str = "pos", vec: str = "vec") -> DataFrame:
    """``rows`` with ``distance``, the cosine distance to the next row of the same ``id_``; null at the last."""
    after = F.lead(vec).over(Window.partitionBy(id_).orderBy(pos))
    return rows.withColumn("_after", after).withColumn("distance", F.when(F.col("_after").isNotNull(), V.cosine_distance(F.col(vec), F.col("_after")))).drop("_after")


def ordered_distances(rows: DataFrame, id_: str, pos: str, vec: str = "vec") -> DataFrame:
    """``adjacent_distances`` where few ids hold many rows each: ``pos`` is not null and unique within an id.

    Rows are range-partitioned by both, so an id spreads over tasks; what ends a partition meets the first row of the
    next one. Only the partitions' first places, as many as there are partitions, pass through the driver.
    """
    # Kept, as range bounds are drawn from a sample and both uses must see the same partitions.
    placed = rows.repartitionByRange(F.col(id_), F.col(pos)).withColumn("_part", F.spark_partition_id()).persist()
    order = Window.partitionBy("_part").orderBy(id_, pos)
    here = F.struct(F.col(id_).alias("i"), F.col(vec).alias("v"))
    heads = placed.groupBy("_part").agg(F.min_by(here, F.struct(id_, pos)).alias("_head"))
    parts = sorted(r["_part"] for r in heads.select("_part").collect())
    before = rows.sparkSession.createDataFrame(list(zip(parts[1:], parts)), "_part int, _before int")
    closing = heads.join(F.broadcast(before), "_part").select(F.col("_before").alias("_part"), "_head")
    found = placed.withColumn("_inside", F.lead(here).over(order)).join(F.broadcast(closing), "_part", "left").withColumn("_next", F.coalesce("_inside", "_head"))
    same = F.col("_next.i").eqNullSafe(F.col(id_)) & F.col("_next").isNotNull()
    return found.withColumn("distance", F.when(same & F.col("_next.v").isNotNull(), V.cosine_distance(F.col(vec), F.col("_next.v")))).drop("_part", "_inside", "_head", "_next")


def context_distances(found: Column, make: Callable[[], V.Embedder] = V.HashEmbedder, batch: int = 64) -> Column:
    """For each text of an array, the cosine distance of its vector to the next one's; null at the last.

    A document is one row and stays where it is: vectors are made and compared in the task and never leave it.
    """

    @F.arrow_udf("array<double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make()
        for column in columns:
            ends, texts = np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)), column.flatten()
            out, last = np.full(len(texts), np.nan), None
            # Only a batch of texts and vectors is held as Python objects, and the vector before it.
            for i in range(0, len(texts), batch):
                made = np.asarray(embedder([t or "" for t in texts.slice(i, batch).to_pylist()]), float)
                vectors = made if last is None else np.concatenate([last, made])
                length = np.linalg.norm(vectors, axis=1)
                length[length == 0] = V.TINY
                at = i + len(made) - len(vectors)
                out[at : i + len(made) - 1] = 1 - np.einsum("ij,ij->i", vectors[:-1], vectors[1:]) / (length[:-1] * length[1:])
                last = made[-1:]
            closing = np.zeros(len(texts), bool)
            closing[ends[ends > 0] - 1] = True
            yield pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out, pa.float64(), mask=closing))

    return run(found)


def with_distances(docs: DataFrame, sents: str = "sentences", id_: str = "doc_id", buffer: int = 1, make: Callable[[], V.Embedder] = V.HashEmbedder) -> DataFrame:
    """A row per document: ``id_``, ``sents`` (stripped, blank ones dropped), made once a row, and their ``distances``."""
    clean = docs.select(id_, F.explode(F.array(stripped(F.col(sents)))).alias("sents"))
    around = clean.select(id_, "sents", F.explode(F.array(contexts(F.col("sents"), buffer))).alias("around"))
    return around.select(id_, "sents", context_distances(F.col("around"), make).alias("distances"))


def percentile_of(values: Column, percentile: float) -> Column:
    """The interpolated percentile of an array's numbers; null without any."""
    known = F.sort_array(F.filter(values, lambda v: v.isNotNull()))

    def between(v: Column) -> Column:
        at = (F.size(v) - 1) * F.lit(percentile / 100)
        low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        return F.when(F.size(v) > 0, low + (high - low) * (at - F.floor(at)))

    return let(known, between)


def semantic_breaks(sents: Column, distances: Column, percentile: float = 95, places: int | None = None) -> Column:
    """For each of ``sents`` (stripped, none blank) a struct of ``pos``, ``sentence``, ``distance`` and ``breaks``: whether a chunk ends here.

    distances: as ``context_distances`` gives them. The threshold is the interpolated percentile of the document's
    distances; only larger ones break. places: rounds distance and threshold first, so that other engines' last digits
    change nothing.
    """
    rounded = (lambda c: c) if places is None else lambda c: F.round(c, places)

    def marked(x: Column) -> Column:
        found = F.transform(x["d"], rounded)
        return let(
            F.struct(found.alias("d"), rounded(percentile_of(found, percentile)).alias("limit")),
            lambda y: F.transform(x["s"], lambda s, i: F.struct(i.alias("pos"), s.alias("sentence"), F.get(y["d"], i).alias("distance"), F.coalesce(F.get(y["d"], i) > y["limit"], F.lit(False)).alias("breaks"))),
        )

    return let(F.struct(sents.alias("s"), distances.alias("d")), marked)


def semantic_chunks(sents: Column, distances: Column, percentile: float = 95, max_sentences: int = 0, places: int | None = None) -> Column:
    """Chunks of ``sents`` that end at semantic breaks, as an array (``chunk_id``, ``text``, ``first_sentence``, ``n_sentences``).

    max_sentences above 0 cuts longer chunks every so many sentences.
    """

    def chunks(rows: Column) -> Column:
        starts = F.transform(F.filter(rows, lambda r: (r["pos"] == 0) | F.get(rows, r["pos"] - 1)["breaks"]), lambda r: r["pos"])
        if max_sentences > 0:
            starts = let(starts, lambda a: F.flatten(F.transform(a, lambda b, j: F.sequence(b, F.coalesce(F.get(a, j + 1), F.size(rows)) - 1, F.lit(max_sentences)))))
        text = F.transform(rows, lambda r: r["sentence"])

        def chunk(a: Column, begin: Column, j: Column) -> Column:
            n = F.coalesce(F.get(a, j + 1), F.size(rows)) - begin
            return F.struct(j.alias("chunk_id"), F.array_join(F.slice(text, begin + 1, n), " ").alias("text"), begin.alias("first_sentence"), n.alias("n_sentences"))

        return let(starts, lambda a: F.transform(a, lambda begin, j: chunk(a, begin, j)))

    return let(semantic_breaks(sents, distances, percentile, places), chunks)


def create_chunks(docs: DataFrame, method: str = "sentence", sents: str = "sentences", id_: str = "doc_id", size: int = 40, overlap: int = 5, make: Callable[[], V.Embedder] | None = None, percentile: float = 95, buffer: int = 1, max_sentences: int = 0, token_size: int = 512, token_overlap: int = 50, counts: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks of ``docs`` by ``sentence``, ``semantic`` or ``token``: ``id_``, ``chunk_id``, ``text``, ``first_sentence``.

    counts: exact token counts of arrays of sentences; without it they are estimated.
    """
    if method == "semantic":
        if make is None:
            raise ValueError("semantic chunking needs an embedder")
        rows = with_distances(docs, sents, id_, buffer, make)
        return rows.select(id_, F.inline(semantic_chunks(F.col("sents"), F.col("distances"), percentile, max_sentences))).drop("n_sentences")
    return docs.select(id_, F.inline(chunk_arrays(F.col(sents), method, size, overlap, token_size, token_overlap, counts)))


def chunk_arrays(sents: Column, method: str = "sentence", size: int = 40, overlap: int = 5, token_size: int = 512, token_overlap: int = 50, counts: Callable[[Column], Column] | None = None) -> Column:
    """The chunks of a document's sentences by ``sentence`` or ``token``, as an array."""
    if method == "sentence":
        return sentence_windows(sents, size, overlap)
    if method == "token":
        return token_chunks(sents, token_size, token_overlap, counts=counts)
    raise ValueError(f"unknown chunking method: {method}")


def first_sentence_metadata(chunks: DataFrame, docs: DataFrame, records: str = "records", id_: str = "doc_id") -> DataFrame:
    """``chunks`` with ``page_number`` and ``section_title`` of their first sentence.

    docs: ``id_`` and ``records``, an array of structs (text, page_number, section_title); a number beyond its end takes
    the last.
    """
    known = docs.select(id_, F.col(records).alias("_records"))
    first = F.get(F.col("_records"), F.least(F.col("first_sentence"), F.size("_records") - 1))
    return chunks.join(known, id_, "left").withColumn("_first", first).withColumns({"page_number": F.col("_first.page_number"), "section_title": F.col("_first.section_title")}).drop("_records", "_first")
