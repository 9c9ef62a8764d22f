"""Substring dedup with a run-length compressed Burrows-Wheeler transform of the repeated regions.

Where a long repeat can be, documents share anchors: the least hashed ``GRAM`` of every window, so that equal windows
have equal anchors at equal places. Anchors that occur once are left out. The surroundings of the others are the rows of
the transform: ordered by what follows the anchor, and extended to the left one byte at a time by LF steps. Rows whose
preceding bytes are equal form runs; in a run the longest common prefix with the neighbour stays known, and only at run
ends it is sampled anew. So each row streams its matching statistics over all windows that hold its anchor, and marks
those at least as long as a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.frequent import Frequent, often, sampled_texts
from millrace.llm.recompression import rolled

U = np.uint64
GRAM = 40
BYTES = np.random.default_rng(97).integers(1, 2**63, 256, U) * U(2) + U(1)
CONTEXT = "key long, k long, th long, pos long, before int, after int, context binary"
SPAN = "k long, th long, start long, stop long"


def slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over the ``width`` values from each position on, as far as there are so many."""
    span = 1
    while 2 * span <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if width > span else values


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its count, one range after the other."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def frequent_grams(texts: list[str]) -> Frequent:
    """The grams that a sample of texts has often."""
    grams = [rolled(BYTES[np.frombuffer(t.encode(), np.uint8)], GRAM) for t in texts]
    return Frequent(np.concatenate(grams) if grams else np.empty(0, U), often(len(texts)))


def anchors(data: np.ndarray, sizes: np.ndarray, window: int, frequent: Frequent) -> tuple[np.ndarray, ...]:
    """Of concatenated documents: each anchor's hash, position, and the first and last start of the windows it stands for.

    A window's anchor is the leftmost of its grams with the least hash, frequent grams coming after all others: where a
    common passage meets other text, the anchors lie outside it or across its edge.
    """
    none = tuple(np.empty(0, t) for t in (U, np.int64, np.int64, np.int64))
    width = window - GRAM + 1
    ends = np.cumsum(sizes)
    full = np.maximum(sizes - window + 1, 0)
    if not full.any():
        return none
    grams = frequent.last(rolled(BYTES[data], GRAM)) | U(1)
    starts = spread(ends - sizes, full)
    least = np.zeros(len(grams), U)
    least[starts] = slide(grams, width, np.minimum)[starts]
    high = slide(np.concatenate([np.zeros(width - 1, U), least]), width, np.maximum)
    found = np.flatnonzero(grams == high)
    value = least[starts]
    new = np.concatenate([[True], (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)])
    first = np.flatnonzero(new)
    s0, s1, v = starts[first], starts[np.concatenate([first[1:], [len(starts)]]) - 1], value[first]
    a, b = np.searchsorted(found, s0), np.searchsorted(found, s1 + width)
    run = np.repeat(np.arange(len(s0)), b - a)
    place = found[spread(a, b - a)]
    fits = grams[place] == v[run]
    run, place = run[fits], place[fits]
    before = np.concatenate([[-1], np.where(run[1:] == run[:-1], place[:-1], -1)]) if len(run) else place
    lo, hi = np.maximum(s0[run], before + 1), np.minimum(s1[run], place)
    keep = lo <= hi
    return v[run][keep], place[keep], lo[keep], hi[keep]


def matching_spans(group: np.ndarray, right: np.ndarray, n_right: np.ndarray, left: np.ndarray, n_left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, how far before its anchor the first and after it the last byte lies of windows that another row has.

    group: the anchors' numbers; right, left: a row of bytes each from the anchor on and, backwards, before it, of which
    the first ``n_right`` and ``n_left`` count. Rows without such a window get (0, 0).
    """
    reach, end = np.zeros(len(group), np.int64), np.zeros(len(group), np.int64)
    # What is padded comes before a row that has real zeros there.
    rows = np.lexsort((n_right, np.ascontiguousarray(right).view(f"S{right.shape[1]}").ravel(), group))
    same = right[rows[1:]] == right[rows[:-1]]
    lcp = np.where(same.all(axis=1), right.shape[1], same.argmin(axis=1))
    lcp = np.minimum(lcp, np.minimum(n_right[rows[1:]], n_right[rows[:-1]]))
    lcp = np.concatenate([[0], np.where(group[rows[1:]] == group[rows[:-1]], lcp, 0)])
    for a in range(left.shape[1] + 1):
        best = np.maximum(lcp, np.concatenate([lcp[1:], [0]]))
        hit = rows[best >= window - a]
        reach[hit] = a
        end[hit] = np.maximum(end[hit], window - a)
        # Rows end where their text does, or where no other row can still reach a whole window with them.
        alive = (n_left[rows] > a) & (best > 0) & (best + n_left[rows] >= window)
        if a == left.shape[1] or not alive.any():
            break
        old = np.flatnonzero(alive)
        byte = left[rows[old], a]
        order = np.argsort(byte, kind="stable")
        old, byte = old[order], byte[order]
        new = np.zeros(len(old), lcp.dtype)
        if len(old) > 1:
            x, y = old[:-1], old[1:]
            together = byte[1:] == byte[:-1]
            inside = together & (y == x + 1)
            new[1:][inside] = lcp[y[inside]]
            ends = np.flatnonzero(together & ~inside)
            if len(ends):
                bounds = np.column_stack([x[ends] + 1, y[ends] + 1]).ravel()
                new[1:][ends] = np.minimum.reduceat(np.concatenate([lcp, [0]]), bounds)[::2]
        rows, lcp = rows[old], new
    return reach, end


def repeated_spans(docs: DataFrame, window: int, batch_bytes: int, turn_rows: int, frequent: Frequent) -> DataFrame:
    """Stretches (``k``, ``th``, ``start``, ``stop``) of repeated windows of keyed documents (``k``, ``th``, ``text``)."""

    def gathered(frames: Iterator[pa.RecordBatch], extra: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """Batches of documents: their other columns, their bytes one after the other, their sizes."""
        rows, blobs, held = [], [], 0
        for frame in frames:
            for at in range(0, frame.num_rows, 200):
                part = frame.slice(at, 200)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    rows.append((*row[:2], *row[3 : 3 + extra]))
                    blobs.append(row[2].encode())
                    held += len(blobs[-1])
                    if held >= batch_bytes:
                        yield rows, np.frombuffer(b"".join(blobs), np.uint8), np.array([len(x) for x in blobs], np.int64)
                        rows, blobs, held = [], [], 0
        if rows:
            yield rows, np.frombuffer(b"".join(blobs), np.uint8), np.array([len(x) for x in blobs], np.int64)

    def find(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct anchors of each document and how often it has them."""
        for rows, data, sizes in gathered(frames, 0):
            key, place, _, _ = anchors(data, sizes, window, frequent)
            doc = np.searchsorted(np.cumsum(sizes), place, "right")
            order = np.lexsort((key, doc))
            key, doc = key[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])) if len(key) else np.empty(0, np.int64)
            n = np.diff(np.concatenate([new, [len(key)]]))
            ids = np.array([r[:2] for r in rows], np.int64).reshape(-1, 2)
            for at in range(0, len(new), 50_000):
                part = new[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[part].view(np.int64)), pa.array(ids[doc[part], 0]), pa.array(ids[doc[part], 1]), pa.array(np.minimum(n[at : at + 50_000], 2))], names=["key", "k", "th", "n"])

    def surround(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The surroundings of repeated anchors; those equal within the batch are settled, one of each is sent on."""
        for rows, data, sizes in gathered(frames, 1):
            wanted = np.unique(np.concatenate([np.array(r[2], np.int64) for r in rows])).view(U)
            wanted.sort()
            key, place, lo, hi = anchors(data, sizes, window, frequent)
            at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
            keep = wanted[at] == key
            key, place, lo, hi = key[keep], place[keep], lo[keep], hi[keep]
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            doc = np.searchsorted(offsets[1:], place, "right")
            ids = np.array([r[:2] for r in rows], np.int64).reshape(-1, 2)
            stop = hi + window
            raw = data.tobytes()
            mark = np.fromiter((xxhash.xxh3_64_intdigest(raw[b:e]) for b, e in zip(lo.tolist(), stop.tolist())), U, len(lo))
            order = np.lexsort((place - lo, mark, key))
            same = (key[order][1:] == key[order][:-1]) & (mark[order][1:] == mark[order][:-1]) & ((place - lo)[order][1:] == (place - lo)[order][:-1])
            # An equal hash is not enough: the bytes decide.
            pairs = np.flatnonzero(same)
            x, y = order[pairs], order[pairs + 1]
            same[pairs] = [raw[a:b] == raw[c:d] for a, b, c, d in zip(lo[x].tolist(), stop[x].tolist(), lo[y].tolist(), stop[y].tolist())]
            first, again = order[np.concatenate([[True], ~same])] if len(order) else order, np.zeros(len(order), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            settled = np.flatnonzero(again)
            # What is settled, as one row for each run of overlapping stretches of a document.
            if len(settled):
                b, e, d = lo[settled], stop[settled], doc[settled]
                o = np.lexsort((b, d))
                b, e, d = b[o], np.maximum.accumulate(e[o]), d[o]
                new = np.concatenate([[True], (b[1:] > e[:-1]) | (d[1:] != d[:-1])])
                f = np.flatnonzero(new)
                l = np.concatenate([f[1:], [len(b)]]) - 1
                none = pa.array([b""] * len(f), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(ids[d[f], 1]), pa.array(ids[d[f], 0]), pa.array(ids[d[f], 1]), pa.array(b[f] - offsets[d[f]]), pa.array(np.zeros(len(f), np.int32)), pa.array((e[l] - b[f]).astype(np.int32)), none], names=["key", "k", "th", "pos", "before", "after", "context"])
            for at in range(0, len(first), 20_000):
                f = first[at : at + 20_000]
                n = stop[f] - lo[f]
                body = data[spread(lo[f], n)].tobytes()
                bounds = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                context = pa.Array.from_buffers(pa.binary(), len(f), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(body)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[f].view(np.int64)), pa.array(ids[doc[f], 0]), pa.array(ids[doc[f], 1]), pa.array(place[f] - offsets[doc[f]]), pa.array((place[f] - lo[f]).astype(np.int32)), pa.array((stop[f] - place[f]).astype(np.int32)), context],
                    names=["key", "k", "th", "pos", "before", "after", "context"],
                )

    def transform(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        """The transform of one turn of whole groups."""
        key, k, th, pos, before, after = (np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in parts]) for c in range(6))
        body = np.frombuffer(b"".join(b"".join(p.column(6).to_pylist()) for p in parts), np.uint8)
        before, after = before.astype(np.int64), after.astype(np.int64)
        blank = np.concatenate([np.asarray(pc.binary_length(p.column(6))) for p in parts]) == 0
        size = np.where(blank, 0, before + after)
        at = np.cumsum(size) - size + before
        n_left, n_right = np.where(blank, 0, before), np.where(blank, 0, after)
        at[blank] = 0
        most = max(1, int(n_left.max(initial=0)))
        padded = np.concatenate([np.zeros(most, np.uint8), body, np.zeros(window, np.uint8)])
        right = np.lib.stride_tricks.sliding_window_view(padded, window)[at + most]
        left = np.lib.stride_tricks.sliding_window_view(padded, most)[at][:, ::-1]
        right[np.arange(window) >= n_right[:, None]] = 0
        reach, end = matching_spans(key, right, n_right, left, n_left, window)
        start, stop = np.where(blank, pos, pos - reach), np.where(blank, pos + after, pos + end)
        some = stop > start
        some &= blank | (end > 0)
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (k, th, start, stop)], names=["k", "th", "start", "stop"])

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by key; turns end where a key does."""
        held, size, last = [], 0, None
        for frame in frames:
            for at in range(0, frame.num_rows, 5000):
                part = frame.slice(at, 5000)
                key = part.column(0).to_numpy()
                if size >= turn_rows:
                    other = np.flatnonzero(key != last)
                    if len(other):
                        held.append(part.slice(0, int(other[0])))
                        yield transform(held)
                        part, held, size = part.slice(int(other[0])), [], 0
                held.append(part)
                size += part.num_rows
                last = int(key[-1])
        if held:
            yield transform(held)

    found = docs.mapInArrow(find, "key long, k long, th long, n long")
    several = found.groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key")
    lists = found.select("key", "k", "th").join(several, "key").groupBy("k", "th").agg(F.collect_set("key").alias("keys")).withColumnsRenamed({"k": "lk", "th": "lth"})
    listed = docs.join(lists, (F.col("k") == F.col("lk")) & (F.col("th") == F.col("lth"))).select("k", "th", "text", "keys")
    # Which rows are settled depends on the batch, so a repeated task must see the same rows in the same order.
    around = listed.sortWithinPartitions("k", "th").mapInArrow(surround, CONTEXT)
    return around.repartition("key").sortWithinPartitions("key").mapInArrow(meet, SPAN)


def remove_substrings(docs: DataFrame, window: int = 200, batch_bytes: int = 2_000_000, turn_rows: int = 40_000, sample_rows: int = 2000, sample_chars: int = 20_000) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept`` (binary).

    Texts are UTF-8 bytes, a null one none. Every byte is removed that a string of ``window`` bytes covers which also
    starts anywhere else, in the same document or another; overlaps count, matches never cross documents, and strings
    are judged on the input. ``n_spans`` counts the maximal removed runs; what remains may cut characters, so it is
    binary.

    Documents are read in batches of ``batch_bytes`` (or one document); surroundings equal within a batch are settled
    there, so a passage in a third of all documents sends a row per batch. Grams that a sample of ``sample_rows`` documents
    has often are anchors only where there are no others, which keeps the different surroundings of such a passage
    apart; the sample decides nothing else. Transforms are built in turns of about ``turn_rows`` rows (or one anchor's). Repeated rows are documents of their own, and so repeat each other; rows are
    told apart by id and text, and a null id is allowed. No rows give no rows.
    """
    if window < 2 * GRAM:
        raise ValueError(f"window must be at least {2 * GRAM}")
    smallest = -(2**63)
    keyed = docs.select(F.coalesce("doc_id", F.lit(smallest)).alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select("k", F.xxhash64("text", "k").alias("th"), "text")
    placed = keyed.repartition("k", "th")
    frequent = frequent_grams(sampled_texts(docs, sample_rows, sample_chars))
    spans = repeated_spans(placed, window, batch_bytes, turn_rows, frequent).groupBy("k", "th").agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("s"))
    spans = spans.select(F.col("k").alias("sk"), F.col("th").alias("sth"), F.col("s.start").alias("starts"), F.col("s.stop").alias("stops"))
    met = placed.join(spans, (F.col("k") == F.col("sk")) & (F.col("th") == F.col("sth")), "left").select("k", "text", "starts", "stops")

    def apply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 500):
                rows = frame.slice(at, 500)
                out = []
                for text, starts, stops in zip(*(rows.column(c).to_pylist() for c in (1, 2, 3))):
                    data = text.encode()
                    kept, end, n = [], 0, 0
                    for s, e in zip(starts or (), stops or ()):
                        n += s > end or not n
                        if s > end:
                            kept.append(data[end:s])
                        end = max(end, e)
                    kept.append(data[end:])
                    left = b"".join(kept)
                    out.append((len(data), len(data) - len(left), n, left))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()])]
                yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=["k", "n_bytes", "n_removed", "n_spans", "kept"])

    done = met.mapInArrow(apply, "k long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done.select(F.nullif(F.col("k"), F.lit(smallest)).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings of all documents, with a digest of what is left."""
    done = remove_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
