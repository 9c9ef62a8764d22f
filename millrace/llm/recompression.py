"""Substring dedup by recompression: rounds name runs and pairs of tokens, and shared symbols reveal long repeats.

Each round replaces runs of a symbol, then pairs of a left-class and a right-class symbol, by new symbols. Names are
hashes of what they stand for, so every document and task names alike. A symbol keeps the stretch of words that its
making depended on; two equal windows contain the same symbols of such stretches inside them. The least of the highest
level stands for the window: names are counted over all documents, windows are dropped whose symbol is in one document
alone, and the others meet under it and are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored
from millrace.llm.frequent import LAST, Frequent, often, sampled_texts
from millrace.llm.neardup import WordHashes, mixed

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = U(pow(BASE, -1, 2**64))
BLOCK = 1 << 15


def rolled(tokens: np.ndarray, window: int) -> np.ndarray:
    """The polynomial hash modulo 2^64 of the ``window`` tokens from each position on; shorter at the end: none."""
    n = len(tokens) - window + 1
    if n <= 0:
        return np.empty(0, U)
    out = np.empty(n, U)
    up = np.cumprod(np.full(BLOCK + window, U(BASE)))
    down = np.cumprod(np.full(BLOCK, INVERSE))
    for at in range(0, n, BLOCK):
        part = tokens[at : at + BLOCK + window - 1]
        total = np.concatenate([np.zeros(1, U), np.cumsum(part * up[: len(part)])])
        k = len(part) - window + 1
        out[at : at + k] = (total[window : window + k] - total[:k]) * down[:k]
    return mixed(out)


def levels(words: np.ndarray, doc: np.ndarray, rounds: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Symbols, and the first and last word each depended on, of the words themselves and after each round.

    doc: the number of each word's document; symbols never span documents, and at a document's edge a symbol depends on
    a word outside, so it serves no window.
    """
    sym, lo, hi = words.copy(), np.arange(len(words)), np.arange(len(words))
    yield sym, lo, hi
    own = doc
    for level in range(rounds):
        edge = np.concatenate([[True], own[1:] != own[:-1]]) if len(own) else np.empty(0, bool)
        # Runs: equal neighbours become one symbol; every symbol has looked at both neighbours.
        begins = np.flatnonzero(edge | np.concatenate([[True], sym[1:] != sym[:-1]])) if len(sym) else np.empty(0, np.int64)
        if not len(begins):
            return
        ends = np.concatenate([begins[1:], [len(sym)]])
        n = ends - begins
        first, last = edge[begins], np.concatenate([edge, [True]])[ends]
        lo = np.where(first, lo[begins] - 1, lo[np.maximum(begins - 1, 0)])
        hi = np.where(last, hi[ends - 1] + 1, hi[np.minimum(ends, len(hi) - 1)])
        sym, own, edge = np.where(n > 1, mixed(sym[begins] * U(3) + n.astype(U) + U(level)), sym[begins]), own[begins], first
        # Pairs: a symbol of the left class and its right-class neighbour; either has looked at the other side.
        left = (mixed(sym + U(level)) & U(1)).astype(bool)
        last = np.concatenate([edge[1:], [True]])
        heads = left & ~last & ~np.concatenate([left[1:], [True]])
        tails = np.concatenate([[False], heads[:-1]])
        look_lo = np.where(left, lo, np.where(edge, lo - 1, np.concatenate([lo[:1], lo[:-1]])))
        look_hi = np.where(left, np.where(last, hi + 1, np.concatenate([hi[1:], hi[-1:]])), hi)
        kept = np.flatnonzero(~tails)
        mate = np.minimum(kept + 1, len(sym) - 1)
        pair = heads[kept]
        lo = np.where(pair, np.minimum(look_lo[kept], look_lo[mate]), look_lo[kept])
        hi = np.where(pair, np.maximum(look_hi[kept], look_hi[mate]), look_hi[kept])
        sym, own = np.where(pair, mixed(mixed(sym[kept]) * U(5) + sym[mate]), sym[kept]), own[kept]
        yield sym, np.maximum.accumulate(lo), hi


def frequent_symbols(texts: list[str], rounds: int) -> Frequent:
    """The symbols, of any level, that a sample of texts has often."""
    hashes = WordHashes()
    split = [t.encode().split() for t in texts]
    words = np.fromiter((hashes[w] for t in split for w in t), U, sum(map(len, split)))
    doc = np.repeat(np.arange(len(split)), [len(t) for t in split])
    found = [sym for sym, _, _ in levels(words, doc, rounds)]
    # A symbol that a level leaves as it was counts once.
    values, n = zip(*(np.unique(f, return_counts=True) for f in found))
    values, n = np.concatenate(values), np.concatenate(n)
    return Frequent(np.unique(values[n >= often(len(texts))]), 1)


def keys(words: np.ndarray, doc: np.ndarray, starts: np.ndarray, window: int, rounds: int, frequent: Frequent) -> np.ndarray:
    """For each window start, a symbol whose making lies inside the window: the least of the highest level that has one.

    Levels with only frequent symbols there are passed over, unless all are such.
    """
    out = np.zeros(len(starts), U)
    open_, blank = np.ones(len(starts), bool), np.ones(len(starts), bool)
    for sym, lo, hi in reversed(list(levels(words, doc, rounds))):
        if not open_.any():
            break
        hi = np.minimum.accumulate(hi[::-1])[::-1]
        at = starts[open_]
        a, b = np.searchsorted(lo, at, "left"), np.searchsorted(hi, at + window - 1, "right")
        some = b > a
        a, b = a[some], b[some]
        least, table, width = np.empty(len(a), U), frequent.last(sym), 1
        span = b - a
        while len(a):
            # Range minima by doubling: a range of width to 2 * width - 1 symbols is the least of two tables' entries.
            now = (span >= width) & (span < 2 * width)
            least[now] = np.minimum(table[a[now]], table[b[now] - width])
            if width * 2 > span.max():
                break
            table = np.minimum(table[:-width], table[width:]) if len(table) > width else table
            width *= 2
        places = np.flatnonzero(open_)[some]
        better = blank[places] | (least < LAST)
        out[places[better]] = least[better]
        blank[places] = False
        open_[places[least < LAST]] = False
    return out


#: Kinds of rows that are sent: windows settled in their batch, stretches under a symbol, single windows under a common one.
SETTLED, STRETCH, SINGLE = 0, 1, 2


class Batch:
    """The words of some documents, rows of (id, words, more ...), and the starts of their windows."""

    def __init__(self, rows: list[tuple], window: int, hashes: WordHashes):
        self.rows, self.window = rows, window
        sizes = np.array([len(r[1]) for r in rows], np.int64)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.words = np.fromiter(map(hashes.__getitem__, (w for r in rows for w in r[1])), U, int(self.offsets[-1]))
        self.doc = np.repeat(np.arange(len(rows)), sizes)
        full = np.maximum(sizes - window + 1, 0)
        self.owner = np.repeat(np.arange(len(rows)), full)
        self.starts = np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full) + self.offsets[self.owner]

    def keys(self, rounds: int, frequent: Frequent) -> np.ndarray:
        return keys(self.words, self.doc, self.starts, self.window, rounds, frequent) if len(self.starts) else np.empty(0, U)


def repeats(key: np.ndarray, hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each window, by its symbol and its hash, also has a smaller id."""
    order = np.lexsort((ids, hashes, key))
    k, h, d = key[order], hashes[order], ids[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.empty(0, bool)
    out = np.empty(len(h), bool)
    out[order] = d > d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(h) else False
    return out


def stretches(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true flags that do not cross a break."""
    if not len(flags):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    begin = flags & np.concatenate([[True], ~flags[:-1] | breaks[1:]])
    end = flags & np.concatenate([~flags[1:] | breaks[1:], [True]])
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def meeting(kind: int, begin: np.ndarray, end: np.ndarray, key: np.ndarray, hashes: np.ndarray, ids: np.ndarray, local: np.ndarray) -> pa.RecordBatch:
    """Rows of one kind for stretches of windows: settled ones without hashes, single ones under their hash with their symbol's name."""
    n = end - begin
    where = np.repeat(begin - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else begin
    data = b"" if kind == SETTLED else (key if kind == SINGLE else hashes)[where].tobytes()
    ends = np.zeros(len(n) + 1, np.int32) if kind == SETTLED else np.concatenate([[0], np.cumsum(8 * n)]).astype(np.int32)
    binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)])
    # Settled stretches meet nothing and spread over the tasks.
    under = (mixed(ids.view(U)) if kind == SETTLED else hashes if kind == SINGLE else key)[begin].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), kind, np.int32)), pa.array(under), pa.array(ids[begin]), pa.array(local[begin]), pa.array(n), binary], names=["kind", "key", "doc_id", "start", "length", "hashes"])


def compare(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """The stretches of repeated windows among those that meet in one turn, whole keys each."""
    key, ids, start, n = (np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts]) for k in range(1, 5))
    hashes = np.frombuffer(b"".join(b"".join(p.column(5).to_pylist()) for p in parts), U)
    row = np.repeat(np.arange(len(n)), n)
    b, e = stretches(repeats(key[row], hashes, ids[row]), np.concatenate([[True], row[1:] != row[:-1]]))
    first = np.cumsum(n) - n
    return pa.RecordBatch.from_arrays([pa.array(ids[row[b]]), pa.array(start[row[b]] + b - first[row[b]]), pa.array(e - b)], names=["doc_id", "start", "length"])


def later(singles: pa.RecordBatch, before: tuple | None) -> tuple[pa.RecordBatch, tuple]:
    """Of single windows, sorted by hash, symbol and id, those after an equal one of a smaller id, and the last one's first.

    before: hash, symbol and least id of what the rows before these ended in.
    """
    key, ids = singles.column(1).to_numpy(), singles.column(2).to_numpy()
    names = np.frombuffer(b"".join(singles.column(5).to_pylist()), np.int64)
    new = np.concatenate([[before is None or (key[0], names[0]) != before[:2]], (key[1:] != key[:-1]) | (names[1:] != names[:-1])])
    heads = np.where(new, np.arange(len(key)), -1)
    heads = np.maximum.accumulate(heads)
    least = np.where(heads < 0, before[2] if before else 0, ids[np.maximum(heads, 0)])
    out = pa.RecordBatch.from_arrays([singles.column(c) for c in (2, 3, 4)], names=["doc_id", "start", "length"]).filter(pa.array(ids > least))
    return out, (key[-1], names[-1], int(least[-1]))


def placed_by_id(docs: DataFrame) -> DataFrame:
    """``docs`` as ``k`` (the id, a number for null ones), ``doc_id`` and ``text`` (a null one empty), partitioned by ``k``."""
    k = F.coalesce("doc_id", F.lit(-(2**63)))
    return docs.select(k.alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition("k")


def repeated_words(docs: DataFrame, window: int = 50, rounds: int = 4, batch_words: int = 500_000, sample_rows: int = 2000, sample_chars: int = 20_000, hot_docs: int = 20_000) -> DataFrame:
    """The windows of ``docs`` (``doc_id``, ``text``) that also start in a document of a smaller id: ``doc_id``, ``start``, ``length``.

    A row is a stretch of consecutive window starts. Words are what white space separates in the whole text; a window is
    ``window`` consecutive words of one document.

    First every document's symbols of up to ``rounds`` rounds that stand for a window are counted by name over all
    documents, and windows are dropped whose symbol is in one document alone. What is left meets under its symbol, in
    turns of bounded memory: two windows are the same if symbol and window hash are, 128 bits in all. Windows whose
    symbol more than ``hot_docs`` documents have do not meet under it but each under its own hash, in order of the id,
    so that only the one before is remembered and a common symbol's rows spread over tasks.

    Windows that already repeat within a batch of about ``batch_words`` words (or one document) are settled there, and
    only one document's copy of each is sent on, so a passage in a third of all documents sends a row per batch. Symbols
    that a sample of ``sample_rows`` documents has often stand for windows only where there are no others, which keeps
    the different surroundings of such a passage apart; the sample decides nothing else. Rows with a null id or text are
    left out; rows that share an id are one document's, and do not repeat each other.
    """
    if rounds < 1:
        raise ValueError("at least one round must name symbols")
    frequent = frequent_symbols(sampled_texts(docs, sample_rows, sample_chars), rounds)
    rows = docs.select("doc_id", "text").where("doc_id is not null and text is not null")

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[Batch]:
        hashes, held, size = WordHashes(), [], 0
        for frame in frames:
            for at in range(0, frame.num_rows, 200):
                for doc, text, *more in zip(*(c.to_pylist() for c in frame.slice(at, 200).columns)):
                    if doc is None:
                        continue
                    held.append((doc, text.encode().split(), *more))
                    size += len(held[-1][1])
                    if size >= batch_words:
                        yield Batch(held, window, hashes)
                        held, size = [], 0
        if held:
            yield Batch(held, window, hashes)

    def name(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct symbols that stand for windows of each document."""
        for batch in batches(frames):
            key, owner = batch.keys(rounds, frequent), batch.owner
            order = np.lexsort((key, owner))
            key, owner = key[order], owner[order]
            new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])])) if len(key) else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key[new].view(np.int64)), pa.array(batch.ids[owner[new]])], names=["name", "doc_id"])

    def send(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            shared, hot = (np.unique(np.concatenate([np.array(r[c], np.int64) for r in batch.rows])).view(U) for c in (2, 3))
            key = batch.keys(rounds, frequent)
            alive = np.flatnonzero(np.isin(key, shared))
            key, owner, starts = key[alive], batch.owner[alive], batch.starts[alive]
            hashes, ids, local = rolled(batch.words, window)[starts], batch.ids[owner], starts - batch.offsets[owner]
            done, common = repeats(key, hashes, ids), np.isin(key, hot)
            apart = np.concatenate([[True], (owner[1:] != owner[:-1]) | (starts[1:] != starts[:-1] + 1)]) if len(key) else np.empty(0, bool)
            other = apart | np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else apart
            for kind, flags, breaks in ((SETTLED, done, apart), (STRETCH, ~done & ~common, other), (SINGLE, ~done & common, np.ones(len(key), bool))):
                b, e = stretches(flags, breaks)
                for at in range(0, len(b), 20_000):
                    yield meeting(kind, b[at : at + 20_000], e[at : at + 20_000], key, hashes, ids, local)

    def meet(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Settled stretches pass; others meet those of their key, sorted by it and the id."""
        held, size, last, first = [], 0, None, None
        for frame in frames:
            kinds = frame.column(0).to_numpy()
            bounds = [0, *np.searchsorted(kinds, [STRETCH, SINGLE]).tolist(), frame.num_rows]
            settled, frame_, singles = (frame.slice(x, y - x) for x, y in zip(bounds, bounds[1:]))
            if settled.num_rows:
                yield settled.select(["doc_id", "start", "length"])
            if frame_.num_rows:
                key = frame_.column(1).to_numpy()
                if size > 2_000_000:
                    beyond = np.flatnonzero(key != last)
                    if len(beyond):
                        held.append(frame_.slice(0, int(beyond[0])))
                        yield compare(held)
                        frame_, held, size = frame_.slice(int(beyond[0])), [], 0
                held.append(frame_)
                size += int(np.sum(frame_.column(4).to_numpy()))
                last = int(key[-1])
            if singles.num_rows:
                found, first = later(singles, first)
                yield found
        if held:
            yield compare(held)

    named, _ = stored(rows.mapInArrow(name, "name long, doc_id long"))
    counts = named.groupBy("name").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n"))
    counts = counts.where("least < most").select("name", (F.col("n") > hot_docs).alias("hot"))
    lists = named.join(counts, "name").groupBy(F.col("doc_id").alias("in_doc")).agg(F.collect_set("name").alias("names"), F.collect_set(F.when(F.col("hot"), F.col("name"))).alias("hot"))
    # Which windows are settled depends on the batch, so a repeated task must see the same rows in the same order.
    met = placed_by_id(docs).join(lists, F.col("k") == F.col("in_doc")).select("doc_id", "text", "names", "hot").sortWithinPartitions("doc_id", F.xxhash64("text"))
    sent = met.mapInArrow(send, "kind int, key long, doc_id long, start long, length long, hashes binary")
    order = ("kind", "key", "hashes", "doc_id", "start")
    return sent.repartition("key").sortWithinPartitions(*order).mapInArrow(meet, "doc_id long, start long, length long")


def remove_repeats(docs: DataFrame, window: int = 50, rounds: int = 4) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``): ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (words joined by a space).

    Every word is removed that a window covers which also starts in a document of a smaller id (see ``repeated_words``);
    windows are judged on the input. A null text has no words and is kept as an empty one; rows with a null id lose
    nothing and take nothing from others; repeated rows get equal results; no rows give no rows.
    """
    found = repeated_words(docs, window, rounds).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("spans"))
    spans = found.select(F.col("doc_id").alias("span_id"), F.col("spans.start").alias("starts"), F.col("spans.length").alias("lengths"))
    both = placed_by_id(docs).join(spans, F.col("k") == F.col("span_id"), "left").select("doc_id", "text", "starts", "lengths")

    def apply(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, 500):
                rows = frame.slice(at, 500)
                n, gone, kept = [], [], []
                for doc, text, starts, lengths in zip(*(c.to_pylist() for c in rows.columns)):
                    words = text.encode().split()
                    n.append(len(words))
                    if starts and doc is not None:
                        left, end = [], 0
                        for s, k in zip(starts, lengths):
                            left += words[end:s] if s > end else []
                            end = max(end, s + k + window - 1)
                        words = left + words[end:]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return both.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def op4_recompression(spark, sf_dir: str) -> DataFrame:
    """Repeated 50-word windows of all documents, with a digest of what is left."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
